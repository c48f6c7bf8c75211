"""The rules spelled out on small Python objects, for comparison only."""

from __future__ import annotations

import random
from fractions import Fraction
from math import comb


def all_drawn(deck, drawn, wanted):
    if drawn == 0:
        return Fraction(1)
    if wanted < drawn or wanted > deck:
        return Fraction(0)
    return Fraction(comb(wanted, drawn), comb(deck, drawn))


def pvalue(counts, f, b):
    """Sum over explicit symbol splits."""
    total = sum(counts)
    places = range(len(counts))

    def split(fg, bg):
        return all_drawn(total, f, sum(counts[i] for i in fg)) * all_drawn(
            total - f, b, sum(counts[i] for i in bg)
        )

    p = Fraction(0)
    for x in places:
        rest = [y for y in places if y != x]
        p += split([x], rest)
        if f != b:
            p += split(rest, [x])
    if f != b and len(counts) > 2:
        for x in places:
            for y in places:
                if x != y:
                    p -= split([x], [y])
    return float(p)


def profile(column):
    solid = [s for s in column.values() if s != "-"]
    counts = {s: solid.count(s) for s in set(solid)}
    minority = len(solid) - max(counts.values(), default=0)
    return (len(column) - len(solid)) / len(column), minority, counts


def evaluate(column, fg, bg):
    """Counts, lists, tag and pattern of one column for one trait; None without evidence."""
    found = {g: sorted(s for s in members if column.get(s, "-") != "-") for g, members in ((1, fg), (0, bg))}
    if not found[1] or not found[0]:
        return None
    symbols = {g: sorted({column[s] for s in found[g]}) for g in (1, 0)}
    single = (len(symbols[1]) == 1, len(symbols[0]) == 1)
    pattern = {(True, True): 1, (True, False): 2, (False, True): 3, (False, False): 4}[single]
    gaps = [sum(column.get(s) == "-" for s in members) for members in (fg, bg)]
    missing = [sorted(s for s in members if s not in column) for members in (fg, bg)]
    return {
        "hit": not set(symbols[1]) & set(symbols[0]),
        "pattern": pattern,
        "tag": "".join(symbols[1]) + "/" + "".join(symbols[0]),
        "found": found,
        "gaps": gaps,
        "missing": missing,
    }


def accepted(e, bounds):
    def ok(value, bound):
        return bound is None or value <= bound

    mfg, mbg = (len(m) for m in e["missing"])
    gfg, gbg = e["gaps"]
    bg_gaps, bg_miss = bounds.max_bg_gaps, bounds.max_bg_miss
    if bounds.bg_bound == "fg":
        bg_gaps = None if bg_gaps is None else bounds.max_fg_gaps
        bg_miss = None if bg_miss is None else bounds.max_fg_miss
    return (
        ok(gfg, bounds.max_fg_gaps)
        and ok(gbg, bg_gaps)
        and ok(gfg + gbg, bounds.max_gaps)
        and ok(mfg, bounds.max_fg_miss)
        and ok(mbg, bg_miss)
        and ok(mfg + mbg, bounds.max_miss)
    )


def columns_of(records):
    """{(gene, pos): {species: symbol}} with short sequences padded by gaps."""
    genes = {}
    for gene, species, seq in records:
        genes.setdefault(gene, {})[species] = seq
    out = {}
    for gene, seqs in genes.items():
        for pos in range(max(map(len, seqs.values()))):
            out[gene, pos] = {s: (q[pos] if pos < len(q) else "-") for s, q in seqs.items()}
    return out


def discovery(records, groups, bounds, patterns, ratio):
    rows = set()
    for (gene, pos), column in columns_of(records).items():
        gap_ratio, minority, counts = profile(column)
        for trait, (fg, bg) in groups.items():
            if gap_ratio > ratio or minority < bounds.threshold(len(fg), len(bg)):
                continue
            e = evaluate(column, fg, bg)
            if e is None or not e["hit"] or e["pattern"] not in patterns or not accepted(e, bounds):
                continue
            f, b = len(e["found"][1]), len(e["found"][0])
            rows.add(
                (
                    gene, trait, pos, e["tag"], round(pvalue(list(counts.values()), f, b), 9),
                    f"pattern{e['pattern']}", f, b, *e["gaps"], *(len(m) for m in e["missing"]),
                    ",".join(e["found"][1]), ",".join(e["found"][0]),
                    ",".join(sorted(e["missing"][0] + e["missing"][1])) or "-",
                )
            )
    return rows


def bootstrap(records, groups, n_cycles, threshold, bounds, patterns, ratio):
    rows = set()
    for (gene, pos), column in columns_of(records).items():
        gap_ratio, minority, _ = profile(column)
        if gap_ratio > ratio or minority < threshold:
            continue
        hits = []
        for trait, (fg, bg) in groups.items():
            e = evaluate(column, fg, bg)
            if e and e["hit"] and e["pattern"] in patterns and accepted(e, bounds):
                hits.append(trait)
        rows.add((f"{gene}@{pos}", len(hits), n_cycles, round(len(hits) / n_cycles, 9), ",".join(sorted(hits)), "cfg"))
    return rows


def random_case(seed, n_genes=4, n_species=14, width=25, n_traits=70, ragged=False):
    rng = random.Random(seed)
    names = [f"s{i:02d}" for i in range(n_species)]
    records = []
    for g in range(n_genes):
        for s in names:
            if rng.random() < 0.15:
                continue
            length = rng.randint(1, width) if ragged else width
            seq = "".join(rng.choice("AAAAABBBCDE-") for _ in range(length))
            records.append((f"g{g}", s, seq))
    groups = {}
    for t in range(n_traits):
        picked = rng.sample(names, rng.randint(2, 7))
        cut = rng.randint(1, len(picked) - 1)
        groups[f"t{t:03d}"] = (picked[:cut], picked[cut:])
    return records, groups


def group_rows(groups):
    return [(t, s, g) for t, sides in groups.items() for g, side in zip((1, 0), sides) for s in side]
