"""Token alignment, fingerprints and conversation repair against brute force, and on odd tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from tokenizers import Tokenizer

from cladewise.llm import alignment, repair, simhash
from cladewise.llm.queries import QUERIES

PATHS = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "alpha beta gamma delta " * 3000
DOCS = "doc_id long, text string, fp string, row string, pair string, docs string, cell string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and long texts, repeated rows and ids, columns with clashing names."""
    rows = [
        (None, None, None, None, None, None, None),
        (1, None, "x", "y", "z", "1", "c"),
        (2, "", "x", "y", "z", "1", "c"),
        (3, " \n\t ", None, "a", None, None, None),
        (4, LONG, "x", "y", "z", "1", "c"),
        (4, LONG, "x", "y", "z", "1", "c"),
        (4, "other words under the same id", "x", "y", "z", "1", "c"),
        (None, "a text without an id that has some words", "x", "y", "z", "1", "c"),
        (5, "中文 and 😀 <|endoftext|> </s> don't  stop ", "x", "y", "z", "1", "c"),
        (6, "a literal ▁ mark", "x", "y", "z", "1", "c"),
    ]
    return spark.createDataFrame(rows, DOCS)


# --- 11 ----------------------------------------------------------------------


@pytest.fixture(scope="module")
def sides():
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [x for x in range(256) if x not in plain]
    back = {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(rest)}

    def tokens(text):
        if not text:
            return [], []
        ids_a = a.encode(" " + text, add_special_tokens=False).ids
        found_a = [(i, bytes(back[c] for c in a.id_to_token(i))) for i in ids_a]
        found_b = []
        for i in b.encode(text):
            p = b.id_to_piece(i)
            found_b.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
        want = (" " + text).encode()
        whole = (b"".join(t for _, t in f) == want for f in (found_a, found_b))
        return (found_a, found_b) if all(whole) else ([], [])

    return tokens


def spans(tokens):
    at = 0
    for i, t in tokens:
        yield i, at, at + len(t)
        at += len(t)


def brute_alignment(texts, tokens):
    """By comparing byte ranges: a row of results for each text."""
    rows, in_docs = [], Counter()
    for text in texts:
        a, b = (list(spans(x)) for x in tokens(text))
        links = [(i, j) for i, s, e in a for j, u, v in b if s < v and u < e]
        common = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, low = [], 0
        for high in common:
            sides = [",".join(str(i) for i, s, e in x if low <= s and e <= high) for x in (a, b)]
            groups.append("|".join(sides))
            low = high
        in_docs.update(set(links))
        rows.append((len(a), len(b), groups, links))
    most = defaultdict(int)
    for (i, _), n in in_docs.items():
        most[i] = max(most[i], n)
    return [
        (
            n_a,
            n_b,
            len(groups),
            len(links),
            sum(in_docs[x] == most[x[0]] for x in links),
            sum(in_docs[x] for x in links),
            hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "",
        )
        for n_a, n_b, groups, links in rows
    ]


FIELDS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def result(rows):
    return Counter(tuple(r[c] for c in ("doc_id", *FIELDS)) for r in rows)


@pytest.mark.parametrize("broadcast", [alignment.BROADCAST_PAIRS, 10])
def test_alignment_against_byte_ranges(spark, sf_dir, sides, broadcast, monkeypatch):
    if broadcast == 10:
        monkeypatch.setattr(alignment, "HOT_SHARE", 20)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = sorted(docs.collect(), key=lambda r: len(r.text or ""))[:120]
    frame = spark.createDataFrame([(r.doc_id, r.text) for r in held], "doc_id long, text string").repartition(3)
    want = brute_alignment([r.text for r in held], sides)
    got = alignment.link_statistics(frame, *PATHS, broadcast=broadcast)
    assert result(got.collect()) == Counter((r.doc_id, *w) for r, w in zip(held, want))


def test_alignment_query_counts(spark, sf_dir, sides):
    """Whole texts of the whole table: token counts by the libraries, links and groups by sets of ends."""
    got = {r.doc_id: r for r in QUERIES["op11_token_alignment"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert got.keys() == {r.doc_id for r in docs}
    for r in docs:
        a, b = sides(r.text)
        ends_a, ends_b = ({e for *_, e in spans(x)} for x in (a, b))
        want = (len(a), len(b), len(ends_a & ends_b), len(ends_a | ends_b))
        assert tuple(got[r.doc_id][c] for c in FIELDS[:4]) == want


def test_alignment_odd_and_empty(odd, sides):
    held = odd.collect()
    short = [r for r in held if r.text != LONG]
    got = alignment.link_statistics(odd.where("text is null or length(text) < 1000"), *PATHS).collect()
    assert result(got) == Counter((r.doc_id, *w) for r, w in zip(short, brute_alignment([r.text for r in short], sides)))
    assert alignment.link_statistics(odd, *PATHS).count() == len(held)
    for r in alignment.align(odd, *PATHS).collect():
        assert len(r.group_a) == len(r.group_b) and (not r.a_ids or r.group_a[-1] == len(r.a_ids))
    assert alignment.link_statistics(odd.limit(0), *PATHS).count() == 0
    assert alignment.align(odd.limit(0), *PATHS).count() == 0


def test_merge_path_pieces_are_equal_and_independent():
    rng = np.random.default_rng(1)
    for _ in range(200):
        top = int(rng.integers(1, 400))
        a, b = (np.append(np.sort(rng.choice(top, rng.integers(0, top), replace=False)) + 1, top + 1) for _ in range(2))
        whole = alignment.merged(a, b, len(a) + len(b))
        ends = sorted({*a.tolist(), *b.tolist()})
        assert whole.link_a.tolist() == np.searchsorted(a, ends).tolist()
        assert whole.link_b.tolist() == np.searchsorted(b, ends).tolist()
        for piece in (1, 2, 7, 64):
            path = alignment.crossings(a, b, piece)
            assert (np.diff(path.sum(axis=1))[:-1] == piece).all()
            for x, y in zip(alignment.merged(a, b, piece), whole):
                assert x.tolist() == y.tolist()


# --- 12 ----------------------------------------------------------------------


def brute_fingerprint(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    n = min(4, len(words))
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    """For each fingerprint the place of the first one that it is connected with."""
    label = list(range(len(fps)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                x, y = sorted((root(i), root(j)))
                label[y] = x
    return [root(i) for i in range(len(fps))]


def parts(labels):
    out = defaultdict(set)
    for x, label in labels:
        out[label].add(x)
    return sorted(map(sorted, out.values()))


def test_simhash_query(spark, sf_dir):
    docs = sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    fps = [brute_fingerprint(r.text) for r in docs]
    want = {r.doc_id: (f"{f:016x}", docs[k].doc_id) for r, f, k in zip(docs, fps, brute_components(fps))}
    got = QUERIES["op12_simhash_neardup"](spark, sf_dir).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == want


@pytest.mark.parametrize("block", [simhash.BLOCK, 64])
def test_simhash_links_in_hot_cells(spark, block):
    """Balls of fingerprints around few centres, which share most of their cells, and lone ones."""
    random.seed(3)
    fps = {random.getrandbits(64) for _ in range(200)}
    for _ in range(4):
        centre = random.getrandbits(64)
        for _ in range(150):
            fps.add(centre ^ sum({1 << random.randrange(64) for _ in range(random.randint(0, 9))}))
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = simhash.linked_nodes(spark.createDataFrame([(f,) for f in signed], "fp long"), block)
    labels = {r.node: r.label for r in found.collect()}
    assert parts(zip(signed, brute_components(fps))) == parts((f, labels.get(f, f)) for f in signed)


def test_simhash_distance_is_bounded_by_counts():
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 1 << 63, (2, 5000), dtype=np.uint64)
    manhattan = np.bitwise_count(simhash._unary(x) ^ simhash._unary(y))
    count = lambda v: np.stack([np.bitwise_count(v >> np.uint64(2 * k) & np.uint64(3)) for k in range(32)]).astype(int)
    assert (manhattan == abs(count(x) - count(y)).sum(axis=0)).all()
    assert (manhattan <= np.bitwise_count(x ^ y)).all()


def test_simhash_odd_and_empty(odd):
    got = simhash.near_duplicates(odd).collect()
    held = odd.collect()
    assert Counter((r.doc_id, r.fingerprint) for r in got) == Counter(
        (r.doc_id, f"{brute_fingerprint(r.text):016x}") for r in held
    )
    # Texts without words are one component, and the row without an id is named by the others.
    assert {r.component_id for r in got if r.fingerprint == "0" * 16} == {1}
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


# --- 13 ----------------------------------------------------------------------

NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}


def brute_repair(rows):
    """Least (cost, audit) over all paths through the grammar, a row at a time."""

    def with_inserts(states):
        todo = list(states)
        while todo:
            q = todo.pop()
            cost, audit = states[q]
            for x, to in NEXT[q].items():
                found = (cost + 5, audit + "I")
                if x != "s" and (to not in states or found < states[to]):
                    states[to] = found
                    todo.append(to)
        return states

    states = with_inserts({0: (0, "")})
    for initial, fault in rows:
        new = {}
        for q, (cost, audit) in states.items():
            moves = [(q, cost + 2, "D")]
            if fault not in "BD":
                more = 5 if fault == "T" else 0
                for x, to in NEXT[q].items():
                    if x == initial:
                        moves.append((to, cost + more, "K"))
                    elif x != "s":
                        moves.append((to, cost + more + 1, "R"))
            for to, total, letter in moves:
                new[to] = min(new.get(to, (1 << 60, "")), (total, audit + letter))
        states = with_inserts(new)
    return min(states[q] for q in (0, 3) if q in states)


def brute_report(rows):
    """Everything but the conversation's id, of rows (turn, role, text) in order."""
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    faults, seen = [], set()
    for _, role, text in rows:
        said = WORD.findall(text)
        faults.append("B" if not said else "D" if (role, text) in seen else "-" if said[-1][-1] in ".!?" else "T")
        seen.add((role, text))
    initials = [role[:1] if role[:1] in tuple("sua") else "o" for _, role, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, audit = brute_repair(list(zip(initials, faults)))
    out, at, todo = [], 0, list(zip(rows, initials))
    for letter in audit:
        due = "user" if at == 0 else "assistant"
        if letter == "I":
            out.append(f"{due}:")
        else:
            (_, role, text), initial = todo.pop(0)
            if letter == "D":
                continue
            out.append(f"{role if letter == 'K' else due}:{text}")
            if letter == "K" and initial == "s":
                continue
        at = 1 - at
    digest = hashlib.sha256("\n".join(out).encode()).hexdigest()
    return gaps, *(faults.count(k) for k in "BDT"), illegal, cost, audit, digest


REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damaged(turns):
    out = defaultdict(list)
    for conv_id, turn, role, text in turns:
        out[conv_id] += []
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        row = (turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
        out[conv_id] += [row] * (2 if kind == 3 else 1)
    for rows in out.values():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    return out


def check_repair(spark, turns):
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = repair.audited(frame, repair.damage(frame)).collect()
    want = {k: brute_report(rows) for k, rows in damaged(turns).items()}
    assert len(got) == len(want)
    for r in got:
        assert tuple(r[c] for c in REPORT) == want[r.conv_id], r


def test_repair_query(spark, sf_dir):
    turns = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r[c] for c in REPORT) for r in QUERIES["op13_conversation_repair"](spark, sf_dir).collect()}
    assert got == {k: brute_report(rows) for k, rows in damaged(turns).items()}


def test_repair_long_and_odd_conversations(spark):
    """Conversations over many tasks, with nulls, ties, repeated rows and strange roles."""
    random.seed(4)
    said = ["Yes.", "No!", "Why", "", " \n", "Well?  ", None, "a. b", "é😀."]
    roles = ["user", "assistant", "assistant", "user", "system", "tool", "", None, "sys", "Ärger"]
    turns = []
    for conv, n in ((1, 700), (2, 3), (3, 90), (None, 40), (4, 1), (5, 0), (6, 33)):
        for t in range(n):
            turns.append((conv, random.choice([t, t, t, None, 3]), random.choice(roles), random.choice(said)))
            if random.random() < 0.1:
                turns.append(turns[-1])
    check_repair(spark, turns)
    check_repair(spark, [(7, t, "user", None) for t in range(30)] + [(8, 0, "user", "Is it?"), (8, 1, "assistant", "It is.")])


def test_repair_rows_and_empty(spark):
    frame = spark.createDataFrame(
        [(1, 0, "user", "Hi.", "x"), (1, 1, "user", "Hello.", "y")], "conv_id long, turn long, role string, text string, cost string"
    )
    faults = repair.judged(frame)
    rows = repair.repaired(faults, repair.reports(faults)).collect()
    assert [(r.edit, r.role, r.text) for r in rows] == [("K", "user", "Hi."), ("R", "assistant", "Hello.")]
    empty = frame.limit(0)
    assert repair.audited(empty, repair.damage(empty)).count() == 0


def test_repair_pieces_against_paths():
    random.seed(5)
    for it in range(1500):
        n = random.choice([30, 70, 130]) if it % 50 == 0 else random.randint(1, 12)
        rows = [(random.choice("suaaauo"), random.choice("--------BDTT")) for _ in range(n)]
        found = repair.run_options("".join(a + b for a, b in rows), (repair.START,))
        assert repair.best_of(found[repair.START]) == brute_repair(rows)
