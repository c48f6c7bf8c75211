"""Conversation repair by Wagner-Fischer alignment with the targets of a role grammar.

Roles shall read ``(s?(ua)+)?`` by their initials. Rows may be kept (0), given the
role user or assistant (1), deleted (2), and user or assistant rows without text may
be inserted (5); a truncated row that is not deleted costs 5 more. Blank and repeated
rows must go. The cheapest edits win, and of these the least audit by ASCII
(``D`` delete, ``I`` insert, ``K`` keep, ``R`` rerole, in order).

Rows are aligned with the grammar's string of each feasible length. The first
length tried is the one nearest to the number of rows; its cost is the incumbent, and
an alignment of another length is only followed on those diagonals on which inserting
and deleting alone does not cost more (Ukkonen's band). Equal costs are decided by
tracing the alignments back and comparing the audits.

Long conversations are cut into pieces of ``PIECE`` rows. A piece is aligned with
the strings from each state of the grammar (start, after s, after u, after a), which
gives the cheapest edits and least audit from each state to each state. Pieces are
joined over the states between them; equal costs of one piece never have one audit
as the beginning of another, so the least audits of the pieces make the least whole.
Rows are dealt by range of (conversation, turn), so a conversation of any length spreads
over tasks, and what the tasks found is joined in order. Only reading out the repaired
rows of a conversation in order, as a digest of its whole text needs, is a stream through one task.

Nulls in role and text are one space. Null turns come first; rows of one turn come by
role and the text's SHA-256. Identical rows are counted, not listed, until they are
repaired. A null conversation id is a conversation of its own. Empty tables give empty
results; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladewise.llm.common import SPACE, same, stored

PIECE = 32
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States of the grammar, and those in which a conversation may end.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
ENDS = (START, AFTER_A)
LEGAL = ("su", "ua", "au")
_NEVER = 1 << 60

#: From a state: to each state the least (cost, audit).
Options = dict[int, tuple[int, str]]


def targets(state: int, length: int) -> list[tuple[str, int]]:
    """The strings of a length that the grammar may go on with from a state, and the state after each."""
    if not length:
        return [("", state)]
    found = (("au" if state == AFTER_U else "ua") * length)[:length]
    out = [(found, AFTER_U if found[-1] == "u" else AFTER_A)]
    if state == START:
        found = ("s" + "ua" * length)[:length]
        out.append((found, {"s": AFTER_S, "u": AFTER_U, "a": AFTER_A}[found[-1]]))
    return out


def _gap(k: int) -> int:
    return INSERT * k if k > 0 else -DELETE * k


def aligned(rows: list[tuple[str, bool]], target: str, bound: int) -> tuple[int, str] | None:
    """The least cost and audit of rows (initial, truncated) against a target, or None if it is over the bound."""
    m, n = len(rows), len(target)
    band = [k for k in range(-m, n + 1) if _gap(k) + _gap(n - m - k) <= bound]
    if not band:
        return None
    low, high = band[0], band[-1]
    #: cost[i][j - i - low]: the rest of the rows against the rest of the target.
    width = high - low + 1
    cost = [[_NEVER] * (width + 1) for _ in range(m + 2)]

    def steps(i: int, j: int) -> Iterator[tuple[str, int, int, int]]:
        """Edits at a cell in order of their letters: letter, cost of it and the rest, next cell."""
        at = j - i - low
        if i < m and at > 0:
            yield "D", DELETE + cost[i + 1][at - 1], i + 1, j
        if j < n and target[j] != "s":
            yield "I", INSERT + cost[i][at + 1], i, j + 1
        if i < m and j < n:
            initial, truncated = rows[i]
            rest = cost[i + 1][at] + (TRUNCATED if truncated else 0)
            if initial == target[j]:
                yield "K", KEEP + rest, i + 1, j + 1
            elif target[j] != "s":
                yield "R", REROLE + rest, i + 1, j + 1

    for i in range(m, -1, -1):
        for j in range(min(n, i + high), max(0, i + low) - 1, -1):
            if i == m and j == n:
                cost[i][j - i - low] = 0
                continue
            cost[i][j - i - low] = min((s[1] for s in steps(i, j)), default=_NEVER)
    total = cost[0][-low] if low <= 0 <= high else _NEVER
    if total > bound:
        return None
    audit, i, j = [], 0, 0
    while (i, j) != (m, n):
        here = cost[i][j - i - low]
        letter, _, i, j = next(s for s in steps(i, j) if s[1] == here)
        audit.append(letter)
    return total, "".join(audit)


def _with_forced(pattern: str, audit: str) -> str:
    """The audit of all rows from that of the free ones; a forced deletion comes before insertions at its place."""
    out, at = [], 0
    for fault in pattern[1::2]:
        if fault in "BD":
            out.append("D")
            continue
        while audit[at] == "I":
            out.append("I")
            at += 1
        out.append(audit[at])
        at += 1
    return "".join(out) + audit[at:]


@lru_cache(maxsize=1 << 16)
def piece_options(pattern: str, state: int) -> Options:
    """The cheapest edits of a piece from a state; the pattern has initial and fault of each row."""
    rows = [(a, b == "T") for a, b in zip(pattern[::2], pattern[1::2]) if b not in "BD"]
    forced = DELETE * (len(pattern) // 2 - len(rows))
    m, best = len(rows), {}
    # Outwards from the number of rows: m, m - 1, m + 1, ...; longer strings stop at the worst incumbent.
    lengths = sorted(range(0, m * (DELETE + INSERT) // INSERT + 3), key=lambda n: (abs(n - m), n))
    for n in lengths:
        for target, to in targets(state, n):
            # Without an incumbent the band is widened until it holds an alignment.
            bound = best[to][0] if to in best else _gap(n - m) + INSERT
            if _gap(n - m) > bound:
                continue
            found = aligned(rows, target, bound)
            while to not in best and found is None and bound < DELETE * m + INSERT * n:
                bound *= 2
                found = aligned(rows, target, bound)
            if found and (to not in best or found < best[to]):
                best[to] = found
    return {to: (cost + forced, _with_forced(pattern, audit)) for to, (cost, audit) in best.items()}


def joined(first: dict[int, Options], then: dict[int, Options]) -> dict[int, Options]:
    """Options over two pieces in a row."""
    out: dict[int, Options] = {}
    for p, middle in first.items():
        best: Options = {}
        for q, (cost, audit) in middle.items():
            for r, (more, rest) in then[q].items():
                if r not in best or cost + more <= best[r][0]:
                    found = (cost + more, audit + rest)
                    best[r] = min(best.get(r, found), found)
        out[p] = best
    return out


def run_options(pattern: str, states: tuple[int, ...]) -> dict[int, Options]:
    """Options of a run of rows of any length from the given states; neighbours are joined pair by pair."""
    cuts = range(0, len(pattern), 2 * PIECE)
    pieces = [
        {s: piece_options(pattern[c : c + 2 * PIECE], s) for s in (states if c == 0 else range(4))} for c in cuts
    ]
    while len(pieces) > 1:
        pairs = [joined(a, b) for a, b in zip(pieces[::2], pieces[1::2])]
        pieces = pairs + pieces[len(pairs) * 2 :]
    return pieces[0]


def best_of(options: Options) -> tuple[int, str]:
    return min(options[q] for q in ENDS if q in options)


# --- Spark -----------------------------------------------------------------


def damage(turns: DataFrame) -> DataFrame:
    """Rows damaged by a checksum of their place, as a test of the repair."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = F.crc32(key.cast("binary")) % 20
    rows = turns.select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
        kind.alias("kind"),
    ).where("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.otherwise(F.col("text")).alias("text"),
        F.explode(times).alias("_copy"),
    ).drop("_copy")


def judged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, said, copies, initial, fault``: different rows with their number of copies.

    ``fault`` is that of the first copy: B blank, D said earlier, T truncated, - none.
    """
    different = (
        rows.select(
            F.col("conv_id").cast("long"),
            F.col("turn").cast("long"),
            F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
        )
        .groupBy("conv_id", "turn", "role", "text")
        .agg(F.count("*").alias("copies"))
        .withColumn("said", F.sha2("text", 256))
    )
    different = stored(different)
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    again = (
        different.groupBy(F.col("conv_id").alias("of_conv"), F.col("role").alias("of_role"), F.col("said").alias("of_said"))
        .agg(F.min(place).alias("earliest"), F.count("*").alias("turns"))
        .where("turns > 1")
    )
    here = (
        same(F.col("conv_id"), F.col("of_conv"))
        & (F.col("role") == F.col("of_role"))
        & (F.col("said") == F.col("of_said"))
    )
    initial = F.substring("role", 1, 1)
    fault = (
        F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "B")
        .when(F.col("earliest").isNotNull() & (place != F.col("earliest")), "D")
        .when(~F.col("text").rlike(rf"[.!?]{SPACE}*\z"), "T")
        .otherwise("-")
    )
    return different.join(again, here, "left").select(
        "conv_id",
        "turn",
        "role",
        "text",
        "said",
        "copies",
        F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"),
        fault.alias("fault"),
    )


_ORDER = ["conv_id", "turn", "role", "said"]
_RUN = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("part", pa.int64()),
        ("first", pa.string()),
        ("last", pa.string()),
        *((c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")),
        ("options", pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))),
    ]
)
_RUN_SPARK = (
    "conv_id long, part long, first string, last string, blank long, duplicate long, truncated long, illegal long, "
    "options array<struct<p: int, q: int, cost: long, audit: string>>"
)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 256) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def out() -> pa.RecordBatch:
        columns = list(zip(*held)) or [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield out()
            held = []
    if held:
        yield out()


def runs(faults: DataFrame) -> DataFrame:
    """What each task finds for its part of each conversation, in order of ``part``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def found() -> Iterator[tuple]:
            states: tuple[int, ...] = tuple(range(4))
            for conv_id, rows in groupby(_rows(batches), key=lambda r: r[0]):
                pattern: list[str] = []
                for _, initial, fault, copies in rows:
                    pattern.append(initial + fault)
                    pattern += [initial + ("B" if fault == "B" else "D")] * (copies - 1)
                whole = "".join(pattern)
                initials = whole[::2]
                yield (
                    conv_id,
                    part,
                    initials[0],
                    initials[-1],
                    *(whole[1::2].count(k) for k in "BDT"),
                    sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])),
                    [
                        (p, q, cost, audit)
                        for p, options in run_options(whole, states).items()
                        for q, (cost, audit) in options.items()
                    ],
                )
                # Only the first conversation of a part may have begun in an earlier one.
                states = (START,)

        yield from _batches(found(), _RUN)

    ordered = faults.select(*_ORDER, "initial", "fault", "copies").repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER)
    return ordered.select("conv_id", "initial", "fault", "copies").mapInArrow(run, _RUN_SPARK)


_REPORT = pa.schema(
    [("conv_id", pa.int64())]
    + [(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    + [("audit", pa.string())]
)


def reports(faults: DataFrame) -> DataFrame:
    """``conv_id, blank, duplicate, truncated, illegal, cost, audit`` of each conversation with rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for conv_id, parts in groupby(_rows(batches), key=lambda r: r[0]):
                counts, last, whole = [0, 0, 0, 0], None, None
                for _, _, first, end, *numbers, options in parts:
                    counts = [a + b for a, b in zip(counts, numbers)]
                    counts[3] += last is not None and last + first not in LEGAL
                    last = end
                    here: dict[int, Options] = {}
                    for o in options:
                        here.setdefault(o["p"], {})[o["q"]] = (o["cost"], o["audit"])
                    whole = {START: here[START]} if whole is None else joined(whole, here)
                yield conv_id, *counts, *best_of(whole[START])

        yield from _batches(found(), _REPORT)

    ordered = runs(faults).repartition("conv_id").sortWithinPartitions("conv_id", "part")
    schema = "conv_id long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    return ordered.mapInArrow(run, schema)


REPAIRED = "conv_id long, seq long, edit string, role string, text string"
_REPAIRED = pa.schema(
    [("conv_id", pa.int64()), ("seq", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]
)


def repaired(faults: DataFrame, reported: DataFrame) -> DataFrame:
    """The rows after repair in order of ``seq`` with the edit that left them; a conversation is a stream through one task."""
    nothing = {"turn": "long", "role": "string", "said": "string", "text": "string", "initial": "string", "copies": "long"}
    heads = reported.select(
        "conv_id", F.lit(0).alias("kind"), *(F.lit(None).cast(t).alias(c) for c, t in nothing.items()), "audit"
    )
    rows = faults.select("conv_id", F.lit(1).alias("kind"), *nothing, F.lit(None).cast("string").alias("audit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for conv_id, group in groupby(_rows(batches), key=lambda r: r[0]):
                audit = next(group)[-1]
                at, seq, expected = 0, 0, "u"

                def role_now() -> str:
                    return "user" if expected == "u" else "assistant"

                def inserts() -> Iterator[tuple]:
                    nonlocal at, seq, expected
                    while at < len(audit) and audit[at] == "I":
                        yield conv_id, seq, "I", role_now(), ""
                        at, seq, expected = at + 1, seq + 1, "a" if expected == "u" else "u"

                for _, role, text, initial, copies, _ in group:
                    for _ in range(copies):
                        yield from inserts()
                        edit = audit[at]
                        at += 1
                        if edit == "D":
                            continue
                        yield conv_id, seq, edit, role if edit == "K" else role_now(), text
                        seq += 1
                        if not (edit == "K" and initial == "s"):
                            expected = "a" if expected == "u" else "u"
                yield from inserts()

        yield from _batches(found(), _REPAIRED)

    ordered = heads.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "said")
    return ordered.select("conv_id", "role", "text", "initial", "copies", "audit").mapInArrow(run, REPAIRED)


def digests(rows: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` of repaired rows that come in order, as ``repaired`` gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for conv_id, group in groupby(_rows(batches), key=lambda r: r[0]):
                digest = hashlib.sha256()
                for k, (_, role, text) in enumerate(group):
                    digest.update(f"{chr(10) if k else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
                yield conv_id, digest.hexdigest()

        yield from _batches(found(), pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())]))

    return rows.select("conv_id", "role", "text").mapInArrow(run, "conv_id long, repaired_sha256 string")


def gaps(rows: DataFrame) -> DataFrame:
    """``conv_id, gaps``: turns between the first and the last that no row has; null turns do not count."""
    missing = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    return rows.groupBy("conv_id").agg(F.coalesce(missing, F.lit(0)).cast("long").alias("gaps"))


def audited(turns: DataFrame, rows: DataFrame) -> DataFrame:
    """A report with the digest of the repaired rows for every conversation of ``turns``, whose damaged rows are ``rows``."""
    faults = stored(judged(rows))
    reported = stored(reports(faults))
    found = reported.join(
        digests(repaired(faults, reported)).withColumnRenamed("conv_id", "_conv"),
        same(F.col("conv_id"), F.col("_conv")),
        "left",
    ).drop("_conv")
    every = turns.select(F.col("conv_id").cast("long").alias("id")).distinct()
    empty = hashlib.sha256().hexdigest()

    def filled(name: str, value: object) -> Column:
        return F.coalesce(F.col(name), F.lit(value).cast("string" if isinstance(value, str) else "long")).alias(name)

    return (
        every.join(gaps(rows).withColumnRenamed("conv_id", "_gap_id"), same(F.col("id"), F.col("_gap_id")), "left")
        .join(found, same(F.col("id"), F.col("conv_id")), "left")
        .select(
            F.col("id").alias("conv_id"),
            *(filled(c, 0) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
            filled("audit", ""),
            filled("repaired_sha256", empty),
        )
    )
