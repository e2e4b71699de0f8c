"""Repair of conversation structure by weighted interval parsing.

A conversation is well formed if the initials of its roles spell
``(s?(ua)+)?``.  Edits have costs: Keep 0, Rerole (to user or assistant) 3,
Delete 4, Insert (an empty user or assistant turn) 3; a truncated row that is
not deleted adds 3; blank and repeated rows must be deleted.

**Grammar.**  The language's automaton has four states (nothing yet, after
``s``, after ``u``, after ``a``).  The nonterminals are the pairs of states: a
span derives ``[p, q]`` if its rows can be edited so that they lead from p to q.
In Chomsky normal form the binary rules are ``[p, q] -> [p, r] [r, q]`` and the
unary ones the edits of a single row, closed under insertions on both sides.  A
span's cell keeps for each pair the least (cost, audit), audit being the edits'
initials.  Two audits of one span and cost are never prefixes of each other (the
longer one would have paid for its extra insertions), so the least of a span
goes on being least in every longer one.

**Parsing.**  Cells are combined bottom-up by span length.  The r of a binary
rule ranges over all states, so one split of each span gives every derivation:
neighbouring spans of 1, 2, 4, ... rows are combined, and a conversation costs as
many combinations as it has rows.  The same holds over partitions: rows are
range-partitioned by conversation and turn, each partition parses the stretch of
every conversation that it holds, and the stretches' cells are combined
afterwards.  A conversation that holds a third of all rows is split like that.
What grows with one conversation is its audit, which is one value of the result.

The cheapest audits then meet the texts again, sorted by conversation and turn,
and are replayed as a stream: a task holds one audit and a batch of rows.  (The
hash of one conversation's repaired text is a chain, so a single task runs it.)

Rows: a null role or text is one space, and so is a null conversation or turn in
the damage key.  Rows of equal turn go by role, then by a 128-bit hash of role
and text; a null turn comes first.  A null ``conv_id`` is a conversation of its
own.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, shuffle_partitions

# fixed values: the costs of the edits
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3

START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = ("su", "ua", "au")
INK = "[^\\x20\\x09-\\x0D]"

#: A cell: for every pair of states, in order, the least (cost, audit) or None.
Cell = tuple


@lru_cache(maxsize=50_000)
def combine(left: Cell, right: Cell) -> Cell:
    """The binary rules: cells of two neighbouring spans to the cell of both."""
    out = []
    for p in STATES:
        for q in STATES:
            best = None
            for r in STATES:
                a, b = left[4 * p + r], right[4 * r + q]
                if a and b and (best is None or a[0] + b[0] <= best[0]):
                    new = (a[0] + b[0], a[1] + b[1])
                    best = new if best is None else min(best, new)
            out.append(best)
    return tuple(out)


def _insertions() -> Cell:
    """Least insertions that lead from state to state (none from a state to itself)."""
    cell = {(p, p): (0, "") for p in STATES}
    for _ in STATES:
        for (p, c), q in STEP.items():
            if c != "s":
                for o in STATES:
                    if (o, p) in cell:
                        cost, audit = cell[o, p]
                        cell[o, q] = min(cell.get((o, q), (1 << 60, "")), (cost + INSERT, audit + "I"))
    return tuple(cell.get((p, q)) for p in STATES for q in STATES)


NOTHING = _insertions()


@lru_cache(maxsize=4096)
def leaf(initial: str, must_go: bool, truncated: bool) -> Cell:
    """The cell of one row, insertions on both sides included."""
    cell = {(p, p): (DELETE, "D") for p in STATES}
    if not must_go:
        extra = TRUNCATED if truncated else 0
        for (p, c), q in STEP.items():
            ways = [(KEEP + extra, "K")] if c == initial else []
            if c != "s":
                ways.append((REROLE + extra, "R"))
            for way in ways:
                cell[p, q] = min(cell.get((p, q), (1 << 60, "")), way)
    return combine(combine(NOTHING, tuple(cell.get((p, q)) for p in STATES for q in STATES)), NOTHING)


def parse(cells: list[Cell]) -> Cell:
    """The cell of a whole stretch, bottom-up by span length."""
    while len(cells) > 1:
        cells = [combine(*cells[i : i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0] if cells else NOTHING


def cheapest(cell: Cell) -> tuple[int, str]:
    """The least (cost, audit) that ends with nothing or after an assistant."""
    return min(cell[4 * START + START], cell[4 * START + ASSISTANT])


def replay(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[str]:
    """``role:text`` of every turn that the audit's edits leave."""
    state = START
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit == "K":
            state = STEP[state, role[:1]]
        else:
            state = ASSISTANT if state == USER else USER
            role = NAMES[state]
        yield f"{role}:{text}"


# ---- rows --------------------------------------------------------------------
def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, copy, gone) after the planted damage.

    A dropped row stays as a marker (``gone``), so that no conversation is lost.
    """
    space = F.lit(" ")
    conv, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    name = F.concat(F.coalesce(conv.cast("string"), space), F.lit(":"), F.coalesce(turn.cast("string"), space))
    role, text = (F.coalesce(F.col(c).cast("string"), space) for c in ("role", "text"))
    rows = conversations.select(conv.alias("conv_id"), turn.alias("turn"), role.alias("role"), text.alias("text"), (F.crc32(name.cast("binary")) % 20).alias("fault"))
    text = F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"), (F.col("fault") == 0).alias("gone"))


def _named(rows: DataFrame) -> DataFrame:
    digest = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    return rows.withColumn("digest", digest)


ORDER = ("gone", "turn", "role", "digest", "copy")


def _order() -> list:
    return [F.col(c).asc_nulls_first() for c in ORDER]


STRETCH = "conv_id long, at int, rows long, blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, first string, last string, costs array<long>, audits array<string>"


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each conversation's stretch of a sorted partition."""
    schema = _schema(STRETCH)

    def rows():
        for b in batches:
            yield from zip(*(b.column(c).to_pylist() for c in ("conv_id", "part", "gone", "turn", "initial", "fault", "truncated")))

    out = []
    for conv, group in groupby(rows(), key=lambda r: r[0]):
        cells, count, illegal, turns, low, high, first, last, seen, at = [], {0: 0, 1: 0, 2: 0, 3: 0}, 0, 0, None, None, None, None, None, 0
        for _, at, gone, turn, initial, fault, truncated in group:
            if gone:
                continue
            cells.append(leaf(initial, fault in (1, 2), truncated))
            count[fault] += 1
            illegal += last is not None and last + initial not in LEGAL
            first, last = initial if first is None else first, initial
            if turn is not None:
                turns += turn != seen
                low, high, seen = turn if low is None else low, turn, turn
        cell = parse(cells)
        out.append((conv, at, len(cells), count[1], count[2], count[3], illegal, turns, low, high, first, last, [c[0] if c else None for c in cell], [c[1] if c else None for c in cell]))
        if len(out) >= 500:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(n, kinds[k]) for n, k in (f.split(" ") for f in ddl.split(", "))])


REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches, sorted by conversation and place, to one row per conversation."""
    schema = _schema(REPORT)

    def rows():
        for b in batches:
            yield from b.to_pylist()

    out = []
    for conv, group in groupby(rows(), key=lambda r: r["conv_id"]):
        cells, total, illegal, turns, low, high, last = [], [0, 0, 0], 0, 0, None, None, None
        for s in group:
            if not s["rows"]:
                continue
            cells.append(tuple(None if c is None else (c, a) for c, a in zip(s["costs"], s["audits"])))
            total = [x + s[k] for x, k in zip(total, ("blank", "duplicate", "truncated"))]
            illegal += s["illegal"] + (last is not None and last + s["first"] not in LEGAL)
            last = s["last"]
            if s["low"] is not None:
                turns += s["turns"] - (s["low"] == high)
                low, high = s["low"] if low is None else low, s["high"]
        cost, audit = cheapest(parse(cells))
        out.append((conv, 0 if low is None else high - low + 1 - turns, *total, illegal, cost, audit))
        if len(out) >= 5000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each conversation's report (first) and rows, as a stream, to the report and its hash."""
    reports = [f.split(" ")[0] for f in REPORT.split(", ")]
    schema = _schema(REPORT + ", repaired_sha256 string")

    def rows():
        for b in batches:
            yield from zip(b.column("conv_id").to_pylist(), b.column("report").to_pylist(), b.column("role").to_pylist(), b.column("text").to_pylist())

    out = []
    for _, group in groupby(rows(), key=lambda r: r[0]):
        report = next(group)[1]
        sha, first = hashlib.sha256(), True
        for turn in replay(report["audit"], ((r[2], r[3]) for r in group)):
            sha.update((turn if first else "\n" + turn).encode())
            first = False
        out.append((*(report[c] for c in reports), sha.hexdigest()))
        if len(out) >= 2000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)


def reports(rows: DataFrame) -> DataFrame:
    """Faults and cheapest edits of every conversation of ``damaged`` rows."""
    n = shuffle_partitions(rows.sparkSession)
    rows = _named(rows)
    again = F.row_number().over(Window.partitionBy("conv_id", "gone", "digest").orderBy(F.col("turn").asc_nulls_first(), "copy")) > 1
    blank = ~F.col("text").rlike(INK)
    last = F.regexp_extract("text", f"({INK})[\\x20\\x09-\\x0D]*\\z", 1)
    slim = rows.select("conv_id", *ORDER, F.substring("role", 1, 1).alias("initial"), blank.alias("blank"), (~last.isin(".", "!", "?")).alias("truncated"))
    slim = slim.withColumn("again", again)
    fault = F.when(F.col("blank"), 1).when(F.col("again"), 2).when(F.col("truncated"), 3).otherwise(0)
    key = [F.col("conv_id").asc_nulls_first(), *_order()]
    dealt = slim.select("conv_id", *ORDER, "initial", "truncated", fault.alias("fault")).repartitionByRange(n, *key).sortWithinPartitions(*key)
    stretches = cut(dealt.withColumn("part", F.spark_partition_id()).mapInArrow(_stretches, STRETCH))
    return stretches.repartition(n, "conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "at").mapInArrow(_reports, REPORT)


def repair(rows: DataFrame) -> DataFrame:
    """Reports with the SHA-256 of every repaired conversation; see the module."""
    n = shuffle_partitions(rows.sparkSession)
    found = cut(reports(rows))
    first = found.select("conv_id", F.struct(*found.columns).alias("report"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), *[F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("digest", "binary"), ("copy", "int"))], F.lit(0).alias("kind"))
    rest = _named(rows.where("not gone")).select("conv_id", F.lit(None).cast(first.schema["report"].dataType).alias("report"), "role", "text", "turn", "digest", "copy", F.lit(1).alias("kind"))
    key = [F.col("conv_id").asc_nulls_first(), "kind", *[F.col(c).asc_nulls_first() for c in ORDER if c != "gone"]]
    both = first.unionByName(rest).repartition(n, "conv_id").sortWithinPartitions(*key)
    return both.select("conv_id", "report", "role", "text").mapInArrow(_hashes, REPORT + ", repaired_sha256 string")
