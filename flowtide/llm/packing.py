"""Best-fit packing by hierarchical residual rounds.

1. Every input partition tokenizes its documents, cuts those longer than a
   sequence, and packs the pieces best-fit decreasing on its own.
2. Bins filled to within ``slack`` tokens are done.  The underfull ones become
   items (one row per bin, whatever it holds) and are merged up a tree: the bins
   of ``fanout`` neighbouring partitions meet in one task and are packed best
   fit again, round after round, up to the root.
3. A group never gets more than about ``group_items`` bins.  Where more are left
   (sizes that do not combine, say all just over half a sequence) the group is
   dealt out by hash and the rounds end once they no longer save anything.

Only bins move after the first step: the pieces stay in a checkpointed table
and learn their final place from the chain of bin moves.

Rows: a null or empty text is the end id alone; a null ``doc_id`` and repeated
rows are packed like any other; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .textnum import slices, utf8
from .tokens import encoder

CAPACITY = 4096
END_ID = 1
SLACK = 8
FANOUT = 8
GROUP_ITEMS = 20_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, fill long, part int"
MOVES = "bin long, parent long, shift long, fill long, part int"


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: bin and offset of every item, and each bin's fill.

    Free room is kept as one integer with a bit for every residual that some
    bin has, so the tightest bin is found by a shift and a lowest set bit.
    """
    n = len(sizes)
    where, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    fill: list[int] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        above = rooms >> size
        if above:
            room = size + (above & -above).bit_length() - 1
            stack = by_room[room]
            b = stack.pop()
            if not stack:
                rooms &= ~(1 << room)
        else:
            b, room = len(fill), capacity
            fill.append(0)
        where[i], offset[i] = b, fill[b]
        fill[b] += size
        if left := room - size:
            by_room.setdefault(left, []).append(b)
            rooms |= 1 << left
    return where, offset, np.array(fill, np.int64)


def _pieces(path: str, capacity: int):
    schema = pa.schema(
        [("doc_id", pa.int64()), ("piece", pa.int32()), *((c, pa.int64()) for c in ("start", "length", "ids_crc32", "bin", "offset", "fill")), ("part", pa.int32())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(path), TaskContext.get().partitionId()
        cols: tuple[list, ...] = ([], [], [], [], [])
        for batch in batches:
            docs = batch.column(0).to_pylist()
            buf, offs = utf8(batch.column(1))
            for i, j in slices(offs, 500_000):
                ids, rows = enc.encode(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                for d, a, b in zip(docs[i:j], rows[:-1].tolist(), rows[1:].tolist()):
                    own = np.append(ids[a:b], np.uint32(END_ID)).astype("<u4")
                    for p, at in enumerate(range(0, len(own), capacity)):
                        cut_out = own[at : at + capacity]
                        for c, v in zip(cols, (d, p, at, len(cut_out), zlib.crc32(cut_out))):
                            c.append(v)
        if not cols[0]:
            return
        where, offset, fill = best_fit(np.array(cols[3], np.int64), capacity)
        arrays = [*cols, where + (part << 40), offset, fill[where], np.full(len(where), part)]
        yield from pa.Table.from_arrays([pa.array(a, f.type) for a, f in zip(arrays, schema)], schema=schema).to_batches(20_000)

    return run


def _merge(capacity: int):
    def run(pdf):
        pdf = pdf.sort_values("bin")
        where, offset, fill = best_fit(pdf["fill"].to_numpy(), capacity)
        bins, first = pdf["bin"].to_numpy(), offset == 0
        names = np.zeros(len(fill), np.int64)
        names[where[first]] = bins[first]  # a merged bin keeps the name of what lies first in it
        return pdf.assign(parent=names[where], shift=offset, fill=fill[where])[["bin", "parent", "shift", "fill", "part"]]

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, slack: int = SLACK, fanout: int = FANOUT, group_items: int = GROUP_ITEMS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``docs`` needs ``doc_id`` and ``text``; other columns are not read.
    ``tokenizer`` is the path of a ``tokenizers`` vocabulary file that every
    executor can read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = cut(rows.mapInArrow(_pieces(tokenizer, capacity), PIECES))
    under = pieces.where((F.col("offset") == 0) & (F.col("fill") < capacity - slack)).select("bin", "fill", "part")
    moves, width, before = None, fanout, None
    while True:
        found = under.agg(F.count(F.lit(1)).alias("n"), F.max("part").alias("top")).first()
        if not found["n"] or before is not None and found["n"] > 0.98 * before and done:
            break
        groups = found["top"] // width + 1
        deal = -(-found["n"] // (groups * group_items))
        done = groups == 1
        before = found["n"]
        step = cut(
            under.withColumn("deal", F.pmod(F.xxhash64("bin", F.lit(width)), F.lit(deal)))
            .groupBy(F.floor(F.col("part") / width), "deal")
            .applyInPandas(_merge(capacity), MOVES)
        )
        if moves is None:
            moves = step.select("bin", F.col("parent").alias("sequence_id"), "shift")
        else:
            later = step.select(F.col("bin").alias("sequence_id"), "parent", F.col("shift").alias("more"))
            moves = cut(
                moves.join(later, "sequence_id", "left").select(
                    "bin", F.coalesce("parent", "sequence_id").alias("sequence_id"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift")
                )
            )
        if done and deal == 1:
            break
        under = step.where((F.col("shift") == 0) & (F.col("fill") < capacity - slack)).select(F.col("parent").alias("bin"), "fill", "part")
        width *= fanout
    out = ("doc_id", "piece", "start", "length", "ids_crc32")
    if moves is None:
        return pieces.select(*out, F.col("bin").alias("sequence_id"), "offset")
    return pieces.join(moves, "bin", "left").select(
        *out, F.coalesce("sequence_id", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset")
    )
