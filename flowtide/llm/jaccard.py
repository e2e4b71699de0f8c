"""Exact Jaccard similarity join of word-shingle sets with signature trees.

Two documents link when their sets of word shingles have
``intersection / union >= num / den``.  The result is each document's component.

**Distribution.**  Sets whose similarity reaches the threshold differ in at most
``d`` shingles, a number that follows from their sizes.  Shingles are dealt by
hash into ``K > d`` parts, so two linked sets agree wholly on at least ``K - d``
parts, and each agreeing part that is not empty has an equal key.  Sizes fall
into bands that fix ``K``; a set that reaches into the next band gives keys for
that band too.  (A set with ``K - d`` or more empty parts also gives the keys of
those.)  Keys that only one set has are dropped, then sets that share fewer keys
than any link of theirs must, and so again.  Each remaining key ties its sets to
the least of them; the connected components of these ties are the groups that
cannot link to each other.  A key that many sets of one task have sends one row
to its meeting point from there, so a key of a third of all rows is no hot spot.

**Signature trees.**  In each group the sets are leaves of a tree whose nodes
hold the OR of their sets' bitmaps, the range of their sizes and the most bit
collisions of a set.  Pairs of nodes are walked down together.  A pair goes on
only if its greatest possible overlap, ``min(sizes, common bits + collisions)``,
can still reach the threshold for its least sizes, and if it is not inside one
component already.  Leaf pairs are compared exactly.

**Large groups.**  Links of the stars are checked first, on Spark, and
components of those links formed.  Then the group is cut into blocks (of one
component where that has many sets); pairs of blocks whose sizes fit go through
the same walk, except pairs inside one component.  Nothing is capped or
dropped; the whole of a group never sits in one task.

Sets with equal shingles are one node throughout (by a 64-bit hash of the set),
so copies are never compared with each other.

Rows: null texts, empty texts and texts without words have no shingles and link
with nothing (their component is their own id).  Repeated ``doc_id`` rows share
a component only through their texts.  Rows whose ``doc_id`` is null get a null
component; they never represent others.  An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Steps, cut, shuffle_partitions
from .components import connected
from .textnum import distinct, lower_ascii, mix, shingles, slices, utf8, word_hashes, words

GROUP_SETS = 512
GROUP_SHINGLES = 2_000_000
FANOUT = 8
SLICE = 500_000  # bytes of text worked on at a time


@dataclass(frozen=True)
class Threshold:
    """``den * intersection >= num * union``, in whole numbers."""

    num: int = 85
    den: int = 100

    def links(self, both, a, b):
        return self.den * both >= self.num * (a + b - both)

    def may_reach(self, both, a, b):
        """Can sets of at least ``a`` and ``b`` shingles with that overlap link?"""
        return (self.den + self.num) * both >= self.num * (a + b)

    def sizes_fit(self, least, most):
        """Can a set of ``least`` shingles link with one of ``most``?"""
        return self.den * least >= self.num * most

    def bands(self, most: int) -> list[tuple[int, int, int]]:
        """(largest size, d, K) of each band up to one that holds ``most``."""
        out, low = [], 1
        while True:
            high = max(low, low * self.den * self.den // (self.num * self.num))
            d = 2 * high * (self.den - self.num) // (self.den + self.num)
            out.append((high, d, d + 1 + -(-d // 4)))
            if low > most:
                return out
            low = high + 1


def sets_of(buf: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes, their ranges, and a 64-bit name for each set."""
    buf = lower_ascii(buf)
    starts, ends, rows = words(buf, offs)
    h, at = distinct(*shingles(word_hashes(buf, starts, ends), rows, k))
    n = np.diff(at)
    total = np.zeros(len(n), np.uint64)
    if len(h):
        total[n > 0] = np.add.reduceat(mix(h ^ np.uint64(0x2545F4914F6CDD1D)), at[:-1][n > 0])
    return h, at, mix(total + n.astype(np.uint64)).view(np.int64)


def part_keys(h: np.ndarray, at: np.ndarray, names: np.ndarray, t: Threshold) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, set name, need) for every part that each set answers for.

    The low six bits of a key are its band; ``need`` is the least number of keys
    of that band which the set shares with any set it links to.
    """
    n = np.diff(at)
    bands = t.bands(int(n.max(initial=1)))
    high = np.array([b[0] for b in bands])
    own = np.searchsorted(high, n)
    out = [(np.zeros(0, np.int64),) * 3]
    for up in (0, 1):
        band = own + up
        use = n > 0 if not up else (n > 0) & t.sizes_fit(n, high[own] + 1)
        rows = np.flatnonzero(use)
        if not len(rows):
            continue
        d, parts = (np.array([b[c] for b in bands])[band[rows]] for c in (1, 2))
        base = np.cumsum(parts) - parts
        size = n[rows]
        take = np.repeat(at[:-1][rows] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        x = h[take]
        cell = np.repeat(base, size) + ((x >> np.uint64(32)) * np.repeat(parts, size).astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        total = int(parts.sum())
        y = mix(x ^ np.uint64(0x94D049BB133111EB))
        low = np.bincount(cell, weights=(y & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=total)
        top = np.bincount(cell, weights=(y >> np.uint64(32)).astype(np.float64), minlength=total)
        count = np.bincount(cell, minlength=total)
        row = np.repeat(np.arange(len(rows)), parts)
        part = np.arange(total) - base[row]
        empty = np.bincount(row, weights=count == 0, minlength=len(rows)).astype(np.int64)
        tell = empty >= parts - d
        give = (count > 0) | tell[row]
        key = mix(low.astype(np.uint64) + mix(top.astype(np.uint64)) + mix((band[rows][row] << 32 | part).astype(np.uint64)))
        key = (key & ~np.uint64(63)) | (band[rows][row] & 63).astype(np.uint64)
        # a set that tells shares keys of empty parts only with others that tell; with the rest, one key at least
        need = np.where(tell, 1, parts - d - empty)
        out.append((key[give].view(np.int64), names[rows][row[give]], need[row[give]]))
    return tuple(np.concatenate(c) for c in zip(*out))


_KEYED = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("need", pa.int32())])
KEYED = "key long, a long, need int"
_PACKED = pa.schema([("bucket", pa.int32()), ("met", pa.bool_()), ("blob", pa.binary())])
PACKED = "bucket int, met boolean, blob binary"


def pack(key: np.ndarray, a: np.ndarray, need: np.ndarray) -> bytes:
    """Rows in ascending order of key as bytes.

    The keys' bytes are laid out by significance (the high ones of neighbours are
    alike and compress); each set is named once and numbered in its rows.
    """
    pair = np.rec.fromarrays([a, need], names="a,need")
    sets, at = np.unique(pair, return_inverse=True)
    at = at.astype(np.uint16 if len(sets) <= 1 << 16 else np.uint32)
    head = np.array([len(key), len(sets)], "<u4")
    planes = np.ascontiguousarray(key.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return b"".join((head.tobytes(), planes.tobytes(), at.tobytes(), sets["a"].astype("<i8").tobytes(), sets["need"].astype("<i4").tobytes()))


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, m = np.frombuffer(blob, "<u4", 2).tolist()
    key = np.ascontiguousarray(np.frombuffer(blob, np.uint8, 8 * n, 8).reshape(8, n).T).view("<u8").ravel()
    kind = np.dtype("<u2" if m <= 1 << 16 else "<u4")
    place = 8 + 8 * n
    at = np.frombuffer(blob, kind, n, place)
    place += kind.itemsize * n
    return key, np.frombuffer(blob, "<i8", m, place)[at], np.frombuffer(blob, "<i4", m, place + 8 * m)[at]


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First row of every run of equal keys, and the run's length at each row."""
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(first)
    return first, np.repeat(np.diff(np.append(at, len(key))), np.diff(np.append(at, len(key))))


def _once(key: np.ndarray, a: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in order of key, each (key, set) once."""
    order = np.lexsort((a, key))
    key, a, need = key[order], a[order], need[order]
    own = np.ones(len(key), bool)
    own[1:] = (key[1:] != key[:-1]) | (a[1:] != a[:-1])
    return key[own], a[own], need[own]


def _emit(k: int, t: Threshold, buckets: int, flush: int = 250_000):
    """Keys of all sets, packed by bucket (a range of keys).

    Rows whose key has met another set in this task are marked and dealt by key
    and set; only the first of them goes on to look for sets of other tasks.
    """

    def out(cols):
        key, a, need = _once(*(np.concatenate(c) for c in zip(*cols)))
        first, length = _runs(key)
        for rows, met in ((first, False), (length > 1, True)):
            x, y, z = key[rows], a[rows], need[rows]
            bucket = (mix(x ^ y.view(np.uint64)) if met else x) >> np.uint64(32)
            bucket = (bucket * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            bucket, x, y, z = bucket[order], x[order], y[order], z[order]
            start = np.flatnonzero(_runs(bucket)[0])
            blobs = [pack(x[i:j], y[i:j], z[i:j]) for i, j in zip(start.tolist(), [*start[1:].tolist(), len(x)])] if len(x) else []
            yield pa.RecordBatch.from_arrays([pa.array(bucket[start]), pa.array(np.full(len(start), met)), pa.array(blobs, pa.binary())], schema=_PACKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols, held = [], 0
        for batch in batches:
            buf, offs = utf8(batch.column(0))
            for i, j in slices(offs, SLICE):
                key, a, need = part_keys(*sets_of(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], k), t)
                cols.append((key.view(np.uint64), a, need.astype(np.int32)))
                held += len(key)
                # within a batch too: one batch of long texts has millions of keys
                if held > flush:
                    yield from out(cols)
                    cols, held = [], 0
        if held:
            yield from out(cols)

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted buckets' rows, those whose key more than one set has; a bucket at a time."""

    def rows():
        for b in batches:
            yield from zip(b.column("bucket").to_pylist(), b.column("met").to_pylist(), b.column("blob").to_pylist())

    for (_, met), group in groupby(rows(), key=lambda r: r[:2]):
        key, a, need = _once(*(np.concatenate(c) for c in zip(*(unpack(r[2]) for r in group))))
        if not met:
            many = _runs(key)[1] > 1
            key, a, need = key[many], a[many], need[many]
        table = pa.Table.from_arrays([pa.array(key.view(np.int64)), pa.array(a), pa.array(need)], schema=_KEYED)
        yield from table.to_batches(100_000)


def shared_keys(steps: Steps, rows: DataFrame, k: int, t: Threshold) -> DataFrame:
    """(key, a) of all sets that share enough keys to have a link.

    A row may come twice, which only counts in favour of its set.
    """
    parts = shuffle_partitions(rows.sparkSession)
    met = rows.select("text").mapInArrow(_emit(k, t, 4 * parts), PACKED).repartition(parts, "bucket").sortWithinPartitions("bucket", "met").mapInArrow(_meet, KEYED)
    own = Window.partitionBy("a", F.col("key").bitwiseAND(F.lit(63)))
    return steps.keep("keys", met.withColumns({"c": F.count(F.lit(1)).over(own), "n": F.max("need").over(own)}).where("c >= n").select("key", "a"))


# ---- signature trees --------------------------------------------------------
class Tree:
    """Levels of nodes over sets; the sets are the last level."""

    def __init__(self, sets: list[np.ndarray], bits: int):
        n = np.array([len(s) for s in sets])
        self.order = sorted(range(len(sets)), key=lambda i: (n[i], int(sets[i][0]) if n[i] else 0))
        n = n[self.order]
        maps = np.zeros((len(sets), bits // 64), np.uint64)
        for r, i in enumerate(self.order):
            at = (sets[i] & np.uint64(bits - 1)).astype(np.int64)
            np.bitwise_or.at(maps[r], at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        lost = n - np.bitwise_count(maps).sum(axis=1).astype(np.int64)
        self.levels = [(maps, n, n, lost)]
        while len(self.levels[-1][0]) > 1:
            maps, low, high, lost = self.levels[-1]
            at = np.arange(0, len(maps), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(maps, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(lost, at)))
        self.levels.reverse()


class Labels:
    """Components of the sets of a walk; ``of`` gives each set's label."""

    def __init__(self, of: np.ndarray):
        self.of = of.copy()

    def join(self, a: int, b: int) -> None:
        x, y = self.of[a], self.of[b]
        self.of[self.of == max(x, y)] = min(x, y)


def _keeps(x, y, a, b, t: Threshold) -> np.ndarray:
    """Which node pairs (a, b) of levels x and y may hold a link."""
    (maps, low, high, lost), (maps2, low2, high2, lost2) = x, y
    ok = t.sizes_fit(high[a], low2[b]) & t.sizes_fit(high2[b], low[a])
    a, b = a[ok], b[ok]
    bits = np.bitwise_count(maps[a] & maps2[b]).sum(axis=1).astype(np.int64)
    most = np.minimum(np.minimum(high[a], high2[b]), bits + np.minimum(lost[a], lost2[b]))
    ok[ok] = t.may_reach(most, low[a], low2[b])
    return ok


def walk(x: Tree, y: Tree, sets_x: list, sets_y: list, labels: Labels, at_x: np.ndarray, at_y: np.ndarray, t: Threshold, chunk: int = 4096) -> list[tuple[int, int]]:
    """Links between the sets of two trees (or of one) that join components.

    ``at_x[i]`` and ``at_y[j]`` are the sets' numbers in ``labels``.
    """
    same, found = x is y, []
    depth = max(len(x.levels), len(y.levels))
    up = lambda tree, k: max(0, k - (depth - len(tree.levels)))  # noqa: E731  the shorter tree waits at its root
    stack = [(0, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        k, a, b = stack.pop()
        keep = _keeps(x.levels[up(x, k)], y.levels[up(y, k)], a, b, t)
        a, b = a[keep], b[keep]
        if not len(a):
            continue
        if k == depth - 1:
            found += _leaves(x, y, a, b, sets_x, sets_y, labels, at_x, at_y, t)
            continue
        kids = []
        for tree, v in ((x, a), (y, b)):
            if up(tree, k + 1) == up(tree, k):
                kids.append((v[:, None], np.ones((len(v), 1), bool)))
            else:
                c = v[:, None] * FANOUT + np.arange(FANOUT)
                kids.append((c, c < len(tree.levels[up(tree, k + 1)][0])))
        (ca, oka), (cb, okb) = kids
        pa_, pb_ = np.broadcast_arrays(ca[:, :, None], cb[:, None, :])
        ok = oka[:, :, None] & okb[:, None, :]
        if same:
            ok = ok & (pa_ <= pb_) & ((pa_ != pb_) | (k + 1 < depth - 1))
        na, nb = pa_[ok], pb_[ok]
        stack += [(k + 1, na[i : i + chunk], nb[i : i + chunk]) for i in range(0, len(na), chunk)]
    return found


def _leaves(x, y, a, b, sets_x, sets_y, labels, at_x, at_y, t) -> list[tuple[int, int]]:
    found = []
    i, j = np.array(x.order)[a], np.array(y.order)[b]
    u, v = at_x[i], at_y[j]
    while len(i):
        open_ = labels.of[u] != labels.of[v]
        i, j, u, v = i[open_], j[open_], u[open_], v[open_]
        # of each pair of components, one pair of sets a turn
        pair = np.stack([np.minimum(labels.of[u], labels.of[v]), np.maximum(labels.of[u], labels.of[v])], axis=1)
        turn = np.unique(pair, axis=0, return_index=True)[1] if len(i) else np.zeros(0, np.int64)
        for s in turn.tolist():
            if labels.of[u[s]] == labels.of[v[s]]:
                continue
            p, q = sets_x[i[s]], sets_y[j[s]]
            if t.links(len(np.intersect1d(p, q, assume_unique=True)), len(p), len(q)):
                labels.join(int(u[s]), int(v[s]))
                found.append((int(u[s]), int(v[s])))
        rest = np.ones(len(i), bool)
        rest[turn] = False
        i, j, u, v = i[rest], j[rest], u[rest], v[rest]
    return found


def _bits(sets: list[np.ndarray]) -> int:
    most = max((len(s) for s in sets), default=1)
    return 1 << min(16, max(8, math.ceil(math.log2(4 * most + 1))))


def _unpack(column) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u8") for x in column]


def _tree_group(t: Threshold):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("name")  # a repeated doc_id may bring a set twice
        sets, names = _unpack(pdf["shingles"]), pdf["name"].to_numpy()
        tree = Tree(sets, _bits(sets))
        at = np.arange(len(sets))
        links = walk(tree, tree, sets, sets, Labels(at), at, at, t)
        return pd.DataFrame({"a": names[[u for u, _ in links]], "b": names[[v for _, v in links]]}, columns=["a", "b"]).astype("int64")

    return run


def _tree_blocks(t: Threshold):
    """One pair of blocks (or a block with itself): ``side`` 0 and 1."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sets, names = _unpack(pdf["shingles"]), pdf["name"].to_numpy()
        labels = Labels(np.unique(pdf["label"].to_numpy(), return_inverse=True)[1].astype(np.int64))
        bits = _bits(sets)
        sides = [np.flatnonzero(pdf["side"].to_numpy() == s) for s in (0, 1)]
        own = [[sets[i] for i in s] for s in sides]
        trees = [Tree(s, bits) for s in own if s]
        if len(trees) == 1:
            side = 0 if own[0] else 1
            links = walk(trees[0], trees[0], own[side], own[side], labels, sides[side], sides[side], t)
        else:
            links = walk(*trees, *own, labels, *sides, t)
        return pd.DataFrame({"a": names[[u for u, _ in links]], "b": names[[v for _, v in links]]}, columns=["a", "b"]).astype("int64")

    return run


# ---- the join ---------------------------------------------------------------
def _named(k: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("name", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = utf8(batch.column(1))
            for i, j in slices(offs, SLICE):
                _, at, names = sets_of(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], k)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(at)), pa.array(names)], schema=schema)

    return run


SETS = "name long, grp long, large boolean, n long, shingles binary"


def _with_sets(k: int):
    """Texts of known groups to their sets; a text must give the name it came for."""
    schema = pa.schema([("name", pa.int64()), ("grp", pa.int64()), ("large", pa.bool_()), ("n", pa.int64()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = utf8(batch.column(3))
            want = batch.column(0).to_numpy()
            for i, j in slices(offs, SLICE):
                h, at, names = sets_of(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], k)
                good = np.flatnonzero(names == want[i:j])
                raw = [h[at[g] : at[g + 1]].astype("<u8").tobytes() for g in good.tolist()]
                same = [batch.column(c).slice(i, j - i).take(pa.array(good)) for c in (0, 1, 2)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(np.diff(at)[good]), pa.array(raw, pa.binary())], schema=schema)

    return run


def _check_pair(t: Threshold):
    @F.pandas_udf("boolean")
    def linked(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(_unpack(x), _unpack(y)):
            out.append(bool(t.links(len(np.intersect1d(p, q, assume_unique=True)), len(p), len(q))))
        return pd.Series(out, dtype=bool)

    return linked


def _large_links(sets: DataFrame, ties: DataFrame, t: Threshold, group_sets: int) -> DataFrame:
    """Links of the groups that are too large for one task; ``sets`` is a kept table."""
    side = lambda c: sets.select(F.col("name").alias(c), F.col("shingles").alias(f"s{c}"))
    tested = cut(ties.join(side("a"), "a").join(side("b"), "b").where(_check_pair(t)("sa", "sb")).select("a", "b"))
    label = connected(tested, "a", "b")
    known = sets.select("name", "grp", "n").join(label, F.col("name") == F.col("node"), "left").select("name", "grp", "n", F.coalesce("root", "name").alias("label"))
    # blocks: a component with many sets has its own; the others share by size band and hash
    many = known.groupBy(F.col("grp").alias("g"), F.col("label").alias("l")).agg(F.count(F.lit(1)).alias("members"))
    pure = F.when(F.col("members") >= group_sets // 2, F.col("label"))
    wide = math.log(t.den / t.num)
    band = F.floor(F.log(F.col("n").cast("double")) / wide)
    block = cut(known.join(many, (F.col("grp") == F.col("g")) & (F.col("label") == F.col("l"))).select("name", "grp", "n", "label", pure.alias("pure"), band.alias("band")))
    crowd = block.groupBy(F.col("grp").alias("g"), F.col("pure").alias("p"), F.col("band").alias("w")).agg(F.count(F.lit(1)).alias("crowd"))
    same = (F.col("grp") == F.col("g")) & F.col("pure").eqNullSafe(F.col("p")) & (F.col("band") == F.col("w"))
    deal = F.pmod(F.xxhash64("name"), F.ceil(F.col("crowd") / group_sets))
    placed = cut(block.join(crowd, same).select("name", "grp", "n", "label", "pure", F.xxhash64("pure", "band", deal).alias("block")))
    blocks = placed.groupBy("grp", "block", "pure").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    x, y = blocks.alias("x"), blocks.alias("y")
    fits = (
        (F.col("x.block") <= F.col("y.block"))
        & t.sizes_fit(F.col("x.high"), F.col("y.low"))
        & t.sizes_fit(F.col("y.high"), F.col("x.low"))
        & ~F.coalesce(F.col("x.pure") == F.col("y.pure"), F.lit(False))
    )
    pairs = x.join(y, F.col("x.grp") == F.col("y.grp")).where(fits).select(F.col("x.grp").alias("grp"), F.col("x.block").alias("left"), F.col("y.block").alias("right"))
    ends = pairs.select("*", F.explode(F.array_distinct(F.array("left", "right"))).alias("block"))
    ends = ends.withColumn("side", F.when(F.col("block") == F.col("left"), 0).otherwise(1))
    sent = ends.join(placed, ["grp", "block"]).select("left", "right", "side", "name", "label")
    full = sent.join(sets.select("name", "shingles"), "name")
    return tested.unionByName(full.groupBy("left", "right").applyInPandas(_tree_blocks(t), "a long, b long"))


def classes(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100, group_sets: int = GROUP_SETS, group_shingles: int = GROUP_SHINGLES) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id.

    Words are runs of characters other than 0x20 and 0x09-0x0D with A-Z
    lower-cased; fewer than ``k`` words are one shingle.  ``component_id`` is the
    least ``doc_id`` that can be reached over links, the own one included.
    """
    t = Threshold(num, den)
    steps = Steps(docs.sparkSession, "jaccard")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keys = shared_keys(steps, rows, k, t)
    hubs = keys.groupBy("key").agg(F.min("a").alias("b"))
    ties = steps.keep("ties", keys.join(hubs, "key").where("a <> b").select("a", "b").distinct())
    steps.drop("keys")
    group = steps.keep("groups", connected(ties, "a", "b").select(F.col("node").alias("name"), F.col("root").alias("grp")))
    named = steps.keep("names", rows.mapInArrow(_named(k), "doc_id long, n_shingles long, name long"))
    # of every set that is in a group: one row that has it
    one = named.where("doc_id is not null").join(group, "name").groupBy("name").agg(F.min("doc_id").alias("doc_id"), F.first("grp").alias("grp"), F.first("n_shingles").alias("n"))
    one = steps.keep("one", one)
    weight = one.groupBy("grp").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("weight"))
    heavy = (F.col("members") > group_sets) | (F.col("weight") > group_shingles)
    one = one.join(weight.where("members > 1").select("grp", heavy.alias("large")), "grp")
    # one pass over the texts for all groups; the same plan at every size
    texts = rows.join(one.hint("merge"), "doc_id").dropDuplicates(["doc_id", "name", "text"]).select("name", "grp", "large", "text")
    sets = steps.keep("sets", texts.mapInArrow(_with_sets(k), SETS))
    links = sets.where("not large").groupBy("grp").applyInPandas(_tree_group(t), "a long, b long")
    if one.where("large").limit(1).count():
        inside = ties.join(one.where("large").select(F.col("name").alias("a")), "a", "left_semi")
        links = links.unionByName(_large_links(sets.where("large"), inside, t, group_sets))
    links = steps.keep("links", links)
    steps.drop("sets", "ties", "groups", "one")
    label = connected(links, "a", "b")
    full = named.join(label, F.col("name") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("root", "name").alias("class"))
    counted = F.col("n_shingles") > 0
    least = full.where(counted).groupBy("class").agg(F.min("doc_id").alias("least"))
    component = F.when(counted, F.col("least")).otherwise(F.col("doc_id"))
    return full.join(least, "class", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
