"""Near copies among embeddings by a pivot-permutation index.

Two vectors link if their cosine (in double precision) is at least ``threshold``.

**Index.**  A bounded sample of the rows (least hashes, ``SAMPLE``) is fetched to
choose reference points: *pivots*, no two of them close to each other, about
16 sqrt(rows) and at most ``PIVOTS``; and *centres* of dense places, around which
at least ``DENSE`` sampled rows lie within half the linking angle.  Every row is
then described by its ``NEAREST`` nearest pivots in order of distance, its centre
if it lies in the ball of half the linking angle around one, and the centres
within one and a half times that angle.

**Lists.**  Rows outside balls go to inverted pivot lists.  Similar vectors have
most pivots in common: pairs with ``SHARED`` common pivots are candidates.  A pair
with that many meets in one of the ``NEAREST - SHARED + 1`` lists that are rarest
for each of its rows, so only these are kept; it counts in the rarest list that
both have.  First the lists alone are joined; only rows with a candidate are sent
again with their vectors, to be verified.  The list of a common pivot is cut into
blocks, and pairs of blocks go to different tasks.

**Balls.**  Two members of a ball are within the linking angle (triangle
inequality), so a hot group of near copies or copies needs no pair at all: its
members' links are counted from the ball's size.  A member can only link to rows
within one and a half linking angles of the centre; these are verified against
the members, block by block.

Tasks return sums of links and a spanning set of them, never pairs.  The index is
approximate outside balls: at cosine 0.95 in 64 dimensions, ten nearest pivots of
which four are shared find about 97 to 99 % of pairs, and more of closer ones.

Rows: vectors that are null, empty, zero or hold null or non-finite components,
and rows without ``vec_id``, link with nothing.  Shorter vectors count as padded
with zeros.  Rows of equal ``vec_id`` are vectors of their own.  An empty table
gives no rows.  Other columns are ignored.

Bounds: the sample (``SAMPLE`` rows on the driver) and the reference points drawn
from it.  Beyond about 260,000 rows the number of pivots stops growing and lists
grow with the table; places that hold fewer than ``DENSE`` of ``SAMPLE`` rows
have no ball and are compared through lists.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import connected

SAMPLE = 16_384
PIVOTS = 8_192
NEAREST = 10
SHARED = 4
APART = 0.85
DENSE = 8
BLOCK = 1_024
ROUNDING = 1e-9


def units(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column as unit vectors of ``dim`` doubles."""
    lists = column.to_pylist() if column.null_count else None
    sizes = np.diff(column.offsets.to_numpy()) if lists is None else np.array([len(v or ()) for v in lists])
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float) if lists is None else np.array([c for v in lists for c in v or ()], float)
    out = np.zeros((len(sizes), dim))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    most = np.abs(out).max(axis=1, keepdims=True, initial=0)
    out /= np.where(most > 0, most, 1)
    return out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-300)


class Index:
    """Reference points and the angles that they decide."""

    def __init__(self, sample: np.ndarray, rows: int, threshold: float, pivots: int | None = None):
        angle = math.acos(threshold)
        self.dim = sample.shape[1]
        self.inside = math.cos(angle / 2) + ROUNDING
        self.beside = math.cos(min(math.pi, 1.5 * angle)) - ROUNDING
        self.pivots = sample[_apart(sample, min(PIVOTS, pivots or max(64, math.ceil(16 * math.sqrt(rows)))))]
        self.centres = sample[_dense(sample, self.inside)]

    def describe(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
        """Nearest pivots in order, ball (or -1) and centres nearby of every row."""
        k = min(NEAREST, len(self.pivots))
        cos = x @ self.pivots.T
        near = np.argpartition(-cos, k - 1, axis=1)[:, :k] if k < len(self.pivots) else np.tile(np.arange(k), (len(x), 1))
        order = np.lexsort((near, -np.take_along_axis(cos, near, axis=1)))
        near = np.take_along_axis(near, order, axis=1)
        if not len(self.centres):
            return near, np.full(len(x), -1), [[] for _ in x]
        cos = x @ self.centres.T
        best = cos.argmax(axis=1)
        ball = np.where(cos[np.arange(len(x)), best] >= self.inside, best, -1)
        close = cos >= self.beside
        close[np.arange(len(x)), best] &= ball < 0
        # of two balls, the pair is looked for in the one of lower number
        close &= (ball[:, None] < 0) | (np.arange(len(self.centres)) < ball[:, None])
        beside: list = [[] for _ in x]
        for i, j in zip(*(a.tolist() for a in np.nonzero(close))):
            beside[i].append(j)
        return near, ball, beside


def _apart(sample: np.ndarray, most: int) -> list[int]:
    """Rows in order of which none is close to an earlier one."""
    out: list[int] = []
    for i in range(len(sample)):
        if len(out) == most:
            break
        if not out or (sample[out] @ sample[i]).max() < APART:
            out.append(i)
    return out


def _dense(sample: np.ndarray, inside: float) -> list[int]:
    """Rows with ``DENSE`` sampled rows around them, the densest first, none in another's ball."""
    count = np.zeros(len(sample), int)
    for i in range(0, len(sample), 1024):
        count[i : i + 1024] = (sample[i : i + 1024] @ sample.T >= inside).sum(axis=1)
    free, out = np.ones(len(sample), bool), []
    for i in np.argsort(-count, kind="stable"):
        if count[i] < DENSE:
            break
        if free[i]:
            out.append(int(i))
            free &= sample @ sample[i] < inside
    return out


# ---- tasks -------------------------------------------------------------------
DESCRIBED = "row long, vec_id long, near array<int>, ball int, beside array<int>"


def _describe(index):
    schema = pa.schema([("row", pa.int64()), ("vec_id", pa.int64()), ("near", pa.list_(pa.int32())), ("ball", pa.int32()), ("beside", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, BLOCK):
                b = whole.slice(i, BLOCK)
                near, ball, beside = index.value.describe(units(b.column("e"), index.value.dim))
                yield pa.RecordBatch.from_arrays([b.column("row"), b.column("vec_id"), *(pa.array(c, f.type) for c, f in zip((near.tolist(), ball, beside), list(schema)[2:]))], schema=schema)

    return run


def shared(a: np.ndarray, b: np.ndarray, long: int = 4096) -> np.ndarray:
    """How many pivots every row of ``a`` has in common with every row of ``b``.

    Postings of one pivot meet each other: long ones one pivot at a time, all
    short ones in one go.
    """
    lists = []
    for s in (a, b):
        order = np.argsort(s, axis=None, kind="stable")
        pivot, first, size = np.unique(s.ravel()[order], return_index=True, return_counts=True)
        lists.append((order // s.shape[1], pivot, first, size))
    (rows_a, pivot_a, first_a, size_a), (rows_b, pivot_b, first_b, size_b) = lists
    _, x, y = np.intersect1d(pivot_a, pivot_b, assume_unique=True, return_indices=True)
    pairs = size_a[x] * size_b[y]
    out = np.zeros((len(a), len(b)), np.uint8)
    for i, j in zip(x[pairs > long], y[pairs > long]):
        out[np.ix_(rows_a[first_a[i] : first_a[i] + size_a[i]], rows_b[first_b[j] : first_b[j] + size_b[j]])] += 1
    x, y, pairs = x[pairs <= long], y[pairs <= long], pairs[pairs <= long]
    for k in range(0, len(x), 1000):
        i, j, n = x[k : k + 1000], y[k : k + 1000], pairs[k : k + 1000]
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        wide = np.repeat(size_b[j], n)
        left = rows_a[np.repeat(first_a[i], n) + at // wide]
        right = rows_b[np.repeat(first_b[j], n) + at % wide]
        out += np.bincount(left * len(b) + right, minlength=out.size).reshape(out.shape).astype(np.uint8)
    return out


def candidates(a: np.ndarray, b: np.ndarray, same: bool, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs with enough common pivots whose rarest common list is ``rank``.

    Rows of ``a`` and ``b`` are pivots' ranks in ascending order (rarest first).
    """
    need = min(SHARED, a.shape[1])
    i, j = np.nonzero(shared(a, b) >= need)
    if same:
        i, j = i[i < j], j[i < j]
    keep = np.zeros(len(i), bool)
    for at in range(0, len(i), 100_000):
        x, y = a[i[at : at + 100_000]], b[j[at : at + 100_000]]
        least = np.where((x[:, :, None] == y[:, None, :]).any(axis=2), x, np.iinfo(np.int32).max).min(axis=1)
        keep[at : at + 100_000] = least == rank
    return i[keep], j[keep]


def _matrix(column) -> np.ndarray:
    return np.stack(column.to_numpy(zero_copy_only=False)) if len(column) else np.zeros((0, 1), np.int32)


CELL = ["pivot", "ball", "low", "high"]
WANTED = "pivot int, ball int, low int, high int, side int, row long, node long, ranks array<int>"
_WANTED = pa.schema([*((c, pa.int32()) for c in (*CELL, "side")), ("row", pa.int64()), ("node", pa.int64()), ("ranks", pa.list_(pa.int32()))])


def _want(t: pa.Table) -> pa.Table:
    """Of a cell of a pivot list, the rows that have a candidate in it."""
    ranks, side = _matrix(t.column("ranks")), t.column("side").to_numpy()
    same = t.column("low")[0].as_py() == t.column("high")[0].as_py()
    at = [np.flatnonzero(side == 0)] * 2 if same else [np.flatnonzero(side == s) for s in (0, 1)]
    i, j = candidates(ranks[at[0]], ranks[at[1]], same, t.column("pivot")[0].as_py())
    return t.take(pa.array(np.union1d(at[0][i], at[1][j]))).select(_WANTED.names).cast(_WANTED)


FOUND = "row long, links long, node long, other long"
_FOUND = pa.schema([(c, pa.int64()) for c in ("row", "links", "node", "other")])


def _verify(dim: int, threshold: float):
    """Links of a cell: each row's number, and a node that it hangs on."""

    def run(t: pa.Table) -> pa.Table:
        x = units(t.column("e").combine_chunks(), dim)
        side, row, node = (t.column(c).to_numpy() for c in ("side", "row", "node"))
        a, b = (np.flatnonzero(side == s) for s in (0, 1))
        if t.column("ball")[0].as_py() < 0:
            ranks = _matrix(t.column("ranks"))
            same = t.column("low")[0].as_py() == t.column("high")[0].as_py()
            b = a if same else b
            i, j = candidates(ranks[a], ranks[b], same, t.column("pivot")[0].as_py())
            good = np.concatenate([np.einsum("ij,ij->i", x[a[i[k : k + 50_000]]], x[b[j[k : k + 50_000]]]) >= threshold for k in range(0, len(i), 50_000)] or [np.zeros(0, bool)])
            i, j = a[i[good]], b[j[good]]
        else:
            i, j = np.nonzero(x[a] @ x[b].T >= threshold)
            i, j = a[i], b[j]
        links = np.bincount(i, minlength=len(x)) + np.bincount(j, minlength=len(x))
        names, code = np.unique(node, return_inverse=True)
        least = _least(code[i], code[j], len(names))[code]
        own = np.flatnonzero(links > 0)
        return pa.Table.from_arrays([pa.array(c.astype(np.int64)) for c in (row[own], links[own], node[own], names[least[own]])], schema=_FOUND)

    return run


def _least(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The least member of everyone's component under the links (i, j)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


# ---- the job -----------------------------------------------------------------
def near_copies(vectors: DataFrame, threshold: float = 0.95, pivots: int | None = None, block: int = BLOCK) -> DataFrame:
    """Per row of ``vectors`` (vec_id, embedding): vec_id, n_links, component_id, kept."""
    e = F.col("embedding")
    finite = F.forall(e, lambda c: c.isNotNull() & (F.abs(c) < float("inf"))) & F.exists(e, lambda c: c != 0) & F.col("vec_id").isNotNull()
    rows = cut(vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.when(F.coalesce(finite, F.lit(False)), e).alias("e")))
    good = rows.where("e is not null")
    n, dim = good.agg(F.count(F.lit(1)), F.max(F.size("e"))).first()
    alone = rows.where("e is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    if not n:
        return alone
    sample = good.orderBy(F.xxhash64("e", "vec_id"), "row").limit(SAMPLE).select("e").toArrow()
    index = Index(units(sample.column("e").combine_chunks(), dim), n, threshold, pivots)
    sent = vectors.sparkSession.sparkContext.broadcast(index)
    told = cut(good.mapInArrow(_describe(sent), DESCRIBED))
    found = cut(_links(told, good, dim, threshold, block))
    return _report(told, found).unionByName(alone)


def _lists(length: list[int], ranks: dict[int, int], block: int):
    """Rows outside balls to the cells of the lists that they are kept in."""
    place = np.zeros(max(ranks, default=0) + 1, np.int32)
    place[list(ranks)] = list(ranks.values())
    schema = pa.schema([*_WANTED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            own = np.sort(place[_matrix(b.column("near"))], axis=1)
            out = []
            for row, mine in zip(b.column("row").to_pylist(), own):
                for r in _kept(mine).tolist():
                    blocks = -(-length[r] // block) if length else 1
                    at = row % blocks
                    out += [(r, -1, min(at, o), max(at, o), int(at > o), row, row, mine) for o in range(blocks)]
            for i in range(0, len(out), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[i : i + 20_000]), schema)], schema=schema)

    return run


def _kept(ranks: np.ndarray) -> np.ndarray:
    """A pair with ``SHARED`` common pivots has one among these of each of its rows."""
    return ranks[: len(ranks) - min(SHARED, len(ranks)) + 1]


def _links(told: DataFrame, good: DataFrame, dim: int, threshold: float, block: int) -> DataFrame:
    """Sums of links and spanning links of all cells.

    What the driver sees of lists and balls is one row per reference point.
    """
    lone = told.where("ball < 0").select("row", "near")
    counts = lone.select(F.explode("near").alias("p")).groupBy("p").count().collect()
    ranks = {r["p"]: k for k, r in enumerate(sorted(counts, key=lambda r: (r["count"], r["p"])))}
    kept = lone.mapInArrow(_lists([], ranks, block), WANTED).groupBy("pivot").count().collect()
    length = [0] * len(ranks)
    for r in kept:
        length[r["pivot"]] = r["count"]
    cells = lone.mapInArrow(_lists(length, ranks, block), WANTED)
    wanted = cells.groupBy(*CELL).applyInArrow(_want, WANTED)
    beside = told.select("row", _node().alias("node"), F.explode("beside").alias("ball"))
    balls = beside.groupBy("ball").agg(F.count(F.lit(1)).alias("others")).join(told.groupBy("ball").agg(F.count(F.lit(1)).alias("members")), "ball")
    balls = balls.select("ball", *[F.ceil(F.col(c) / block).cast("int").alias(c) for c in ("others", "members")])
    member = told.select("row", _node().alias("node"), "ball").join(F.broadcast(balls), "ball")
    other = beside.join(F.broadcast(balls), "ball")
    at = lambda c: (F.col("row") % F.col(c)).cast("int")
    all_of = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    member = member.select("ball", at("members").alias("low"), all_of("others").alias("high"), F.lit(0).alias("side"), "row", "node")
    other = other.select("ball", all_of("members").alias("low"), at("others").alias("high"), F.lit(1).alias("side"), "row", "node")
    near_balls = member.unionByName(other).withColumns({"pivot": F.lit(-1), "ranks": F.lit(None).cast("array<int>")})
    sent = wanted.unionByName(near_balls).join(good.select("row", "e"), "row")
    return sent.groupBy(*CELL).applyInArrow(_verify(dim, threshold), FOUND)


def _node():
    """Members of a ball are one node of the graph of links."""
    return F.when(F.col("ball") < 0, F.col("row")).otherwise(-1 - F.col("ball").cast("long"))


def _report(told: DataFrame, found: DataFrame) -> DataFrame:
    links = found.groupBy("row").agg(F.sum("links").alias("links"))
    root = cut(connected(found.select("node", "other"), "node", "other"))
    balls = told.where("ball >= 0").groupBy("ball").agg(F.count(F.lit(1)).alias("members"), F.min("vec_id").alias("first"))
    lone = told.where("ball < 0").select("row", "vec_id")
    firsts = lone.select(F.col("row").alias("node"), F.col("vec_id").alias("first")).unionByName(balls.select((-1 - F.col("ball").cast("long")).alias("node"), "first"))
    least = root.join(firsts, "node").groupBy("root").agg(F.min("first").alias("least"))
    component = cut(root.join(least, "root").select("node", "least"))
    # at most one row per centre
    balls = balls.join(component, F.col("node") == -1 - F.col("ball").cast("long"), "left").select("ball", "members", F.coalesce("least", "first").alias("component_id"))
    inside = told.where("ball >= 0").select("row", "vec_id", "ball").join(F.broadcast(balls), "ball").select("row", "vec_id", (F.col("members") - 1).alias("near"), "component_id")
    outside = lone.join(component, F.col("row") == F.col("node"), "left").select("row", "vec_id", F.lit(0).cast("long").alias("near"), F.coalesce("least", "vec_id").alias("component_id"))
    out = inside.unionByName(outside).join(links, "row", "left")
    return out.select("vec_id", (F.col("near") + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
