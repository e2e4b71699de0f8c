"""Random forests of large tables, grown from the counts of binned rows.

A histogram forest cuts every feature into at most ``MAX_BINS`` bins before it grows.
From then on a row counts by its bins and class alone, so the rows of a table, however
many, are told by the count of each (bins, class) cell: at most 32^3 x 2 numbers.  Every
row is counted, in two scans: one finds where the bins are cut, one counts the cells.
A row's bootstrap count in a tree is Poisson(1), so a cell of n rows has Poisson(n).

Trees grow by pyspark's rules (bins of equal weight, Gini gain, sqrt feature subsets
drawn for each node, ``minInstancesPerNode`` on unweighted counts, leaves of one
prediction merged), one task for some trees, each with a random stream of its own: a
forest depends neither on files nor on cores.  It is stored as pyspark stores a forest
and read back as pyspark's model.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from .profile import magnitude
from .store import scratch_folder

#: pyspark's default
MAX_BINS = 32
#: A fixed bin with more than this part of the weight is cut once more, into as many parts.
FINE, PARTS = 1 / 1024, 64
#: Column of a cell table: the rows that a cell stands for.
ROWS = "_rows"


@dataclass
class Cells:
    """Rows counted by bins: ``cuts`` of every feature, ``bins`` and ``rows`` (by class) of every cell."""

    cuts: list
    bins: np.ndarray
    rows: np.ndarray

    def table(self, spark: SparkSession, target: str) -> DataFrame:
        """A row for each cell and class that has rows: a point of the cell, the class and ``ROWS``."""
        at, y = np.nonzero(self.rows)
        point = [np.append(c, c[-1] + 1.0 if len(c) else 0.0)[b] for c, b in zip(self.cuts, self.bins[at].T)]
        rows = list(zip(*[p.tolist() for p in point], y.tolist(), self.rows[at, y].tolist()))
        df = spark.createDataFrame(rows, ", ".join([*(f"{c} double" for c in K.FEATURES), f"{target} int", f"{ROWS} long"]))
        return VectorAssembler(inputCols=K.FEATURES, outputCol="features").transform(df)


def count_cells(rows: DataFrame, side: str, weights: tuple[float, float], target: str) -> tuple[Cells, Cells, Cells]:
    """The cells of ``rows`` on one side, of those on the other (by the first one's cuts), and of all (by their own).

    ``side`` names a column that is true for the rows of the first.
    """
    narrow = rows.select(*K.FEATURES, F.col(target).cast("int").alias("y"), F.col(side).alias("first")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        own, every = find_cuts(narrow, weights)
        counted = _count(narrow, own, every)
    finally:
        narrow.unpersist()
    return counted


def find_cuts(rows: DataFrame, weights: tuple[float, float]) -> tuple[list, list]:
    """Cuts of every feature into bins of equal weight: by the rows that are ``first``, and by all."""
    tall = rows.select("y", "first", F.posexplode(F.array(*K.FEATURES)).alias("t", "x")).withColumn("bin", magnitude(F.col("x")))
    measures = [F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")]
    coarse = pd.DataFrame([tuple(r) for r in tall.groupBy("t", "bin", "y", "first").agg(*measures).collect()], columns=["t", "bin", "y", "first", "n", "lo", "hi"])
    coarse["w"] = coarse["n"] * np.asarray(weights)[coarse["y"]]
    heavy = coarse.groupby(["t", "bin"]).agg(w=("w", "sum"), lo=("lo", "min"), hi=("hi", "max")).reset_index()
    heavy = heavy[(heavy["w"] > FINE * heavy.groupby("t")["w"].transform("sum")) & (heavy["lo"] < heavy["hi"])]
    coarse["part"] = 0
    if len(heavy):
        wide = rows.sparkSession.createDataFrame(
            [(int(t), int(b), float(lo), float(hi)) for t, b, lo, hi in zip(heavy["t"], heavy["bin"], heavy["lo"], heavy["hi"])], "t int, bin long, _lo double, _hi double"
        )
        part = F.least(F.floor((F.col("x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * PARTS), F.lit(PARTS - 1).cast("long")).alias("part")
        # at most 1 / FINE bins of each feature
        fine = tall.join(F.broadcast(wide), ["t", "bin"]).groupBy("t", "bin", "y", "first", part).agg(*measures)
        fine = pd.DataFrame([tuple(r) for r in fine.collect()], columns=["t", "bin", "y", "first", "part", "n", "lo", "hi"])
        fine["w"] = fine["n"] * np.asarray(weights)[fine["y"]]
        was = pd.MultiIndex.from_frame(coarse[["t", "bin"]]).isin(pd.MultiIndex.from_frame(heavy[["t", "bin"]]))
        coarse = pd.concat([coarse[~was], fine])

    def cuts(some: pd.DataFrame) -> list:
        steps = some.groupby(["t", "bin", "part"]).agg(w=("w", "sum"), lo=("lo", "min"), hi=("hi", "max")).reset_index()
        return [equal_cuts(*steps[steps["t"] == t].sort_values("lo")[["lo", "hi", "w"]].to_numpy(float).T) for t in range(len(K.FEATURES))]

    return cuts(coarse[coarse["first"]]), cuts(coarse)


def equal_cuts(lo: np.ndarray, hi: np.ndarray, w: np.ndarray) -> np.ndarray:
    """At most ``MAX_BINS`` - 1 cuts between rising steps of values (``lo`` to ``hi``, weight ``w``), of about equal weight."""
    between = (hi[:-1] + lo[1:]) / 2.0
    if len(between) < MAX_BINS:
        return between
    stride, total, goal, found = w.sum() / MAX_BINS, 0.0, 1, []
    for i, own in enumerate(w):
        # the step that would take the weight further from the goal begins the next bin
        if i and abs(total - goal * stride) < abs(total + own - goal * stride):
            found.append(between[i - 1])
            goal = max(goal, int(total / stride + 0.5)) + 1
        total += own
    return np.asarray(found[: MAX_BINS - 1])


def _count(rows: DataFrame, own: list, every: list) -> tuple[Cells, Cells, Cells]:
    sizes = [tuple(len(c) + 1 for c in cuts) for cuts in (own, every)]
    span = 2 * max(math.prod(s) for s in sizes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(3 * span, np.int64)  # a third each: the first side, the other, all
        for batch in batches:
            x = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(own))]
            y, first = (batch.column(i).to_numpy(zero_copy_only=False) for i in (len(own), len(own) + 1))
            at = [2 * np.ravel_multi_index([np.searchsorted(c, v) for c, v in zip(cuts, x)], size) + y for cuts, size in zip((own, every), sizes)]
            counts += np.bincount(np.concatenate([at[0] + np.where(first, 0, span), at[1] + 2 * span]), minlength=3 * span)
        cell = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(counts[cell])], names=["cell", "n"])

    found = rows.select(*K.FEATURES, "y", "first").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(3 * span, np.int64)
    counts[found["cell"].to_numpy()] = found["n"].to_numpy()

    def cells(part: int, cuts: list, size: tuple) -> Cells:
        by_class = counts[part * span : (part + 1) * span].reshape(-1, 2)
        used = np.flatnonzero(by_class.any(axis=1))
        return Cells(cuts, np.column_stack(np.unravel_index(used, size)), by_class[used])

    return cells(0, own, sizes[0]), cells(1, own, sizes[0]), cells(2, every, sizes[1])


def gini(stats: np.ndarray) -> np.ndarray:
    total = stats.sum(axis=-1)
    share = stats / np.where(total > 0, total, 1.0)[..., None]
    return np.where(total > 0, 1.0 - (share**2).sum(axis=-1), 0.0)


def grow(cells: Cells, weights: tuple[float, float], max_depth: int, min_rows: int, rng: np.random.Generator) -> pd.DataFrame:
    """One tree's nodes in the order of their numbers (a node, its left branch, its right branch)."""
    n_features, w = len(cells.cuts), np.asarray(weights)
    drawn = rng.poisson(cells.rows)
    kept = drawn.any(axis=1)
    drawn, bins = drawn[kept], cells.bins[kept]
    tried = math.ceil(math.sqrt(n_features))
    levels, at = [], np.zeros(len(drawn), np.int64)  # each cell's place among the open nodes
    raw = drawn.sum(axis=0, keepdims=True)
    open_ = np.ones(1, bool)
    while True:
        k = len(raw)
        stats = raw * w
        level = {"raw": raw, "feature": np.full(k, -1), "cut": np.full(k, -1), "gain": np.full(k, -1.0), "left": np.full(k, -1)}
        levels.append(level)
        spread = np.flatnonzero(open_) if len(levels) <= max_depth else np.empty(0, int)
        if not len(spread):
            break
        place = np.full(k, -1)
        place[spread] = np.arange(len(spread))
        mine = place[at] >= 0
        at, drawn, bins = place[at[mine]], drawn[mine], bins[mine]
        among = rng.random((len(spread), n_features)).argsort(axis=1) < tried
        best, feature, cut = np.full(len(spread), -np.inf), np.zeros(len(spread), int), np.zeros(len(spread), int)
        whole, parent, total = raw[spread][:, None, :], gini(stats[spread])[:, None], stats[spread].sum(axis=1)[:, None]
        for f, cuts in enumerate(cells.cuts):
            if not len(cuts):
                continue
            size = len(cuts) + 1
            hist = np.stack([np.bincount(at * size + bins[:, f], weights=drawn[:, c], minlength=len(spread) * size).reshape(-1, size) for c in (0, 1)], axis=-1)
            left = hist.cumsum(axis=1)[:, :-1]
            right = whole - left
            gain = parent - ((left * w).sum(axis=-1) * gini(left * w) + (right * w).sum(axis=-1) * gini(right * w)) / total
            fits = (left.sum(axis=-1) >= min_rows) & (right.sum(axis=-1) >= min_rows) & among[:, f, None]
            gain = np.where(fits, gain, -np.inf)
            i = gain.argmax(axis=1)
            top = gain[np.arange(len(spread)), i]
            better = top > best
            best, feature, cut = np.where(better, top, best), np.where(better, f, feature), np.where(better, i, cut)
        splits = best > 0
        node = spread[splits]
        level["feature"][node], level["cut"][node], level["gain"][node] = feature[splits], cut[splits], best[splits]
        level["left"][node] = 2 * np.arange(len(node))
        child = np.full(len(spread), -1)
        child[splits] = level["left"][node]
        on = child[at] >= 0
        at, drawn, bins = at[on], drawn[on], bins[on]
        at = child[at] + (bins[np.arange(len(at)), feature[at]] > cut[at])
        raw = np.stack([np.bincount(at, weights=drawn[:, c], minlength=2 * len(node)) for c in (0, 1)], axis=-1).astype(np.int64)
        open_ = gini(raw * w) > np.finfo(float).eps
        if not len(node):
            break
    return _numbered(cells.cuts, levels, w)


def _numbered(cuts: list, levels: list[dict], w: np.ndarray) -> pd.DataFrame:
    """Levels of nodes as one table: leaves of one prediction merged, numbered branch by branch."""
    size = None
    for level, below in zip(reversed(levels), [None, *reversed(levels)]):
        level["prediction"] = (level["raw"] * w).argmax(axis=1)
        level["size"] = np.ones(len(level["raw"]), np.int64)
        i = np.flatnonzero(level["left"] >= 0)
        if len(i):
            l, r = level["left"][i], level["left"][i] + 1
            one = (below["left"][l] < 0) & (below["left"][r] < 0) & (below["prediction"][l] == below["prediction"][r])
            level["left"][i[one]] = -1
            level["size"][i[~one]] += size[l[~one]] + size[r[~one]]
        size = level["size"]
    out, number, live = [], np.zeros(1, np.int64), np.zeros(1, np.int64)
    for level, below in zip(levels, [*levels[1:], None]):
        inner = level["left"][live] >= 0
        pick = lambda name, other: np.where(inner, level[name][live], other)
        left = level["left"][live]
        after = np.where(inner, number + 1 + (below["size"][left] if below is not None and len(below["size"]) else 0), -1)
        stats = level["raw"][live] * w
        f, c = pick("feature", -1), pick("cut", 0)
        out.append(
            pd.DataFrame(
                {
                    "id": number, "prediction": level["prediction"][live].astype(float), "impurity": gini(stats), "w0": stats[:, 0], "w1": stats[:, 1],
                    "raw": level["raw"][live].sum(axis=1), "gain": pick("gain", -1.0), "left": np.where(inner, number + 1, -1), "right": after,
                    "feature": f, "threshold": [float(cuts[i][j]) if i >= 0 else math.nan for i, j in zip(f, c)],
                }
            )
        )
        number = np.column_stack([number[inner] + 1, after[inner]]).ravel()
        live = np.column_stack([left[inner], left[inner] + 1]).ravel()
        if not len(live):
            break
    return pd.concat(out).sort_values("id")


_NODES = "tree int, id int, prediction double, impurity double, w0 double, w1 double, raw long, gain double, left int, right int, feature int, threshold double"


def fit_cells(spark: SparkSession, cells: Cells, weights: tuple[float, float], params: dict, target: str, seed: int = K.MODEL_SEED) -> RandomForestClassificationModel:
    """The forest of the counted rows, as pyspark's model."""
    trees, depth, least = params["numTrees"], params["maxDepth"], params["minInstancesPerNode"]
    counted = spark.sparkContext.broadcast(cells)

    def some(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for tree in batch["id"]:
                nodes = grow(counted.value, weights, depth, least, np.random.default_rng([seed, int(tree)]))
                yield nodes.assign(tree=int(tree))[[c.split()[0] for c in _NODES.split(", ")]]

    tasks = min(trees, max(16, spark.sparkContext.defaultParallelism))
    nodes = spark.range(0, trees, 1, tasks).mapInPandas(some, _NODES)
    leaf = F.col("left") < 0
    split = F.struct(
        F.col("feature").alias("featureIndex"),
        F.when(leaf, F.array().cast("array<double>")).otherwise(F.array("threshold")).alias("leftCategoriesOrThreshold"),
        F.lit(-1).alias("numCategories"),
    )
    data = F.struct(
        "id", "prediction", "impurity", F.array("w0", "w1").alias("impurityStats"), F.col("raw").alias("rawCount"), "gain",
        F.col("left").alias("leftChild"), F.col("right").alias("rightChild"), split.alias("split"),
    )
    path = scratch_folder(spark, "forest-of-cells")
    _shell(spark, params, target, seed).write().save(path)
    nodes.select(F.col("tree").alias("treeID"), data.alias("nodeData")).write.mode("overwrite").parquet(f"{path}/data")
    return RandomForestClassificationModel.load(path)


def _shell(spark: SparkSession, params: dict, target: str, seed: int) -> RandomForestClassificationModel:
    """A forest with the right parameters, classes and number of trees, whose nodes are then replaced."""
    two = spark.createDataFrame([(*[0.0] * len(K.FEATURES), 0), (*[1.0] * len(K.FEATURES), 1)], ", ".join([*(f"{c} double" for c in K.FEATURES), f"{target} int"]))
    rf = RandomForestClassifier(
        featuresCol="features", labelCol=target, numTrees=params["numTrees"], maxDepth=params["maxDepth"],
        minInstancesPerNode=params["minInstancesPerNode"], featureSubsetStrategy="sqrt", seed=seed,
    )
    return rf.fit(VectorAssembler(inputCols=K.FEATURES, outputCol="features").transform(two.coalesce(1)))
