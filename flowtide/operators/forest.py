"""A fitted forest as a table of nodes.

A stored forest is read back as one row per node: tree, node, feature and
threshold of its split (rows at or below it go left), its children, the weight of
the training rows that reached it, the gain of its split and the share of class 1
among its rows.  That table scores rows without the library that trained the
forest: ``score_nodes`` descends all trees at once over Arrow batches, once for
each cell between the forest's cuts that rows fall into, and the same table can be
descended by a recursive SQL query (``plans/sqlforest.py``).

The size of a node table is bounded by the forest's parameters (trees x
2^depth), not by the data, so it may be sent to every executor.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from .store import scratch_folder

NODE_COLUMNS = ["tree", "node", "feature", "threshold", "left_child", "right_child", "weight", "gain", "share"]


def node_table(spark: SparkSession, model_path: str) -> DataFrame:
    """The nodes of a stored binary forest; leaves have no feature, threshold or children."""
    n = spark.read.parquet(f"{model_path}/data").select(F.col("treeID").alias("tree"), "nodeData.*")
    inner = F.col("leftChild") >= 0
    weight = F.aggregate("impurityStats", F.lit(0.0), lambda a, x: a + x)
    of = lambda c: F.when(inner, c)
    return n.select(
        "tree",
        F.col("id").alias("node"),
        of(F.col("split.featureIndex")).alias("feature"),
        of(F.try_element_at("split.leftCategoriesOrThreshold", F.lit(1))).alias("threshold"),
        of(F.col("leftChild")).alias("left_child"),
        of(F.col("rightChild")).alias("right_child"),
        weight.alias("weight"),
        of(F.col("gain")).alias("gain"),
        F.try_divide(F.try_element_at("impurityStats", F.lit(2)), weight).alias("share"),
    )


#: Up to so many cells between a forest's cuts have their answers kept (8 bytes each).
MOST_CELLS = 1 << 22


def stored_nodes(spark: SparkSession, model) -> DataFrame:
    """The nodes of a fitted forest, which is stored for it."""
    path = scratch_folder(spark, "forest")
    model.write().save(path)
    return node_table(spark, path)


class NodeArrays:
    """All trees' nodes as flat arrays; a leaf is its own child.

    A tree compares a feature with its cuts alone, so all rows between the same cuts of
    every feature take the same way: a histogram forest of three features has 32^3 such
    cells at most, however many rows it scores.  A cell is descended when its first row
    comes and its answer is kept.
    """

    def __init__(self, nodes: pd.DataFrame):
        nodes = nodes.sort_values(["tree", "node"])
        at = {key: i for i, key in enumerate(zip(nodes["tree"], nodes["node"]))}
        leaf = nodes["feature"].isna().to_numpy()
        own = np.arange(len(nodes))
        child = lambda c: np.where(leaf, own, [at.get(k, 0) for k in zip(nodes["tree"], nodes[c].fillna(-1).astype(int))])
        self.left, self.right = child("left_child"), child("right_child")
        self.feature = nodes["feature"].fillna(0).astype(int).to_numpy()
        self.threshold = nodes["threshold"].fillna(np.inf).to_numpy()
        self.share = nodes["share"].to_numpy()
        self.roots = own[(nodes["node"] == 0).to_numpy()]
        inner = ~leaf
        self.cuts = [np.unique(self.threshold[inner & (self.feature == f)]) for f in range(self.feature.max(initial=0) + 1)]
        self.known = None

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Mean share of class 1 over the leaves that every row reaches."""
        size = tuple(len(c) + 1 for c in self.cuts)
        if math.prod(size) > MOST_CELLS:
            return self._descend(x)
        if self.known is None:
            self.known = np.full(math.prod(size), np.nan)
        # a missing value is above all cuts, as it goes right at every node
        cell = np.ravel_multi_index([np.searchsorted(c, x[:, f]) for f, c in enumerate(self.cuts)], size)
        new = np.flatnonzero(np.isnan(self.known[cell]))
        if len(new):
            cells, first = np.unique(cell[new], return_index=True)
            self.known[cells] = self._descend(x[new[first]])
        return self.known[cell]

    def _descend(self, x: np.ndarray, rows: int = 4096) -> np.ndarray:
        out = np.empty(len(x))
        for i in range(0, len(x), rows):
            part = x[i : i + rows]
            at = np.tile(self.roots, (len(part), 1))
            row = np.arange(len(part))[:, None]
            while True:
                new = np.where(part[row, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
                if (new == at).all():
                    break
                at = new
            out[i : i + rows] = self.share[at].mean(axis=1)
        return out


def score_nodes(df: DataFrame, nodes: DataFrame, features: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """``prob`` and ``pred`` of every row by descending the node table."""
    arrays = df.sparkSession.sparkContext.broadcast(NodeArrays(nodes.toPandas()))

    @F.pandas_udf("double")
    def probability(*columns: pd.Series) -> pd.Series:
        return pd.Series(arrays.value.probability(np.column_stack([c.to_numpy(float) for c in columns])))

    out = df.withColumn("prob", probability(*[F.col(c) for c in features or K.FEATURES]))
    return out.withColumn("pred", (F.col("prob") > threshold).cast("int"))


def node_importance(nodes: DataFrame, features: list[str] | None = None) -> DataFrame:
    """(feature, importance, rank): gain times weight, scaled per tree, then over trees."""
    features = features or K.FEATURES
    splits = nodes.where("feature is not null").groupBy("tree", "feature").agg(F.sum(F.col("gain") * F.col("weight")).alias("g"))
    totals = splits.groupBy("tree").agg(F.sum("g").alias("t")).where("t > 0")
    own = splits.join(totals, "tree").groupBy("feature").agg(F.sum(F.col("g") / F.col("t")).alias("g"))
    sums = {r["feature"]: r["g"] for r in own.collect()}  # a row per feature
    total = sum(sums.values()) or 1.0
    ranked = sorted(((f, float(sums.get(i, 0.0)) / total) for i, f in enumerate(features)), key=lambda r: -r[1])
    return nodes.sparkSession.createDataFrame([(f, v, i + 1) for i, (f, v) in enumerate(ranked)], "feature string, importance double, rank int")
