"""Exact feature attribution (Shapley values) for three-feature scoring functions.

With three features there are 8 coalitions, so exact Shapley values are a
fixed linear combination of 8 function evaluations per row (weights 1/3,
1/6, 1/6, 1/3 over the four coalition pairs of each feature).  An absent
feature takes the table mean (one global aggregate).  For a column-expression
score (the risk score) the 8 evaluations are 8 column expressions: a pure
projection, no shuffle.  For a fitted forest they are 8 descents of its nodes
(``forest.NodeArrays``) over Arrow batches.
"""

from __future__ import annotations

import math
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.columns import risk_score
from .forest import NodeArrays, stored_nodes

MASKS = list(product([0, 1], repeat=3))  # (latency, throughput, packet_loss) present?


def _weight(mask_without: tuple, i: int) -> float:
    size = sum(mask_without)
    return {0: 1 / 3, 1: 1 / 6, 2: 1 / 3}[size]


def background(df: DataFrame) -> dict:
    r = df.agg(*[F.avg(c).alias(c) for c in K.FEATURES]).collect()[0]
    return {c: r[c] for c in K.FEATURES}


def local_attribution(df: DataFrame, bg: dict | None = None) -> DataFrame:
    """Per-row exact Shapley values of the risk score; adds ``phi_*``, ``base_value``, ``f_x``."""
    bg = bg or background(df)
    vals = {}
    for m in MASKS:
        args = [F.col(c) if present else F.lit(bg[c]) for c, present in zip(K.FEATURES, m)]
        vals[m] = risk_score(*args)
    t = df.withColumns({f"_v{''.join(map(str, m))}": e for m, e in vals.items()})
    v = {m: F.col(f"_v{''.join(map(str, m))}") for m in MASKS}
    phis = {}
    for i, c in enumerate(K.FEATURES):
        terms = []
        for m in MASKS:
            if m[i] == 1:
                continue
            with_i = tuple(1 if j == i else m[j] for j in range(3))
            terms.append(F.lit(_weight(m, i)) * (v[with_i] - v[m]))
        phis[f"phi_{c}"] = terms[0] + terms[1] + terms[2] + terms[3]
    t = t.withColumns({**phis, "base_value": v[(0, 0, 0)], "f_x": v[(1, 1, 1)]})
    return t.drop(*[f"_v{''.join(map(str, m))}" for m in MASKS])


def global_attribution(attributed: DataFrame) -> DataFrame:
    """Mean |phi| per feature, ranked (one aggregate, stacked to 3 rows)."""
    one = attributed.agg(*[F.avg(F.abs(F.col(f"phi_{c}"))).alias(c) for c in K.FEATURES])
    structs = [F.struct(F.lit(c).alias("feature"), F.col(c).alias("mean_abs_attribution")) for c in K.FEATURES]
    out = one.select(F.inline(F.array(*structs)))
    from pyspark.sql import Window

    # three rows: a global window is trivially small here
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.col("mean_abs_attribution").desc(), "feature")).cast("long"))


def model_attribution(df: DataFrame, model, bg: dict | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """Exact Shapley values of a fitted forest's class-1 probability.

    Adds ``phi_*``, ``base_value`` and ``f_x``.  Every row's 8 coalition inputs descend the
    forest's nodes (``nodes``: their table, where the model is stored already): a
    projection, with no shuffle and no key.
    """
    bg = bg or background(df)
    mean = [math.nan if bg[c] is None else float(bg[c]) for c in K.FEATURES]
    arrays = df.sparkSession.sparkContext.broadcast(NodeArrays((stored_nodes(df.sparkSession, model) if nodes is None else nodes).toPandas()))
    names = ["v" + "".join(map(str, m)) for m in MASKS]

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def coalitions(*columns: pd.Series) -> pd.DataFrame:
        x = [c.to_numpy(float, na_value=math.nan) for c in columns]
        absent = [np.full(len(c), v) for c, v in zip(x, mean)]
        scores = [arrays.value.probability(np.column_stack([own if present else other for own, other, present in zip(x, absent, m)])) for m in MASKS]
        return pd.DataFrame(dict(zip(names, scores)))

    t = df.withColumn("_coalitions", coalitions(*[F.col(c).cast("double") for c in K.FEATURES]))
    v = {m: F.col("_coalitions").getField(n) for m, n in zip(MASKS, names)}
    phis = {}
    for i, c in enumerate(K.FEATURES):
        phi = F.lit(0.0)
        for m in MASKS:
            if m[i] == 0:
                phi = phi + F.lit(_weight(m, i)) * (v[tuple(1 if j == i else m[j] for j in range(3))] - v[m])
        phis[f"phi_{c}"] = phi
    return t.withColumns({**phis, "base_value": v[(0, 0, 0)], "f_x": v[(1, 1, 1)]}).drop("_coalitions")
