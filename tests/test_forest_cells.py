"""Scores by a forest's nodes: one descent for each cell between its cuts."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowtide.functions import constants as K
from flowtide.operators import explain as ex
from flowtide.operators import forest as fo
from flowtide.operators import ml


@pytest.fixture(scope="module")
def fitted(spark):
    u = lambda seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(10_007)) / 10_007.0
    df = spark.range(3000).select("id", (u(1) * 5000).alias("latency"), u(2).alias("throughput"), u(3).alias("packet_loss"))
    df = df.withColumn("congestion", ((F.col("latency") / 5000 + F.col("packet_loss") + 0.4 * u(4)) > 1.2).cast("int"))
    train = ml.with_class_weights(ml.assemble(df))
    model = ml.fit_forest(train, {"numTrees": 15, "maxDepth": 7, "minInstancesPerNode": 2})
    return df, model, fo.stored_nodes(spark, model).toPandas()


def test_rows_descend_by_cells_not_one_by_one(fitted, monkeypatch):
    nodes = fo.NodeArrays(fitted[2])
    rng = np.random.default_rng(5)
    some = np.column_stack([rng.uniform(0, 5000, 300), rng.random(300), rng.random(300)])
    edge = np.array([[c, nodes.cuts[1][0], nodes.cuts[2][-1]] for c in nodes.cuts[0]])
    odd = np.array([[np.nan, 0.5, 0.5], [100.0, np.nan, np.nan], [np.inf, -np.inf, 0.2], [-1.0, 2.0, -3.0]])
    x = np.vstack([some, edge, np.nextafter(edge, np.inf), odd])
    want = nodes._descend(x)
    went = []
    descend = fo.NodeArrays._descend
    monkeypatch.setattr(fo.NodeArrays, "_descend", lambda self, x, *a: went.append(len(x)) or descend(self, x, *a))
    for _ in range(50):  # as many batches of the same rows
        assert np.array_equal(nodes.probability(x), want)
    assert went and sum(went) <= len(x)
    monkeypatch.setattr(fo, "MOST_CELLS", 10)  # too many cells to keep
    assert np.array_equal(nodes.probability(x), want)


def test_a_forest_without_a_split(spark):
    leaf = {"tree": [0, 1], "node": [0, 0], **{c: [np.nan] * 2 for c in ("feature", "threshold", "left_child", "right_child", "gain")}, "weight": [2.0, 2.0], "share": [0.25, 0.75]}
    nodes = fo.NodeArrays(pd.DataFrame(leaf))
    assert nodes.probability(np.zeros((3, 3))).tolist() == [0.5] * 3


def test_attribution_equals_the_models_own_scores(spark, fitted):
    """Eight transforms of the model, as the values were made before."""
    df, model, nodes = fitted
    bg = ex.background(df)
    df = df.limit(200).withColumn("packet_loss", F.when(F.col("id") % 50 != 0, F.col("packet_loss")))
    got = ex.model_attribution(df, model, bg)
    assert got._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    given = ex.model_attribution(df, model, bg, spark.createDataFrame(nodes))
    rows = got.toPandas().set_index("id").sort_index()
    assert rows.equals(given.toPandas().set_index("id").sort_index())
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    v = {}
    for m in ex.MASKS:
        t = df.withColumns({c: F.col(c) if on else F.lit(bg[c]) for c, on in zip(K.FEATURES, m)})
        t = model.transform(VectorAssembler(inputCols=K.FEATURES, outputCol="features", handleInvalid="keep").transform(t))
        v[m] = t.select("id", vector_to_array("probability")[1].alias("p")).toPandas().set_index("id").sort_index()["p"]
    for i, c in enumerate(K.FEATURES):
        want = sum(ex._weight(m, i) * (v[tuple(1 if j == i else m[j] for j in range(3))] - v[m]) for m in ex.MASKS if not m[i])
        assert np.allclose(rows[f"phi_{c}"], want, atol=1e-12)
    assert np.allclose(rows["f_x"], v[1, 1, 1], atol=1e-12) and np.allclose(rows["base_value"], v[0, 0, 0], atol=1e-12)
