"""Quantile selection on hard inputs; bounded, reproducible fits; stored models and metrics."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowtide.operators import ml
from flowtide.operators.profile import quantiles

SMALL = [{"numTrees": 8, "maxDepth": 4, "minInstancesPerNode": 2}]


@pytest.mark.parametrize("cap", [1, 40, 10**6])
def test_quantiles_of_wide_tied_and_tiny_values(spark, cap):
    rng, n = np.random.default_rng(3), 4000
    data = {
        "wide": np.exp(rng.normal(0, 60, n)),
        "tied": np.where(rng.random(n) < 0.6, 7.0, rng.normal(0, 1, n)),
        "far": np.concatenate([[-1e308, 1e308, 5e-324, 0.0], rng.normal(0, 1e-200, n - 4)]),
        "gap": np.concatenate([np.full(n // 2, -1.0), np.full(n // 2, 1.0)]),
    }
    df = spark.createDataFrame(pd.DataFrame(data)).repartition(3)
    qs = [0, 0.001, 0.25, 1 / 3, 0.5, 0.99, 1.0]
    got = quantiles(df, {k: (k, qs) for k in data}, collect_cap=cap, bins=32)
    for k, v in data.items():
        v = np.sort(v)
        for q, x in zip(qs, got[k]):
            lo = math.floor((n - 1) * q)
            hi = min(lo + 1, n - 1) if (n - 1) * q > lo else lo
            assert x == (v[lo] if v[lo] == v[hi] or lo == hi else v[lo] + (v[hi] - v[lo]) * ((n - 1) * q - lo))
        assert (got[k + "__min"], got[k + "__max"], got[k + "__n"]) == (v[0], v[-1], n)


def test_exact_quantiles_have_no_sketch(spark, monkeypatch):
    monkeypatch.setattr(F, "percentile_approx", None)
    df = spark.createDataFrame([(None,), (float("nan"),)], "x double")
    assert quantiles(df, {"x": ("x", [0.5])}) == {"x__n": 0, "x__min": None, "x__max": None, "x": [None]}


def rows(spark, parts):
    r = spark.range(3000).repartition(parts)
    late = (F.col("id") * 1.6).alias("latency")
    loss = (F.pmod(F.xxhash64("id"), F.lit(100)) / 100.0).alias("packet_loss")
    df = r.select("id", late, (1 - (F.col("id") % 10) / 10.0).alias("throughput"), loss)
    return df.withColumn("congestion", ((F.col("latency") > 2400) | (F.col("packet_loss") > 0.8)).cast("int"))


def test_cap_keeps_shares_and_bound(spark):
    df = rows(spark, 3)
    have = {r[0]: r[1] for r in df.groupBy("congestion").count().collect()}
    cut = ml.stratified_cap(df, ["id"], 500)
    got = {r[0]: r[1] for r in cut.groupBy("congestion").count().collect()}
    assert got == {c: 500 * n // 3000 for c, n in have.items()}
    assert ml.stratified_cap(df, ["id"], 3000).count() == ml.stratified_cap(df, ["id"], 0).count() == 3000


def test_fit_is_reproducible_stored_and_gated(spark, tmp_path):
    a, b = (ml.fit_selected(rows(spark, p), ["id"], SMALL) for p in (2, 7))
    score = lambda model: [r["prob"] for r in ml.predict(model, a.test).orderBy("id").collect()]
    want = score(a.model)
    assert score(b.model) == want and a.train.count() + a.test.count() == 3000
    weights = {r[0]: r[1] for r in a.train.groupBy("congestion").agg(F.sum("weight")).collect()}
    assert weights[0] == pytest.approx(weights[1])  # balanced on the training rows alone
    ml.save_model(a.model, f"{tmp_path}/model")
    assert score(ml.load_model(f"{tmp_path}/model")) == want
    metrics = ml.evaluate(a.model, a.test)
    assert metrics["accuracy"] > 0.9
    ml.save_metrics(spark, metrics, f"{tmp_path}/metrics")
    kept = ml.load_metrics(spark, f"{tmp_path}/metrics")
    assert kept == metrics
    ml.validate_metrics(kept)
    with pytest.raises(ValueError, match="below"):
        ml.validate_metrics(kept | {"accuracy": 0.5})
    floors = {r["feature"]: r for r in ml.importance_floors(spark, a.model).collect()}
    assert floors["latency"]["ok"] and not floors["throughput"]["ok"]  # the target does not use it
    with pytest.raises(ValueError, match="throughput"):
        ml.learning_gate(spark, a.model)
    a.release(), b.release()
