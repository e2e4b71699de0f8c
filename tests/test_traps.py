"""Semantic traps: missing values, infinities, strict thresholds, terciles."""

import math

import numpy as np
from pyspark.sql import functions as F

from flowtide.functions.columns import alert_tier, clip, finite, to_number
from flowtide.operators.features import label_target
from flowtide.operators.profile import order_statistics, quantiles
from flowtide.operators.towers import tower_segments


def test_clip_keeps_missing(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (-float("inf"),), (-3.0,), (7.0,), (2.0,)], "x double")
    got = [r[0] for r in df.select(clip("x", 0.0, 5.0)).collect()]
    assert got[0] is None and got[1] is None
    assert got[2:] == [5.0, 0.0, 0.0, 5.0, 2.0]


def test_coercion_and_finite(spark):
    df = spark.createDataFrame([(" 12 ",), ("abc",), ("Infinity",), ("NaN",), (None,)], "s string")
    got = [r[0] for r in df.select(to_number("s")).collect()]
    assert got[0] == 12.0 and got[1] is None and got[2] == float("inf") and got[3] is None and got[4] is None
    fin = [r[0] for r in df.select(finite(to_number("s"))).collect()]
    assert fin == [12.0, None, None, None, None]


def test_null_label_counts_as_attack(spark):
    df = spark.createDataFrame([(None, 0.0), (" benign ", 0.0), ("DDoS", 0.0), ("BENIGN", 0.31)], "label string, packet_loss double")
    got = [r[0] for r in label_target(df, "label").select("congestion").collect()]
    assert got == [1, 0, 1, 1]


def test_tiers_are_strict(spark):
    df = spark.createDataFrame([(0.40,), (0.4000001,), (0.70,), (0.7000001,)], "p double")
    assert [r[0] for r in df.select(alert_tier(F.col("p"))).collect()] == ["Normal", "Warning", "Warning", "Critical"]


def test_exact_quantiles_match_linear_interpolation(spark):
    rng = np.random.default_rng(7)
    vals = np.concatenate([rng.lognormal(size=5000), np.full(3000, 2.5), [np.inf, np.nan]])
    df = spark.createDataFrame([(float(v),) for v in vals], "x double").repartition(4)
    qs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]
    clean = vals[np.isfinite(vals)]
    want = np.quantile(clean, qs)
    for cap in (100_000, 50):  # second run forces the histogram narrowing path
        got = quantiles(df, {"x": ("x", qs)}, collect_cap=cap)["x"]
        assert np.allclose(got, want, rtol=0, atol=1e-12), (cap, got, want)
    ks = order_statistics(df, {"x": ("x", [0, 4000, 7999])}, collect_cap=50)["x"]
    assert ks == sorted(clean)[0:1] + [sorted(clean)[4000], sorted(clean)[7999]]


def test_terciles_are_not_ntile(spark):
    for n, sizes in [(5, [2, 1, 2]), (7, [2, 2, 3])]:
        df = spark.createDataFrame([(float(i), i) for i in range(n)], "throughput double, rid long")
        seg = tower_segments(df, "throughput", ["rid"]).groupBy("tower").count().orderBy("tower").collect()
        assert [r["count"] for r in seg] == sizes


def test_tied_terciles_fall_back_to_first_come_ranks(spark):
    df = spark.createDataFrame([(1.0, i) for i in range(6)], "throughput double, rid long")
    seg = tower_segments(df, "throughput", ["rid"]).orderBy("rid").collect()
    assert [r["tower"] for r in seg] == ["A", "A", "B", "B", "C", "C"]
