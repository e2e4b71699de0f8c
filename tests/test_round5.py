"""Legacy engineering keeps only what it uses; states and the best action do nothing twice."""

import pytest
from pyspark.sql import functions as F

from flowtide.functions import constants as K
from flowtide.operators import features as feat_ops
from flowtide.operators import whatif as wi
from flowtide.plans import catalog

ROW = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"


@pytest.fixture
def folder(spark, tmp_path):
    r = spark.range(300)
    c = {n: F.col("id") for n in ("l_orderkey", "l_partkey", "l_suppkey")} | {
        "l_linenumber": F.col("id") % 7, "l_quantity": F.col("id") % 50 + 1.0, "l_extendedprice": 900.0 + F.col("id") * 37 % 5000,
        "l_discount": F.col("id") % 11 / 100.0, "l_tax": F.col("id") % 9 / 100.0, "l_returnflag": F.lit("R"), "l_linestatus": F.lit("O"),
        "l_shipdate": F.timestamp_seconds(F.col("id") * 86400),
    }
    r.select(*[c[x.split()[0]].cast(x.split()[1]).alias(x.split()[0]) for x in ROW.split(", ")]).write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def test_legacy_index_keeps_used_columns_and_serves_the_quantile(spark, folder, monkeypatch):
    kept, fitted = [], []
    index, fit = feat_ops.ordered_index, feat_ops.quantiles
    monkeypatch.setattr(feat_ops, "ordered_index", lambda df, *a: kept.append(df.columns) or index(df, *a))
    monkeypatch.setattr(feat_ops, "quantiles", lambda df, *a, **k: fitted.append(df.columns) or fit(df, *a, **k))
    assert catalog.QUERIES["legacy_engineered"](spark, folder).count() == 300
    assert set(kept[0]) == {*catalog.FLOW_KEYS, *catalog.FLOW_ORDER, *K.FEATURES, "latency_norm", "throughput_norm"}
    assert "_idx" in fitted[0]  # the rows that the index kept, not the table again


def test_states_fit_no_target(spark, folder, monkeypatch):
    def never(*_a, **_k):
        raise AssertionError("no state depends on the target")

    monkeypatch.setattr(feat_ops, "fit_target", never)
    assert catalog.states(spark, folder).count() == 300


def test_best_reward_is_the_reward_of_the_best_action(spark):
    cells = [(a, t, s, w, p) for a in (6.0, 900.0, 4800.0, None) for t in (11.0, 400.0) for s in (0.0, 0.4) for w in (20.0, 95.0) for p in (0.05, 0.6)]
    rows = spark.createDataFrame(cells, "_lat double, _tp double, _loss double, _load double, _prob double")
    g = wi.greedy_action(rows, reward="best")
    lat, tp, loss, load, p = (F.col(c) for c in wi.STATE)
    e = wi._effect(F.col("_act"), lat, tp, loss, load)
    again = wi._reward(F.col("_act"), p, wi._prob(e["lat"], e["loss"], e["tp"]), lat, e["lat"], tp, e["tp"])
    got = g.select("best", again.alias("again"), "_act").collect()
    assert len(got) == 64 and all(r["best"] == r["again"] and r["_act"] for r in got)
