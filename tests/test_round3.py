"""Scans and jobs counted, grouped quantiles, lazy and stored profiles, stores that notice
changes, header discovery, uploads with bad lines, stored metrics of many runs."""

import json
import time
import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowtide.functions import constants as K
from flowtide.operators import analytics as an
from flowtide.operators import features as fe
from flowtide.operators import ml, quality
from flowtide.operators.clean import cascade_cuts, clean_raw_flows
from flowtide.operators.profile import Profile, RowProfile, grouped_quantiles, quantiles
from flowtide.operators.store import fingerprint, stored_table
from flowtide.sources.flows import accepted, csv_layouts, quarantined, read_flow_csv, read_upload


class Counted:
    """A table that counts how often it is read."""

    def __init__(self, spark, df):
        self.rows, kept = df.count(), df.persist()
        kept.count()
        self.seen = spark.sparkContext.accumulator(0)

        def look(batches, seen=self.seen):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        self.df = kept.mapInArrow(look, kept.schema)

    @property
    def scans(self):
        return self.seen.value / self.rows


def jobs(spark, work):
    """Jobs that ``work`` starts, and its result."""
    sc, group = spark.sparkContext, uuid.uuid4().hex
    sc.setJobGroup(group, "")
    out = work()
    time.sleep(0.3)
    return len(sc.statusTracker().getJobIdsForGroup(group)), out


def flows(spark, n=4000, seed=1):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({
        "flow_duration": rng.exponential(1e4, n), "total_fwd_packets": rng.integers(0, 200, n).astype(float), "total_backward_packets": rng.integers(0, 60, n).astype(float),
        "flow_bytes_s": rng.lognormal(8, 2, n), "flow_packets_s": rng.choice([1.0, 5.0, 70.0], n) * rng.random(n),
    })
    return spark.createDataFrame(pdf).repartition(3), pdf


@pytest.mark.parametrize("cap", [20, 10**6])
def test_any_quantiles_take_two_scans(spark, cap):
    df, pdf = flows(spark)
    t = Counted(spark, df)
    qs = [0.01, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.995]
    got = quantiles(t.df, {c: (c, qs) for c in pdf.columns}, collect_cap=cap)
    assert t.scans == 2
    for c in pdf.columns:
        assert got[c] == pytest.approx(list(pdf[c].quantile(qs)), rel=1e-12)
    few = Counted(spark, df)
    assert quantiles(few.df, {"d": ("flow_duration", [0.0, 1.0])})["d"] == [pdf["flow_duration"].min(), pdf["flow_duration"].max()]
    assert few.scans == 1  # extremes need no second look


def test_cleaning_takes_three_scans(spark):
    df, pdf = flows(spark)
    for c in ("flow_duration", "flow_bytes_s", "flow_packets_s"):
        pdf = pdf[pdf[c] <= pdf[c].quantile(K.CLEAN_CUT_Q)]
    t = Counted(spark, df)
    assert clean_raw_flows(t.df).count() == len(pdf)
    assert t.scans == 3


@pytest.mark.parametrize("q", [0.0, 0.3, 0.9, 1.0])
def test_cuts_follow_each_other_at_any_level(spark, q):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"a": rng.integers(0, 30, 500).astype(float), "b": -rng.random(500), "c": np.round(rng.normal(0, 2, 500), 1)})
    got, left = cascade_cuts(spark.createDataFrame(pdf), ["a", "b", "c"], q), pdf
    for c in "abc":
        assert got[c] == pytest.approx(left[c].quantile(q))
        left = left[left[c] <= got[c]]
    assert cascade_cuts(spark.createDataFrame(pdf).limit(0), ["a", "b"], q) == {}


def test_kpi_summary_is_one_fit_and_one_aggregate(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"latency": rng.random(300) * 5000, "throughput": rng.random(300), "packet_loss": rng.random(300), "congestion": rng.integers(0, 2, 300)})
    pdf.loc[[3, 9], "latency"] = np.nan
    for rows in (pdf, pdf[:2]):
        t = Counted(spark, spark.createDataFrame(rows))
        got = an.kpi_summary(t.df).first()
        own = rows.dropna()
        lat, tp = (own[c].clip(upper=own[c].quantile(0.99)) for c in ("latency", "throughput"))
        want = [len(own), 3, len(rows) - len(own), own["congestion"].mean() * 100, lat.mean(), tp.mean(), lat.quantile(0.75), tp.quantile(0.25)]
        assert list(got) == pytest.approx(want) and t.scans <= 3


@pytest.mark.parametrize("window", [1, 50, 10_000])
def test_grouped_quantiles_of_many_and_hot_groups(spark, window):
    rng = np.random.default_rng(7)
    n = 6000
    group = np.where(rng.random(n) < 0.4, 0, rng.integers(1, 120, n))
    value = np.where(rng.random(n) < 0.2, 3.0, rng.lognormal(0, 3, n) * rng.choice([-1, 1], n))
    pdf = pd.DataFrame({"g": group, "h": group % 2, "v": value})
    t = Counted(spark, spark.createDataFrame(pdf).repartition(5))
    qs = [0.0, 0.25, 1 / 3, 0.5, 0.99, 1.0]
    got = {(r["g"], r["h"]): (r["n"], [r[f"q{i}"] for i in range(len(qs))]) for r in grouped_quantiles(t.df, ["g", "h"], "v", qs, window_rows=window).collect()}
    assert t.scans == 2
    want = {k: (len(v), list(v.quantile(qs))) for k, v in pdf.groupby(["g", "h"])["v"]}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], rel=1e-12)


def test_box_plots_of_any_classes(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"kind": rng.choice(list("abcde"), 900), "x": rng.standard_cauchy(900)})
    df = spark.createDataFrame(pdf).unionByName(spark.createDataFrame([(None, 1.0), ("a", None), ("z", None)], "kind string, x double"))
    out = an.boxplot_stats(df.withColumnRenamed("kind", "c"), "x", "c")
    assert out.count() == 5
    for r in out.collect():
        v = pdf[pdf["kind"] == r["c"]]["x"]
        q1, q3 = v.quantile(0.25), v.quantile(0.75)
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        assert [r["n"], r["q1"], r["median"], r["q3"], r["whisker_low"], r["whisker_high"], r["outliers"]] == pytest.approx(
            [len(v), q1, v.median(), q3, v[v >= lo].min(), v[v <= hi].max(), ((v < lo) | (v > hi)).sum()]
        )
    density = an.density_by_class(df.withColumnRenamed("kind", "c"), "x", "c", grid=10)
    assert density.groupBy("c").count().count() == 5


def test_distinct_counts_without_expand(spark, capsys):
    rows = [(float(i % 7), i % 3 / 2, 0.5) for i in range(50)] + [(float("nan"), None, 0.5)]
    df = spark.createDataFrame(rows, "latency double, throughput double, packet_loss double")
    for report in (quality.feature_distribution(df), quality.feature_quality(df)):
        report.explain()
        assert "Expand" not in capsys.readouterr().out
        assert {r["feature"]: r["nunique"] for r in report.collect()} == {"latency": 7, "throughput": 3, "packet_loss": 1}
    assert {r["feature"]: r["ok"] for r in quality.feature_quality(df).collect()} == {"latency": True, "throughput": True, "packet_loss": False}
    assert {r["feature"]: r["nunique"] for r in quality.distinct_counts(df, K.FEATURES, "approx").collect()} == {"latency": 7, "throughput": 3, "packet_loss": 1}
    assert quality.feature_quality(df.limit(0)).where("ok").count() == 0


@pytest.mark.parametrize("loss", [False, True])
def test_a_given_profile_starts_no_job(spark, tmp_path, loss):
    df, _ = flows(spark)
    if loss:
        df = df.withColumn("packet_loss", F.col("flow_packets_s") + 20)
    prof = fe.fit_profile(df)
    want = sorted(map(tuple, fe.create_features(df).collect()))
    prof.save(spark, f"{tmp_path}/p")
    again = Profile.load(spark, f"{tmp_path}/p")
    assert {k: v for k, v in prof.values.items() if v is not None} == again.values
    stored = spark.read.parquet(f"{tmp_path}/p")  # the listing and schema are read here
    for p in (prof, again, RowProfile(stored)):
        n, out = jobs(spark, lambda p=p: fe.create_features(df, profile=p))
        assert n == 0
        got = sorted(map(tuple, out.collect()))
        assert len(got) == len(want) and np.allclose(np.array(got, float), np.array(want, float), rtol=1e-12)


def test_a_stored_profile_scores_other_flows_on_the_old_scales(spark, tmp_path):
    old, _ = flows(spark)
    fe.fit_profile(old).save(spark, f"{tmp_path}/p")
    new, _ = flows(spark, seed=2)
    lazy = fe.create_features(new, profile=RowProfile.load(spark, f"{tmp_path}/p"))
    eager = fe.create_features(new, profile=fe.fit_profile(old))
    a, b = (np.array(sorted(map(tuple, t.collect())), float) for t in (lazy, eager))
    assert a.shape == b.shape and np.allclose(a, b, rtol=1e-12)
    assert lazy.agg(F.max("latency")).first()[0] == 5000.0


def test_a_stored_table_notices_changed_files(spark, tmp_path):
    made, folder = [], f"{tmp_path}/in"

    def build():
        made.append(1)
        return spark.read.parquet(folder).groupBy().agg(F.sum("id").alias("s"))

    get = lambda: stored_table(spark, f"sum-{tmp_path.name}", [folder], build).first()["s"]
    spark.range(10).write.parquet(folder)
    assert (get(), get(), len(made)) == (45, 45, 1)
    first = fingerprint(spark, [folder])
    spark.range(10, 12).coalesce(1).write.mode("append").parquet(folder)
    assert (get(), get(), len(made)) == (66, 66, 2)
    time.sleep(1.1)
    spark.range(12).write.mode("overwrite").parquet(folder)
    assert (get(), len(made)) == (66, 3)
    assert len({first, fingerprint(spark, [folder]), fingerprint(spark, [folder], settings=2)}) == 3


def test_headers_of_many_files_in_one_job(spark, tmp_path):
    for i in range(40):
        head = "a, Flow Duration" if i % 2 else "Flow Duration,b"
        (tmp_path / f"f{i:02}.csv").write_text(f"{head}\n" + "".join(f"{i},{j}\n" for j in range(500 if i == 7 else 3)))
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "bom.csv").write_text("\n﻿a, Flow Duration\n5,6\n")
    (tmp_path / "other.txt").write_text("x\n")
    n, found = jobs(spark, lambda: csv_layouts(spark, str(tmp_path)))
    assert n <= 2  # adaptive execution runs a shuffle and its result as two
    assert {k: len(v) for k, v in found.items()} == {("a", " Flow Duration"): 21, ("Flow Duration", "b"): 20}
    (tmp_path / "bom.csv").unlink()
    df = read_flow_csv(spark, str(tmp_path))
    assert set(df.columns) == {"a", "b", "flow_duration"} and df.count() == 39 * 3 + 500
    with pytest.raises(FileNotFoundError):
        read_flow_csv(spark, [f"{tmp_path}/empty.csv"])


def test_uploads_keep_bad_lines_apart(spark, tmp_path):
    (tmp_path / "a.csv").write_text("latency,throughput , packet_loss,note\n10,0.5,0.1,x\nabc,0.5,0.1,y\n1,,NaN,z\n5,0.5\n7,0.1,0.2,q,extra\n8,0.25,0.75,\n")
    (tmp_path / "b.csv").write_text("throughput,packet_loss,latency,tower_load\n0.1,0.2,30,12\n0.1,0.2,31,?\n")
    up = read_upload(spark, str(tmp_path), K.FEATURES, {"tower_load": 70.0})
    good = {(r["latency"], r["throughput"], r["packet_loss"], r["tower_load"]) for r in accepted(up).collect()}
    assert good == {(10.0, 0.5, 0.1, 70.0), (8.0, 0.25, 0.75, 70.0), (30.0, 0.1, 0.2, 12.0), (31.0, 0.1, 0.2, 70.0)}
    bad = sorted((r["problem"], r["raw_line"]) for r in quarantined(up).collect())
    assert bad == [("malformed line", "5,0.5"), ("malformed line", "7,0.1,0.2,q,extra"), ("no number: latency", "abc,0.5,0.1,y"), ("no number: throughput, packet_loss", "1,,NaN,z")]
    assert [r["latency"] for r in read_upload(spark, f"{tmp_path}/a.csv", K.FEATURES, row_cap=2).collect()] == [10.0, None]
    with pytest.raises(ValueError, match="tower_load"):
        read_upload(spark, str(tmp_path), [*K.FEATURES, "tower_load"])


def test_metrics_of_many_runs_are_one_table(spark, tmp_path):
    good = {"tp": 5, "fp": 1, "fn": 0, "tn": 9, "accuracy": 0.93, "precision": 0.83, "recall": 1.0, "f1": 0.9}
    ml.save_metrics(spark, good, f"{tmp_path}/one")
    ml.save_metrics(spark, good | {"accuracy": 0.4}, f"{tmp_path}/two")
    spark.createDataFrame([("{torn",)], "value string").coalesce(1).write.text(f"{tmp_path}/three")
    spark.createDataFrame([(json.dumps({"tp": 1}),)], "value string").coalesce(1).write.text(f"{tmp_path}/four")
    got = {r["run"]: (r["accuracy"], r["passed"], r["problem"]) for r in ml.gate_runs(ml.metric_runs(spark, str(tmp_path))).collect()}
    assert got == {"one": (0.93, True, None), "two": (0.4, False, None), "three": (None, False, "malformed"), "four": (None, False, "no accuracy")}


@pytest.mark.parametrize("kind", ["double", "float", "int", "string", "decimal(9,2)", "boolean"])
def test_numbers_of_every_type(spark, kind):
    from flowtide.functions.columns import to_number

    df = spark.range(2).selectExpr(f"CAST(CASE WHEN id = 0 THEN 1 END AS {kind}) AS x")
    assert sorted((r[0] for r in df.select(to_number("x")).collect()), key=str) == [1.0, None]
    assert ("RLIKE" in df.select(to_number("x").alias("n"))._jdf.queryExecution().optimizedPlan().toString()) == (kind == "string")
