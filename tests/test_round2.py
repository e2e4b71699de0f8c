"""Ordered index, CSV layouts, coercion, label padding, ties, model attribution."""

import pytest
from pyspark.sql import functions as F

from flowtide.functions.columns import to_number
from flowtide.operators.explain import model_attribution
from flowtide.operators.features import label_target, risk_target
from flowtide.operators.window import IDX, ordered_index
from flowtide.sources.flows import read_flow_csv, require_columns


@pytest.mark.parametrize("parts", [2, 5, 50])
def test_ordered_index_keeps_null_nan_and_tied_keys(spark, parts):
    nan = float("nan")
    rows = [(None, i) for i in range(7)] + [(nan, i) for i in range(7)] + [(1.0, i) for i in range(40)] + [(2.0, 0), (-3.0, 1)]
    df = spark.createDataFrame(rows, "k double, t int").repartition(4)
    out, n = ordered_index(df, ["k", "t"], partitions=parts)
    got = [(r["k"], r["t"]) for r in out.orderBy(IDX).collect()]
    assert n == len(rows) and sorted(r[IDX] for r in out.collect()) == list(range(n))
    want = [(None, i) for i in range(7)] + [(-3.0, 1)] + [(1.0, i) for i in range(40)] + [(2.0, 0)]
    assert got[: len(want)] == want
    assert [t for _, t in got[len(want) :]] == list(range(7))


def test_two_layouts_read_alike_on_every_path(spark, tmp_path):
    (tmp_path / "a.csv").write_text(" Flow Duration,Flow Bytes/s\n300,5\n")
    (tmp_path / "b.csv").write_text("Flow Bytes/s, Flow Duration\n7,400\n")
    want = {(300, 5), (400, 7)}
    for path in (str(tmp_path), f"file://{tmp_path}", [f"{tmp_path}/a.csv", f"file://{tmp_path}/b.csv"], f"{tmp_path}/*.csv"):
        got = read_flow_csv(spark, path)
        assert {(int(r["flow_duration"]), int(r["flow_bytes_s"])) for r in got.collect()} == want
    typed = read_flow_csv(spark, str(tmp_path), schema="flow_bytes_s double, flow_duration double, label string")
    assert {(r["flow_duration"], r["flow_bytes_s"], r["label"]) for r in typed.collect()} == {(300.0, 5.0, None), (400.0, 7.0, None)}
    with pytest.raises(ValueError, match="label"):
        require_columns(got, ["label"])


def test_number_suffixes_are_not_numbers(spark):
    df = spark.createDataFrame([("12d",), ("3f",), (" 12 ",), ("1e3",), ("abc",), (None,)], "s string")
    assert [r[0] for r in df.select(to_number("s")).collect()] == [None, None, 12.0, 1000.0, None, None]


def test_label_padding_of_any_white_space(spark):
    df = spark.createDataFrame([("\tBENIGN", 0.0), ("benign\r", 0.0), ("DDoS", 0.0), (None, 0.0), ("BENIGN", 0.3)], "label string, packet_loss double")
    assert [r["congestion"] for r in label_target(df, "label").collect()] == [0, 0, 1, 1, 1]


def test_equal_scores_mark_a_quarter(spark):
    df = spark.createDataFrame([(0.5, i) for i in range(40)], "congestion_score double, k int")
    assert risk_target(df).where("congestion = 1").count() == 10
    assert {r["k"] for r in risk_target(df, tie_col=["k"]).where("congestion = 1").collect()} == set(range(10))


def test_model_attribution_adds_up_without_shuffle(spark):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    df = spark.range(200).select((F.col("id") * 25.0).alias("latency"), ((F.col("id") % 7) / 7.0).alias("throughput"), ((F.col("id") % 5) / 5.0).alias("packet_loss"), (F.col("id") > 100).cast("double").alias("label"))
    names = ["latency", "throughput", "packet_loss"]
    model = RandomForestClassifier(numTrees=5, seed=1).fit(VectorAssembler(inputCols=names, outputCol="features").transform(df))
    out = model_attribution(df, model)
    worst = out.select(F.max(F.abs(F.col("phi_latency") + F.col("phi_throughput") + F.col("phi_packet_loss") - (F.col("f_x") - F.col("base_value"))))).first()[0]
    assert worst < 1e-9
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
