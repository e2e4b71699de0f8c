"""Feature building on fixed small inputs."""

from flowtide.functions.constants import FEATURES
from flowtide.operators.features import build_features, create_features, legacy_engineered


def test_normalised_features_and_flag(spark):
    raw = spark.createDataFrame(
        [(100, 1000, 10, 0), (200, 900, 15, 1), (300, 700, 20, 2), (400, 500, 25, 3), (500, 300, 30, 4)],
        "flow_duration long, flow_bytes_s long, flow_packets_s long, rid long",
    )
    rows = build_features(raw, ["rid"]).collect()
    assert len(rows) == 5
    assert all(0.0 <= r[c] <= 1.0 for r in rows for c in ("latency_norm", "throughput_norm", "packet_loss"))
    assert all(r["congestion_flag"] in (0, 1) for r in rows)


def test_single_row_keeps_its_inputs(spark):
    row = spark.createDataFrame([(0.5, 0.7, 0.2, 0)], "latency double, throughput double, packet_loss double, rid long")
    (r,) = legacy_engineered(row, ["rid"]).collect()
    assert (r["latency"], r["throughput"], r["packet_loss"]) == (0.5, 0.7, 0.2)
    assert r["load_ratio"] is not None and r["packet_intensity"] is not None


def test_slow_flows_are_the_congested_quarter(spark):
    rows = list(
        zip(
            [100, 120, 150, 250, 5000, 8000, 12000, 16000],
            [10, 12, 14, 18, 80, 100, 150, 200],
            [10, 11, 12, 15, 30, 20, 5, 0],
            [100000, 90000, 75000, 60000, 2000, 1000, 300, 50],
            range(8),
        )
    )
    raw = spark.createDataFrame(rows, "flow_duration long, total_fwd_packets long, total_backward_packets long, flow_bytes_s long, rid long")
    f = create_features(raw, tie_col="rid").orderBy("rid").collect()
    assert [r["rid"] for r in f] == list(range(8))
    assert [r["congestion"] for r in f] == [0, 0, 0, 0, 0, 0, 1, 1]
    assert f[7]["latency"] == max(r["latency"] for r in f) <= 5000
    assert f[7]["throughput"] == min(r["throughput"] for r in f) >= 0
    assert all(0 <= r["packet_loss"] <= 1 for r in f) and f[0]["packet_loss"] < f[7]["packet_loss"]
    assert all(len({r[c] for r in f}) > 1 for c in FEATURES)
