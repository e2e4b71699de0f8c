"""CSV flow source: header stripping, canonical names, stacking files by name."""

from flowtide.operators.clean import coerce_numeric
from flowtide.sources import read_flow_csv


def test_read_flow_csv_stacks_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text(" Flow Duration , Flow Bytes/s , Label\n100,1000,BENIGN\n200,abc, DDoS\n")
    (tmp_path / "b.csv").write_text("Flow Bytes/s,Flow Duration,Flow Packets/s\n5,300,7\n")
    df = read_flow_csv(spark, str(tmp_path))
    assert set(df.columns) == {"flow_duration", "flow_bytes_s", "label", "flow_packets_s"}
    rows = sorted(coerce_numeric(df, ["flow_duration", "flow_bytes_s", "flow_packets_s"]).collect(), key=lambda r: r["flow_duration"])
    assert [r["flow_duration"] for r in rows] == [100.0, 200.0, 300.0]
    assert rows[1]["flow_bytes_s"] is None  # junk text becomes missing
    assert rows[2]["label"] is None and rows[2]["flow_packets_s"] == 7.0
    assert rows[0]["flow_packets_s"] is None


def test_empty_folder_is_an_error(spark, tmp_path):
    import pytest

    with pytest.raises(FileNotFoundError):
        read_flow_csv(spark, str(tmp_path))
