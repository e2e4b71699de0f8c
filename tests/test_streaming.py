"""Stateless stream scoring with a batch-fitted profile equals batch scoring."""

from pyspark.sql import functions as F

from flowtide.operators.features import apply_feature_profile, fit_feature_profile, raw_kpis, with_risk_score
from flowtide.sources import flows_from_lineitem, read_table
from flowtide.streaming import score_stream

SF = "/root/testdata/sf0.001"


def test_stream_scores_match_batch(spark):
    li = read_table(spark, SF, "lineitem")
    prof = fit_feature_profile(raw_kpis(flows_from_lineitem(li)))
    stream = spark.readStream.schema(li.schema).option("pathGlobFilter", "lineitem.parquet").parquet(SF)
    q = (
        score_stream(flows_from_lineitem(stream), prof)
        .select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "prob", "alert_level")
        .writeStream.format("memory").queryName("scored_flows").outputMode("append").start()
    )
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT * FROM scored_flows")
    batch = with_risk_score(apply_feature_profile(raw_kpis(flows_from_lineitem(li)), prof), "prob")
    assert got.count() == batch.count() == li.count()
    g = got.agg(F.sum("prob")).collect()[0][0]
    b = batch.agg(F.sum("prob")).collect()[0][0]
    assert abs(g - b) < 1e-6
    assert {r[0] for r in got.select("alert_level").distinct().collect()} <= {"Normal", "Warning", "Critical"}
