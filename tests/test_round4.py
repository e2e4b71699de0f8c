"""Findings of round 3: caps apart from splits, what-if policies without logs, joins without a hot task."""

from pyspark.sql import functions as F

from flowtide.operators import ml


def test_capped_training_rows_reach_both_sides_of_the_validation_split(spark):
    n = 40_000
    df = spark.range(n).select("id", (F.col("id") % 5000).cast("double").alias("latency"), F.lit(0.5).alias("throughput"), F.lit(0.1).alias("packet_loss"), (F.col("id") % 4 == 0).cast("int").alias("congestion"))
    train, test = ml.training_tables(df, ["id"], max_train_rows=2000)
    part, valid = ml.split(train, ["id"], seed=ml.K.MODEL_SEED)
    assert 1990 <= train.count() <= 2000 and 0.15 < test.count() / n < 0.25
    assert 1400 < part.count() < 1800 and 200 < valid.count() < 600
    assert {r[0] for r in part.select("congestion").distinct().collect()} == {0, 1}
    weights = {r[0]: r[1] for r in train.groupBy("congestion").agg(F.sum("weight")).collect()}
    assert abs(weights[0] - weights[1]) < 1e-6
    train.unpersist()


def test_forests_keep_the_rows_nodes_between_levels(spark, monkeypatch):
    seen = {}

    class Spy(ml.RandomForestClassifier):
        def fit(self, train):
            seen["kept"] = self.getCacheNodeIds()

    monkeypatch.setattr(ml, "RandomForestClassifier", Spy)
    ml.fit_forest(spark.range(1), ml.K.RF_CANDIDATES[0])
    assert seen["kept"] and spark.sparkContext.getCheckpointDir()


def test_a_class_is_not_joined_in_one_task(spark, monkeypatch):
    from flowtide.operators import analytics, profile

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(4000).select((F.col("id") % 4 == 0).cast("int").alias("congestion"), F.log1p(F.col("id") % 1000).alias("log_latency"))
        df = df.withColumn("log_throughput", F.col("log_latency"))
        box, density = analytics.boxplot_stats(df), analytics.density_by_class(df)
        joins = [line for d in (box, density) for line in d._jdf.queryExecution().toString().splitlines() if "Join" in line]
        assert any("BroadcastHashJoin" in line for line in joins[:20])
        assert "SortMergeJoin" not in box._jdf.queryExecution().executedPlan().toString()
        want = [sorted(map(tuple, d.collect())) for d in (box, density)]
        monkeypatch.setattr(profile, "BROADCAST_GROUPS", 0)  # as if there were many groups
        got = [sorted(map(tuple, d.collect())) for d in (analytics.boxplot_stats(df), analytics.density_by_class(df))]
        assert got[0] == want[0] and len(got[1]) == len(want[1]) == 200
        assert all(abs(a[3] - b[3]) < 1e-9 for a, b in zip(got[1], want[1]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_priority_action_against_plain_python(spark):
    import random

    from flowtide.functions import constants as K
    from flowtide.operators import whatif as wi

    rng = random.Random(4)
    acts = ["reduce_load", "reroute_traffic", "increase_bandwidth", "rebalance_towers"]
    rows = []
    for i in range(1500):
        n = rng.randrange(5)
        rows.append((i, rng.uniform(0, 2.5) * K.PRIORITY_LATENCY_ABOVE, rng.uniform(0.2, 2) * K.PRIORITY_MBPS_BELOW, rng.choice([None, 0.0, 2.0]), rng.uniform(0, 100), rng.choice([0.01, 0.9]), rng.choice(acts) if n > 1 else None, rng.choice(acts) if n else None, n))
    df = spark.createDataFrame(rows, "id int, _lat double, _tp double, _loss double, _load double, _prob double, _h1 string, _h2 string, _n int")
    got = {r["id"]: r for r in wi.priority_action(df).collect()}
    for i, lat, tp, loss, load, prob, h1, h2, n in rows:
        tests = [loss is not None and loss > K.PRIORITY_LOSS_ABOVE, lat > K.PRIORITY_LATENCY_ABOVE, tp < K.PRIORITY_MBPS_BELOW, load > K.PRIORITY_LOAD_ABOVE]
        found = [a for a, t in zip(acts, tests) if t] or list(K.PRIORITY_FALLBACK)
        fresh = [a for a in found if n < 2 or a not in (h1, h2)]
        act = "do_nothing" if prob < K.IDLE_BELOW else (fresh or [found[n % len(found)]])[0]
        assert got[i]["_act"] == act
        assert got[i]["_n"] == (0 if act == "do_nothing" else min(n + 1, K.HISTORY_CAP))


def test_action_lists_need_no_step_logs(spark):
    from flowtide.operators import whatif as wi

    df = spark.createDataFrame([(900.0, 200.0, 0.4, 80.0, 0.7)], "a double, b double, c double, d double, e double")
    p = wi.project(df, *"abcde", steps=3)
    assert "reward_before" not in p.columns and "latency_before" not in p.select("actions")._jdf.queryExecution().optimizedPlan().toString()
    row = p.select("actions", "log").first()
    assert row["actions"] == [s["action"] for s in row["log"]]
