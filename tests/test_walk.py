"""What-if steps on Arrow batches against the column expressions, and rounding without big decimals."""

import random

import pytest
from pyspark.sql import functions as F

from flowtide.functions.columns import rounded
from flowtide.operators import whatif as wi

STEPS = 5


def states(spark):
    rng = random.Random(8)
    maybe = lambda v: None if rng.random() < 0.04 else v
    rows = [
        (i, maybe(rng.choice([5.0, 100.0, 200.0, rng.uniform(5, 5000)])), maybe(rng.choice([10.0, 300.0, 700.0, rng.uniform(10, 1000)])),
         maybe(rng.choice([0.0, 0.1, 1.0, rng.random()])), maybe(rng.choice([10.0, 65.0, 80.0, rng.uniform(10, 100)])), maybe(rng.choice([0.0, 0.08, 0.75, rng.random()])))
        for i in range(400)
    ]
    return spark.createDataFrame(rows, "id int, a double, b double, c double, d double, e double").coalesce(2)


def by_expressions(df, policy):
    """The steps one by one, each read from the one before."""
    t = df.select("id", *[F.col(c).alias(s) for c, s in zip("abcde", wi.STATE)], F.lit(None).cast("string").alias("_h1"), F.lit(None).cast("string").alias("_h2"), F.lit(0).alias("_n"))
    logs = []
    for s in range(1, STEPS + 1):
        if policy == "priority":
            t = wi.priority_action(t)
        elif policy == "greedy":
            t = wi.greedy_action(t)
        elif policy == "random":
            t = wi.random_action(t, ["id"], s)
        else:
            t = t.withColumn("_act", wi.rule_action_expr(*(F.col(c) for c in wi.STATE)) if policy == "rule" else F.lit("do_nothing"))
        lat, tp, loss, load, p = (F.col(c) for c in wi.STATE)
        new = wi._effect(F.col("_act"), lat, tp, loss, load)
        t = t.withColumns({f"new_{k}": v for k, v in new.items()})
        t = t.withColumn("new_p", wi._prob(F.col("new_lat"), F.col("new_loss"), F.col("new_tp")))
        t = t.withColumn("_rew", wi._reward(F.col("_act"), p, F.col("new_p"), lat, F.col("new_lat"), tp, F.col("new_tp"))).localCheckpoint()
        after = ["new_lat", "new_tp", "new_loss", "new_load", "new_p"]
        logs += [(r["id"], s, (s, r["_act"], *(r[c] for c in after), r["_rew"], *(r[c] for c in wi.STATE))) for r in t.collect()]
        t = t.select("id", *[F.col(c).alias(s_) for c, s_ in zip(after, wi.STATE)], "_h1", "_h2", "_n")
    return logs


@pytest.mark.parametrize("policy", ["priority", "greedy", "random", "rule", "nothing"])
def test_steps_equal_the_column_expressions(spark, policy):
    df = states(spark)
    got = {r["id"]: r for r in wi.project(df, *"abcde", policy=policy, steps=STEPS, key_cols=["id"]).collect()}
    total = dict.fromkeys(got, 0.0)
    for i, s, want in by_expressions(df, policy):
        assert tuple(got[i]["log"][s - 1]) == want, (i, s)
        assert got[i]["actions"][s - 1] == want[1]
        total[i] += want[7]
        if s == STEPS:
            assert tuple(got[i][f"final_{c}"] for c in ("latency", "throughput", "packet_loss", "tower_load", "prob")) == want[2:7]
    assert {i: r["total_reward"] for i, r in got.items()} == total
    assert [tuple(got[1][c] for c in wi.INIT)] == [tuple(r) for r in df.where("id = 1").select(*"abcde").collect()]


def test_the_plan_does_not_grow_with_the_steps(spark):
    df = states(spark)
    plan = lambda steps: wi.step_log(wi.project(df, *"abcde", steps=steps), ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan(2).count("Project") == plan(10).count("Project") <= 4
    one = wi.project(df, *"abcde", steps=3).select("final_prob", "total_reward")._jdf.queryExecution().executedPlan().toString()
    assert one.count("ArrowEvalPython") == 1 and one.count("run(") == 1  # log and actions are not made


def test_rounding_is_that_of_spark(spark):
    x = spark.range(200_000).select(
        F.explode(
            F.array(
                (F.rand(1) - 0.5) * 10, F.rand(2) * 5000, F.rand(3) * 1e-5, F.col("id") / 2e6, -F.col("id") / 2e6, (F.col("id") * 2 + 1) / 2e6 + 100, F.rand(4) * 1e12,
                F.exp(F.rand(5) * 80 - 40), F.lit(float("nan")), F.lit(float("inf")), F.lit(None).cast("double"), F.lit(-1e-9), F.lit(-0.0),
            )
        ).alias("x")
    )
    x = x.localCheckpoint()
    for digits in (0, 2, 6):
        want, got = F.round("x", digits), rounded(F.col("x"), digits)
        assert x.where(~want.eqNullSafe(got) | (want.cast("string") != got.cast("string"))).count() == 0
