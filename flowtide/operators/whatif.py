"""Deterministic what-if projections of corrective actions, per row.

Each row's network state is advanced ``k`` steps by a policy using the
mid-point effect of every action.  The steps run on Arrow batches (``walk.py``),
so the plan does not grow with ``k`` and needs no shuffle: rows are independent.
Single actions, effects and rewards are column expressions.  The per-step log is
an array of structs that ``inline`` turns into a long table when asked for; log,
actions and final state are each made only where they are read.

Declared deviations from the original single-row simulator: mid-point effects
instead of seeded noise, a fresh action history per row (the original shares
one history across all rows of a batch), no rounding until the sink.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.columns import alert_tier, clip, heuristic_probability, post_state
from . import walk

STATE = ["_lat", "_tp", "_loss", "_load", "_prob"]
INIT = ["init_latency", "init_throughput", "init_packet_loss", "init_tower_load", "init_prob"]
LOG_FIELDS = [
    "step", "action", "latency", "throughput", "packet_loss", "tower_load", "congestion_prob", "reward",
    "latency_before", "throughput_before", "packet_loss_before", "tower_load_before", "congestion_prob_before",
]


def _prob(lat: Column, loss: Column, mbps: Column) -> Column:
    return heuristic_probability(lat, loss, mbps)


def _effect(action: Column, lat: Column, tp: Column, loss: Column, load: Column) -> dict[str, Column]:
    """Next (clipped) state under ``action``; all inputs are column references."""
    def pick(idx):
        out = None
        for a, eff in K.ACTION_EFFECTS.items():
            f = eff[idx]
            if f is None:
                continue
            out = (F.when(action == a, F.lit(f)) if out is None else out.when(action == a, F.lit(f)))
        return out.otherwise(F.lit(1.0))

    b = K.STATE_BOUNDS
    reb = F.greatest(load * F.lit(K.ACTION_EFFECTS["rebalance_towers"][3]), F.lit(K.REBALANCE_FLOOR))
    return {
        "lat": clip(lat * pick(0), *b["latency"]),
        "tp": clip(tp * pick(1), *b["throughput"]),
        "loss": clip(loss * pick(2), *b["packet_loss"]),
        "load": clip(F.when(action == "rebalance_towers", reb).otherwise(load), *b["tower_load"]),
    }


def _reward(action: Column, p_old: Column, p_new: Column, lat_old, lat_new, tp_old, tp_new) -> Column:
    idle = action == "do_nothing"
    base = (
        F.when(idle & (p_new <= K.IDLE_BELOW), F.lit(K.REWARD_IDLE_OK))
        .when(p_new < p_old, (p_old - p_new) * K.REWARD_GAIN_SCALE)
        .otherwise(F.lit(K.REWARD_NO_GAIN))
    )
    return (
        base
        + F.when(lat_new < lat_old, K.REWARD_LATENCY_BETTER).otherwise(0.0)
        + F.when(tp_new > tp_old, K.REWARD_MBPS_BETTER).otherwise(0.0)
        + F.when(idle & (p_new > K.IDLE_BELOW), K.REWARD_IDLE_BAD).otherwise(0.0)
    )


def _priorities(lat: Column, tp: Column, loss: Column, load: Column) -> list[tuple[str, Column]]:
    """The actions that a state may call for, by falling priority, each with its test."""
    wants = [
        ("reduce_load", loss > K.PRIORITY_LOSS_ABOVE),
        ("reroute_traffic", lat > K.PRIORITY_LATENCY_ABOVE),
        ("increase_bandwidth", tp < K.PRIORITY_MBPS_BELOW),
        ("rebalance_towers", load > K.PRIORITY_LOAD_ABOVE),
    ]
    return [(a, F.coalesce(w, F.lit(False))) for a, w in wants]


def priority_action(df: DataFrame) -> DataFrame:
    """``_act`` from the priority policy with the per-row history (_h1, _h2, _n).

    The list of wanted actions is never built: plain flags name its first action
    that is not recent, else the one whose turn it is.
    """
    wants = _priorities(F.col("_lat"), F.col("_tp"), F.col("_loss"), F.col("_load"))
    t = df.withColumns({f"_w{i}": w for i, (_, w) in enumerate(wants)})
    flags = [F.col(f"_w{i}") for i in range(len(wants))]
    nothing = ~flags[0]
    for w in flags[1:]:
        nothing = nothing & ~w
    listed = [(a, w) for (a, _), w in zip(wants, flags)] + [(a, F.col("_none")) for a in K.PRIORITY_FALLBACK]
    ones = [w.cast("int") for w in flags]
    t = t.withColumns({"_none": nothing, "_size": F.when(nothing, F.lit(len(K.PRIORITY_FALLBACK))).otherwise(sum(ones[1:], ones[0]))})
    t = t.withColumn("_turn", F.col("_n") % F.col("_size"))
    recent = lambda a: F.coalesce((F.col("_n") >= 2) & ((F.col("_h1") == a) | (F.col("_h2") == a)), F.lit(False))
    fresh = turn = None
    before = F.lit(0)
    for a, w in listed:
        first, due = w & ~recent(a), w & (F.col("_turn") == before)
        fresh = F.when(first, F.lit(a)) if fresh is None else fresh.when(first, F.lit(a))
        turn = F.when(due, F.lit(a)) if turn is None else turn.when(due, F.lit(a))
        before = before + w.cast("int")
    idle = F.col("_prob") < K.IDLE_BELOW
    t = t.withColumn("_act", F.when(idle, F.lit("do_nothing")).otherwise(F.coalesce(fresh, turn)))
    return t.withColumns(
        {
            "_h1": F.when(idle, F.lit(None).cast("string")).otherwise(F.col("_h2")),
            "_h2": F.when(idle, F.lit(None).cast("string")).otherwise(F.col("_act")),
            "_n": F.when(idle, F.lit(0)).otherwise(F.least(F.col("_n") + 1, F.lit(K.HISTORY_CAP))),
        }
    ).drop(*[f"_w{i}" for i in range(len(wants))], "_none", "_size", "_turn")


def rule_action_expr(lat: Column, tp: Column, loss: Column, load: Column, prob: Column) -> Column:
    return (
        F.when((load >= K.RULE_LOAD_AT_LEAST) | (prob >= K.RULE_PROB_AT_LEAST), F.lit("rebalance_towers"))
        .when(loss >= K.RULE_LOSS_AT_LEAST, F.lit("reduce_load"))
        .when(tp <= K.RULE_MBPS_AT_MOST, F.lit("increase_bandwidth"))
        .when(lat >= K.RULE_LATENCY_AT_LEAST, F.lit("reroute_traffic"))
        .otherwise(F.lit("do_nothing"))
    )


def greedy_action(df: DataFrame, reward: str | None = None) -> DataFrame:
    """``_act`` = action with the highest one-step reward; first in order wins ties.

    ``reward`` names a column for that reward.
    """
    lat, tp, loss, load, p = (F.col(c) for c in STATE)
    cols = {}
    for i, a in enumerate(K.ACTIONS):
        e = _effect(F.lit(a), lat, tp, loss, load)
        cols[f"_gl{i}"], cols[f"_gt{i}"], cols[f"_gs{i}"] = e["lat"], e["tp"], e["loss"]
    t = df.withColumns(cols)
    rew = {}
    for i, a in enumerate(K.ACTIONS):
        pn = _prob(F.col(f"_gl{i}"), F.col(f"_gs{i}"), F.col(f"_gt{i}"))
        rew[f"_gr{i}"] = _reward(F.lit(a), p, pn, lat, F.col(f"_gl{i}"), tp, F.col(f"_gt{i}"))
    t = t.withColumns(rew)
    best = F.greatest(*[F.col(f"_gr{i}") for i in range(len(K.ACTIONS))])
    t = t.withColumn("_gbest", best)
    act = None
    for i, a in enumerate(K.ACTIONS):
        cond = F.col(f"_gr{i}") == F.col("_gbest")
        act = F.when(cond, F.lit(a)) if act is None else act.when(cond, F.lit(a))
    t = t.withColumn("_act", act)
    if reward:
        t = t.withColumn(reward, F.col("_gbest"))
    return t.drop(*[c for c in t.columns if c.startswith("_g")])


def random_action(df: DataFrame, key_cols: list[str], step: int, seed: int = 42) -> DataFrame:
    return df.withColumn("_act", F.element_at(F.array(*[F.lit(a) for a in K.ACTIONS]), _drawn(key_cols, step, seed) + 1))


def _drawn(key_cols: list[str], step: int, seed: int) -> Column:
    """Number of the action that the random policy takes."""
    s = F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in key_cols], F.lit(str(step)))
    return (F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("long") % len(K.ACTIONS)).cast("int")


def project(
    df: DataFrame,
    lat: str,
    tp: str,
    loss: str,
    load: str,
    prob: str,
    policy: str = "priority",
    steps: int = K.PROJECTION_STEPS,
    key_cols: list[str] | None = None,
    seed: int = 42,
) -> DataFrame:
    """Run ``steps`` policy steps from the given (already normalised) state columns.

    Adds ``_init_*`` (the starting state), final state ``final_*``,
    ``total_reward``, ``actions`` (array) and ``log`` (array of step structs).
    """
    start = dict(zip(INIT, (F.col(c).cast("double") for c in (lat, tp, loss, load, prob))))
    t = df.withColumns(start)
    given = [F.col(c) for c in INIT]
    if policy == "random":
        given.append(F.array(*[_drawn(key_cols or [], s, seed) for s in range(1, steps + 1)]))
    entry = ", ".join(f"{n}: {'int' if n == 'step' else 'string' if n == 'action' else 'double'}" for n in LOG_FIELDS)
    # what is not read is not made
    final = F.arrow_udf(walk.finals(policy, steps), ", ".join(f"{n} double" for n in walk.FINAL))
    t = t.withColumn("_final", final(*given))
    t = t.withColumns(
        {
            "log": F.arrow_udf(walk.log(policy, steps, LOG_FIELDS), f"array<struct<{entry}>>")(*given),
            **{c if c == "total_reward" else f"final_{c}": F.col("_final").getField(c) for c in walk.FINAL},
            "actions": F.arrow_udf(walk.actions(policy, steps), "array<string>")(*given),
        }
    )
    return t.drop("_final")


def simulator_state(df: DataFrame, lat: str, mbps: str, loss: str, load: str, prob: str | None = None) -> DataFrame:
    """Simulator reset from a state record: clip latency 5-5000, Mbps 10-1000,
    loss (percent if > 1) 0-1, load 0-100; probability given or heuristic."""
    b = K.STATE_BOUNDS
    t = df.withColumns(
        {
            "s_lat": clip(F.col(lat), *b["latency"]),
            "s_tp": clip(F.col(mbps), *b["throughput"]),
            "s_loss": F.when(F.col(loss) > 1, F.col(loss) / 100).otherwise(F.col(loss)),
            "s_load": clip(F.col(load), 0.0, 100.0),
        }
    )
    t = t.withColumn("s_loss", clip("s_loss", 0.0, 1.0))
    p = F.col(prob) if prob else _prob(F.col("s_lat"), F.col("s_loss"), F.col("s_tp"))
    return t.withColumn("s_prob", clip(p, 0.0, 1.0))


def summary_columns(projected: DataFrame) -> DataFrame:
    """Total reward and % changes vs the starting state (floor 1e-6), action string."""
    init_c = _prob(F.col("init_latency"), F.col("init_packet_loss"), F.col("init_throughput"))
    floor = F.lit(1e-6)
    return projected.withColumns(
        {
            "congestion_reduction_pct": (init_c - F.col("final_prob")) / F.greatest(init_c, floor) * 100.0,
            "latency_improvement_pct": (F.col("init_latency") - F.col("final_latency")) / F.greatest(F.col("init_latency"), floor) * 100.0,
            "throughput_improvement_pct": (F.col("final_throughput") - F.col("init_throughput")) / F.greatest(F.col("init_throughput"), floor) * 100.0,
            "action_sequence": F.array_join(F.col("actions"), " → "),
        }
    )


def step_log(projected: DataFrame, key_cols: list[str]) -> DataFrame:
    """Long step table: one row per (row, step) via ``inline`` (no shuffle)."""
    # inline_outer: a non-outer generator makes Catalyst infer size(log) > 0, which is asked before the log is made
    return projected.select(*key_cols, F.inline_outer("log"))


def post_tier(p: Column) -> dict[str, Column]:
    return {"after_state": post_state(p), "after_alert": alert_tier(p)}
