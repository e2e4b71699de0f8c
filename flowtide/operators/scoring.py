"""Row scoring rules: probabilities, tiers, safety overrides, diagnosis, state bins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.columns import alert_tier, clip, heuristic_probability, network_state
from .features import prepare_features
from .profile import quantiles


def congestion_probability(df: DataFrame, latency: str = "latency", loss: str = "packet_loss", mbps: str = "throughput_mbps", input_unit: str = "mbps") -> DataFrame:
    return df.withColumn("heuristic_prob", heuristic_probability(F.col(latency), F.col(loss), F.col(mbps), input_unit))


def alert_tiers(df: DataFrame, prob: str = "prob") -> DataFrame:
    p = F.col(prob)
    return df.withColumns({"alert_level": alert_tier(p), "network_state": network_state(p)})


def safety_overrides(df: DataFrame, pred: str = "pred", prob: str = "prob") -> DataFrame:
    """Quiet cap and loss/latency floors applied to (prediction, probability).

    Inputs are clipped to the model ranges first, as the predictor does.
    """
    p = prepare_features(df)
    lat, tp, loss = F.col("latency"), F.col("throughput"), F.col("packet_loss")
    quiet = (F.col(pred) == 0) & (lat <= K.QUIET_LATENCY_MAX) & (loss <= K.QUIET_LOSS_MAX)
    prob0 = F.when(quiet, F.least(F.col(prob), F.lit(K.QUIET_PROB_CAP))).otherwise(F.col(prob))
    o1 = F.when((loss >= 0.15) & (tp <= 0.30), F.lit(K.OVERRIDE_MID))
    o2 = (
        F.when(loss >= 0.50, F.lit(K.OVERRIDE_HIGH))
        .when(loss >= 0.30, F.greatest(F.coalesce(o1, F.lit(0.0)), F.lit(K.OVERRIDE_MID)))
        .otherwise(o1)
    )
    p = p.withColumns({"_prob0": prob0, "_o2": o2})
    o3 = F.when((lat >= 3000) & (loss >= 0.20), F.greatest(F.coalesce(F.col("_o2"), F.lit(0.0)), F.lit(K.OVERRIDE_HIGH))).otherwise(F.col("_o2"))
    p = p.withColumn("override_prob", o3)
    has = F.col("override_prob").isNotNull()
    return p.withColumns(
        {
            "final_pred": F.when(has, F.lit(1)).otherwise(F.col(pred).cast("int")),
            "final_prob": F.when(has, F.greatest(F.col("_prob0"), F.col("override_prob"))).otherwise(F.col("_prob0")),
        }
    ).drop("_prob0", "_o2")


def diagnosis_thresholds(df: DataFrame, method: str = "exact") -> dict:
    """p75 latency, p25 throughput and p90 loss of the table (one quantile pass)."""
    q = quantiles(
        df,
        {"l": ("latency", [K.DIAG_LATENCY_Q]), "t": ("throughput", [K.DIAG_THROUGHPUT_Q]), "p": ("packet_loss", [K.DIAG_LOSS_Q])},
        method=method,
    )
    return {"latency": q["l"][0], "throughput": q["t"][0], "packet_loss": q["p"][0]}


def _flags(th: dict):
    loss = (F.col("packet_loss") > K.DIAG_LOSS_ABS) | (F.col("packet_loss") > F.lit(th["packet_loss"]))
    lat = F.col("latency") > F.lit(th["latency"])
    tp = F.col("throughput") < F.lit(th["throughput"])
    return loss, lat, tp


def root_causes(df: DataFrame, thresholds: dict, congested: str = "congestion") -> DataFrame:
    """Per row the list of causes; ``multi-factor`` if congested with none, else ``none``."""
    loss, lat, tp = _flags(thresholds)
    found = F.filter(
        F.array(F.when(loss, K.CAUSE_LOSS), F.when(lat, K.CAUSE_LATENCY), F.when(tp, K.CAUSE_THROUGHPUT)), lambda x: x.isNotNull()
    )
    causes = (
        F.when(F.size(found) > 0, found)
        .when(F.col(congested) == 1, F.array(F.lit(K.CAUSE_MULTI)))
        .otherwise(F.array(F.lit(K.CAUSE_NONE)))
    )
    return df.withColumn("root_causes", causes)


def suggestions(df: DataFrame, thresholds: dict, prob: str = "prob", congested: str = "congestion") -> DataFrame:
    """Per row suggested actions (urgent when prob > 0.9)."""
    loss, lat, tp = _flags(thresholds)
    base = F.filter(
        F.array(F.when(loss, K.SUGGEST_LOSS), F.when(lat, K.SUGGEST_LATENCY), F.when(tp, K.SUGGEST_THROUGHPUT)), lambda x: x.isNotNull()
    )
    with_urgent = (
        F.when(F.col(prob) > K.URGENT_ABOVE, F.concat(base, F.array(F.lit(K.SUGGEST_URGENT))))
        .when((F.col(congested) == 1) & (F.size(base) == 0), F.array(F.lit(K.SUGGEST_INVESTIGATE)))
        .otherwise(base)
    )
    out = df.withColumn("_s", with_urgent)
    return out.withColumn("suggestions", F.when(F.size("_s") > 0, F.col("_s")).otherwise(F.array(F.lit(K.SUGGEST_NORMAL)))).drop("_s")


def normalize_state(df: DataFrame, latency="latency", throughput="throughput", loss="packet_loss", load="tower_load", prob: str | None = None) -> DataFrame:
    """Dashboard inputs -> simulator units: ratio throughput (0-1) x1000, percent
    loss (>1) /100, defaults for missing fields, probability given or heuristic,
    then clip to the simulator ranges."""
    d = K.STATE_DEFAULTS
    b = K.STATE_BOUNDS
    out = df.withColumns(
        {
            "_lat": F.coalesce(F.col(latency).cast("double"), F.lit(d["latency"])),
            "_tp": F.coalesce(F.col(throughput).cast("double"), F.lit(d["throughput"])),
            "_loss": F.coalesce(F.col(loss).cast("double"), F.lit(d["packet_loss"])),
            "_load": F.coalesce(F.col(load).cast("double"), F.lit(d["tower_load"])) if load in df.columns else F.lit(d["tower_load"]),
        }
    )
    out = out.withColumns(
        {
            "_tp": F.when((F.col("_tp") >= 0) & (F.col("_tp") <= 1), F.col("_tp") * 1000).otherwise(F.col("_tp")),
            "_loss": F.when(F.col("_loss") > 1, F.col("_loss") / 100).otherwise(F.col("_loss")),
        }
    )
    fallback = heuristic_probability(F.col("_lat"), F.col("_loss"), F.col("_tp"))
    p = F.coalesce(F.col(prob).cast("double"), fallback) if prob else fallback
    out = out.withColumn("_p", p)
    return out.withColumns(
        {
            "state_latency": clip("_lat", *b["latency"]),
            "state_throughput": clip("_tp", *b["throughput"]),
            "state_packet_loss": clip("_loss", *b["packet_loss"]),
            "state_tower_load": clip("_load", *b["tower_load"]),
            "state_prob": clip("_p", 0.0, 1.0),
        }
    ).drop("_lat", "_tp", "_loss", "_load", "_p")


def bin_edges() -> dict[str, list[float]]:
    """Inner edges of the 6-bin state grid (a rule: 7 evenly spaced points)."""
    return {k: [float(v) for v in np.linspace(lo, hi, K.STATE_BIN_COUNT + 1)[1:-1]] for k, (lo, hi) in K.STATE_BIN_RANGES.items()}


def state_bins(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Bin index 0-5 per state field = number of inner edges <= value."""
    edges = bin_edges()
    cols = {}
    for key, c in fields.items():
        v = F.col(c)
        cols[f"bin_{key}"] = sum((v >= F.lit(e)).cast("int") for e in edges[key])
    return df.withColumns(cols)


def state_occupancy(binned: DataFrame, prob: str) -> DataFrame:
    keys = [c for c in binned.columns if c.startswith("bin_")]
    return binned.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.avg(prob).alias("mean_prob"))
