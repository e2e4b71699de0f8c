"""Stateless scoring of a flow stream with a profile fitted on batch data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import alert_tier, network_state
from ..operators.features import apply_feature_profile, raw_kpis, with_risk_score
from ..operators.profile import Profile


def score_stream(stream: DataFrame, profile: Profile) -> DataFrame:
    """Features, risk score and alert tier for every arriving flow.

    The quantile scalars come from ``fit_feature_profile`` on batch data, so
    the streaming plan is a pure projection (no state)."""
    scored = with_risk_score(apply_feature_profile(raw_kpis(stream), profile), "prob")
    return scored.withColumns({"alert_level": alert_tier(F.col("prob")), "network_state": network_state(F.col("prob"))})


def alert_counts(scored: DataFrame, event_time: str, window: str = "5 minutes", watermark: str = "10 minutes") -> DataFrame:
    """Windowed alert counts with a watermark for late rows (append mode)."""
    return (
        scored.withWatermark(event_time, watermark)
        .groupBy(F.window(event_time, window), "alert_level")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("prob").alias("mean_prob"))
    )
