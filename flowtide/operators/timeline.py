"""Rolling congestion trend, spikes and recent status over an ordered series.

All windows use the block form of ``flowtide.operators.window`` so no step
funnels the series through one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from .profile import quantiles
from .window import IDX, ordered_index, rolling, rolling_mean


def _pct(c: str = "congestion"):
    # average 0.0/100.0 values: exact sums, so engines agree to the last bit
    return F.when(F.col(c).isNotNull(), F.col(c).cast("double") * 100.0)


def rolling_trend(df: DataFrame, order_cols: list[str], window: int = K.ROLLING_WINDOW, block_rows: int = 1_000_000) -> tuple[DataFrame, int]:
    """Rolling congestion %, its own rolling mean (nested) and rolling latency.

    Returns the frame (with ``_idx``) and the row count.
    """
    clean = df.where(F.col("congestion").isNotNull() & F.col("latency").isNotNull() & ~F.isnan("latency"))
    indexed, n = ordered_index(clean, order_cols)
    out = rolling(
        indexed.withColumn("_c100", _pct()),
        [
            {"rolling_congestion": rolling_mean("_c100", window), "latency_rolling": rolling_mean("latency", window)},
            {"rolling_mean": rolling_mean("rolling_congestion", window)},
        ],
        halo=2 * (window - 1),
        block_rows=block_rows,
    )
    return out.drop("_c100"), n


def spike_threshold(trend: DataFrame, method: str = "exact") -> float:
    return quantiles(trend, {"r": ("rolling_congestion", [K.SPIKE_Q])}, method=method)["r"][0]


def congestion_spikes(trend: DataFrame, threshold: float) -> DataFrame:
    """Rows whose rolling congestion is strictly above the spike threshold."""
    return trend.where(F.col("rolling_congestion") > F.lit(threshold)).withColumn("spike_threshold", F.lit(threshold))


def recent_spike_status(trend: DataFrame, n: int, threshold: float, recent: int = K.RECENT_ROWS) -> DataFrame:
    """Latest rolling value, spike count and any-spike flag over the last rows.

    The last ``recent`` rows are a filter on the global index (no sort).
    """
    tail = trend.where(F.col(IDX) >= F.lit(n - recent))
    is_spike = F.col("rolling_congestion") > F.lit(threshold)
    return tail.agg(
        F.max_by("rolling_congestion", IDX).alias("latest_rolling_congestion"),
        F.lit(threshold).cast("double").alias("spike_threshold"),
        F.count_if(is_spike).cast("long").alias("recent_spikes"),
        F.coalesce(F.max(is_spike), F.lit(False)).alias("recent_spike"),
    )
