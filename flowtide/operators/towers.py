"""Tower segmentation, ranking, action plan and load redistribution."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from .profile import quantiles
from .window import IDX, ordered_index


def tercile_levels() -> list[float]:
    """Tercile quantile levels as pandas evaluates them: through percent
    (q * 100, then / 100), which moves 1/3 and 2/3 down by an ulp and decides
    which side of an edge a tied rank lands on."""
    return [(i / 3) * 100.0 / 100.0 for i in range(4)]


def tower_segments(df: DataFrame, value: str = "throughput", order_cols: list[str] | None = None, method: str = "exact") -> DataFrame:
    """Terciles A/B/C by quantile edges (right-closed, lowest included).

    When two edges coincide the split falls back to first-come ranks
    (row position in ``value, *order_cols`` order) cut at the rank terciles,
    which needs the distributed row index rather than ``ntile``.
    """
    q = quantiles(df, {"v": (value, tercile_levels())}, method=method)
    e0, e1, e2, e3 = q["v"]
    n = q["v__n"]
    a, b, c = K.TOWER_LABELS
    if len({e0, e1, e2, e3}) == 4:
        v = F.col(value)
        return df.withColumn("tower", F.when(v <= e1, a).when(v <= e2, b).when(v <= e3, c))
    indexed, _n = ordered_index(df, [value] + (order_cols or []))
    r = F.col(IDX) + 1
    lv = tercile_levels()
    r1, r2 = 1 + (n - 1) * lv[1], 1 + (n - 1) * lv[2]
    return indexed.withColumn("tower", F.when(r <= r1, a).when(r <= r2, b).otherwise(c)).drop(IDX)


def tower_summary(df: DataFrame, tower: str = "tower", target: str = "congestion") -> DataFrame:
    """Records and congestion rate per tower, ranked by congestion % (desc)."""
    agg = df.groupBy(tower).agg(F.count(F.lit(1)).alias("records"), F.avg(F.col(target).cast("double")).alias("congestion_rate"))
    agg = agg.withColumn("congestion_percentage", F.col("congestion_rate") * 100)
    # one row per tower: a global window over the aggregate is tiny
    w = Window.orderBy(F.col("congestion_percentage").desc(), F.col(tower))
    return agg.withColumn("rank", F.row_number().over(w).cast("long"))


def load_band(c) -> F.Column:
    return F.when(c > K.OVERLOAD_ABOVE, "overloaded").when(c > K.UNDERLOAD_BELOW, "elevated").otherwise("normal")


def tower_action_plan(summary: DataFrame) -> DataFrame:
    p = F.col("congestion_percentage")
    (hi, s_hi, a_hi), (mid, s_mid, a_mid), (_, s_lo, a_lo) = K.TOWER_PLAN
    return summary.select(
        "tower",
        "congestion_percentage",
        F.when(p > hi, s_hi).when(p > mid, s_mid).otherwise(s_lo).alias("status"),
        F.when(p > hi, a_hi).when(p > mid, a_mid).otherwise(a_lo).alias("action"),
        F.when(p > hi, "Critical").when(p > mid, "Warning").otherwise("Normal").alias("alert"),
    )


def most_congested_tower(summary: DataFrame) -> DataFrame:
    """Top tower by congestion % plus its status (a top-1, bounded)."""
    top = summary.orderBy(F.col("congestion_percentage").desc(), F.col("tower")).limit(1)
    p = F.col("congestion_percentage")
    return top.select(
        "tower",
        "congestion_percentage",
        F.when(p > K.OVERLOAD_ABOVE, "Critical").when(p > K.UNDERLOAD_BELOW, "Warning").otherwise("Normal").alias("alert"),
    )


def tower_redistribution(loads: DataFrame, group: str = "cell", tower: str = "tower", load: str = "load") -> DataFrame:
    """Move the excess above 75 % to towers under 60 %, capped at 75.

    Closed form of the sequential loop: with E the total excess of a group and
    U its number of under-loaded towers, an overloaded tower ends at 75 (if
    U > 0) and an under-loaded one at ``min(load + E/U, 75)`` (capped adds of
    non-negative shares compose).  The per-group (E, U) table is a grouped
    aggregate joined back on the group key, so no group is collected anywhere.
    """
    L = F.col(load)
    per_group = loads.groupBy(group).agg(
        F.sum(F.when(L > K.OVERLOAD_ABOVE, L - K.OVERLOAD_ABOVE).otherwise(0.0)).alias("_excess"),
        F.count_if(L < K.UNDERLOAD_BELOW).alias("_under"),
    )
    j = loads.join(per_group, group)
    after = (
        F.when((L > K.OVERLOAD_ABOVE) & (F.col("_under") > 0), F.lit(K.OVERLOAD_ABOVE))
        .when((L < K.UNDERLOAD_BELOW) & (F.col("_under") > 0), F.least(L + F.col("_excess") / F.col("_under"), F.lit(K.OVERLOAD_ABOVE)))
        .otherwise(L)
    )
    return j.select(
        F.col(group),
        F.col(tower),
        L.alias("load_before"),
        after.alias("load_after"),
        load_band(L).alias("band_before"),
        load_band(after).alias("band_after"),
    )


def redistribution_summary(redistributed: DataFrame, group: str = "cell") -> DataFrame:
    """Overloaded towers before/after and spread reduction (population std) per group."""
    return redistributed.groupBy(group).agg(
        F.count(F.lit(1)).alias("towers"),
        F.count_if(F.col("load_before") > K.OVERLOAD_ABOVE).alias("overloaded_before"),
        F.count_if(F.col("load_after") > K.OVERLOAD_ABOVE).alias("overloaded_after"),
        F.stddev_pop("load_before").alias("std_before"),
        F.stddev_pop("load_after").alias("std_after"),
        (F.stddev_pop("load_before") - F.stddev_pop("load_after")).alias("spread_reduction"),
    )
