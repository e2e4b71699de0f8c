"""Coercion, cleaning and scaling (DataFrame in, DataFrame out)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.columns import clip, is_finite, nan_to_null, to_number
from ..session import ensure_checkpoint_dir
from .profile import histograms, lerp, order_statistics, quantiles, ranks


def coerce_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text or numbers to double; junk and NaN become null (never raises)."""
    return df.withColumns({c: to_number(F.col(f"`{c}`")) for c in columns})


def drop_non_finite(df: DataFrame, subset: list[str]) -> DataFrame:
    """Drop rows whose value in ``subset`` is null, NaN or +-Inf."""
    cond = None
    for c in subset:
        e = is_finite(F.col(f"`{c}`"))
        cond = e if cond is None else cond & e
    return df.where(cond)


def clean_raw_flows(df: DataFrame, columns: list[str] | None = None, q: float = K.CLEAN_CUT_Q, method: str = "exact") -> DataFrame:
    """Coerce, drop missing/invalid rows, then cut each column above its q-quantile.

    The cuts are sequential: each quantile is taken on the rows left by the cuts
    before it (order: duration, bytes/s, packets/s), by ``cascade_cuts``.
    """
    columns = columns or K.CLEANING_COLUMNS
    out = coerce_numeric(df, columns)
    out = drop_non_finite(out, columns)
    out = out.where((F.col("flow_duration") > 0) & (F.col("flow_bytes_s") >= 0) & (F.col("flow_packets_s") >= 0))
    if method == "approx":
        for c in columns:
            upper = quantiles(out, {c: (c, [q])}, method=method)[c][0]
            out = out if upper is None else out.where(F.col(c) <= F.lit(upper))
        return out
    for c, upper in cascade_cuts(out, columns, q).items():
        out = out.where(F.col(c) <= F.lit(upper))
    return out


def cascade_cuts(df: DataFrame, columns: list[str], q: float) -> dict[str, float]:
    """Each column's q-quantile on the rows that the cuts before it leave, in two scans.

    A cut removes at most the share 1 - q, so the order statistics of the j-th cut
    lie among the highest (j + 1)(1 - q) of their column in the whole table.  One
    histogram of all columns tells where these tails begin; the rows of any tail
    are written once, and every cut is selected from them.  Rows below a tail are
    only counted: none of them is removed by that column's cut.
    """
    names = {c: F.col(c).cast("double") for c in columns}
    counted = histograms(df, names)
    n = counted[columns[0]][-1].below + counted[columns[0]][-1].inside if counted[columns[0]] else 0
    if not n:
        return {}
    start, least = {}, n
    for c in columns:
        rank = max(0, math.floor((least - 1) * q))
        start[c] = next(b for b in counted[c] if rank < b.below + b.inside).lo
        least = max(1, least - math.ceil(least * (1 - q)) - 1)
    tails = F.lit(False)
    for c in columns:
        tails = tails | (names[c] >= F.lit(start[c]))
    ensure_checkpoint_dir(df.sparkSession)
    kept = df.select(*[x.alias(c) for c, x in names.items()]).where(tails).checkpoint()
    cuts, left = {}, n
    for c in columns:
        tail = kept.where(F.col(c) >= F.lit(start[c]))
        below = left - tail.count()
        low, high, frac = ranks(left, q)
        found = order_statistics(tail, {c: (c, [low - below, high - below])})[c]
        cuts[c] = lerp(*found, frac)
        left -= kept.where(F.col(c) > F.lit(cuts[c])).count()
        kept = kept.where(F.col(c) <= F.lit(cuts[c]))
    return cuts


def robust_minmax(df: DataFrame, column: str, out_col: str | None = None, method: str = "exact") -> DataFrame:
    """Scale to 0-1 by the 1st/99th percentiles, clipped; a flat column gives 0."""
    out_col = out_col or f"{column}_scaled"
    qs = quantiles(df, {column: (column, [0.01, 0.99])}, method=method)[column]
    lo, hi = qs
    if lo is None or hi <= lo:
        return df.withColumn(out_col, F.lit(0.0))
    return df.withColumn(out_col, clip((F.col(column) - F.lit(lo)) / F.lit(hi - lo), 0.0, 1.0))


def min_max_scale(df: DataFrame, column: str | Column, out_col: str, extremes: tuple | None = None) -> DataFrame:
    """(x - min) / (max - min); a constant column gives 0.  Global min/max is one
    partial aggregate (two scalars)."""
    c = F.col(column) if isinstance(column, str) else column
    if extremes is None:
        r = df.agg(F.min(nan_to_null(c)).alias("mn"), F.max(nan_to_null(c)).alias("mx")).collect()[0]
        extremes = (r["mn"], r["mx"])
    mn, mx = extremes
    if mn is None or mn == mx:
        return df.withColumn(out_col, F.lit(0.0))
    return df.withColumn(out_col, (c - F.lit(mn)) / F.lit(mx - mn))
