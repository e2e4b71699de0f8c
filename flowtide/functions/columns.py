"""Null-safe column expressions shared by every operator.

Spark's ``greatest``/``least`` skip nulls and treat NaN as the largest value,
so ``least(NaN, 5000)`` is 5000 and ``greatest(null, 0)`` is 0.  Pandas keeps
the missing value.  These helpers keep missing values missing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c




def nan_to_null(c: str | Column) -> Column:
    """NaN -> null (references the input once, so nesting stays linear)."""
    return F.nanvl(col(c).cast("double"), F.lit(None).cast("double"))


def finite(c: str | Column) -> Column:
    """Value if finite, else null (NaN and +-Inf become null).

    Spark orders NaN above +Inf, so ``abs(x) < inf`` is false for NaN and +-Inf
    and null for null: one test covers all three.
    """
    c = col(c)
    return F.when(F.abs(c) < F.lit(float("inf")), c.cast("double"))


def is_finite(c: str | Column) -> Column:
    """Predicate form of ``finite`` (references the input once, so a filter
    pushed below projections stays small)."""
    return F.coalesce(F.abs(col(c)) < F.lit(float("inf")), F.lit(False))


def to_number(c: str | Column) -> Column:
    """Coerce anything to double; unparsable text becomes null (never raises).

    Java's number suffixes (``12d``, ``3f``) are no numbers here.  Only text is
    searched for them: the type is known when the plan is made, so the test is
    folded away for numeric columns.
    """
    c = col(c)
    suffixed = F.rlike(c.cast("string"), F.lit(r"[0-9.]\s*[dDfF]\s*$"))
    return nan_to_null(F.when((F.typeof(c) == "string") & F.coalesce(suffixed, F.lit(False)), F.lit(None)).otherwise(c.try_cast("double")))


def clip(c: str | Column, lo: float | Column | None = None, hi: float | Column | None = None) -> Column:
    """Clip that keeps null as null (NaN is treated as null).

    The input is referenced exactly once, so nested clips stay linear in size
    even when the optimizer inlines them into a pushed-down filter.  Missing
    values travel as NaN inside: Spark orders NaN above every number, so
    ``greatest(NaN, lo)`` is NaN and the upper bound is applied as
    ``-greatest(-x, -hi)``, which keeps NaN too; ``nanvl`` turns it back into
    null at the end.
    """
    v = F.coalesce(col(c).cast("double"), F.lit(float("nan")))
    if lo is not None:
        v = F.greatest(v, lo if isinstance(lo, Column) else F.lit(float(lo)))
    if hi is not None:
        v = -F.greatest(-v, -(hi if isinstance(hi, Column) else F.lit(float(hi))))
    return F.nanvl(v, F.lit(None).cast("double"))


def safe_div(num: Column, den: Column) -> Column:
    """Division that yields null for a zero or null denominator (ANSI-safe)."""
    return F.try_divide(num, F.when(den != 0, den))


def risk_score(lat: Column, tp: Column, loss: Column) -> Column:
    """Monotonic congestion risk score on model-range features, clipped to 0-1."""
    w_lat, w_tp, w_loss, w_lat_tp, w_loss_tp = K.RISK_WEIGHTS
    lat_r = clip(lat, 0.0, K.LATENCY_MAX) / F.lit(K.LATENCY_MAX)
    tp_r = clip(tp, 0.0, K.THROUGHPUT_MAX)
    loss_r = clip(loss, 0.0, K.LOSS_MAX)
    raw = (
        F.lit(w_lat) * lat_r
        + F.lit(w_tp) * tp_r
        + F.lit(w_loss) * loss_r
        + F.lit(w_lat_tp) * F.sqrt(lat_r * tp_r)
        + F.lit(w_loss_tp) * F.sqrt(loss_r * tp_r)
    )
    return clip(raw, 0.0, 1.0)


def heuristic_probability(lat: Column, loss: Column, mbps: Column, input_unit: str = "mbps") -> Column:
    """0.4*latency/5000 + 0.4*loss + 0.2*(1 - min(mbps/1000, 1)), clipped to 0-1.

    ``input_unit='auto'`` reproduces the form that accepts a 0-1 ratio or Mbps
    (values above 1 are read as Mbps).
    """
    w_lat, w_loss, w_bw = K.HEURISTIC_WEIGHTS
    if input_unit == "auto":
        ratio = F.when(mbps > 1.0, F.least(mbps / F.lit(K.MBPS_MAX), F.lit(1.0))).otherwise(mbps)
        ratio = clip(ratio, 0.0, 1.0)
    else:
        ratio = F.least(mbps / F.lit(K.MBPS_MAX), F.lit(1.0))
    raw = (lat / F.lit(K.LATENCY_MAX)) * w_lat + (loss / F.lit(1.0)) * w_loss + (F.lit(1.0) - ratio) * w_bw
    return clip(raw, 0.0, 1.0)


def alert_tier(p: Column) -> Column:
    return F.when(p > K.CRITICAL_ABOVE, "Critical").when(p > K.WARNING_ABOVE, "Warning").otherwise("Normal")


def network_state(p: Column) -> Column:
    return (
        F.when(p > K.CRITICAL_ABOVE, "Congestion Detected")
        .when(p > K.WARNING_ABOVE, "Elevated Risk")
        .otherwise("Normal Network")
    )


def post_state(p: Column) -> Column:
    return F.when(p > K.CRITICAL_ABOVE, "Congestion Detected").when(p > K.WARNING_ABOVE, "Warning").otherwise("Normal Network")


def class_label(c: Column) -> Column:
    """Name of the classes 0 and 1; others have none."""
    c = c.try_cast("int")
    return F.when(c == 0, "Normal").when(c == 1, "Congested")


def rounded(c: Column, digits: int) -> Column:
    """``F.round`` (half up on the shortest decimal), without its big decimals where no tie is near.

    Below 10^6 the scaled value is off by far less than the distance to a tie that is asked
    for, and a whole number over a power of ten is the double nearest to that decimal.
    """
    scaled = c * F.lit(10.0**digits)
    whole = F.rint(scaled)
    clear = (F.abs(c) < 1e6) & (F.abs(scaled - whole) < 0.499)
    # adding zero turns -0.0 into 0.0
    return F.when(clear, whole / F.lit(10.0**digits) + F.lit(0.0)).otherwise(F.round(c, digits))


def round_doubles(df, digits: int = 6):
    """Sink-side rounding of every double column (engines differ in the last bits)."""
    out = []
    for f in df.schema.fields:
        if f.dataType.typeName() == "double":
            out.append(rounded(F.col(f"`{f.name}`"), digits).alias(f.name))
        elif f.dataType.typeName() == "float":
            out.append(F.round(F.col(f"`{f.name}`"), digits).alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)
