"""Feature and target diagnostics as small report tables (long form)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.columns import finite, nan_to_null
from .features import prepare_features
from .profile import quantiles


# distinct values are counted at 9 decimals: last-bit noise of transcendental
# functions (log1p) must not create or merge "distinct" feature values
NUNIQUE_DIGITS = 9


def _stack(df_one_row: DataFrame, key: str, rows: list[tuple[str, list]], cols: list[str]) -> DataFrame:
    """Turn one wide row into ``len(rows)`` long rows via ``inline`` (no shuffle)."""
    structs = [F.struct(F.lit(name).alias(key), *[e.alias(c) for c, e in zip(cols, exprs)]) for name, exprs in rows]
    return df_one_row.select(F.inline(F.array(*structs)))


def distinct_counts(df: DataFrame, columns: list[str], method: str = "exact") -> DataFrame:
    """(feature, nunique): distinct finite values at ``NUNIQUE_DIGITS`` decimals.

    Exact counts shuffle slim (feature, value) pairs, each once per map task, and
    no other column; ``method="approx"`` is Spark's mergeable sketch, without a
    shuffle of values.
    """
    cells = [F.round(finite(F.col(c)), NUNIQUE_DIGITS) for c in columns]
    if method == "approx":
        one = df.agg(*[F.approx_count_distinct(x).alias(c) for c, x in zip(columns, cells)])
        return _stack(one, "feature", [(c, [F.col(c)]) for c in columns], ["nunique"])
    tall = df.select(F.posexplode(F.array(*cells)).alias("t", "x")).where("x is not null")
    counts = tall.groupBy("t", "x").agg(F.count(F.lit(1)).alias("n")).groupBy("t").agg(F.count(F.lit(1)).alias("nunique"))
    names = F.array(*[F.lit(c) for c in columns])
    return counts.select(F.element_at(names, F.col("t") + 1).alias("feature"), "nunique")


def _with_distinct(rows: DataFrame, df: DataFrame, method: str) -> DataFrame:
    """Report rows with their ``nunique`` (a row per feature on both sides)."""
    return rows.join(distinct_counts(df, K.FEATURES, method), "feature", "left").withColumn("nunique", F.coalesce("nunique", F.lit(0)))


def feature_distribution(df: DataFrame, method: str = "exact") -> DataFrame:
    """min, p01, median, p99, max, population std and distinct count per feature."""
    q = quantiles(df, {c: (c, [0.01, 0.5, 0.99]) for c in K.FEATURES}, method=method)
    one = df.agg(*[F.stddev_pop(finite(F.col(c))).alias(c) for c in K.FEATURES])
    number = lambda v: F.lit(v).cast("double")
    rows = [(c, [number(q[c + "__min"]), *map(number, q[c]), number(q[c + "__max"]), F.col(c)]) for c in K.FEATURES]
    return _with_distinct(_stack(one, "feature", rows, ["min", "p01", "median", "p99", "max", "std"]), df, method)


def feature_quality(df: DataFrame, method: str = "exact") -> DataFrame:
    """Per feature: distinct count, std, rows out of the model range, ok flag.

    Two distinct values are told by ``min < max`` alone.
    """
    bounds = {"latency": (0.0, K.LATENCY_MAX), "throughput": (0.0, K.THROUGHPUT_MAX), "packet_loss": (0.0, K.LOSS_MAX)}
    aggs, rows = [], []
    for c in K.FEATURES:
        x = F.round(finite(F.col(c)), NUNIQUE_DIGITS)
        lo, hi = bounds[c]
        aggs += [(F.min(x) < F.max(x)).alias(f"{c}_v"), F.stddev_pop(finite(F.col(c))).alias(f"{c}_s"), F.count_if((nan_to_null(c) < lo) | (nan_to_null(c) > hi)).alias(f"{c}_o")]
        ok = F.col(f"{c}_v") & (F.col(f"{c}_s") > K.QUALITY_MIN_STD) & (F.col(f"{c}_o") == 0)
        rows.append((c, [F.col(f"{c}_s"), F.col(f"{c}_o").cast("long"), F.coalesce(ok, F.lit(False))]))
    return _with_distinct(_stack(df.agg(*aggs), "feature", rows, ["std", "out_of_range", "ok"]), df, method)


def label_relationship(df: DataFrame, target: str = "congestion") -> DataFrame:
    """Class means per feature and whether the target contradicts the risk direction."""
    aggs = []
    for c in K.FEATURES:
        aggs += [
            F.avg(F.when(F.col(target) == 0, F.col(c))).alias(f"{c}_0"),
            F.avg(F.when(F.col(target) == 1, F.col(c))).alias(f"{c}_1"),
        ]
    one = df.agg(*aggs)
    rows = []
    for c in K.FEATURES:
        n0, n1 = F.col(f"{c}_0"), F.col(f"{c}_1")
        direction = "traffic_load_0_to_1" if c == "throughput" else "higher_is_risk"
        violation = n0.isNull() | n1.isNull()
        if c != "throughput":
            violation = violation | (n1 <= n0)
        rows.append((c, [n0, n1, F.lit(direction), F.coalesce(violation, F.lit(True))]))
    return _stack(one, "feature", rows, ["normal_mean", "congested_mean", "direction", "violation"])


def score_correlation(df: DataFrame, score_col: str = "congestion_score") -> DataFrame:
    """Pearson correlation of each (model-range clipped) feature with the score."""
    p = prepare_features(df)
    one = p.agg(*[F.corr(c, score_col).alias(c) for c in K.FEATURES])
    return _stack(one, "feature", [(c, [F.col(c)]) for c in K.FEATURES], ["correlation"])


def assert_quality(report: DataFrame) -> None:
    """Opt-in gate: raise when any feature row is not ok."""
    bad = [r["feature"] for r in report.where(~F.col("ok")).select("feature").collect()]
    if bad:
        raise ValueError(f"Feature quality check failed: {bad}")
