"""Dashboard analytics: correlations, KPI summary, distributions, samples, metrics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.columns import class_label, clip, finite, is_finite
from ..session import ensure_checkpoint_dir
from .clean import drop_non_finite
from .profile import grouped_quantiles, join_groups, lerp, quantiles
from .quality import _stack


def correlation_matrix(df: DataFrame, features: list[str] | None = None) -> DataFrame:
    """Pearson correlation for every feature pair, long form, with +-0.30 bands."""
    features = features or K.FEATURES
    clean = drop_non_finite(df, features)
    pairs = [(a, b) for a in features for b in features]
    one = clean.agg(*[F.corr(a, b).alias(f"{a}__{b}") for a, b in pairs])
    structs = [
        F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(f"{a}__{b}").alias("correlation")) for a, b in pairs
    ]
    out = one.select(F.inline(F.array(*structs)))
    band = (
        F.when(F.col("correlation") < -K.CORRELATION_BAND, "strong_negative")
        .when(F.col("correlation") > K.CORRELATION_BAND, "strong_positive")
        .otherwise("weak")
    )
    return out.withColumn("band", band)


def kpi_summary(df: DataFrame, method: str = "exact") -> DataFrame:
    """Rows, missing cells, congestion rate %, means of p99-clipped latency and
    throughput, and p75 latency / p25 throughput taken after the clip.

    One fit and one aggregate: clipping keeps the order, so an order statistic of
    the clipped column is the clipped order statistic of the column.
    """
    cols = K.FEATURES + ["congestion"]
    whole = F.lit(True)
    for c in cols:
        whole = whole & is_finite(F.col(c).cast("double"))
    q = quantiles(df.where(whole), {"l": ("latency", [K.SCALE_Q, 0.75]), "t": ("throughput", [K.SCALE_Q, 0.25])}, method=method)
    l99, t99 = q["l"][0], q["t"][0]
    own = lambda x: F.when(F.col("_whole"), x)
    missing = sum(F.sum(F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), 1).otherwise(0)) for c in cols)
    return df.withColumn("_whole", whole).agg(
        F.count_if("_whole").alias("rows"),
        F.lit(len(K.FEATURES)).alias("features"),
        F.coalesce(missing, F.lit(0)).cast("long").alias("missing_values"),
        (F.avg(own(F.col("congestion").cast("double"))) * 100).alias("congestion_rate"),
        F.avg(own(clip("latency", None, l99))).alias("avg_latency"),
        F.avg(own(clip("throughput", None, t99))).alias("avg_throughput"),
        F.lit(_clipped(q, "l", l99)).cast("double").alias("latency_threshold"),
        F.lit(_clipped(q, "t", t99)).cast("double").alias("throughput_threshold"),
    )


def _clipped(q: dict, name: str, most: float | None) -> float | None:
    """The second quantile of ``name`` after a clip at ``most``."""
    if most is None:
        return None
    if name + "__steps" not in q:
        return min(q[name][1], most)
    low, high, frac = q[name + "__steps"][1]
    return lerp(min(low, most), min(high, most), frac)


def boxplot_stats(df: DataFrame, value: str = "log_latency", by: str = "congestion") -> DataFrame:
    """Five-number summary with 1.5*IQR whiskers per class (what a box plot draws).

    Any number of classes: one grouped fit, then one aggregate joined on the
    class.  Rows without a class or a finite value are left out.
    """
    q = grouped_quantiles(df, [by], value, [0.25, 0.5, 0.75]).withColumnRenamed("n", "_n")
    iqr = F.col("q2") - F.col("q0")
    fences = q.select(by, "q0", "q1", "q2", iqr.alias("iqr"), (F.col("q0") - 1.5 * iqr).alias("_low"), (F.col("q2") + 1.5 * iqr).alias("_high")).checkpoint()
    rows = df.select(by, finite(F.col(value)).alias("_x")).where("_x is not null")
    x, low, high = F.col("_x"), F.col("_low"), F.col("_high")
    out = join_groups(rows, fences, [by], "_x").groupBy(by, "q0", "q1", "q2", "iqr").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(x >= low, x)).alias("whisker_low"),
        F.max(F.when(x <= high, x)).alias("whisker_high"),
        F.count_if((x < low) | (x > high)).alias("outliers"),
    )
    return out.select(
        by, "n", F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3"), "iqr", "whisker_low", "whisker_high", "outliers",
        class_label(F.col(by)).alias("label"),
    )


def _bin(x: Column, lo: float, hi: float, bins: int) -> Column:
    if hi == lo:
        return F.lit(0)
    return F.least(F.floor((x - F.lit(lo)) * F.lit(bins / (hi - lo))), F.lit(bins - 1)).cast("int")


def latency_histogram(df: DataFrame, value: str = "log_latency", bins: int = K.HIST_BINS) -> DataFrame:
    """Equal-width histogram over [min, max], last bin closed; one grouped count."""
    x = finite(F.col(value))
    ext = df.agg(F.min(x).alias("mn"), F.max(x).alias("mx")).collect()[0]
    lo, hi = ext["mn"], ext["mx"]
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, lower double, upper double, n long")
    width = (hi - lo) / bins
    b = _bin(x, lo, hi, bins)
    return (
        df.where(x.isNotNull())
        .groupBy(b.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("lower"), (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("upper"), "n")
    )


def density_2d(df: DataFrame, pairs: list[tuple[str, str, str]], grid: int = K.HIST_BINS) -> DataFrame:
    """Counts on a grid x grid lattice, only non-empty cells, for each (name, x, y)."""
    out = None
    aggs = []
    for name, xc, yc in pairs:
        aggs += [F.min(finite(F.col(xc))).alias(f"{name}_xmn"), F.max(finite(F.col(xc))).alias(f"{name}_xmx")]
        aggs += [F.min(finite(F.col(yc))).alias(f"{name}_ymn"), F.max(finite(F.col(yc))).alias(f"{name}_ymx")]
    ext = df.agg(*aggs).collect()[0]
    elems = []
    for name, xc, yc in pairs:
        x, y = finite(F.col(xc)), finite(F.col(yc))
        ix = _bin(x, ext[f"{name}_xmn"], ext[f"{name}_xmx"], grid)
        iy = _bin(y, ext[f"{name}_ymn"], ext[f"{name}_ymx"], grid)
        elems.append(F.when(x.isNotNull() & y.isNotNull(), F.struct(F.lit(name).alias("plot"), ix.alias("ix"), iy.alias("iy"))))
    exploded = df.select(F.explode(F.array(*elems)).alias("e")).where(F.col("e").isNotNull()).select("e.*")
    out = exploded.groupBy("plot", "ix", "iy").agg(F.count(F.lit(1)).alias("n"))
    return out


def density_by_class(
    df: DataFrame, value: str = "log_throughput", by: str = "congestion", grid: int = K.DENSITY_GRID, prebins: int = 1000
) -> DataFrame:
    """Gaussian kernel density per class on a grid over the class range.

    Bandwidth is Scott's rule (sample std x n^-1/5).  Rows are first reduced to
    a ``prebins``-bin histogram per class (one grouped count), so the kernel sum
    costs grid x prebins per class regardless of the row count.  Any number of
    classes: the class statistics join on the class, without a broadcast hint.
    """
    ensure_checkpoint_dir(df.sparkSession)
    rows = df.select(F.col(by).alias("_by"), finite(F.col(value)).alias("x")).where("x is not null")
    # a row per class, kept so that the table is read twice in all
    stats = rows.groupBy("_by").agg(F.count("x").alias("n"), F.stddev_samp("x").alias("sd"), F.min("x").alias("mn"), F.max("x").alias("mx")).where("n >= 2")
    wide = (F.col("mx") - F.col("mn")) / F.lit(prebins)
    stats = stats.withColumns({"h": F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2)), "w": wide}).checkpoint()
    bin_ = F.when(F.col("w") > 0, F.least(F.floor((F.col("x") - F.col("mn")) / F.col("w")), F.lit(prebins - 1))).otherwise(F.lit(0)).cast("int")
    binned = join_groups(rows, stats.select("_by", "mn", "w"), ["_by"], "x").groupBy("_by", bin_.alias("b")).agg(F.count(F.lit(1)).alias("c"))
    points = stats.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
    points = points.withColumn("grid_x", F.col("mn") + (F.col("mx") - F.col("mn")) * F.col("g") / F.lit(grid - 1))
    center = F.col("mn") + (F.col("b") + 0.5) * F.col("w")
    kern = points.join(binned, "_by").withColumn("k", F.col("c") * F.exp(-0.5 * F.pow((F.col("grid_x") - center) / F.col("h"), 2)))
    kern = kern.groupBy("_by", "g", "grid_x", "h", "n").agg(F.sum("k").alias("ks"))
    density = F.col("ks") / (F.col("n") * F.col("h") * F.lit(math.sqrt(2 * math.pi)))
    return kern.select(F.col("_by").alias(by), F.col("g").alias("point"), "grid_x", density.alias("density"), class_label(F.col("_by")).alias("label"))


def class_distribution(df: DataFrame, target: str = "congestion") -> DataFrame:
    return df.groupBy(F.col(target).cast("int").alias(target)).agg(F.count(F.lit(1)).alias("n"))


def binary_metrics(df: DataFrame, label: str, pred: str, rows: str | None = None) -> DataFrame:
    """Confusion cells, accuracy, precision, recall and F1 (0 for 0/0).

    ``rows`` names a column with the number of rows that each row stands for.
    """
    y, p = F.col(label).cast("int"), F.col(pred).cast("int")
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col(rows))), F.lit(0)) if rows else F.count_if(c)
    one = df.agg(
        count((y == 1) & (p == 1)).cast("long").alias("tp"),
        count((y == 0) & (p == 1)).cast("long").alias("fp"),
        count((y == 1) & (p == 0)).cast("long").alias("fn"),
        count((y == 0) & (p == 0)).cast("long").alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ["tp", "fp", "fn", "tn"])
    prec = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))
    rec = F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    return one.select(
        "tp", "fp", "fn", "tn",
        F.coalesce(F.try_divide(tp + tn, tp + tn + fp + fn), F.lit(0.0)).alias("accuracy"),
        prec.alias("precision"),
        rec.alias("recall"),
        F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1"),
    )


def preview_rows(df: DataFrame, order_cols: list[str], n: int = 50) -> DataFrame:
    """First ``n`` rows in order (TakeOrderedAndProject: bounded per task)."""
    return df.orderBy(*order_cols).limit(n)


def hash_unit(seed: int | str, key_cols: list[str]) -> Column:
    """Deterministic per-row number in [0, 1) from md5(seed:key)."""
    s = F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in key_cols])
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def stable_sample(df: DataFrame, key_cols: list[str], n: int, seed: int = 42) -> DataFrame:
    """Exact seeded sample of ``n`` rows: the ``n`` smallest md5(seed:key) values."""
    s = F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in key_cols])
    return df.withColumn("_h", F.md5(s)).orderBy("_h", *key_cols).limit(n).drop("_h")


def stratified_split(df: DataFrame, key_cols: list[str], target: str = "congestion", test_fraction: float = 0.2, seed: int = 99) -> DataFrame:
    """Per-row split by a seeded hash threshold (same ~fraction in every class, no shuffle)."""
    return df.withColumn("split", F.when(hash_unit(seed, key_cols) < test_fraction, "test").otherwise("train"))
