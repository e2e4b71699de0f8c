"""Table-wide quantiles ("profiles") computed as distributed Spark jobs.

Many rules compare each row with a quantile of the whole table (p99 clip,
p75 target, p90 spike threshold ...).  The quantiles are fitted once into a
small ``Profile`` of named scalars, which can be stored, applied to other tables
and to streams, and read back as a one-row table that a plan joins lazily.

Exact quantiles use linear interpolation between order statistics
(``(n-1)*q``), the definition of pandas ``quantile`` and DuckDB
``quantile_cont``.  Spark's built-in exact ``percentile`` keeps a value->count
map per group and merges it in a single task, which does not survive 100 TB.
``method="exact"`` therefore *selects* the needed order statistics in at most two
scans of the table, whatever the number of columns and quantiles:

1. one grouped count over fixed bins (``BINS`` to each power of two, so the bins
   need no extremes first and partial counts merge) of all columns.  Each rank's
   bin, with its least and greatest value, brackets the order statistic; ties and
   extremes are known from that alone;
2. the values inside the brackets, well below a hundredth of a column each.  Few
   are fetched; more are written once to the checkpoint folder and cut further
   there (linear bins of the brackets), without the table.

``grouped_quantiles`` does the same for any number of groups with brackets as
rows.  What reaches the driver is a number of bins that does not follow the data.
``method="approx"`` is one aggregate with Spark's quantile sketch.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import col, finite
from ..session import ensure_checkpoint_dir


@dataclass
class Profile:
    """Named scalars fitted from a table (quantiles, extremes, rules).

    A scalar is inlined as a literal.  ``save`` writes them as a one-row table.
    """

    values: dict = field(default_factory=dict)

    def __getitem__(self, key):
        return self.values[key]

    def get(self, key, default=None):
        return self.values.get(key, default)

    def __contains__(self, key) -> bool:
        return self.values.get(key) is not None

    def update(self, other: dict) -> "Profile":
        self.values.update(other)
        return self

    def attach(self, df: DataFrame) -> DataFrame:
        return df

    def detach(self, df: DataFrame) -> DataFrame:
        return df

    def column(self, key: str) -> Column:
        return F.lit(self.values[key])

    def row(self, spark: SparkSession) -> DataFrame:
        """The scalars as a one-row table (missing ones are left out)."""
        kinds = {bool: "boolean", int: "long", float: "double", str: "string"}
        known = {k: v for k, v in self.values.items() if v is not None} | {"fitted": True}
        return spark.createDataFrame([tuple(known.values())], ", ".join(f"`{k}` {kinds[type(v)]}" for k, v in known.items()))

    def save(self, spark: SparkSession, path: str) -> None:
        self.row(spark).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Profile":
        return cls({k: v for k, v in spark.read.parquet(path).first().asDict().items() if k != "fitted"})


class RowProfile:
    """A stored profile as a one-row table that plans join, without reading it first.

    ``attach`` joins the row (one row by construction, so it is broadcast) and
    ``column`` names a scalar of it; building a plan starts no job.
    """

    def __init__(self, row: DataFrame):
        self.one = row

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "RowProfile":
        return cls(spark.read.parquet(path))

    def __contains__(self, key) -> bool:
        return key in self.one.columns

    def attach(self, df: DataFrame) -> DataFrame:
        return df.crossJoin(F.broadcast(self.one.select([F.first(f"`{c}`").alias(f"_profile_{c}") for c in self.one.columns])))

    def detach(self, df: DataFrame) -> DataFrame:
        return df.drop(*[f"_profile_{c}" for c in self.one.columns])

    def column(self, key: str) -> Column:
        return F.col(f"_profile_{key}")


def lerp(lo: float, hi: float, frac: float) -> float:
    if frac == 0.0 or lo == hi:
        return lo
    return lo + (hi - lo) * frac


#: Bins to each power of two in the first scan.
BINS = 64
#: Bins of a bracket in later rounds, which no longer read the table.
PARTS = 4096


def quantiles(
    df: DataFrame,
    targets: dict[str, tuple[str | Column, list[float]]],
    method: str = "exact",
    accuracy: int = 100_000,
    collect_cap: int = 20_000,
    bins: int = BINS,
) -> dict:
    """Quantiles of several columns in at most two scans.

    ``targets`` maps a name to ``(column, [q, ...])``; NaN/Inf/null are ignored
    (pandas drops them).  Returns ``{name: [value per q]}`` plus ``{name}__n``
    (non-null count), ``{name}__min``, ``{name}__max`` and, for the exact method,
    ``{name}__steps``: per q the two order statistics and the weight of the second.
    A column with no finite value yields ``None``.  ``accuracy`` is that of the
    sketch of ``method="approx"``.
    """
    exprs = {n: finite(col(c)) for n, (c, _) in targets.items()}
    if method == "approx":
        return _approximate(df, targets, exprs, accuracy)
    counted = histograms(df, exprs, bins)
    out, plan, wanted = {}, {}, {}
    for n, (_, qs) in targets.items():
        cells = counted[n]
        total = cells[-1].below + cells[-1].inside if cells else 0
        out |= {n + "__n": total, n + "__min": cells[0].lo if cells else None, n + "__max": cells[-1].hi if cells else None, n: [None] * len(qs)}
        if cells:
            plan[n] = [ranks(total, float(q)) for q in qs]
            wanted[n] = {k for k0, k1, _ in plan[n] for k in (k0, k1)}
    found = _select(df, exprs, counted, wanted, collect_cap)
    for n, steps in plan.items():
        out[n + "__steps"] = [(found[n, k0], found[n, k1], frac) for k0, k1, frac in steps]
        out[n] = [lerp(*s) for s in out[n + "__steps"]]
    return out


def order_statistics(df: DataFrame, targets: dict[str, tuple[str | Column, list[int]]], collect_cap: int = 20_000, bins: int = BINS) -> dict:
    """Exact k-th smallest values (0-based ranks over non-null finite values)."""
    exprs = {n: finite(col(c)) for n, (c, _) in targets.items()}
    counted = histograms(df, exprs, bins)
    size = {n: cells[-1].below + cells[-1].inside if cells else 0 for n, cells in counted.items()}
    wanted = {n: {int(k) for k in ks if 0 <= k < size[n]} for n, (_, ks) in targets.items()}
    found = _select(df, exprs, counted, wanted, collect_cap)
    return {n: [found.get((n, int(k))) for k in ks] for n, (_, ks) in targets.items()}


def _approximate(df: DataFrame, targets: dict, exprs: dict[str, Column], accuracy: int) -> dict:
    aggs = [e for i, x in enumerate(exprs.values()) for e in (F.count(x).alias(f"n{i}"), F.min(x).alias(f"mn{i}"), F.max(x).alias(f"mx{i}"))]
    aggs += [F.percentile_approx(exprs[n], [float(q) for q in qs], accuracy).alias(f"ap{i}") for i, (n, (_, qs)) in enumerate(targets.items()) if qs]
    row, out = df.agg(*aggs).first(), {}
    for i, (n, (_, qs)) in enumerate(targets.items()):
        out |= {n + "__n": row[f"n{i}"], n + "__min": row[f"mn{i}"], n + "__max": row[f"mx{i}"]}
        out[n] = [float(v) for v in row[f"ap{i}"]] if qs and row[f"n{i}"] else [None] * len(qs)
    return out


def ranks(n: int, q: float) -> tuple[int, int, float]:
    """The two order statistics around a quantile and the weight of the second."""
    at = (n - 1) * q
    low = int(math.floor(at))
    return low, min(low + 1, n - 1) if at > low else low, at - low


@dataclass(frozen=True)
class _Bracket:
    """Values ``lo`` to ``hi`` of a column: ``inside`` rows, ``below`` rows under them."""

    name: str
    lo: float
    hi: float
    below: int
    inside: int

    def value(self, rank: int) -> float | None:
        """The order statistic, where the extremes tell it."""
        if self.lo == self.hi or rank == self.below:
            return float(self.lo)
        return float(self.hi) if rank == self.below + self.inside - 1 else None


def magnitude(x: Column, bins: int = BINS) -> Column:
    """Number of a double's fixed bin: rising, ``bins`` to each power of two; 0 has its own."""
    return F.when(x == 0, F.lit(0).cast("long")).otherwise(F.floor(F.signum(x) * (F.log2(F.abs(x)) + F.lit(1080.0)) * F.lit(float(bins))))


def _tall(df: DataFrame, exprs: dict[str, Column]) -> DataFrame:
    """(t, x): the finite values of all columns, ``t`` counting the columns.

    A filter on generated rows is not pushed down, so no formula is written out twice.
    """
    cells = [x.cast("double") for x in exprs.values()]
    return df.select(F.array(*cells).alias("v")).select(F.posexplode("v").alias("t", "x")).where("x is not null")


def histograms(df: DataFrame, exprs: dict[str, Column], bins: int = BINS) -> dict[str, list[_Bracket]]:
    """Every column's bins that hold rows, ascending (one scan)."""
    names = list(exprs)
    got: dict[str, list] = {n: [] for n in names}
    counts = _tall(df, exprs).groupBy("t", magnitude(F.col("x"), bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    for r in counts.collect():
        got[names[r["t"]]].append((r["bin"], r["lo"], r["hi"], r["n"]))
    return {n: _stacked(n, cells) for n, cells in got.items()}


def _stacked(name: str, cells: list[tuple], below: int = 0) -> list[_Bracket]:
    out = []
    for _, lo, hi, n in sorted(cells):
        out.append(_Bracket(name, lo, hi, below, n))
        below += n
    return out


def _select(df: DataFrame, exprs: dict[str, Column], counted: dict[str, list[_Bracket]], wanted: dict[str, set[int]], collect_cap: int) -> dict:
    """``{(name, rank): order statistic}``; the table is read once more, if at all."""
    pending = {(n, k): next(b for b in counted[n] if k < b.below + b.inside) for n, ks in wanted.items() for k in ks}
    found, names, kept = {}, list(exprs), None
    while True:
        for (n, k), b in list(pending.items()):
            if (v := b.value(k)) is not None:
                found[n, k] = v
                del pending[n, k]
        if not pending:
            return found
        brackets = list(dict.fromkeys(pending.values()))
        few = sum(b.inside for b in brackets) <= collect_cap
        inside = _inside(_tall(df, exprs) if kept is None else kept, names, brackets)
        if few:
            values: dict[int, list] = {}
            for r in inside.collect():
                values.setdefault(r["t"], []).append(r["x"])
            for t in values:
                values[t].sort()
            for (n, k), b in pending.items():
                own = values[names.index(n)]
                found[n, k] = float(own[bisect_left(own, b.lo) + k - b.below])
            return found
        if kept is None:
            ensure_checkpoint_dir(df.sparkSession)
            kept = inside = inside.checkpoint()
        cut = _cut(inside, names, brackets)
        for (n, k), b in pending.items():
            pending[n, k] = next(c for c in cut[b] if k < c.below + c.inside)


def _inside(tall: DataFrame, names: list[str], brackets: list[_Bracket]) -> DataFrame:
    keep = F.lit(False)
    for b in brackets:
        keep = keep | ((F.col("t") == names.index(b.name)) & F.col("x").between(float(b.lo), float(b.hi)))
    return tall.where(keep)


def _cut(kept: DataFrame, names: list[str], brackets: list[_Bracket]) -> dict:
    """Every bracket's linear bins that hold rows, as brackets in ascending order."""
    of, step = F.lit(None).cast("int"), F.lit(None).cast("long")
    for i, b in enumerate(brackets):
        here = (F.col("t") == names.index(b.name)) & F.col("x").between(float(b.lo), float(b.hi))
        of = F.when(here, F.lit(i)).otherwise(of)
        step = F.when(here, _step(F.col("x"), F.lit(float(b.lo)), F.lit(float(b.hi)))).otherwise(step)
    cells: dict[int, list] = {}
    counts = kept.select(of.alias("b"), step.alias("bin"), "x").groupBy("b", "bin").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("n"))
    for r in counts.collect():
        cells.setdefault(r["b"], []).append((r["bin"], r["lo"], r["hi"], r["n"]))
    return {b: _stacked(b.name, cells[i], b.below) for i, b in enumerate(brackets)}


def _step(x: Column, lo: Column, hi: Column) -> Column:
    """Number of ``x``'s linear bin of the bracket: 0 holds ``lo``, another one ``hi``."""
    width = F.when((hi - lo) / F.lit(float(PARTS)) > 0, (hi - lo) / F.lit(float(PARTS))).otherwise(hi - lo)
    return F.least(F.floor((x - lo) / width), F.lit(PARTS - 1).cast("long"))


#: Groups that are sent to every executor; more are joined by shuffle, each hot group cut in ``SALTS``.
BROADCAST_GROUPS = 100_000
SALTS = 32


def join_groups(rows: DataFrame, groups: DataFrame, on: list[str], value: str) -> DataFrame:
    """``rows`` with the columns of their group (``groups``: kept rows, few to each key).

    A group's rows never meet in one task: a table of few groups is broadcast, whose
    size is counted first, and a larger one is repeated for the salts of ``value``.
    """
    if groups.count() <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(groups), on)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(value), F.lit(SALTS)).cast("int"))
    return salted.join(groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*on, "_salt"]).drop("_salt")


def grouped_quantiles(df: DataFrame, by: list[str], value: str | Column, qs: list[float], window_rows: int = 10_000) -> DataFrame:
    """One row per group: its columns, ``n`` and ``q0``, ``q1``, ... (exact, interpolated).

    Two scans of the table for any number of groups and quantiles; brackets are
    rows that join on the group and bin, and no side is broadcast by hint.  A group
    is cut into bins before anything of it is sorted, so a hot group is no single
    task: windows see at most ``window_rows`` values, or one row per bin.  Rows
    with a null group column or no finite value are left out.
    """
    ensure_checkpoint_dir(df.sparkSession)
    whole = None
    for c in by:
        whole = F.col(c).isNotNull() if whole is None else whole & F.col(c).isNotNull()
    rows = df.where(whole).select(*by, finite(col(value)).alias("x")).where("x is not null").withColumn("cell", magnitude(F.col("x")).cast("string"))
    bins = rows.groupBy(*by, "cell").agg(F.count(F.lit(1)).alias("inside"), F.min("x").alias("lo"), F.max("x").alias("hi")).checkpoint()
    totals = bins.groupBy(*by).agg(F.sum("inside").alias("n"))
    at = [(F.col("n") - 1) * F.lit(float(q)) for q in qs]
    wanted = F.array_distinct(F.concat(*[F.array(F.floor(a), F.ceil(a)) for a in at]))
    bins = bins.join(totals.select(*by, wanted.alias("wanted")), by).withColumn("start", F.lit(0).cast("long"))
    found = []
    while True:
        order = Window.partitionBy(*by, "start").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
        cells = bins.withColumn("below", F.col("start") + F.coalesce(F.sum("inside").over(order), F.lit(0)))
        mine = F.filter("wanted", lambda k: (k >= F.col("below")) & (k < F.col("below") + F.col("inside")))
        cells = cells.withColumn("wanted", mine).where(F.size("wanted") > 0).checkpoint()
        end = F.col("below") + F.col("inside") - 1
        value_of = F.when((F.col("lo") == F.col("hi")) | (F.col("k") == F.col("below")), F.col("lo")).when(F.col("k") == F.col("end"), F.col("hi"))
        told = cells.select(*by, F.explode("wanted").alias("k"), "lo", "hi", "below", end.alias("end")).select(*by, "k", value_of.alias("v"))
        found.append(told.where("v is not null"))
        inner = F.filter("wanted", lambda k: (k > F.col("below")) & (k < end))
        open_ = cells.where("lo < hi").withColumn("wanted", inner).where(F.size("wanted") > 0)
        most = open_.agg(F.max("inside")).first()[0]
        if most is None:
            break
        brackets = open_.select(*by, "cell", "lo", "hi", "below", "wanted")
        rows = join_groups(rows.select(*by, "cell", "x"), brackets, [*by, "cell"], "x")
        if most <= window_rows:
            place = Window.partitionBy(*by, "cell").orderBy("x")
            ranked = rows.withColumn("k", F.col("below") + F.row_number().over(place) - 1)
            found.append(ranked.where(F.array_contains("wanted", F.col("k"))).select(*by, "k", F.col("x").alias("v")))
            break
        rows = rows.withColumn("cell", F.concat_ws(":", "cell", _step(F.col("x"), F.col("lo"), F.col("hi")).cast("string"))).checkpoint()
        bins = rows.groupBy(*by, "cell", F.col("below").alias("start"), "wanted").agg(F.count(F.lit(1)).alias("inside"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    values = found[0]
    for more in found[1:]:
        values = values.unionByName(more)
    known = totals.join(values.groupBy(*by).agg(F.map_from_entries(F.collect_set(F.struct("k", "v"))).alias("at")), by)
    out = []
    for i, a in enumerate(at):
        low, high = F.element_at("at", F.floor(a)), F.element_at("at", F.ceil(a))
        out.append(F.when(low == high, low).otherwise(low + (high - low) * (a - F.floor(a))).alias(f"q{i}"))
    return known.select(*by, "n", *out)


def safe_scale(value, fallback) -> float:
    """Positive scale: the quantile if > 0, else a positive fallback, else 1."""
    if value is None or (isinstance(value, float) and math.isnan(value)) or value <= 0:
        fb = 0.0 if fallback is None or (isinstance(fallback, float) and math.isnan(fallback)) else float(fallback)
        return fb if fb > 0 else 1.0
    return float(value)
