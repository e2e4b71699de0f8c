"""Ordered (time-series) windows without a single-partition sort.

``Window.orderBy(...)`` with no ``partitionBy`` moves every row into one task
(``Exchange SinglePartition``).  Rolling means over a global row order are
computed here in two bounded-width steps instead:

1. ``ordered_index`` gives every row its global position ``_idx``: rows are
   range-partitioned on *all* order columns, sorted inside each partition and
   kept; a row's position in its partition plus the row counts of the
   partitions before it (one row per partition, broadcast) is its index.  Null
   keys come first and NaN last, as in any Spark sort, and a hot leading key is
   split by the later ones.
2. ``rolling`` cuts the index into blocks of ``block_rows`` rows and copies the
   last ``halo`` rows of each block into the next one, so every frame
   ``ROWS BETWEEN h PRECEDING AND CURRENT ROW`` is complete inside one block.
   The window then runs ``partitionBy(block)``: each task sees at most
   ``block_rows + halo`` rows no matter how large the table is.

The order key must be unique for the result to be deterministic (same rule as
any ordered window).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

IDX = "_idx"


def ordered_index(df: DataFrame, order_cols: list[str], partitions: int | None = None) -> tuple[DataFrame, int]:
    """Add ``_idx`` = 0-based position of the row in ``ORDER BY order_cols``.

    Returns the indexed frame and the row count.  The sorted rows are written to
    the checkpoint folder once, so whatever reads the index more than once (the
    halo of ``rolling``, a quantile after it) does not sort again, and a row's
    place cannot change when a lost task is run again.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(c).asc_nulls_first() for c in order_cols]
    kept = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).checkpoint(eager=True)
    part = F.shiftrightunsigned("_at", 33)
    counts = kept.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_off"), "_rows").collect()  # a row per partition
    table = spark.createDataFrame([(r["_part"], r["_off"]) for r in offsets], "_part long, _off long")
    out = kept.withColumn("_part", part).join(F.broadcast(table), "_part").withColumn(IDX, F.col("_off") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_off", "_at")
    return out, sum(r["_rows"] for r in offsets)


def rolling(
    indexed: DataFrame,
    stages: list[dict[str, Column]],
    halo: int,
    block_rows: int = 1_000_000,
) -> DataFrame:
    """Evaluate window expressions over ``ROWS`` frames ending at the current row.

    ``stages`` is a list of ``{out_col: fn(window_spec) -> Column}`` dicts;
    each stage may use columns produced by earlier stages (nested windows).
    ``halo`` must cover the total look-back (sum of the stages' preceding rows).
    """
    block_rows = max(block_rows, 4 * halo, 1)
    blk = F.floor(F.col(IDX) / F.lit(block_rows)).cast("long")
    own = indexed.withColumn("_blk", blk).withColumn("_halo", F.lit(False))
    tail = (
        indexed.where(F.col(IDX) % F.lit(block_rows) >= F.lit(block_rows - halo))
        .withColumn("_blk", blk + 1)
        .withColumn("_halo", F.lit(True))
    )
    both = own.unionByName(tail)
    base = Window.partitionBy("_blk").orderBy(IDX)
    for stage in stages:
        both = both.withColumns({name: fn(base) for name, fn in stage.items()})
    return both.where(~F.col("_halo")).drop("_blk", "_halo")


def rolling_mean(value: str | Column, window_rows: int):
    """fn(window) -> mean over the last ``window_rows`` rows incl. current (min 1)."""
    v = F.col(value) if isinstance(value, str) else value
    return lambda w: F.avg(v).over(w.rowsBetween(-(window_rows - 1), 0))
