"""Contiguous shards of equal bytes by a distributed prefix sum.

DataFrame functions only.  Narrow rows (no text) are range-partitioned in
``doc_id`` order and kept; each partition's totals give every row its global
byte position: a running sum inside the partition plus the totals of the
partitions before it (a table with one row per partition).  The total is cut at
equal targets; a row belongs to the target that its middle byte falls in, so
each shard is within one row's size of the target.

Rows: a null text has size 1 and checksum 0.  Null ids come first.  Repeated
ids and rows are told apart by their place in the input, so a hot id is spread
over partitions like any other rows.  An empty table gives no rows; with fewer
rows than shards some shards are empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, shuffle_partitions

SHARDS = 16


def shards_by_bytes(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Rows: doc_id, size, text_crc32, law, shard, slot, grown_shard (null)."""
    text = F.col("text").cast("string")
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.monotonically_increasing_id().alias("place"),
    )
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("place")]
    dealt = cut(
        narrow.repartitionByRange(shuffle_partitions(docs.sparkSession), *order)
        .sortWithinPartitions(*order)
        .select("doc_id", "size", "text_crc32", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    bases = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all_bytes"),
    )
    inside = Window.partitionBy("part").orderBy("at")
    placed = (
        dealt.select(
            "*",
            F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"),
            F.row_number().over(inside).alias("rn"),
        )
        .join(F.broadcast(bases), "part")  # one row per shuffle partition
        .select(
            "doc_id", "size", "text_crc32",
            F.expr(f"cast(least({shards - 1}, ((bytes_before + start) * 2 + size) * {shards} div (2 * all_bytes)) as int)").alias("shard"),
            (F.col("rows_before") + F.col("rn") - 1).alias("row"),
        )
    )
    first = placed.groupBy("shard").agg(F.min("row").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
