"""URL rules by a sort-merge range join over reversed-host keys.

DataFrame functions only.  A rule (host, path) becomes the canonical key
``com.example#/path``: its labels reversed, a ``#`` (which no host or path can
hold), its path.  A url has one such key for its host and one for each parent
domain, so a rule fits it exactly when the rule's key is a prefix of one of
them: the rule is the interval of all keys that start with its key.

Rules and url keys are sorted together by range (ties by kind and row, so a hot
host spreads over many partitions).  A sweep in that order carries the rule that
opened last with the stack of the rules around it; prefix intervals are nested
or apart, so every rule that fits a key is on that stack.  Each partition starts
with the stack that the partition before it ends with (a row per partition).
Longest rule (host and path together, then host) wins.

Rows: a null url or one without ``://`` has empty host and path, no rule and the
default verdict.  Null page ids and repeated rows are judged one by one.
Repeated rules with both actions: block wins.  Without rules all get the
default; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, shuffle_partitions

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def reversed_host(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def stacked(rules: DataFrame) -> DataFrame:
    """Rules (host, path, action) as (key, stack): itself and the rules around it.

    Found by joining every proper prefix of a key with the keys; a rule's
    length bounds its prefixes.
    """
    known = (
        rules.where("host is not null and action is not null")
        .select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("/")).alias("path"), "action")
        .groupBy("host", "path").agg(F.max("action").alias("action"))  # of both, block
        .select(F.concat(reversed_host(F.col("host")), F.lit("#"), F.col("path")).alias("key"), F.concat("host", "path").alias("rule"), F.length("host").alias("host_len"), "action")
    )
    entry = F.struct(F.length("rule").alias("len"), "host_len", "key", "rule", "action")
    prefixes = known.select(F.col("key").alias("inner"), F.explode(F.expr("transform(sequence(1, length(key)), i -> substring(key, 1, i))")).alias("key"))
    return prefixes.join(known, "key").groupBy("inner").agg(F.sort_array(F.collect_list(entry), asc=False).alias("stack")).withColumnRenamed("inner", "key")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Rows: page_id, host, path, rule, verdict.  Reads ``page_id`` and ``url``."""
    url = F.col("url").cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), F.monotonically_increasing_id().alias("row"))
    label = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(label)), lambda i: F.concat(F.array_join(F.reverse(F.slice(label, i, F.size(label))), "."), F.lit("#"), F.col("path")))
    asked = rows.select("*", F.explode(suffixes).alias("key"))
    opened = stacked(rules)
    empty = opened.schema["stack"].dataType.simpleString()
    events = opened.select("key", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("row"), F.lit(None).cast("long").alias("page_id"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"), "stack").unionByName(
        asked.select("key", F.lit(1).alias("kind"), "row", "page_id", "host", "path", F.lit(None).cast(empty).alias("stack"))
    )
    order = ["key", "kind", "row"]
    swept = cut(
        events.repartitionByRange(shuffle_partitions(pages.sparkSession), *order).sortWithinPartitions(*order)
        .select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    )
    ends = swept.groupBy("part").agg(F.max_by("stack", F.when(F.col("kind") == 0, F.col("at"))).alias("end"))
    carried = ends.select("part", F.last("end", ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carry"))
    here = F.last("stack", ignorenulls=True).over(Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    met = (
        swept.select("*", here.alias("open"))
        .where("kind = 1")
        .join(F.broadcast(carried), "part")  # one row per shuffle partition
        .select("row", "page_id", "host", "path", F.get(F.filter(F.coalesce("open", "carry"), lambda r: F.col("key").startswith(r["key"])), F.lit(0)).alias("r"))
    )
    best = met.groupBy("row").agg(F.first("page_id").alias("page_id"), F.first("host").alias("host"), F.first("path").alias("path"), F.max("r").alias("r"))
    return best.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.action", F.lit(default)).alias("verdict"))
