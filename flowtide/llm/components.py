"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


#: Tasks of a round: one for so many edges, and a few at least.  A round has seven stages of little
#: work; with a task for each shuffle partition the start of tasks would be most of it.
TASK_EDGES = 16_384
LEAST_TASKS = 8


def connected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, root`` for every node of the edges; the root is the least node.

    Large-star and small-star rounds: each node's neighbours above it (then
    those below it) are hung on its least neighbour, until nothing moves.  A
    hub's neighbours stay rows of a join, which adaptive execution can split;
    they are never gathered in one row.  Each round is checkpointed.
    """
    now = cut(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    )
    mark = _mark(now)
    while True:
        tasks = max(LEAST_TASKS, -(-mark[0] // TASK_EDGES))
        # a node without neighbours below it is the least beside its neighbours above
        least = now.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m")).coalesce(tasks)
        large = now.join(least, "v", "left").select("u", F.coalesce("m", "v").alias("v"))
        large = large.coalesce(tasks).distinct().coalesce(tasks)
        least = large.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks)
        # the row of the least neighbour stays for the node itself
        hung = F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v"))
        small = large.join(least, "u").select(hung.alias("u"), F.col("m").alias("v"))
        now = cut(small.coalesce(tasks).distinct().coalesce(tasks))
        seen = _mark(now)
        if seen == mark:
            break
        mark = seen
    roots = now.groupBy("v").agg(F.first("v").alias("root")).select(F.col("v").alias("node"), "root")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
