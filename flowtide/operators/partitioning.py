"""Partition counts that a session names."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: A session may name a partition count for tables that one file split would read on one core.
SPREAD = "spark.flowtide.spread"


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """``df`` dealt into ``partitions``, or as many as the session names; else as it is.

    The plan follows from the setting alone, never from the size of the input.
    """
    n = partitions or int(df.sparkSession.conf.get(SPREAD, "0"))
    return df.repartition(n) if n > 0 else df
