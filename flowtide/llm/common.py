"""Shared helpers: cutting lineage, scratch folders, table reading."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, which executors and driver both see.

    Without that setting a local session gets a folder of its own; on a cluster
    its absence is an error.
    """
    return ensure_checkpoint_dir(spark).rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path (not yet made) under the shared folder."""
    return f"{shared_dir(spark)}/flowtide-{what}-{uuid.uuid4().hex}"


#: Spark then removes an execution's shuffle files when it ends, not when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaning(spark: SparkSession):
    """Plans made inside remove their shuffle files once they have run."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession, rows: int):
    """Plans run inside send Python at most ``rows`` rows at once: for rows of some MB."""
    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there; its shuffle files go."""
    shared_dir(df.sparkSession)
    with cleaning(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


class Steps:
    """Tables that a job writes between its steps and drops when they are used up.

    A table is Parquet in a folder of its own under the shared folder.  ``drop``
    overwrites it with nothing, through Spark, so it works on any file system.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.what, self.paths = spark, what, {}

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        self.paths[name] = path = scratch(self.spark, f"{self.what}-{name}")
        with cleaning(self.spark):
            df.select("*").write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for n in names:
            self.spark.createDataFrame([], "dropped int").coalesce(1).write.mode("overwrite").parquet(self.paths.pop(n))


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
