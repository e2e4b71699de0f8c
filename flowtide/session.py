"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "flowtide", extra: dict | None = None) -> SparkSession:
    """A session with the engine's SQL settings.

    Under ``spark-submit`` the master and the driver's memory are the submitter's.
    """
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # generated methods above 8 KB of bytecode are never JIT-compiled by the JVM;
        # fall back to per-expression code for such stages instead of interpreting them
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
    )
    if "PYSPARK_GATEWAY_PORT" not in os.environ:
        b = b.master(master).config("spark.driver.memory", "8g")
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    It is used as it is configured.  Only a local session without the setting
    gets a scratch folder; on a cluster a missing setting is an error, since a
    folder of one machine would lose data.
    """
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not current:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="flowtide-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return current
