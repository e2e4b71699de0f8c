"""Derived tables and models stored once and reused while their inputs stay the same.

A stored result lives in a shared folder under its name and the fingerprint of its
input files (path, size and time of change of each, hashed together), of the
settings it was made with and of this package's code.  A changed, added or removed
file, another setting or a new version gives another fingerprint, so what was
stored before is not found any more and is built again.  Sessions share results.  A result is written
to a folder of its own and becomes visible by a one-line manifest afterwards: a
build that dies leaves nothing that is read, and of two builds at once the least
path is used by both from then on.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from functools import cache
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: A session may name a folder that outlives it; else the checkpoint folder is used.
FOLDER = "spark.flowtide.store"


@cache
def _code() -> str:
    """A hash of the package's sources that make stored results."""
    here, h = Path(__file__).resolve().parent.parent, hashlib.sha256()
    for f in sorted(p for part in ("functions", "operators", "plans", "sources") for p in (here / part).glob("*.py")):
        h.update(f.name.encode() + f.read_bytes())
    return h.hexdigest()


def fingerprint(spark: SparkSession, paths: list[str], settings: object = None) -> str:
    """One hash of the listing of all files under ``paths`` (no content is read), the settings and the code."""
    files = spark.read.format("binaryFile").load(paths).select("path", "length", "modificationTime")
    row = files.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("size"), *[F.sum(F.xxhash64(F.lit(k), *files.columns).cast("decimal(38,0)")).alias(f"h{k}") for k in (1, 2)]).first()
    return hashlib.sha256("|".join(map(str, [*row, settings, _code()])).encode()).hexdigest()[:32]


def stored_folder(spark: SparkSession, name: str, inputs: list[str], build: Callable[[str], None], settings: object = None) -> str:
    """The folder that ``build`` filled for the inputs as they are now."""
    root = (spark.conf.get(FOLDER, None) or ensure_checkpoint_dir(spark)).rstrip("/")
    place = f"{root}/store/{name}-{fingerprint(spark, inputs, settings)}"
    found = _manifest(spark, place)
    if found is None:
        path = f"{place}/{uuid.uuid4().hex}"
        build(path)
        spark.createDataFrame([(path,)], "path string").coalesce(1).write.mode("append").text(f"{place}/manifest")
        found = _manifest(spark, place)
    return found


def stored_table(spark: SparkSession, name: str, inputs: list[str], build: Callable[[], DataFrame], settings: object = None) -> DataFrame:
    """The table of ``build``, written once for the inputs as they are now."""
    return spark.read.parquet(stored_folder(spark, name, inputs, lambda path: build().write.parquet(path), settings))


def scratch_folder(spark: SparkSession, what: str) -> str:
    """A fresh folder (not yet made) that executors and driver share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def _manifest(spark: SparkSession, place: str) -> str | None:
    try:
        return spark.read.text(f"{place}/manifest").agg(F.min("value")).first()[0]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
