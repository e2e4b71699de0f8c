"""Flow-record sources and sinks.

* ``read_flow_csv`` - every ``*.csv`` under a folder (or a glob / list of
  paths), headers whitespace-stripped and mapped to canonical snake_case names.
  Executors find the headers; each layout is one read, and the layouts are
  stacked with ``unionByName(allowMissingColumns=True)``.
* ``read_upload`` - a typed read that keeps bad records apart from good ones.
* ``require_columns`` / ``union_sources`` / ``read_table`` / ``write_report``.
"""

from __future__ import annotations

import csv
import os
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import finite, to_number
from ..functions.constants import RAW_HEADER_NAMES


def canonical_name(name: str) -> str:
    stripped = name.strip()
    return RAW_HEADER_NAMES.get(stripped, stripped)


def strip_headers(df: DataFrame) -> DataFrame:
    """Strip header whitespace and map known raw headers to canonical names."""
    return df.toDF(*[canonical_name(c) for c in df.columns])


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """Stack frames by column name; a column missing in a frame becomes null."""
    if not frames:
        raise FileNotFoundError("no flow sources to stack")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    """Session settings for the time of a block."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _first_line(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The path and first line with content of a partition, which is one file."""
    for b in batches:
        for line, path in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if line.strip():
                yield pa.RecordBatch.from_pylist([{"header": line, "path": path}])
                return


def csv_layouts(spark: SparkSession, path: str | list[str]) -> dict[tuple[str, ...], list[str]]:
    """The CSV files under a folder, glob, file or list of those by their header.

    One job on any file system Spark can read: a file is a task that reads its
    first lines and stops, and the headers are grouped in a shuffle.  Files
    without any line have no header and are left out.
    """
    one_file_each = {"spark.sql.files.maxPartitionBytes": str(1 << 60), "spark.sql.files.openCostInBytes": str(1 << 60), "spark.sql.execution.arrow.maxRecordsPerBatch": "8"}
    with _settings(spark, one_file_each):
        lines = spark.read.option("pathGlobFilter", "*.csv").text(path).select("value", F.col("_metadata.file_path").alias("path"))
        found = lines.mapInArrow(_first_line, "header string, path string").groupBy("header").agg(F.sort_array(F.collect_list("path")).alias("paths")).collect()
    out: dict[tuple[str, ...], list[str]] = {}
    for r in sorted(found, key=lambda r: r["paths"][0]):
        columns = tuple(next(csv.reader([r["header"].removeprefix("\ufeff")])))
        out.setdefault(columns, []).extend(r["paths"])
    return out


def read_flow_csv(spark: SparkSession, path: str | list[str], schema=None) -> DataFrame:
    """Read flow CSV files as strings (coercion is an explicit later step).

    One way for every file system: files are grouped by their header, each
    layout is one Spark read that fails if a file's header does not match, and
    the layouts are stacked by name.  An empty folder is an error.  ``schema``
    picks columns by (canonical) name and casts them; text that does not parse
    is null.  Without it numbers are not inferred: ``coerce_numeric`` does that.
    """
    layouts = csv_layouts(spark, path)
    if not layouts:
        raise FileNotFoundError(f"No CSV files found in {path}")
    frames = []
    for columns, group in layouts.items():
        text = T.StructType([T.StructField(c, T.StringType()) for c in columns])
        frames.append(strip_headers(spark.read.csv(group, header=True, schema=text, enforceSchema=False)))
    out = union_sources(frames)
    if schema is None:
        return out
    wanted = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    names = [canonical_name(f.name) for f in wanted]
    return out.select(*[(F.col(f"`{n}`").try_cast(f.dataType) if n in out.columns else F.lit(None).cast(f.dataType)).alias(n) for n, f in zip(names, wanted)])


PROBLEM, RAW_LINE = "problem", "raw_line"


def read_upload(spark: SparkSession, path: str | list[str], required: list[str], optional: dict[str, float] | None = None, row_cap: int | None = None) -> DataFrame:
    """Uploaded CSV rows with numeric model inputs, bad ones marked and kept.

    ``required`` columns must be in every file's header (an error lists what is
    missing) and hold a finite number in every good row; a missing or unreadable
    ``optional`` one takes its default.  Other columns stay text.  A row that has
    too many or too few fields, or a bad required value, carries the reason in
    ``problem`` and its text in ``raw_line``; ``accepted`` and ``quarantined``
    part the two.  ``row_cap`` keeps the first rows in file order (a bound that
    the caller chooses; none by default).
    """
    optional, hidden = optional or {}, ["_malformed", "_line", "_file", "_at"]
    frames = []
    for columns, group in csv_layouts(spark, path).items():
        names = [canonical_name(c) for c in columns]
        if missing := [c for c in required if c not in names]:
            raise ValueError(f"missing columns: {', '.join(missing)}")
        schema = T.StructType([T.StructField(c, T.StringType()) for c in (*columns, "_malformed")])
        rows = spark.read.csv(group, header=True, schema=schema, mode="PERMISSIVE", columnNameOfCorruptRecord="_malformed")
        line = F.coalesce("_malformed", F.to_csv(F.struct(*[F.col(f"`{c}`") for c in columns])))
        rows = rows.select("*", line.alias("_line"), F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_at"))
        frames.append(rows.toDF(*names, *hidden))
    if not frames:
        raise FileNotFoundError(f"No CSV files found in {path}")
    df = union_sources(frames)
    number = {c: finite(to_number(c)) for c in [*required, *(c for c in optional if c in df.columns)]}
    bad = F.concat_ws(", ", *[F.when(number[c].isNull(), F.lit(c)) for c in required])
    problem = F.when(F.col("_malformed").isNotNull(), F.lit("malformed line")).when(bad != "", F.concat(F.lit("no number: "), bad))
    raw = F.when(problem.isNotNull(), F.col("_line"))
    typed = {c: number[c] for c in required} | {c: F.coalesce(number[c], F.lit(float(v))) if c in number else F.lit(float(v)) for c, v in optional.items()}
    out = df.withColumns({PROBLEM: problem, RAW_LINE: raw}).withColumns(typed)
    if row_cap is not None:
        out = out.orderBy("_file", "_at").limit(row_cap)
    return out.drop(*hidden)


def accepted(upload: DataFrame) -> DataFrame:
    return upload.where(F.col(PROBLEM).isNull()).drop(PROBLEM, RAW_LINE)


def quarantined(upload: DataFrame) -> DataFrame:
    return upload.where(F.col(PROBLEM).isNotNull()).select(PROBLEM, RAW_LINE)


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """``df``, or an error that lists the columns it lacks (uploaded files)."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def write_report(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Batch report sink (CSV or parquet); rounding for display belongs here."""
    w = df.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)
