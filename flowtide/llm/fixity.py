"""WARC fixity audit with Merkle trees over records and offset ranges.

Pages are stored as WARC files (a gzip member a record), one per task, with an index of their records
(file, number, offset, length).  A replica is hashed range by range of that
index; nothing in a damaged file is trusted or parsed.  A file's records, in
offset order, are the leaves of a tree; every ``FANOUT`` neighbours make a node
that hashes their digests and covers their offset range, up to one root a file.

An audit joins the roots of two replicas and goes down a level at a time through
the children of nodes that differ, so sound branches are not looked at again.
Records that are cut off show as differences.  A replica's own files and their
true sizes are leaves as well, each after its file's records: bytes behind the
last record and files that only one side has make the roots differ too.

Rows: null urls and html are written as empty; null and repeated page ids are
records like any other.  An empty table gives no files and no differences.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, shuffle_partitions
from .tokenfile import filesystem

FANOUT = 16
INDEX = "file string, number long, offset long, length long, page_id long"
_INDEX = pa.schema([("file", pa.string()), *((c, pa.int64()) for c in ("number", "offset", "length", "page_id"))])


def record(page_id: int | None, url: str | None, html: str | None, number: int) -> bytes:
    """One WARC/1.1 resource record as a gzip member, the same bytes for the same page."""
    body = (html or "").encode()
    name = hashlib.sha256(f"{page_id}|{number}|{url or ''}".encode()).hexdigest()
    head = [
        "WARC/1.1", "WARC-Type: resource", f"WARC-Record-ID: <urn:uuid:{name[:8]}-{name[8:12]}-{name[12:16]}-{name[16:20]}-{name[20:32]}>",
        "WARC-Date: 2000-01-01T00:00:00Z", f"WARC-Target-URI: {(url or '').splitlines()[0] if url else ''}", "Content-Type: text/html",
        f"WARC-Payload-Digest: sha256:{hashlib.sha256(body).hexdigest()}", f"Content-Length: {len(body)}",
    ]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", compresslevel=1, mtime=0)


def _store(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, out, number, at = TaskContext.get(), None, 0, 0
        for batch in batches:
            if out is None:
                system, base = filesystem(folder)
                system.create_dir(base, recursive=True)
                name = f"part-{task.partitionId():06d}.warc.gz"
                temp = f"{base}/.{name}.{task.taskAttemptId()}"
                out = system.open_output_stream(temp)
            rows = []
            for page_id, url, html in zip(*(batch.column(c).to_pylist() for c in range(3))):
                raw = record(page_id, url, html, number)
                out.write(raw)
                rows.append((name, number, at, len(raw), page_id))
                number, at = number + 1, at + len(raw)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _INDEX)], schema=_INDEX)
        if out is not None:
            out.close()
            system.move(temp, f"{base}/{name}")

    return run


def store(pages: DataFrame, folder: str) -> DataFrame:
    """Write pages (page_id, url, html) as WARC files; returns their index, kept as Parquet beside them."""
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    order = [F.col("page_id").asc_nulls_first(), "url"]
    made = rows.repartitionByRange(shuffle_partitions(spark), *order, F.xxhash64("html")).sortWithinPartitions(*order, "html")
    made.mapInArrow(_store(folder), INDEX).write.mode("overwrite").parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def copy_files(index: DataFrame, source: str, target: str, damage) -> DataFrame:
    """Copy the files of ``index``; ``damage(page_id, bytes) -> bytes`` sees every record.

    Returns a row per file written; running it is the copy.
    """

    def run(key, pdf):
        import pandas as pd

        (src, base), (dst, to) = filesystem(source), filesystem(target)
        dst.create_dir(to, recursive=True)
        temp = f"{to}/.{key[0]}.{TaskContext.get().taskAttemptId()}"
        with src.open_input_file(f"{base}/{key[0]}") as f, dst.open_output_stream(temp) as out:
            for page_id, offset, length in pdf.sort_values("offset")[["page_id", "offset", "length"]].itertuples(index=False):
                out.write(damage(page_id, f.read_at(int(length), int(offset))))
        dst.move(temp, f"{to}/{key[0]}")
        return pd.DataFrame({"file": [key[0]], "records": [len(pdf)]})

    return index.select("file", "offset", "length", F.coalesce("page_id", F.lit(-1)).alias("page_id")).groupBy("file").applyInPandas(run, "file string, records long")


def digests(index: DataFrame, folder: str) -> DataFrame:
    """Leaves: every indexed range of a replica with the sha256 of what is there, and every file's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = filesystem(folder)
        name, file = None, None
        for batch in batches:
            out = []
            for f, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))):
                if f != name:
                    name = f
                    try:
                        file = system.open_input_file(f"{base}/{f}")
                    except FileNotFoundError:
                        file = None
                got = b"" if file is None or offset >= file.size() else file.read_at(length, offset)
                out.append(hashlib.sha256(got).hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "hash"])

    spark = index.sparkSession
    # twice as many partitions as files were written by: few files share one
    records = index.repartition(2 * shuffle_partitions(spark), "file").sortWithinPartitions("file", "offset").mapInArrow(run, INDEX + ", hash string")
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "length")
    ends = index.groupBy("file").agg(F.count(F.lit(1)).alias("number"), F.max(F.col("offset") + F.col("length")).alias("offset"))
    found = listed.join(ends, "file", "left").select(
        "file", F.coalesce("number", F.lit(0)).alias("number"), F.coalesce("offset", F.lit(0)).alias("offset"), F.col("length").alias("size"), F.lit(None).cast("long").alias("page_id")
    )
    sizes = found.withColumns({"length": F.col("size") - F.col("offset"), "hash": F.sha2(F.concat(F.lit("size "), F.col("size").cast("string")), 256)}).drop("size")
    return records.unionByName(sizes)


def _above(level: DataFrame, fanout: int) -> DataFrame:
    child = F.sort_array(F.collect_list(F.struct("node", "hash")))  # at most ``fanout`` of them
    return cut(
        level.groupBy("file", F.floor(F.col("node") / fanout).alias("node")).agg(
            F.min("low").alias("low"), F.max("high").alias("high"), F.sha2(F.array_join(F.transform(child, lambda c: c["hash"]), ""), 256).alias("hash")
        )
    )


def tree(leaves: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels from the leaves to a root per file: file, node, low, high, hash."""
    level = cut(leaves.select("file", F.col("number").alias("node"), F.col("offset").alias("low"), (F.col("offset") + F.col("length")).alias("high"), "hash"))
    levels = [level]
    while level.where("node > 0").limit(1).count():
        level = _above(level, fanout)
        levels.append(level)
    return levels


def differences(a: list[DataFrame], b: list[DataFrame], fanout: int = FANOUT) -> DataFrame:
    """Leaf ranges in which two replicas differ: file, node, low, high, hash_a, hash_b.

    A file of one replica alone, and a size, show as leaves after the records.
    """
    a, b = list(a), list(b)
    for short, long in ((a, b), (b, a)):  # a lost large file makes a tree lower
        while len(short) < len(long):
            short.append(_above(short[-1], fanout))
    open_ = None
    for x, y in zip(reversed(a), reversed(b)):
        if open_ is not None:  # only children of nodes that differ
            x, y = (z.withColumn("up", F.floor(F.col("node") / fanout)).join(open_, ["file", "up"], "left_semi").drop("up") for z in (x, y))
        both = x.select("file", "node", "low", "high", F.col("hash").alias("hash_a")).join(y.select("file", "node", F.col("low").alias("l"), F.col("high").alias("h"), F.col("hash").alias("hash_b")), ["file", "node"], "full_outer")
        both = both.select("file", "node", F.coalesce("low", "l").alias("low"), F.coalesce("high", "h").alias("high"), "hash_a", "hash_b")
        found = both.where(~F.col("hash_a").eqNullSafe(F.col("hash_b")))
        open_ = cut(found.select("file", F.col("node").alias("up")))
    return found
