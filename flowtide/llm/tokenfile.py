"""Token-id shards with a minimal perfect hash index.

A shard is one binary file:

=========  ==============================================================
header     64 bytes: magic, then seven little-endian u64 (documents, ids, keys,
           hash levels, id width, positions of directory, index and payload)
payload    raw ids of all documents in ascending ``doc_id`` order, u16 or u32
directory  u64 offset of every document's first id, and one more for the end
index      per level: u64 bit count, then the level's bits; then per key, in
           hash order: u32 fingerprint, u32 number of its first document
           and u32 count of its documents
=========  ==============================================================

The index is a minimal perfect hash in the manner of cascaded bit arrays: each
key takes a position in the first level's bits; keys that are alone there stay,
the others go to the next level.  The rank of a key's bit is its slot, where a
32-bit fingerprint tells foreign keys apart (but for one in 2**32).  A lookup
costs a few hashes and one read, whatever the shard's size.

Shards are cut by ranges of ``doc_id``, so a repeated ``doc_id`` stays in one
shard; the index leads to its first row.  Rows without ``doc_id`` come first and
are not indexed.  A null text is empty and holds the end id alone.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shuffle_partitions
from .textnum import mix, slices, utf8
from .tokens import encoder

MAGIC = b"FTTOK001"
HEADER = "<8s7Q"
HEADER_BYTES = struct.calcsize(HEADER)
END_ID = 2
MANIFEST = "path string, doc_low long, doc_high long, n_docs long, n_tokens long, n_null long"


# ---- minimal perfect hash ---------------------------------------------------
def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return mix(keys.astype(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))) % np.uint64(size)


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.astype(np.uint64) ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """Slots 0 to n - 1 for n distinct integer keys."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.below, n = [], 0
        for bits in levels:  # rank of every position: a running count of the bits
            self.below.append(n + np.cumsum(bits) - bits)
            n += int(bits.sum())
        self.size = n

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 2.0) -> PerfectHash:
        left, levels = keys.astype(np.int64).astype(np.uint64), []
        while len(left):
            size = max(64, int(gamma * len(left)))
            at = _place(left, len(levels), size)
            hits = np.bincount(at.astype(np.int64), minlength=size)
            levels.append(hits == 1)
            left = left[hits[at] != 1]
        return cls(levels)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        """Slot of every key; -1 for some that were never added."""
        keys = keys.astype(np.int64).astype(np.uint64)
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for k, (bits, below) in enumerate(zip(self.levels, self.below)):
            at = _place(keys[todo], k, len(bits))
            here = bits[at]
            out[todo[here]] = below[at[here]]
            todo = todo[~here]
        return out

    def dump(self) -> bytes:
        return b"".join(struct.pack("<Q", len(b)) + np.packbits(b).tobytes() for b in self.levels)

    @classmethod
    def load(cls, raw: memoryview, levels: int) -> tuple[PerfectHash, int]:
        at, out = 0, []
        for _ in range(levels):
            (n,) = struct.unpack_from("<Q", raw, at)
            out.append(np.unpackbits(np.frombuffer(raw, np.uint8, (n + 7) // 8, at + 8), count=n).astype(bool))
            at += 8 + (n + 7) // 8
        return cls(out), at


# ---- one shard --------------------------------------------------------------
def filesystem(uri: str):
    """The file system and the plain path of a URI or local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class Shard:
    """A shard opened for reading."""

    def __init__(self, uri: str):
        system, path = filesystem(uri)
        self.file = system.open_input_file(path)
        head = struct.unpack(HEADER, self.file.read_at(HEADER_BYTES, 0))
        if head[0] != MAGIC:
            raise ValueError(f"{uri} is not a token shard")
        _, self.docs, self.tokens, self.keys, levels, self.width, directory, index = head
        tail = memoryview(self.file.read_at(self.file.size() - directory, directory))
        self.upto = np.frombuffer(tail, "<u8", self.docs + 1).astype(np.int64)
        self.hash, used = PerfectHash.load(tail[index - directory :], levels)
        table = np.frombuffer(tail, "<u4", 3 * self.keys, index - directory + used)
        self.prints, self.rows, self.counts = np.split(table, 3)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First document and number of documents of every key (0: not here)."""
        keys = keys.astype(np.int64)
        slot = self.hash.slot(keys)
        ok = slot >= 0
        ok[ok] = self.prints[slot[ok]] == fingerprints(keys[ok])
        row, count = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        row[ok], count[ok] = self.rows[slot[ok]], self.counts[slot[ok]]
        return row, count

    def ids(self, row: int) -> np.ndarray:
        a, b = int(self.upto[row]), int(self.upto[row + 1])
        return np.frombuffer(self.file.read_at((b - a) * self.width, HEADER_BYTES + a * self.width), f"<u{self.width}")

    def get(self, key: int) -> list[np.ndarray]:
        """Ids of all documents of a key."""
        row, count = (int(x[0]) for x in self.find(np.array([key])))
        return [self.ids(r) for r in range(row, row + count)]

    def facts(self, base: int, row: int) -> tuple[int, int, int]:
        """start, n_tokens and crc32 (of the ids as u32) of a document."""
        return base + int(self.upto[row]), int(self.upto[row + 1] - self.upto[row]), zlib.crc32(self.ids(row).astype("<u4"))


def _write(folder: str, tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        enc, system, handle = encoder(tokenizer), None, None
        width = 2 if enc.tok.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
        keys: list[int | None] = []
        lens: list[np.ndarray] = []
        for batch in batches:
            if handle is None:
                system, base = filesystem(folder)
                system.create_dir(base, recursive=True)
                name = f"shard-{task.partitionId():06d}.tok"
                temp = f"{base}/.{name}.{task.taskAttemptId()}"
                handle = system.open_output_stream(temp)
                handle.write(bytes(HEADER_BYTES))
            keys += batch.column(0).to_pylist()
            buf, offs = utf8(batch.column(1))
            for i, j in slices(offs):
                ids, rows = enc.encode(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                handle.write(np.insert(ids, rows[1:], end_id).astype(f"<u{width}").tobytes())
                lens.append(np.diff(rows) + 1)
        if handle is None:
            return
        upto = np.concatenate([[0], np.cumsum(np.concatenate(lens))])
        known = np.array([k for k in keys if k is not None], np.int64)
        nulls = len(keys) - len(known)
        own, first, count = np.unique(known, return_index=True, return_counts=True)
        ph = PerfectHash.build(own)
        table = np.zeros((3, len(own)), "<u4")
        slot = ph.slot(own)
        table[0, slot], table[1, slot], table[2, slot] = fingerprints(own), first + nulls, count
        directory = HEADER_BYTES + int(upto[-1]) * width
        handle.write(upto.astype("<u8").tobytes())
        handle.write(ph.dump() + table.tobytes())
        handle.close()
        head = struct.pack(HEADER, MAGIC, len(keys), int(upto[-1]), len(own), len(ph.levels), width, directory, directory + 8 * len(upto))
        path = f"{base}/{name}"
        _seal(system, temp, path, head)
        row = {"path": f"{folder}/{name}", "doc_low": int(known[0]) if len(known) else None, "doc_high": int(known[-1]) if len(known) else None}
        row |= {"n_docs": len(keys), "n_tokens": int(upto[-1]), "n_null": nulls}
        yield pa.RecordBatch.from_pylist([row], pa.schema([("path", pa.string()), *((c, pa.int64()) for c in ("doc_low", "doc_high", "n_docs", "n_tokens", "n_null"))]))

    return run


def _seal(system, temp: str, path: str, head: bytes) -> None:
    """Put the header in and give the file its name in one move."""
    from pyarrow import fs

    if isinstance(system, fs.LocalFileSystem):
        with open(temp, "r+b") as f:
            f.write(head)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temp, path)
        return
    with system.open_input_stream(temp) as src, system.open_output_stream(path) as dst:  # stores without in-place writes
        src.read(HEADER_BYTES)
        dst.write(head)
        while block := src.read(8 << 20):
            dst.write(block)
    system.delete_file(temp)


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Write ``docs`` (doc_id, text) as shards under ``folder``; the manifest.

    The manifest has a row per shard with its key range, counts and ``base``,
    the ids of all shards before it; it is also kept as Parquet in ``folder``.
    A task that runs again replaces its own file with the same bytes.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = rows.repartitionByRange(shuffle_partitions(spark), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    made.mapInArrow(_write(folder, tokenizer, end_id), MANIFEST).write.mode("overwrite").parquet(f"{folder}/shards")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Shards in key order with ``base``: the window runs over one row per shard."""
    return spark.read.schema(MANIFEST).parquet(f"{folder}/shards").selectExpr(
        "*", "coalesce(sum(n_tokens) over (order by path rows between unbounded preceding and 1 preceding), 0) as base"
    )


_FACTS = "doc_id long, start long, n_tokens long, ids_crc32 long"
_FACTS_ARROW = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "n_tokens", "ids_crc32")])


def _facts(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=_FACTS_ARROW)


def _lookup(lows: np.ndarray, paths: list[str], bases: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, opened = None, None
        for batch in batches:
            keys, near = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            out: list[tuple] = []
            for s in np.unique(near):
                if s != opened:
                    shard, opened = Shard(paths[s]), s
                asked = keys[near == s]
                for key, row, count in zip(asked.tolist(), *(x.tolist() for x in shard.find(asked))):
                    for r in range(row, row + count):
                        out.append((key, *shard.facts(bases[s], r)))
                        if len(out) >= 10_000:
                            yield _facts(out)
                            out = []
            if out:
                yield _facts(out)

    return run


def lookup(keys: DataFrame, shards: DataFrame) -> DataFrame:
    """Keyed access: doc_id, start, n_tokens and ids_crc32 of all documents of the given keys.

    The manifest (a row per shard, as many as shuffle partitions wrote) is
    sent along; a key goes to the shard of its range and through that shard's
    perfect hash.  Unknown and null keys give no row.
    """
    known = shards.where("doc_low is not null").orderBy("doc_low").select("doc_low", "path", "base").collect()
    asked = keys.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    if not known:
        return asked.where(F.lit(False)).selectExpr("doc_id", "0L as start", "0L as n_tokens", "0L as ids_crc32")
    lows = np.array([r["doc_low"] for r in known], np.int64)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.maximum(0, np.searchsorted(lows, b.column(0).to_numpy(), side="right") - 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at)], ["doc_id", "shard"])

    # a number of its own keeps adaptive execution from merging these small partitions into one task
    parts = 2 * shuffle_partitions(keys.sparkSession)
    routed = asked.mapInArrow(route, "doc_id long, shard long").repartition(parts, "shard").sortWithinPartitions("shard", "doc_id")
    return routed.mapInArrow(_lookup(lows, [r["path"] for r in known], [r["base"] for r in known]), _FACTS)


def unkeyed(shards: DataFrame) -> DataFrame:
    """The documents without a key, which only a scan finds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, n, base in zip(*(b.column(c).to_pylist() for c in ("path", "n_null", "base"))):
                shard = Shard(path)
                for at in range(0, n, 10_000):
                    yield _facts([(None, *shard.facts(base, r)) for r in range(at, min(at + 10_000, n))])

    return shards.where("n_null > 0").select("path", "n_null", "base").mapInArrow(run, _FACTS)
