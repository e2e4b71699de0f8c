"""One-permutation MinHash fingerprints with optimal densification.

The word shingles of a text are hashed once; the top bits of a hash are its bin
and the least hash of each bin is kept.  An empty bin copies the bin that a
universal hash of (bin, attempt) points at, with attempts until a filled one is
met, the same for every text.  Of each bin only the ``BITS`` low-order bits are
stored, packed and written as hexadecimal.  Unequal minima agree on those bits
with probability ``2 ** -BITS``, which the likeness corrects for.

``fingerprints`` compares every document with its successor in ``doc_id`` order
and with an edited copy.  Documents are dealt to blocks between ``doc_id``
bounds (found on ids alone), with each block's first document sent to the block
before as well, and texts packed with zstd for the way; a task streams its rows
in order and holds one batch.

Rows: a null text is empty.  A text without words has the empty fingerprint;
two of those have likeness 1, one and another text 0.  Null ids come first; rows
of equal id are ordered by a hash of their text.  A lone document is its own successor.  An
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, shuffle_partitions
from .textnum import distinct, lower_ascii, mix, shingles, slices, utf8, word_hashes, words

WORDS = 5
BINS = 256
BITS = 8
_FIRST = -(2**63)


def bins_of(u: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows x bins) low-order bits of each bin's least hash, and which are set."""
    n = len(at) - 1
    row = np.repeat(np.arange(n), np.diff(at))
    cell = row * BINS + (u >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.ones(len(u), bool)
    first[1:] = cell[1:] != cell[:-1]  # hashes ascend, so the first of a bin is its least
    low, full = np.zeros(n * BINS, np.uint8), np.zeros(n * BINS, bool)
    low[cell[first]] = (u[first] & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    full[cell[first]] = True
    return low.reshape(n, BINS), full.reshape(n, BINS)


def densify(low: np.ndarray, full: np.ndarray) -> np.ndarray:
    """Fill empty bins of rows that have any; universal hashing of (bin, attempt)."""
    out = low.copy()
    r, b = np.nonzero(~full & full.any(axis=1)[:, None])
    attempt = 1
    while len(r):
        to = (mix((b * 0x10001 + attempt * 0x9E3779B1).astype(np.uint64)) % np.uint64(BINS)).astype(np.int64)
        hit = full[r, to]
        out[r[hit], b[hit]] = low[r[hit], to[hit]]
        r, b = r[~hit], b[~hit]
        attempt += 1
    return out


def sketch(buf: np.ndarray, offs: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all rows (rows x BINS bytes), and which rows have words."""
    buf = lower_ascii(buf)
    starts, ends, rows = words(buf, offs)
    u, at = distinct(*shingles(word_hashes(buf, starts, ends), rows, k))
    return densify(*bins_of(u, at)), np.diff(at) > 0


def likeness(a: np.ndarray, some_a: np.ndarray, b: np.ndarray, some_b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of rows of two sketches, corrected for chance."""
    chance = 2.0**-BITS
    same = (a == b).mean(axis=1)
    est = np.clip((same - chance) / (1 - chance), 0.0, 1.0)
    return np.where(some_a & some_b, est, (some_a == some_b).astype(float))


_SENT = pa.schema([("block", pa.int64()), ("extra", pa.int32()), ("doc_id", pa.int64()), ("tie", pa.binary()), ("packed", pa.binary())])


def _deal(lows: np.ndarray):
    """Rows to their block; a block's first id goes to the block before as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            ids = batch.column(0).fill_null(_FIRST).to_numpy()
            buf, offs = utf8(batch.column(1))
            raw = buf.tobytes()
            block = np.maximum(0, np.searchsorted(lows, ids, side="right") - 1)
            rows = []
            for i, (b, d) in enumerate(zip(block.tolist(), batch.column(0).to_pylist())):
                text = raw[offs[i] : offs[i + 1]]
                tie, packed = hashlib.blake2b(text, digest_size=8).digest(), press.compress(text)
                rows.append((b, 0, d, tie, packed))
                if ids[i] == lows[b]:
                    rows.append(((b - 1) % len(lows), 1, d, tie, packed))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SENT)], schema=_SENT) if rows else pa.RecordBatch.from_pylist([], _SENT)

    return run


_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(held: list[tuple], k: int) -> pa.RecordBatch:
    """Rows (doc_id, text) in order; all but the last have their successor here."""
    texts = [t for _, t in held]
    edited = []
    for a, b in zip(texts, texts[1:]):
        half = len(a) // 2
        edited.append(a[: len(a) - half] + b[:half])
    blobs = [x.encode() for x in texts + edited]
    offs = np.concatenate([[0], np.cumsum([len(x) for x in blobs])])
    fps, some = [], []
    buf = np.frombuffer(b"".join(blobs), np.uint8)
    for i, j in slices(offs):
        f, s = sketch(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], k)
        fps.append(f), some.append(s)
    fp, has = np.concatenate(fps), np.concatenate(some)
    n = len(texts) - 1
    own, nxt, ed = slice(0, n), slice(1, n + 1), slice(n + 1, 2 * n + 1)
    said = lambda s: [x.tobytes().hex() if h else "" for x, h in zip(fp[s], has[s])]
    cols = (
        [d for d, _ in held[:n]], [len(t) for t in texts[:n]], [hashlib.sha256(b).hexdigest() for b in blobs[n + 1 :]], said(own), said(ed),
        likeness(fp[own], has[own], fp[ed], has[ed]), likeness(fp[own], has[own], fp[nxt], has[nxt]),
    )
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _OUT)], schema=_OUT)


def _sweep(k: int, most: int = 3_000_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        held: list[tuple] = []
        size, at, closed = 0, None, False
        for batch in batches:
            for block, extra, d, packed in zip(*(batch.column(c).to_pylist() for c in ("block", "extra", "doc_id", "packed"))):
                if block != at:
                    held, size, at, closed = [], 0, block, False
                if closed:  # further rows of the next block's first id
                    continue
                text = unpack.decompress(packed).decode()
                held.append((d, text))
                size += len(text)
                closed = bool(extra)
                if len(held) > 1 and (closed or size > most):
                    yield _compare(held, k)
                    held, size = held[-1:], len(text)

    return run


def fingerprints(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """Rows: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.

    The edited text is the document with its last ``floor(n_chars / 2)``
    characters replaced by the first as many of the next document.
    """
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    parts = cut(ids.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.coalesce("doc_id", F.lit(_FIRST))).alias("low")))
    lows = np.array(sorted(r["low"] for r in parts.select("low").collect()), np.int64)  # one per partition
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if not len(lows):
        return rows.where(F.lit(False)).mapInArrow(_sweep(k), OUT)
    sent = rows.mapInArrow(_deal(lows), "block long, extra int, doc_id long, tie binary, packed binary")
    order = ["block", "extra", F.col("doc_id").asc_nulls_first(), "tie"]
    # n blocks by hash into three times as many partitions: few of them share one
    return sent.repartition(3 * n, "block").sortWithinPartitions(*order).select("block", "extra", "doc_id", "packed").mapInArrow(_sweep(k), OUT)
