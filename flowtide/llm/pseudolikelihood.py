"""Masked pseudo-likelihood scores from a bidirectional window network.

Every word of a text is predicted from the ``REACH`` words on each side of it;
the sum of the conditional log-probabilities scores the document.

1. The corpus is stored as chunks of some MB of text, one row each.  Every chunk
   counts its words and its pairs of words at each distance up to ``REACH``; text
   ends are a symbol beside the words.  Each distinct key goes once per chunk, as
   sorted bytes, to the part of the key space that adds up its count over the
   corpus, and the totals go back to the chunk.  Nothing is left out, so the
   counts grow with the corpus, and a hot word is one key per chunk.  A part is held
   by one task, so there are parts by the chunks, whatever the shuffle's partitions.
2. Experts, each a distribution over all words of the corpus: uniform, the
   word's share of the corpus, and for every neighbour the share of the word
   among all that stands at this distance from the neighbour.  All leave out the
   masked place itself; a neighbour that occurs nowhere else says what the
   word's share says.
3. The network (a tanh layer, a softmax over the experts) weighs the experts by
   how often each neighbour occurs.  It never sees the masked word, so the
   mixture is a distribution over words.  Its size is fixed; it learns from every
   window of the corpus: each chunk trains the same start on its own windows, and
   the chunks' weights are averaged by their windows.
4. Each chunk's texts are scored beside its totals.

Words: runs of characters other than 0x20, 0x09-0x0D, with A-Z lower-cased; a
word or pair is known by a hash of 54 bits.
Rows: null, empty and wordless texts have 0 words, score 0 and no mean.  Null
and repeated ids are scored row by row.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cleaning, scratch, shuffle_partitions, small_batches
from .textnum import lower_ascii, mix, slices, utf8, word_hashes, words

CHUNK_BYTES = 3_000_000
#: A part of the key space holds the keys of about so many chunks; a file of chunks and a batch hold so many.
CHUNKS_A_PART, CHUNKS_A_FILE, CHUNKS_A_BATCH = 6, 8, 4
REACH = 2
EXPERTS = 2 + 2 * REACH
HIDDEN = 16
BATCH, LEAST_STEPS = 512, 150
KEY_BITS = 56
EDGE = np.uint64(0x5851F42D4C957F2D)


# ---- chunks -----------------------------------------------------------------
_STORED = pa.schema([("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("texts", pa.list_(pa.string()))])


def _chunks(most: int):
    def row(name: int, held: list) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        cols = [pa.ListArray.from_arrays(pa.array([0, len(t)], pa.int32()), t.column(c).combine_chunks().cast(f.value_type)) for c, f in enumerate([_STORED.field(1).type, _STORED.field(2).type])]
        return pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), *cols], schema=_STORED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            offs = utf8(batch.column(1))[1]
            for i, j in slices(offs, most):
                more = int(offs[j] - offs[i])
                if held and size + more > most:
                    yield row(name, held)
                    name, held, size = name + 1, [], 0
                held.append(batch.slice(i, j - i))
                size += more
        if held:
            yield row(name, held)

    return run


class Windows:
    """The words of a chunk's texts between text ends, and the keys they count."""

    def __init__(self, texts: pa.Array):
        buf, offs = utf8(texts)
        hashes, rows = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
        for i, j in slices(offs):
            b = lower_ascii(buf[offs[i] : offs[j]])
            s, e, at = words(b, offs[i : j + 1] - offs[i])
            hashes.append(word_hashes(b, s, e))
            rows.append(at[1:] + rows[-1][-1])
        h, self.rows = np.concatenate(hashes), np.concatenate(rows)
        self.n = np.diff(self.rows)
        # REACH ends before every text and after the last: no pair spans two texts
        self.row = np.repeat(np.arange(len(self.n)), self.n)
        self.at = np.arange(len(h)) + REACH * (self.row + 1)
        line = np.full(len(h) + REACH * (len(self.n) + 1), EDGE)
        line[self.at] = h
        self.size = len(line)
        kinds = [h, *(np.full(1, _edge(d)) for d in range(1, REACH + 1))]
        for d in range(1, REACH + 1):
            kinds.append(mix(line[:-d] * np.uint64(0x9E3779B97F4A7C15) + mix(line[d:] + np.uint64(d))))
        self.cuts = np.cumsum([0, len(h), REACH, *(self.size - d for d in range(1, REACH + 1))])
        self.all = np.concatenate(kinds) >> np.uint64(64 - KEY_BITS)
        self.all &= ~np.uint64(1)
        self.all[: len(h) + REACH] |= np.uint64(1)  # the lowest bit tells words from pairs

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys, ascending, with their counts in the chunk."""
        weight = np.ones(len(self.all))
        for d in range(1, REACH + 1):  # how many words have a text end at this distance, on either side alike
            weight[self.cuts[1] + d - 1] = np.minimum(self.n, d).sum()
        keys, which = np.unique(self.all, return_inverse=True)
        return keys, np.bincount(which, weight, len(keys)).astype(np.uint64)

    def experts(self, totals: np.ndarray, distinct: int, words: int) -> tuple[np.ndarray, np.ndarray]:
        """What the network sees of every word's neighbours, and the experts' probabilities."""
        keys, which = np.unique(self.all, return_inverse=True)
        if len(keys) != len(totals):
            raise ValueError("the totals are not those of this chunk")
        found = totals.astype(np.float64)[which]
        kinds = [found[a:b] for a, b in zip(self.cuts, self.cuts[1:])]
        own, ends, pairs = kinds[0], kinds[1], kinds[2:]
        seen, p = np.empty((len(own), 2 * REACH), np.float32), np.empty((len(own), EXPERTS))
        p[:, 0] = 1.0 / max(1, distinct)
        p[:, 1] = (own - 1) / (words - 1) if words > 1 else p[:, 0]
        for d in range(1, REACH + 1):
            times = np.full(self.size, ends[d - 1])
            times[self.at] = own
            for side, (by, pair) in enumerate(((self.at - d, pairs[d - 1][self.at - d]), (self.at + d, pairs[d - 1][self.at]))):
                c, n = 2 * (d - 1) + side, times[by]
                p[:, 2 + c] = np.where(n > 1, (pair - 1) / np.maximum(1, n - 1), p[:, 1])
                seen[:, c] = np.log(n) / 10
        return seen, p


def _edge(d: int) -> np.uint64:
    return mix(np.array([d], np.uint64) + EDGE)[0]


def _bytes(x: np.ndarray) -> bytes:
    """Whole numbers by planes of bytes, of which the upper ones are mostly zero, packed."""
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _numbers(raw: bytes) -> np.ndarray:
    planes = pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view("<u8").reshape(-1)


# ---- the corpus's counts ----------------------------------------------------
KEYS = "chunk long, part int, keys binary, n binary"
TOTALS = "chunk long, part int, totals binary, distinct_words long, words long"
_KEYS = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("keys", pa.binary()), ("n", pa.binary())])
_TOTALS = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("totals", pa.binary()), ("distinct_words", pa.int64()), ("words", pa.int64())])


def _count(parts: int):
    edges = np.array([i * 2**KEY_BITS // parts for i in range(parts + 1)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                keys, n = Windows(batch.column(1).slice(r, 1).flatten()).keys()
                at = np.searchsorted(keys, edges).tolist()
                spans = [(p, a, b) for p, (a, b) in enumerate(zip(at, at[1:])) if b > a]
                cols = [
                    pa.array([batch.column(0)[r].as_py()] * len(spans), pa.int64()), pa.array([p for p, _, _ in spans], pa.int32()),
                    pa.array([_bytes(np.diff(keys[a:b], prepend=np.uint64(0))) for _, a, b in spans], pa.binary()), pa.array([_bytes(n[a:b]) for _, a, b in spans], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(cols, schema=_KEYS)

    return run


def _total(got: pa.Table) -> pa.Table:
    """The sums over all chunks of one part's keys, in each chunk's order."""
    keys = [np.cumsum(_numbers(x), dtype=np.uint64) for x in got.column("keys").to_pylist()]
    n = np.concatenate([_numbers(x) for x in got.column("n").to_pylist()])
    unique, which = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(which, n.astype(np.float64), len(unique)).astype(np.uint64)
    ends = np.array([_edge(d) for d in range(1, REACH + 1)]) >> np.uint64(64 - KEY_BITS) | np.uint64(1)
    word = (unique & np.uint64(1) == 1) & ~np.isin(unique, ends)
    back = total[which]
    at = np.cumsum([0, *map(len, keys)])
    first = np.arange(len(keys)) == 0
    cols = [
        got.column("chunk"), got.column("part"), pa.array([_bytes(back[a:b]) for a, b in zip(at, at[1:])], pa.binary()),
        pa.array(first * int(word.sum()), pa.int64()), pa.array(first * int(total[word].sum()), pa.int64()),
    ]
    return pa.Table.from_arrays(cols, schema=_TOTALS)


def counted(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, DataFrame]:
    """The corpus as chunks (chunk, ids, texts), and each chunk's totals by parts."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kept, sums = scratch(spark, "windows"), scratch(spark, "totals")
    # a reader holds some thousand rows of a file at once, which are chunks here
    stored = rows.mapInArrow(_chunks(chunk_bytes), "chunk long, ids array<long>, texts array<string>").write
    stored.option("compression", "zstd").option("maxRecordsPerFile", CHUNKS_A_FILE).parquet(kept)
    chunks = spark.read.schema("chunk long, ids array<long>, texts array<string>").parquet(kept)
    parts = max(shuffle_partitions(spark), -(-chunks.count() // CHUNKS_A_PART))
    with cleaning(spark), small_batches(spark, CHUNKS_A_BATCH):
        chunks.select("chunk", "texts").mapInArrow(_count(parts), KEYS).groupBy("part").applyInArrow(_total, TOTALS).write.parquet(sums)
    return chunks, spark.read.schema(TOTALS).parquet(sums)


def _of_chunk(left: pa.Table, right: pa.Table, distinct: int, all_words: int):
    """A chunk's ids, windows, what the network sees, and the experts."""
    ids, texts = (left.column(c).combine_chunks().flatten() for c in ("ids", "texts"))
    raw = right.sort_by("part").column("totals").to_pylist()
    totals = np.concatenate([np.zeros(0, np.uint64), *map(_numbers, raw)])
    w = Windows(texts)
    return ids, w, *w.experts(totals, distinct, all_words)


# ---- the network --------------------------------------------------------------
class Gate:
    """Weights of the experts from how often each neighbour occurs."""

    def __init__(self, hidden: int = HIDDEN, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.p = {"v": rng.normal(0, 0.5, (2 * REACH, hidden)), "a": np.zeros(hidden), "w": rng.normal(0, 0.1, (hidden, EXPERTS)), "b": np.zeros(EXPERTS)}

    def forward(self, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(seen @ self.p["v"] + self.p["a"])
        z = h @ self.p["w"] + self.p["b"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return h, z / z.sum(axis=1, keepdims=True)

    def log_probability(self, seen: np.ndarray, p: np.ndarray, step: int = 50_000) -> np.ndarray:
        out = [np.log((self.forward(seen[i : i + step])[1] * p[i : i + step]).sum(axis=1)) for i in range(0, len(p), step)]
        return np.concatenate([np.zeros(0), *out])

    def train(self, seen: np.ndarray, p: np.ndarray, batch: int = BATCH, least: int = LEAST_STEPS, rate: float = 0.05) -> Gate:
        """Gradient steps (Adam, falling rate) on the mean log-probability of batches that each spread over all windows.

        Every window is seen once, and again only where that makes fewer than ``least`` steps.
        """
        seen, p = seen.astype(np.float32), p.astype(np.float32)
        net = {k: x.astype(np.float32) for k, x in self.p.items()}
        m, v = ({k: np.zeros_like(x) for k, x in net.items()} for _ in range(2))
        each = -(-len(p) // batch)
        steps = each * -(-least // each) if each else 0
        for t in range(1, steps + 1):
            x, q = seen[t % each :: each], p[t % each :: each]
            h = np.tanh(x @ net["v"] + net["a"])
            weight = h @ net["w"] + net["b"]
            weight = np.exp(weight - weight.max(axis=1, keepdims=True))
            weight /= weight.sum(axis=1, keepdims=True)
            share = weight * q
            share /= share.sum(axis=1, keepdims=True)
            d = (weight - share) / np.float32(len(q))
            dh = (d @ net["w"].T) * (1 - h * h)
            grad = {"w": h.T @ d, "b": d.sum(axis=0), "v": x.T @ dh, "a": dh.sum(axis=0)}
            now = rate * (1 - (t - 1) / steps)
            for k, g in grad.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                net[k] = (net[k] - now * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        self.p = {k: x.astype(float) for k, x in net.items()}
        return self

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.p.values()])

    def fill(self, values: np.ndarray) -> Gate:
        ends = np.cumsum([x.size for x in self.p.values()])[:-1]
        self.p = {k: part.reshape(x.shape) for (k, x), part in zip(self.p.items(), np.split(values, ends))}
        return self


def trained(chunks: DataFrame, totals: DataFrame, distinct: int, all_words: int) -> Gate:
    """The mean of the networks that all chunks train on all their windows, weighed by how many those are."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        _, _, seen, p = _of_chunk(left, right, distinct, all_words)
        own = Gate().train(seen, p).flat()
        return pa.table({"place": pa.array(range(len(own)), pa.int32()), "windows": pa.array([len(p)] * len(own), pa.int64()), "value": own * len(p)})

    with cleaning(chunks.sparkSession):
        each = chunks.groupBy("chunk").cogroup(totals.groupBy("chunk")).applyInArrow(run, "place int, windows long, value double")
        # decimals: their sum does not depend on the order of the chunks
        got = each.groupBy("place").agg(F.sum("windows").alias("n"), F.sum(F.col("value").cast("decimal(30,10)")).alias("s")).orderBy("place").collect()  # a row per weight
    if not got or not got[0]["n"]:
        return Gate()
    return Gate().fill(np.array([float(r["s"]) / r["n"] for r in got]))


OUT = "doc_id long, n_words long, log_likelihood double, mean_log_likelihood double"


def scores(docs: DataFrame, gate: Gate | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Rows: doc_id, n_words, log_likelihood (sum), mean_log_likelihood.

    ``gate``: a network to use instead of one trained on the corpus.
    """
    chunks, totals = counted(docs, chunk_bytes)
    size = totals.agg(F.sum("distinct_words").alias("v"), F.sum("words").alias("n")).first()
    distinct, all_words = size["v"] or 0, size["n"] or 0
    net = gate or trained(chunks, totals, distinct, all_words)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("log_likelihood", pa.float64()), ("mean_log_likelihood", pa.float64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, w, seen, p = _of_chunk(left, right, distinct, all_words)
        total = np.bincount(w.row, net.log_probability(seen, p), len(w.n))
        mean = pa.array(np.divide(total, w.n, out=np.zeros(len(w.n)), where=w.n > 0), mask=w.n == 0)
        return pa.Table.from_arrays([ids, pa.array(w.n), pa.array(total), mean], schema=schema)

    return chunks.groupBy("chunk").cogroup(totals.groupBy("chunk")).applyInArrow(run, OUT)
