"""Benchmark decontamination: SimHash of item-sized windows, checked exactly.

DataFrame functions only.

1. Texts are lower-cased words of letters and digits; ``k``-word shingles are
   64-bit hashes, in order, as an array.
2. Of two shingle multisets of sizes ``n`` and ``m`` that are ``similarity`` alike,
   ``similarity (n + m) / (1 + similarity)`` are common.  Every window of an item's size
   that holds so many shingles of items of this size is looked at, wherever it starts
   and however they are ordered; no other window can be similar to one.
3. Each window's and item's SimHash has 300 bits: for each of five hashes of the
   shingles 64 counters, four in each of 16 longs, summed with multiplicity; 60 of
   the 64 bits are used.
4. Multi-index Hamming search: 15 blocks of 20 bits.  Fingerprints within 59 bits
   differ in at most 3 bits of one block at least, so every item is entered under
   all values within 3 bits of its own (1,351 a block) and a window looks up its 15
   values: that finds all of them.  Unlike windows and items meet by chance in
   15 x 1,351 / 2^20 = 1.9 % of pairs.  Two windows of similarity 0.8 differ in
   about 46 bits on average, with a deviation of 6; of 0.85 in 39.
5. Only ids go through that join.  Candidates within the radius are compared
   exactly: sum of lesser over sum of greater shingle multiplicities, at least
   ``similarity``.

Rows: null and empty texts and texts of fewer than ``k`` words hold no window.
Items of fewer than ``k`` words are too short to tell a leak and match nothing.
A text shorter than an item is one window.  A null ``doc_id`` or ``item_id``
cannot be reported and is left out.  Repeated rows and ids give one row for each
(doc_id, item_id).  Empty tables give no rows.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

WORDS = 5
SIMILARITY = 0.8
#: Hashes in a fingerprint, blocks of each, bits of a block, and bits in which a value may differ from an item's.
HASHES, EACH, WIDTH, OFF = 5, 3, 20, 3
BLOCKS = HASHES * EACH
#: If all blocks differed in more bits, the fingerprints would differ in more than this.
RADIUS = BLOCKS * (OFF + 1) - 1
#: Shingles of a benchmark that are sent to every executor; beyond, Spark joins by shuffle.
BROADCAST_SHINGLES = 2_000_000


def with_shingles(df: DataFrame, key: str, k: int) -> DataFrame:
    """(key, sh): hashes of all k-word shingles in order; words are letters and digits."""
    text = F.lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    words = F.array_remove(F.split(text, r"[^\p{L}\p{N}]+"), "")
    run = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
    whole = lambda w: F.when(F.size(w) >= k, run(w)).otherwise(F.array().cast("array<bigint>"))
    # the words are bound inside the expression: wherever a filter takes it, they are split once
    return df.select(F.col(key).cast("long").alias(key), F.get(F.transform(F.array(words), whole), F.lit(0)).alias("sh"))


def simhash(sh: Column) -> Column:
    """The 64-bit SimHash of an array of hashes: 16 longs of four 16-bit counters each, then their signs."""
    lanes = F.lit(0x0001000100010001)
    add = lambda b: lambda acc, h: acc + F.shiftrightunsigned(h, b).bitwiseAND(lanes)
    sums = F.array(*[F.aggregate(sh, F.lit(0).cast("long"), add(b)) for b in range(16)])
    most = lambda c, j: (F.shiftrightunsigned(c, 16 * j).bitwiseAND(F.lit(0xFFFF)) * 2 >= F.size(sh)).cast("long")
    four = lambda c: most(c, 0) + F.shiftleft(most(c, 1), 16) + F.shiftleft(most(c, 2), 32) + F.shiftleft(most(c, 3), 48)
    bits = lambda c, b: F.call_function("shiftleft", four(c), b)
    return F.aggregate(F.transform(sums, bits), F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(x))


def fingerprinted(df: DataFrame) -> DataFrame:
    """Add ``fp``, an array of ``HASHES`` longs, to rows with ``sh``."""
    used = F.lit((1 << EACH * WIDTH) - 1)
    # bound by a lambda, the hashed shingles and the formula stand in the plan once
    one = lambda hs: simhash(hs).bitwiseAND(used)
    hashed = F.transform(F.sequence(F.lit(0), F.lit(HASHES - 1)), lambda k: F.transform("sh", lambda h: F.xxhash64(h, k)))
    return df.withColumn("fp", F.transform(hashed, one))


def blocks(df: DataFrame, off: int = 0) -> DataFrame:
    """A row for each block of ``fp`` and each value within ``off`` bits of it: ``block``, ``value``."""
    near = [sum(1 << b for b in bits) for n in range(off + 1) for bits in combinations(range(WIDTH), n)]
    value = lambda i: F.shiftrightunsigned(F.get("fp", F.lit(i // EACH)), WIDTH * (i % EACH)).bitwiseAND(F.lit((1 << WIDTH) - 1)).cast("int")
    cells = df.select("*", F.posexplode(F.array(*[value(i) for i in range(BLOCKS)])).alias("block", "_own"))
    masks = F.explode(F.split(F.lit(",".join(map(str, near))), ",").cast("array<int>")).alias("_mask")
    return cells.select("*", masks).select(*df.columns, "block", F.col("_own").bitwiseXOR(F.col("_mask")).alias("value"))


def hamming(x: Column, y: Column) -> Column:
    out = F.lit(0)
    for k in range(HASHES):
        out = out + F.bit_count(F.get(x, F.lit(k)).bitwiseXOR(F.get(y, F.lit(k))))
    return out


def shared_weight(x: Column, y: Column) -> Column:
    """Sum over shingles of the lesser multiplicity."""
    times = lambda a, h: F.size(F.filter(a, lambda v: v == h))
    common = F.array_intersect(x, y)
    once = (F.size(F.array_distinct(x)) == F.size(x)) | (F.size(F.array_distinct(y)) == F.size(y))
    return F.when(once, F.size(common)).otherwise(F.aggregate(common, F.lit(0), lambda acc, h: acc + F.least(times(x, h), times(y, h))))


def candidates(windows: DataFrame, items: DataFrame) -> DataFrame:
    """(window, item) of one size whose fingerprints agree in a block but for ``OFF`` bits."""
    near = blocks(windows.select("window", "size", "fp")).select("window", "size", "block", "value")
    # Spark estimates the index by its items, before their values are written out: it must not be broadcast
    index = blocks(items.select("item", "size", "fp"), OFF).select("item", "size", "block", "value").hint("merge")
    return near.join(index, ["size", "block", "value"]).select("window", "item").distinct()


def starts(similarity: float) -> Column:
    """Starts of all windows of ``size`` shingles that hold enough of the places ``at`` (ascending) of a text of ``total``."""
    at, size, total = F.col("at"), F.col("size"), F.col("total")
    need = F.greatest(F.lit(1), F.ceil((size + F.least(size, total)) * F.lit(similarity / (1 + similarity)) - F.lit(1e-9)).cast("int"))

    def first(j: Column) -> Column:  # the windows whose first held place is the j-th
        low = F.greatest(F.lit(0), F.coalesce(F.get(at, j - 1), F.lit(-1)) + 1, F.get(at, j + need - 1) - size + 1)
        high = F.least(F.get(at, j), F.greatest(F.lit(0), total - size))
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    return F.when(F.size(at) >= need, F.flatten(F.transform(F.sequence(F.lit(0), F.size(at) - need), first))).otherwise(F.array().cast("array<int>"))


def leaks(docs: DataFrame, benchmark: DataFrame, k: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """Windows of documents that repeat a benchmark item.

    Rows: doc_id, item_id, start_word and n_words (of the best window), hamming,
    similarity.  Reads ``doc_id, text`` and ``item_id, text`` only.
    """
    items, windows = fingerprints(docs, benchmark, k, similarity)
    far = hamming(F.col("w.fp"), F.col("i.fp"))
    both = candidates(windows, items).join(windows.alias("w"), "window").join(items.alias("i"), "item").where(far <= RADIUS)
    x, y = F.col("w.sh"), F.col("i.sh")
    both = both.select("doc_id", "item_id", "start", F.size(x).alias("n"), far.alias("hamming"), shared_weight(x, y).alias("common"), (F.size(x) + F.size(y)).alias("all"))
    found = both.select("doc_id", "item_id", "start", "n", "hamming", (F.col("common") / (F.col("all") - F.col("common"))).alias("similarity")).where(F.col("similarity") >= similarity)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", -F.col("start"), -F.col("hamming"), "n")).alias("m"))
    return best.select(
        "doc_id", "item_id", (-F.col("m.col2")).cast("long").alias("start_word"), (F.col("m.n") + (k - 1)).cast("long").alias("n_words"),
        (-F.col("m.col3")).cast("int").alias("hamming"), F.round("m.similarity", 6).alias("similarity"),
    )


def fingerprints(docs: DataFrame, benchmark: DataFrame, k: int = WORDS, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Items (item, item_id, size, sh, fp) and windows (window, doc_id, start, size, sh, fp)."""
    known = with_shingles(benchmark.where("item_id is not null"), "item_id", k).where(F.size("sh") > 0).distinct()
    items = cut(fingerprinted(known).select(F.monotonically_increasing_id().alias("item"), "item_id", "sh", "fp", F.size("sh").alias("size")))
    marks = items.select(F.explode("sh").alias("h"), F.col("size")).groupBy("h", "size").agg(F.lit(1).alias("x")).drop("x")
    if marks.count() <= BROADCAST_SHINGLES:
        marks = F.broadcast(marks)
    own = with_shingles(docs.where("doc_id is not null"), "doc_id", k)
    places = own.select("doc_id", F.size("sh").alias("total"), F.posexplode_outer("sh").alias("p", "h"))
    held = places.join(marks, "h").groupBy("doc_id", "total", "size").agg(F.array_sort(F.collect_set("p")).alias("at"))
    proposed = cut(held.select("doc_id", "total", "size", F.explode(starts(similarity)).alias("start")))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hit = with_shingles(texts.join(proposed.select("doc_id").distinct(), "doc_id", "left_semi"), "doc_id", k).withColumn("total", F.size("sh"))
    cuts = hit.join(proposed, ["doc_id", "total"]).select("doc_id", "start", "size", F.slice("sh", F.col("start") + 1, F.col("size")).alias("sh")).where(F.size("sh") > 0)
    return items, cut(fingerprinted(cuts).withColumn("window", F.monotonically_increasing_id()))
