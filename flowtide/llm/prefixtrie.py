"""Trie of conversation prefixes by union-find over sorted neighbours.

A conversation is its sequence of turns; every distinct sequence of first d
turns is a node of depth d.  A turn is known by 24 bytes (a 128-bit hash of role
and text, and the text's code points), so a sequence is a byte string whose order
puts a prefix before its extensions.  Equal sequences are one element with a
count, the least id, and the hash of all its ids.

**In a partition.**  Elements are range-partitioned and sorted.  The longest
common prefix (LCP) of neighbours is an edge between them; edges are taken in
descending depth and their ends' components united (union-find).  A union at
depth d makes the node of depth d a branching one.  A component is a forest
whose only open nodes are the prefixes of its first and of its last element:
whatever is deeper than the edges on both sides can't change any more and is
written out.

**Across partitions.**  What is left of a partition is its contracted forest:
first and last element and the open nodes on these two paths.  Runs of
neighbouring forests are united by the same procedure (the LCP of one's last and
the next one's first element is the edge), level by level, until one is left.  A
task never holds more than ``FAN`` pairs of paths; a prefix that a third of all
conversations share is a few nodes in each of them.

A written node may have a parent that is still open.  Then it names its
partition and the parent's prefix hash; the parents' ids are joined at the end,
on (partition, prefix), so that the root's children don't meet in one task.

**Hashes of ids.**  The ids that end at a node are packed in blocks of 4,096
neighbouring ids before a sorted stream runs the SHA-256 of a sequence; a hot
sequence costs its task one string per block.

Bound: one conversation's digests (24 bytes a turn) are one value.  Rows: a null
role or text is empty; turns go by number (null first), then by role and hash; a
null ``conv_id`` is no conversation.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, shuffle_partitions

UNIT = 24
FAN = 16
PARTITION_BYTES = 8_000_000
BLOCK_BITS = 12
EMPTY = hashlib.sha256(b"").digest()


def lcp(a: bytes, b: bytes) -> int:
    """Common first turns of two sequences."""
    return len(os.path.commonprefix((a, b))) // UNIT


class Node:
    """An open node; ``kids``, ``leaves`` and ``saved`` count closed children only."""

    __slots__ = ("depth", "points", "n", "least", "kids", "leaves", "saved", "ends", "name", "waiting")

    def __init__(self, depth, points, n, least, kids=0, leaves=0, saved=0, ends=None, name=None):
        self.depth, self.points, self.n, self.least = depth, points, n, least
        self.kids, self.leaves, self.saved, self.ends, self.name = kids, leaves, saved, ends, name
        self.waiting = []  # rows of closed children that want this node's id

    def absorb(self, other: Node) -> None:
        self.n += other.n
        self.least = min(self.least, other.least)
        self.kids += other.kids
        self.leaves += other.leaves
        self.saved += other.saved
        self.ends = self.ends or other.ends
        self.waiting += other.waiting

    def row(self, parent: Node | None) -> list:
        """Closes the node and adds it to its parent.  The row: NODE's columns, own and parent's name."""
        leaves = self.leaves if self.kids else 1
        saved = self.saved + (self.n - 1) * self.points
        out = [self.least, self.depth, None, self.n, self.kids, leaves, saved, (self.ends or EMPTY).hex(), self.name, parent and parent.name]
        for child in self.waiting:
            child[2] = self.least
        if parent is not None:
            parent.kids += 1
            parent.leaves += leaves
            parent.saved += saved
            parent.waiting.append(out)
        return out


class Forest:
    """Open nodes on the paths of the first and the last element of a run.

    ``head[k]`` and ``tail[k]`` are the prefixes of k turns; they are the same
    nodes up to ``common``.
    """

    def __init__(self, first: bytes, last: bytes, common: int, head: list[Node], tail: list[Node]):
        self.first, self.last, self.common, self.head, self.tail = first, last, common, head, tail

    @classmethod
    def single(cls, seq: bytes, n: int, least: int, ends: bytes) -> Forest:
        points = np.frombuffer(seq, ">u8")[2::3].tolist()
        path = [Node(d, p, n, least) for d, p in enumerate([0, *points])]
        path[-1].ends = ends
        return cls(seq, seq, len(points), path, list(path))

    def unite(self, right: Forest, d: int, out: list) -> Forest:
        """The run of both; ``d`` is the LCP where they meet.  Closed nodes go to ``out``."""
        close(self.tail, max(d, self.common), out)
        close(right.head, max(d, right.common), out)
        for k in range(d + 1):
            self.tail[k].absorb(right.head[k])
        shared = min(d, right.common)
        right.tail[: shared + 1] = self.tail[: shared + 1]
        if right.common < d:  # prefixes of right's first element alone, and of left's last one
            close(self.tail[: d + 1], max(self.common, right.common), out)
        return Forest(self.first, right.last, min(self.common, d, right.common), self.head, right.tail)


def close(path: list[Node], depth: int, out: list) -> None:
    """Takes the nodes deeper than ``depth`` off the path, the deepest first."""
    while len(path) > depth + 1:
        node = path.pop()
        out.append(node.row(path[-1]))


def grow(forests: list[Forest]) -> tuple[Forest, list]:
    """Unites neighbouring forests over their LCP edges in descending depth."""
    out: list = []
    up = list(range(len(forests)))

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    depth = [lcp(a.last, b.first) for a, b in zip(forests, forests[1:])]
    for i in sorted(range(len(depth)), key=depth.__getitem__, reverse=True):
        a, b = find(i), find(i + 1)
        forests[a] = forests[a].unite(forests[b], depth[i], out)
        forests[b], up[b] = None, a
    return forests[find(0)], out


# ---- transport ---------------------------------------------------------------
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
COLUMNS = [f.split(" ")[0] for f in NODE.split(", ")]
#: kind 0: a closed node; 1: one whose parent is still open (``parent``: its name); 2: a contracted forest
OUT = NODE + ", name binary, parent binary, kind int, part int, first binary, last binary, common int, head binary, tail binary"
_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
_OUT = pa.schema([(n, _KINDS[k]) for n, k in (f.split(" ") for f in OUT.split(", "))])
_WIDE = np.dtype([(c, "<i8") for c in ("depth", "points", "n", "least", "kids", "leaves", "saved", "ended")] + [("ends", "V32")])


def prefixes(seq: bytes) -> list[bytes]:
    """A 128-bit name for each prefix of a sequence, the empty one included."""
    h, out = hashlib.blake2b(digest_size=16), []
    for k in range(0, len(seq) + 1, UNIT):
        out.append(h.copy().digest())
        h.update(seq[k : k + UNIT])
    return out


def _pack(nodes: list[Node]) -> bytes:
    rows = [(x.depth, x.points, x.n, x.least, x.kids, x.leaves, x.saved, x.ends is not None, x.ends or EMPTY) for x in nodes]
    return np.array(rows, _WIDE).tobytes()


def _unpack(raw: bytes, names: list[bytes]) -> list[Node]:
    return [Node(*r[:7], ends=bytes(r[8]) if r[7] else None, name=names[r[0]]) for r in np.frombuffer(raw, _WIDE).tolist()]


def _sent(f: Forest, part: int) -> list:
    return [*[None] * 10, 2, part, f.first, f.last, f.common, _pack(f.head), _pack(f.tail[f.common + 1 :])]


def _received(first: bytes, last: bytes, common: int, head: bytes, tail: bytes) -> Forest:
    own = _unpack(head, prefixes(first))
    return Forest(first, last, common, own, own[: common + 1] + _unpack(tail, prefixes(last)))


def _partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted partition of elements to its closed nodes and its contracted forest."""
    forests, part = [], 0
    for b in batches:
        for *element, part in zip(*(b.column(c).to_pylist() for c in ("seq", "n", "least", "ends", "part"))):
            forests.append(Forest.single(*element))
    if not forests:
        return
    f, closed = grow(forests)
    late = {}
    for path, seq in ((f.head, f.first), (f.tail, f.last)):
        for node, name in zip(path, prefixes(seq)):
            late |= {id(r): name for r in node.waiting}
    rows = [[*r[:8], None, late.get(id(r)), int(id(r) in late), part, *[None] * 5] for r in closed]
    rows.append(_sent(f, part))
    for i in range(0, len(rows), 5000):
        yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows[i : i + 5000]), _OUT)], schema=_OUT)


def _level(final: bool):
    """A run of contracted forests to one (the last of all is closed whole)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: r["part"])
        f, closed = grow([_received(*(r[c] for c in ("first", "last", "common", "head", "tail"))) for r in got])
        part = got[0]["part"] // FAN
        if final:
            close(f.tail, f.common, closed)
            close(f.head, 0, closed)
            closed.append(f.head[0].row(None))
        rows = [[*r, 0, part, *[None] * 5] for r in closed]
        if not final:
            rows.append(_sent(f, part))
        yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows), _OUT)], schema=_OUT)

    return run


# ---- the job -----------------------------------------------------------------
def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, seq): every conversation's turns in order, ``UNIT`` bytes each."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    unit = F.concat(digest, F.lpad(F.hex(F.length(text)), 16, "0"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), unit.alias("unit")).alias("t")).where("conv_id is not null")
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return turns.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["unit"]), "")).alias("seq"))


def grafted(own: DataFrame, every: int = 100, most: int = 5) -> DataFrame:
    """Each conversation c with its first h turns taken from conversation c - c % ``every``.

    h is crc32 of c's decimal digits modulo ``most`` + 1.
    """
    giver = own.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("giver"), F.substring("seq", 1, most * UNIT).alias("start"))
    h = ((F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)) * UNIT).cast("int")
    start = F.coalesce(F.substring(F.col("start"), F.lit(1), h), F.lit(b""))
    rest = F.substring(F.col("seq"), h + 1, F.length("seq"))
    return own.join(giver, F.col("conv_id") - F.col("conv_id") % every == F.col("giver"), "left").select("conv_id", F.concat(start, rest).alias("seq"))


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of ids, sorted by sequence and block, to one element per sequence."""
    schema = pa.schema([("seq", pa.binary()), ("n", pa.int64()), ("least", pa.int64()), ("ends", pa.binary())])

    def rows():
        for b in batches:
            yield from zip(*(b.column(c).to_pylist() for c in ("key", "seq", "n", "least", "ids")))

    out = []
    for _, group in groupby(rows(), key=lambda r: r[0]):
        sha, total, first = hashlib.sha256(), 0, None
        for _, seq, n, least, ids in group:
            sha.update((ids if first is None else "," + ids).encode())
            first = first or (seq, least)
            total += n
        out.append((first[0], total, first[1], sha.digest()))
        if len(out) >= 2000:
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*out), schema)], schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*out), schema)], schema=schema)


def elements(seqs: DataFrame) -> DataFrame:
    """(seq, n, least, ends): distinct sequences, their conversations, and the hash of their ids."""
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    blocks = seqs.groupBy(F.unhex(F.md5("seq")).alias("key"), F.shiftright("conv_id", BLOCK_BITS).alias("block")).agg(
        F.first("seq").alias("seq"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"), ids.alias("ids")
    )
    dealt = blocks.repartition(shuffle_partitions(seqs.sparkSession), "key").sortWithinPartitions("key", "block")
    return dealt.mapInArrow(_ended, "seq binary, n long, least long, ends binary")


def trie(seqs: DataFrame, partition_bytes: int = PARTITION_BYTES, least_partitions: int | None = None) -> DataFrame:
    """All nodes of the trie of ``seqs`` (conv_id, seq); see the module."""
    known = cut(elements(seqs))
    size = known.agg(F.sum(F.length("seq") + UNIT)).first()[0] or 0
    n = max(least_partitions or shuffle_partitions(seqs.sparkSession), -(-size // partition_bytes))
    dealt = known.repartitionByRange(n, "seq").sortWithinPartitions("seq").withColumn("part", F.spark_partition_id())
    base = cut(dealt.mapInArrow(_partition, OUT))
    open_, levels = base.where("kind = 2"), []
    while True:
        final = n <= FAN
        levels.append(cut(open_.groupBy(F.floor(F.col("part") / FAN)).applyInArrow(_level(final), OUT)))
        if final:
            break
        open_, n = levels[-1].where("kind = 2"), -(-n // FAN)
    upper = levels[0]
    for level in levels[1:]:
        upper = upper.unionByName(level)
    upper = upper.where("kind = 0")
    ids = upper.select(F.col("name").alias("parent"), F.col("conv_id").alias("_id"))
    late = base.where("kind = 1")
    wanted = late.select("part", "parent").distinct().join(ids, "parent")
    found = late.join(wanted, ["part", "parent"]).unionByName(upper.join(ids, "parent", "left"))
    found = found.drop("parent_conv_id").withColumnRenamed("_id", "parent_conv_id")
    return base.where("kind = 0").select(*COLUMNS).unionByName(found.select(*COLUMNS))
