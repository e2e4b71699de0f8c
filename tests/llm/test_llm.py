"""Operators of flowtide.llm against brute force on small and awkward tables."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowtide.llm.catalog import tokenizer_path
from flowtide.llm.common import scratch

SCHEMA = "doc_id long, text string, score double, key string, component_id string"
BASE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def _rows():
    rng = np.random.default_rng(3)
    long = [" ".join(rng.choice(BASE, 120)) + f" {i}" for i in range(6)]
    near = [" ".join([*long[0].split()[:-1], "x", str(i)]) for i in range(4)]
    texts = [*long, *near, long[1], long[1], None, "", "   ", "one two", "One TWO", "word", " ".join(rng.choice(BASE, 9000)), "é ß 漢字 🙂 a.b, c", "ab\x0bc\td"]
    return [(i, t, 0.5, "k", "c") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), SCHEMA).repartition(3)


def _empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _words(t):
    low = (t or "").translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}))
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def _set(t, k):
    w = _words(t)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def _ids():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    return {i: e.ids for (i, *_), e in zip(_rows(), tok.encode_batch([t or "" for _, t, *_ in _rows()], add_special_tokens=False))}


def _crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("group_sets", [512, 2])
def test_jaccard_components(spark, docs, group_sets):
    from flowtide.llm.jaccard import classes

    sets = {i: _set(t, 4) for i, t, *_ in _rows()}
    root = {i: i for i in sets}
    for _ in sets:  # enough sweeps for any chain
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in classes(docs, group_sets=group_sets).collect()}
    assert got == {i: (len(sets[i]), root[i]) for i in sets}


def test_jaccard_empty_and_null_ids(spark):
    from flowtide.llm.jaccard import classes

    assert classes(_empty(spark)).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e")], "doc_id long, text string")
    assert sorted((r["doc_id"] or -1, r["component_id"]) for r in classes(rows).collect()) == [(-1, None), (7, 7), (7, 7)]


@pytest.mark.parametrize("k, num, n_words", [(4, 85, 9), (5, 80, 8)])
def test_jaccard_keeps_links_of_sets_with_empty_parts(spark, k, num, n_words):
    """All shingles of the shorter set in one of three parts, the longer one's last in another: one shared key."""
    import pyarrow as pa

    from flowtide.llm.jaccard import classes, sets_of
    from flowtide.llm.textnum import utf8

    long = [" ".join(f"w{i}x{j}" for j in range(n_words + 1)) for i in range(4000)]
    h, at, _ = sets_of(*utf8(pa.array([" ".join(t.split()[:-1]) for t in long])), k)
    h2, at2, _ = sets_of(*utf8(pa.array(long)), k)
    part = lambda x: {int(v) for v in (x >> np.uint64(32)) * np.uint64(3) >> np.uint64(32)}
    found = [i for i in range(len(long)) if len(part(h[at[i] : at[i + 1]])) == 1 and len(part(h2[at2[i] : at2[i + 1]])) == 2]
    assert found
    for i in found[:1]:  # alone in its size band
        rows = spark.createDataFrame([(1, " ".join(long[i].split()[:-1])), (2, long[i])], "doc_id long, text string")
        assert [r["component_id"] for r in classes(rows, k=k, num=num, den=100).collect()] == [1, 1]


def test_packing(spark, docs):
    from flowtide.llm.packing import best_fit, pack

    ids = {i: [*x, 1] for i, x in _ids().items()}
    out = pack(docs, tokenizer_path(), capacity=256, slack=4, fanout=2).toPandas()
    want = {(i, p): (256 * p, len(x[256 * p : 256 * p + 256]), _crc(x[256 * p : 256 * p + 256])) for i, x in ids.items() for p in range(-(-len(x) // 256))}
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in out.itertuples()} == want and len(out) == len(want)
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == list(g.length.cumsum() - g.length) and g.length.sum() <= 256
    whole = best_fit(out.length.to_numpy(), 256)[2]  # all pieces in one best-fit round
    assert out.sequence_id.nunique() <= len(whole) + 1
    assert pack(_empty(spark), tokenizer_path()).count() == 0


def test_token_shards_round_trip(spark, docs):
    from flowtide.llm.tokenfile import PerfectHash, Shard, lookup, unkeyed, write_shards

    extra = spark.createDataFrame([(None, "no key"), (3, "again")], "doc_id long, text string")
    shards = write_shards(docs.select("doc_id", "text").unionByName(extra), scratch(spark, "t"), tokenizer_path())
    rows = lookup(docs, shards).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter([i for i, *_ in _rows()] + [3])
    crcs = {(r["doc_id"], r["ids_crc32"]) for r in rows}
    assert all((i, _crc([*x, 2])) in crcs for i, x in _ids().items())
    assert [r["doc_id"] for r in unkeyed(shards).collect()] == [None]
    spans = sorted((r["start"], r["n_tokens"]) for r in rows + unkeyed(shards).collect())
    assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and spans[0][0] == 0
    first = shards.where("doc_low is not null").first()
    assert Shard(first["path"]).get(10**9) == []
    keys = np.arange(0, 50_000, 7)
    assert sorted(PerfectHash.build(keys).slot(keys)) == list(range(len(keys)))
    none = write_shards(_empty(spark), scratch(spark, "t"), tokenizer_path())
    assert none.count() == 0 and lookup(docs, none).count() == 0


def test_fixity_finds_exactly_the_damage(spark):
    from flowtide.llm.fixity import copy_files, differences, digests, store, tree

    pages = spark.range(300).select(F.col("id").alias("page_id"), F.concat(F.lit("http://a/"), "id").alias("url"), F.repeat(F.lit("x"), F.col("id").cast("int")).alias("html"))
    pages = pages.unionByName(spark.createDataFrame([(None, None, None)], "page_id long, url string, html string"))
    a, b = scratch(spark, "w"), scratch(spark, "w")
    index = store(pages, a)
    copy_files(index, a, b, lambda p, raw: raw[:-1] + b"?" if p in (5, 77) else raw).collect()
    trees = tree(digests(index, a), 4), tree(digests(index, b), 4)
    found = differences(*trees, fanout=4).join(index.withColumnRenamed("number", "node"), ["file", "node"])
    assert sorted(r["page_id"] for r in found.collect()) == [5, 77]
    assert differences(trees[0], trees[0], fanout=4).count() == 0


def test_one_permutation(spark, docs):
    from flowtide.llm.onepermutation import fingerprints

    out = {r["doc_id"]: r for r in fingerprints(docs).collect()}
    texts = {i: t or "" for i, t, *_ in _rows()}
    for i, t in texts.items():
        nxt = texts[(i + 1) % len(texts)]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert out[i]["n_chars"] == len(t) and out[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for other, got in ((edited, out[i]["near_edited"]), (nxt, out[i]["near_next"])):
            x, y = _set(t, 5), _set(other, 5)
            assert abs(got - (len(x & y) / len(x | y) if x | y else 1.0)) < 0.16
    assert out[1]["fingerprint"] == out[10]["fingerprint"] and out[12]["fingerprint"] == ""
    assert fingerprints(_empty(spark)).count() == 0


def test_url_rules(spark):
    from flowtide.llm.urlrules import judge

    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("a.example.net", "/en/x", "block"), ("org", "/e", "allow"), ("org", "/en", "block")]
    urls = ["http://X.example.NET/en/1?q", "https://net", "http://net/", "http://internet/", "ftp://a.example.net/en/xy", "http://b.org/en#f", "http://b.org/e", None, "no scheme", "http://", "http://a.example.net/en/x"]
    rows = [(i, u, "t") for i, u in enumerate(urls * 20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string").repartition(5)
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in judge(pages, spark.createDataFrame(rules, "host string, path string, action string")).collect()}
    for i, u, _ in rows:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fit = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert got[i] == (max(fit)[1:] if fit else (None, "allow")), u
    assert judge(pages.limit(0), spark.createDataFrame(rules, "host string, path string, action string")).count() == 0


def test_leaks(spark, docs):
    from flowtide.llm.decontaminate import leaks

    item = "the quick brown fox jumps over the lazy dog while nine old owls watch from tall trees".split()
    swapped = [*item[:3], "cat", *item[4:]]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "too short"), (3, None), (None, "a b c d e f")], "item_id long, text string")
    texts = [(1, "Start. " + " ".join(item).upper() + " end"), (2, " ".join(swapped)), (3, " ".join(item[:8])), (4, None), (5, "a, b " + " ".join([*item[:-1], "bushes"])), (5, " ".join(item)), (None, " ".join(item))]
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in leaks(spark.createDataFrame(texts, "doc_id long, text string"), bench).collect()}
    assert got == {(1, 1): 1.0, (5, 1): 1.0}
    assert leaks(_empty(spark), bench).count() == 0 and leaks(docs, bench.limit(0)).count() == 0


def test_byte_shards(spark, docs):
    from flowtide.llm.sharding import shards_by_bytes

    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(None, "x" * 50), (3, "again")], "doc_id long, text string"))
    out = shards_by_bytes(rows, 4).toPandas()
    assert len(out) == len(_rows()) + 2 and (out.law == "bytes").all()
    most = out["size"].max()
    sizes = out.groupby("shard")["size"].sum()
    assert sizes.max() - out["size"].sum() / 4 <= most
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert shards_by_bytes(_empty(spark)).count() == 0


def test_quality_held_out(spark):
    from flowtide.llm.quality import score, train

    rng = np.random.default_rng(1)
    rows = []
    for i in range(600):
        w = list(rng.choice(BASE, 40))
        bad = i % 4 == 0
        rows.append((i, " ".join(x.upper() + "!!" if bad else x for x in w), int(not bad)))
    rows += [(601, None, 1), (602, "", None), (None, "abc", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = train(df.select("doc_id", "text"), df.select("doc_id", "quality"))
    got = score(df.select("doc_id", "text"), model).join(df.select("doc_id", F.col("quality").alias("q")), "doc_id").where("held_out and q is not null").toPandas()
    assert (got.predicted == got.q).mean() > 0.97 and got.score.between(0, 1).all()
    none = train(df.select("doc_id", "text"), df.select("doc_id", "quality").limit(0))
    assert score(df.limit(3).select("doc_id", "text"), none).select("score").distinct().count() == 1


def test_pseudo_likelihood_prefers_corpus_like_text(spark):
    from flowtide.llm.pseudolikelihood import scores

    rows = [(i, " ".join(["the cat sat on the mat"] * 10)) for i in range(30)] + [(100, "mat mat mat mat mat mat the the the the"), (101, None), (102, "")]
    got = {r["doc_id"]: r for r in scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0]["mean_log_likelihood"] > got[100]["mean_log_likelihood"] and got[0]["n_words"] == 60
    assert got[101]["n_words"] == 0 and got[101]["mean_log_likelihood"] is None and len(got) == len(rows)


@pytest.mark.parametrize("chunk_bytes", [3_000_000, 300])
def test_pseudo_likelihood_counts_all_words_and_pairs(spark, docs, chunk_bytes):
    """With equal weights a score is the plain mixture, counted by hand; each chunk gets the whole corpus's counts."""
    from flowtide.llm.pseudolikelihood import Gate, scores

    gate = Gate()
    gate.p = {k: np.zeros_like(x) for k, x in gate.p.items()}
    texts = {i: _words(t) for i, t, *_ in _rows()}
    two, n = Counter(), Counter(w for x in texts.values() for w in x)
    for x in texts.values():
        line = [None, None, *x, None, None]
        for d in (1, 2):
            two.update((d, a, b) for a, b in zip(line, line[d:]) if a or b)
            n[d] += min(d, len(x))
    total = sum(v for k, v in n.items() if isinstance(k, str))
    distinct = len(n) - 2

    def log_probability(line, at):
        p = [1 / distinct, (n[line[at]] - 1) / (total - 1)]
        for d in (1, 2):
            for u, pair in ((line[at - d], (d, line[at - d], line[at])), (line[at + d], (d, line[at], line[at + d]))):
                m = n[u] if u else n[d]
                p.append((two[pair] - 1) / (m - 1) if m > 1 else p[1])
        return np.log(sum(p) / 6)

    got = {r["doc_id"]: r for r in scores(docs, gate, chunk_bytes).collect()}
    assert len(got) == len(texts)
    for i, x in texts.items():
        want = sum(log_probability([None, None, *x, None, None], at) for at in range(2, len(x) + 2))
        assert got[i]["n_words"] == len(x) and abs(got[i]["log_likelihood"] - want) < 1e-6 * (1 + abs(want))


def test_pseudo_likelihood_predicts_words(spark):
    """Far more words than classes: a rare word in its own place scores above another of equal count and length."""
    from flowtide.llm.pseudolikelihood import scores

    rows = [(i, " ".join(f"a{j:04d} b{j:04d} c{j:04d}" for j in range(i % 50, 3000, 50))) for i in range(200)]
    rows += [(1000, "a0007 b0007 c0007"), (1001, "a0007 b0008 c0007"), (1002, None), (None, "a0007 b0007 c0007")]
    got = {r["doc_id"]: r["log_likelihood"] for r in scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1000] > got[1001] + 1 and got[None] == pytest.approx(got[1000]) and got[1002] == 0
    assert scores(_empty(spark)).count() == 0


def test_pseudo_likelihood_network_learns_from_every_chunk(spark):
    """The network is the mean of all chunks' networks by their windows, however many chunks there are."""
    from flowtide.llm import pseudolikelihood as pl

    rows = [(i, " ".join(f"w{i * j % 17}" for j in range(5 + i % 9))) for i in range(120)]
    chunks, totals = pl.counted(spark.createDataFrame(rows, "doc_id long, text string"), 60)
    size = totals.groupBy().sum("distinct_words", "words").first()
    want, windows, n = 0, 0, 0
    parts = totals.toArrow().to_pandas()
    for left in chunks.toArrow().to_batches():
        for r in range(left.num_rows):
            own = pa.Table.from_batches([left.slice(r, 1)])
            right = pa.Table.from_pandas(parts[parts["chunk"] == own.column("chunk")[0].as_py()])
            _, _, seen, p = pl._of_chunk(own, right, *size)
            want, windows, n = want + pl.Gate().train(seen, p).flat() * len(p), windows + len(p), n + 1
    assert n > 40 and windows == size[1]
    assert pl.trained(chunks, totals, *size).flat() == pytest.approx(want / windows, abs=1e-6)
