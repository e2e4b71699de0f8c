"""Fixity of extended, cut, lost and extra files; quality models on awkward tables."""

import gzip
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowtide.llm.common import scratch


def _path(folder):
    return folder.removeprefix("file:").replace("///", "/")


@pytest.fixture(scope="module")
def replicas(spark):
    from flowtide.llm.fixity import copy_files, store

    pages = spark.range(200).select(F.col("id").alias("page_id"), F.concat(F.lit("http://a/"), "id").alias("url"), F.repeat(F.lit("x"), F.col("id").cast("int")).alias("html"))
    pages = pages.unionByName(spark.createDataFrame([(None, None, None), (7, "http://a/7", "again"), (7, "http://a/7", "again")], "page_id long, url string, html string"))
    a = scratch(spark, "warc")
    index = store(pages, a)
    return index, a, lambda: (b := scratch(spark, "warc"), copy_files(index, a, b, lambda p, raw: raw).collect())[0]


def _found(spark, index, a, b):
    from flowtide.llm.fixity import differences, digests, tree

    names = {(r["file"], r["number"]): r["page_id"] for r in index.collect()}
    out = differences(tree(digests(index, a), 4), tree(digests(index, b), 4), fanout=4).collect()
    return sorted((r["file"], r["node"], (r["file"], r["node"]) in names, r["hash_a"] is None, r["hash_b"] is None) for r in out)


def test_sound_replica(spark, replicas):
    index, a, copy = replicas
    assert index.count() == 203 and _found(spark, index, a, copy()) == []


def test_bytes_behind_the_last_record_and_extra_files(spark, replicas):
    index, a, copy = replicas
    b = copy()
    files = sorted(f for f in os.listdir(_path(b)) if f.endswith(".warc.gz"))
    with open(f"{_path(b)}/{files[1]}", "ab") as f:
        f.write(b"tail")
    with gzip.open(f"{_path(b)}/zz-extra.warc.gz", "wb") as f:
        f.write(b"more")
    last = index.where(F.col("file") == files[1]).count()
    assert _found(spark, index, a, b) == [(files[1], last, False, False, False), ("zz-extra.warc.gz", 0, False, True, False)]


def test_cut_and_lost_files(spark, replicas):
    index, a, copy = replicas
    b = copy()
    sizes = {r["file"]: r["count"] for r in index.groupBy("file").count().collect()}
    files = sorted(sizes, key=sizes.get)
    with open(f"{_path(b)}/{files[0]}", "r+b") as f:
        f.truncate(os.path.getsize(f"{_path(b)}/{files[0]}") - 1)
    gone = files[-1]  # the largest: the replica's tree is lower without it
    os.truncate(f"{_path(b)}/{gone}", 0)
    found = _found(spark, index, a, b)
    assert [x for x in found if x[0] == files[0]] == [(files[0], sizes[files[0]] - 1, True, False, False), (files[0], sizes[files[0]], False, False, False)]
    assert {x[1] for x in found if x[0] == gone} == set(range(sizes[gone] + 1))


def test_no_pages(spark):
    from flowtide.llm.fixity import copy_files, differences, digests, store, tree

    a, b = scratch(spark, "warc"), scratch(spark, "warc")
    index = store(spark.createDataFrame([], "page_id long, url string, html string"), a)
    copy_files(index, a, b, lambda p, raw: raw).collect()
    assert index.count() == 0 and differences(tree(digests(index, a)), tree(digests(index, a))) .count() == 0


def _labelled(spark, parts):
    rng = np.random.default_rng(2)
    good = [" ".join(rng.choice(["the", "report", "shows", "that", "growth", "slowed."], 60)) for _ in range(160)]
    bad = [" ".join(rng.choice(["!!", "$$$", "a1", "0", "##"], 25)) for _ in range(160)]
    texts = [t for pair in zip(good, bad) for t in pair]
    rows = [(i, t, 1.0, "s") for i, t in enumerate(texts)] + [(8, f"copy {i} !!", 2.0, "s") for i in range(300)] + [(None, "no id", 0.0, "s"), (999, None, 0.0, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, y string").repartition(parts)
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(320)] + [(8, 1, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_quality_model_does_not_depend_on_repeats_or_partitions(spark):
    from flowtide.llm.quality import accept, held_out, score, train

    models = []
    for parts in (1, 7):
        docs, labels = _labelled(spark, parts)
        models.append(train(docs, labels))
        out = {(r["doc_id"], r["held_out"]): r["predicted"] for r in score(docs, models[-1]).collect()}
        told = [(d, p) for (d, held), p in out.items() if held and d is not None and d < 320]
        assert len(told) > 40 and np.mean([p == 1 - d % 2 for d, p in told]) > 0.95
        assert score(docs, models[-1]).count() == docs.count() and accept(docs, models[-1]).columns == docs.columns
    assert models[0].weights == models[1].weights and models[0].intercept == models[1].intercept
    docs, labels = _labelled(spark, 2)
    assert score(docs.limit(0), models[0]).count() == 0
    empty = train(docs.limit(0), labels)
    assert 0 <= score(docs, empty).agg(F.min("score")).first()[0] <= 1
    assert spark.range(3).select(held_out(F.lit(None).cast("long"))).distinct().collect()[0][0] is False


def test_compiled_rules_equal_the_rules(spark):
    """Brute force: every rule's conditions over each text's statistics, weighed one by one."""
    from flowtide.llm.quality import NAMES, score, statistics, train

    docs, labels = _labelled(spark, 3)
    model = train(docs, labels)
    x = docs.select("doc_id", "text", statistics(F.col("text")).alias("s")).select("doc_id", "text", "s.*").toPandas()
    z = np.full(len(x), model.intercept)
    for rule, w in zip(model.rules, model.weights):
        z += w * rule.hits(x[NAMES].to_numpy(float))
    want = sorted(zip(x["doc_id"].fillna(-1).astype(int), np.round(1 / (1 + np.exp(-z)), 9)))
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], round(r["score"], 9)) for r in score(docs, model).collect())
    assert [g[0] for g in got] == [w[0] for w in want] and np.allclose([g[1] for g in got], [w[1] for w in want], atol=1e-8)
