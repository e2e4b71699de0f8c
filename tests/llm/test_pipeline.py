"""The stages and the operators behind them against brute force."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P

SCHEMA = "doc_id long, text string, lang string, score double, component_id string, item_id long, _row int"
WORDS = [f"{a}{b}{c}" for a in "bdkt" for b in "aeiou" for c in ("n", "st", "r", "l")]


def _text(rng, n):
    return " ".join(rng.choice(WORDS, n)) + "."


def _items(rng):
    return [_text(rng, int(n)) for n in (25, 25, 25, 40, 12)] + ["too short here", None]


def _docs(rng, items):
    base = [_text(rng, int(n)) for n in rng.integers(20, 120, 25)]
    near = [" ".join([*t.split()[:-1], f"x{i}"]) for i, t in enumerate(base[:6])]
    edited = items[0].split()
    edited[12] = "other"
    leaky = [f"{base[7]} {items[0]} {base[8]}", f"{items[3]}", f"{_text(rng, 30)} {' '.join(edited)}", " ".join(items[1].split()[:23]), f"{items[4].upper()} {_text(rng, 400)}", _text(rng, 3000) + items[2]]
    texts = base + near + leaky + [None, "", "one two", "one two", "  "]
    rows = [(100 + 3 * i, t) for i, t in enumerate(texts)]
    rows += [(None, base[9]), (None, base[9]), (None, items[1] + " end"), (3, base[1]), (3, _text(rng, 50)), (100, base[0]), (5, base[20]), (5, base[20])]
    return [(d, t, "en", 0.1, "c", 9, i) for i, (d, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rng = np.random.default_rng(11)
    items = _items(rng)
    rows = _docs(rng, items)
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/stage.parquet")
    return rows, items, spark.read.parquet(f"{folder}/stage.parquet"), str(folder)


def _shingles(t, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def _kept(rows):
    """Least (null last) id, then place, of every component of similar texts."""
    sets = [_shingles(r[1]) for r in rows]
    root = list(range(len(rows)))
    for _ in range(4):
        for i in root:
            for j in range(len(rows)):
                both = len(sets[i] & sets[j])
                if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(root[root[root[i]]], []).append(r)
    return groups.values()


def _grams(t, k=5):
    w = [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]
    return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]


def _similar(text, item):
    """The best weighted similarity of an item-sized window, over all windows."""
    a, b, best = _grams(text), _grams(item), 0.0
    want = Counter(b)
    for s in range(max(1, len(a) - len(b) + 1)):
        own = Counter(a[s : s + len(b)])
        if own:
            both = sum((own & want).values())
            best = max(best, both / (sum(own.values()) + len(b) - both))
    return best


def test_near_duplicates(spark, made):
    rows, _, docs, folder = made
    got = sorted(r["_row"] for r in P.near_duplicates(spark, docs, folder).collect())
    groups = _kept(rows)
    assert len(got) == len(groups)
    for g in groups:
        stays = [r for r in g if r[6] in got]
        assert len(stays) == 1
        ids = [r[0] for r in g if r[0] is not None]
        assert stays[0][0] == (min(ids) if ids else None)
    assert P.near_duplicates(spark, docs, folder).columns == docs.columns


def test_decontaminate_and_all_windows(spark, made):
    from flowtide.llm.decontaminate import leaks

    rows, items, docs, folder = made
    leaky = {r[6] for r in rows if any(i and _grams(i) and _similar(r[1], i) >= 0.8 for i in items)}
    got = P.decontaminate(spark, docs, folder)
    assert {r["_row"] for r in got.collect()} == {r[6] for r in rows} - leaky and len(leaky) >= 6
    assert got.columns == docs.columns
    found = leaks(docs.select(F.col("_row").alias("doc_id"), "text"), spark.read.parquet(f"{folder}/benchmark.parquet")).collect()
    want = {(r[6], k): round(_similar(r[1], i), 6) for r in rows for k, i in enumerate(items) if i and _grams(i) and _similar(r[1], i) >= 0.8}
    assert {(r["doc_id"], r["item_id"]): r["similarity"] for r in found} == want
    for r in found:
        own = _grams(rows[r["doc_id"]][1])
        window = own[r["start_word"] : r["start_word"] + len(_grams(items[r["item_id"]]))]
        assert r["n_words"] == len(window) + 4


def test_the_hamming_index_prunes_and_loses_nothing(spark):
    """Random windows against random items, and pairs at the radius itself."""
    from flowtide.llm import decontaminate as D

    rng = np.random.default_rng(3)
    longs = lambda n: rng.integers(0, 1 << D.EACH * D.WIDTH, (n, D.HASHES), dtype=np.int64)
    x, y = longs(300), longs(200)
    near = []
    for i in range(100):  # a partner that differs in exactly the radius
        v = x[i].copy()
        for bit in rng.choice(D.BLOCKS * D.WIDTH, D.RADIUS, replace=False).tolist():
            v[bit // (D.EACH * D.WIDTH)] ^= 1 << bit % (D.EACH * D.WIDTH)
        near.append(v)
    items = spark.createDataFrame([(i, 30, v.tolist()) for i, v in enumerate([*y, *near])], "item long, size int, fp array<long>")
    windows = spark.createDataFrame([(i, 30, v.tolist()) for i, v in enumerate(x)], "window long, size int, fp array<long>")
    got = {(r["window"], r["item"]) for r in D.candidates(windows, items).collect()}
    assert {(i, 200 + i) for i in range(100)} <= got
    assert len(got) - 100 < 0.05 * 300 * 300
    far = D.hamming(F.col("fp"), F.array(*[F.lit(int(v)) for v in x[0]]))
    assert items.where("item = 200").select(far).first()[0] == D.RADIUS


def test_recall_of_fingerprints(spark):
    """Windows a little above the threshold: at least nine of ten within the radius."""
    from flowtide.llm.decontaminate import leaks

    rng = np.random.default_rng(8)
    items = [[f"{a}{i}" for a in rng.choice(WORDS, 60)] for i in range(120)]
    docs, want = [], 0
    for i, w in enumerate(items):
        own = list(w)
        for at in rng.choice(np.arange(6, 54, 12), 1, replace=False):
            own[at] = "new"
        own[-1] = "end"
        docs.append((i, " ".join(own)))
        want += _similar(docs[-1][1], " ".join(w)) >= 0.8
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    found = leaks(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), bench).count()
    assert want == 120 and found >= 0.9 * want


def test_the_whole_pipeline(spark, made, tmp_path):
    rows, items, docs, folder = made
    for name in ("documents", "labels"):
        table = docs if name == "documents" else spark.createDataFrame([(r[0], 1, 0) for r in rows if r[0] is not None], "doc_id long, quality int, toxic int")
        table.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    out = P.run(spark, folder).toPandas()
    clean = [g for g in _kept(rows) if not any(i and _grams(i) and _similar(min(g, key=lambda r: (r[0] is None, r[0] or 0))[1], i) >= 0.8 for i in items)]
    assert len(out[out["piece"] == 0]) == len(clean)  # all labels are good: quality keeps every row
    for _, seq in out.groupby("sequence_id"):
        assert sorted(seq["offset"]) == [0, *np.cumsum(seq.sort_values("offset")["length"])[:-1]] and seq["length"].sum() <= 4096
    docs.limit(0).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    assert P.run(spark, folder).count() == 0
