"""Slices of very few words, alone and after long texts."""

import numpy as np
import pyarrow as pa
import pytest

from flowtide.llm.textnum import shingles, utf8, word_hashes, words


def _of(texts, k):
    buf, offs = utf8(pa.array(texts, pa.string()))
    starts, ends, rows = words(buf, offs)
    h, at = shingles(word_hashes(buf, starts, ends), rows, k)
    return [h[a:b].tolist() for a, b in zip(at, at[1:])]


@pytest.mark.parametrize("k", [1, 4, 5])
def test_shingles_of_random_slices(k):
    rng = np.random.default_rng(k)
    names: dict = {}
    for _ in range(400):
        texts = [" ".join(rng.choice(list("abc"), rng.integers(0, 8))) for _ in range(rng.integers(1, 5))]
        for text, got in zip(texts, _of(texts, k)):
            w = text.split()
            want = [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [tuple(w)] if w else []
            assert len(got) == len(want)
            for g, x in zip(got, want):  # equal shingles have equal hashes, others do not
                assert names.setdefault(x, g) == g
    assert len(set(names.values())) == len(names)


LONG = " ".join(f"w{i}" for i in range(90_000))


@pytest.mark.parametrize("parts", [1, 9])
def test_operators_on_few_words(spark, parts):
    from flowtide.llm.jaccard import classes
    from flowtide.llm.onepermutation import fingerprints

    texts = [LONG, "one two", "a", "a b", "a b c", "a b c d", "a b c d e", "x z", "", None, "one two", LONG]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts)
    rows = rows.coalesce(1).sortWithinPartitions("doc_id") if parts == 1 else rows
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in classes(rows).collect()}
    assert got == {0: (89997, 0), 1: (1, 1), 2: (1, 2), 3: (1, 3), 4: (1, 4), 5: (1, 5), 6: (2, 6), 7: (1, 7), 8: (0, 8), 9: (0, 9), 10: (1, 1), 11: (89997, 0)}
    prints = {r["doc_id"]: r["fingerprint"] for r in fingerprints(rows).collect()}
    assert len(prints) == 12 and prints[0] == prints[11] and prints[1] == prints[10] and prints[8] == prints[9] == ""


def test_one_text_of_two_words(spark):
    from flowtide.llm.jaccard import classes

    assert [tuple(r) for r in classes(spark.createDataFrame([(5, "one two")], "doc_id long, text string")).collect()] == [(5, 1, 5)]
