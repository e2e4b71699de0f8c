"""The pivot index against all pairs on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, label int, row string, node long"


def _group(rng, n, spread, dim=64):
    """n vectors around one direction."""
    centre = rng.normal(size=dim)
    return centre / np.linalg.norm(centre) + rng.normal(size=(n, dim)) * spread / np.sqrt(dim)


def _vectors(seed):
    rng = np.random.default_rng(seed)
    tight = [_group(rng, n, s) for n, s in ((150, 0.08), (40, 0.12), (3, 0.1), (2, 0.2))]
    loose = [_group(rng, 120, 0.24), _group(rng, 60, 0.3)]
    copies = np.repeat(_group(rng, 1, 0), 60, axis=0)
    x = np.concatenate([rng.normal(size=(400, 64)), *tight, *loose, copies, copies[:1] * 3]).astype(np.float32)
    return x[rng.permutation(len(x))]


def _odd(base):
    nan, inf = float("nan"), float("inf")
    vectors = [None, [], [0.0] * 64, [nan] + [1.0] * 63, [inf] + [1.0] * 63, [None] + [1.0] * 63, [1.0] * 5, [1.0] * 5 + [0.0] * 9, [1e38] * 64, [1e-38] * 64]
    return [(base + i, v, 0, "x", 0) for i, v in enumerate(vectors)] + [(None, [1.0] * 64, 0, "x", 0), (base, [1.0] * 64, 0, "x", 0)]


def _brute(rows):
    x = np.zeros((len(rows), 64))
    for i, (v, e, *_) in enumerate(rows):
        if v is not None and e and all(c is not None and np.isfinite(c) for c in e):
            y = np.asarray(e, float)
            x[i, : len(y)] = y / np.abs(y).max() if y.any() else 0
    n = np.linalg.norm(x, axis=1)
    link = (x / np.where(n > 0, n, 1)[:, None]) @ (x / np.where(n > 0, n, 1)[:, None]).T >= 0.95
    np.fill_diagonal(link, False)
    ids = np.array([-1 if r[0] is None else r[0] for r in rows])
    low = ids.copy()
    while True:
        new = np.where(link, low[None, :], low[:, None]).min(axis=1)
        if (new == low).all():
            break
        low = new
    return sorted((int(v), int(k), int(c), bool(v >= 0 and v == c)) for v, k, c in zip(ids, link.sum(axis=1), low))


def _got(df):
    return sorted((-1 if r["vec_id"] is None else r["vec_id"], r["n_links"], -1 if r["component_id"] is None else r["component_id"], r["kept"]) for r in df.collect())


@pytest.mark.parametrize(("seed", "block"), [(1, 1024), (2, 16)])
def test_links_and_components(spark, seed, block):
    from flowtide.llm.pivots import near_copies

    x = _vectors(seed)
    rows = [(1000 - i, v.tolist(), 0, "r", 1) for i, v in enumerate(x)] + _odd(5000)
    got = _got(near_copies(spark.createDataFrame(rows, SCHEMA).repartition(4), block=block))
    assert got == _brute(rows)


def test_recall_without_balls(spark, monkeypatch):
    """Pairs at the threshold itself, found through the lists alone."""
    from flowtide.llm import pivots

    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(axis=1)[:, None] * x
    y = 0.951 * x + np.sqrt(1 - 0.951**2) * z / np.linalg.norm(z, axis=1)[:, None]
    rows = [(i, v.tolist(), 0, "r", 1) for i, v in enumerate(np.concatenate([x, y]))]
    monkeypatch.setattr(pivots, "DENSE", 10**9)
    got = pivots.near_copies(spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert got.agg(F.sum("n_links")).first()[0] >= 0.97 * sum(r[1] for r in _brute(rows))


def test_nothing(spark):
    from flowtide.llm.pivots import near_copies

    assert near_copies(spark.createDataFrame([], SCHEMA)).count() == 0
    assert _got(near_copies(spark.createDataFrame([(1, None, 0, "", 0), (2, [1.0, 2.0], 0, "", 0)], SCHEMA))) == [(1, 0, 1, True), (2, 0, 2, True)]
