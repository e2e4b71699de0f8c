"""Forests of large tables: every row is counted, and the forest is pyspark's in kind."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowtide.functions import constants as K
from flowtide.operators import cells as ce
from flowtide.operators import ml

LADDER = [{"numTrees": 40, "maxDepth": 6, "minInstancesPerNode": 4}]


def rows(spark, n=6000, parts=3):
    r = spark.range(n).repartition(parts)
    u = lambda seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(10_007)) / 10_007.0
    df = r.select("id", (u(1) * 5000).alias("latency"), u(2).alias("throughput"), u(3).alias("packet_loss"))
    late = F.col("latency") / 5000 + F.col("packet_loss") + 0.4 * u(4)
    return df.withColumn("congestion", (late > 1.5).cast("int"))


def test_no_row_is_left_out_of_a_fit(spark, monkeypatch):
    """The weights of all trees' roots tell how many rows they were fitted on."""
    df = rows(spark)
    whole = [r for r in df.collect()]
    u = {r["id"]: r["u"] for r in df.select("id", ml.hash_unit(K.SPLIT_SEED, ["id"]).alias("u")).collect()}
    n_train = sum(u[r["id"]] >= 0.2 for r in whole)
    monkeypatch.setattr(K, "ROW_FIT_ROWS", 1000)
    monkeypatch.setattr(K, "MAX_TRAIN_ROWS", 1000, raising=False)
    fitted = ml.fit_selected(df, ["id"], LADDER)
    assert fitted.train.count() == n_train > 4000
    ml.save_model(fitted.model, path := f"{ml.ensure_checkpoint_dir(spark)}/whole")
    roots = spark.read.parquet(f"{path}/data").where("nodeData.id = 0").select("nodeData.rawCount").toPandas()["rawCount"]
    assert len(roots) == 40 and abs(roots.mean() / n_train - 1) < 0.02 and roots.nunique() > 20
    fitted.release()


def test_fit_of_cells_is_the_fit_of_rows_in_kind(spark, monkeypatch):
    df = rows(spark)
    by_rows = ml.fit_selected(df, ["id"], LADDER)
    monkeypatch.setattr(K, "ROW_FIT_ROWS", 0)
    a, b = ml.fit_selected(df, ["id"], LADDER), ml.fit_selected(rows(spark, parts=7), ["id"], LADDER)
    prob = lambda m: np.array([r["prob"] for r in ml.predict(m, by_rows.test).orderBy("id").collect()])
    p, q = prob(by_rows.model), prob(a.model)
    assert (prob(b.model) == q).all()  # whatever the partitions
    assert np.abs(p - q).mean() < 0.03 and np.corrcoef(p, q)[0, 1] > 0.99
    assert by_rows.report[0][4:8] == pytest.approx(a.report[0][4:8], abs=0.03)
    assert by_rows.report[0][8:] == pytest.approx(a.report[0][8:], abs=0.06)
    # the ladder's metrics, counted in cells, are those of the rows
    _, valid = ml.split(a.train, ["id"], seed=K.MODEL_SEED)
    assert ml.evaluate(a.models[0], valid)["accuracy"] == a.report[0][4]
    assert ml.evaluate(a.models[0], valid)["f1"] == a.report[0][7]
    by_rows.release()


def test_cells_hold_every_row(spark):
    df = rows(spark, 3000).withColumn("first", F.col("id") % 3 > 0)
    part, valid, every = ce.count_cells(df, "first", (1.0, 1.0), "congestion")
    have = df.toPandas()
    for cells, some in ((part, have[have["first"]]), (valid, have[~have["first"]]), (every, have)):
        bins = np.column_stack([np.searchsorted(c, some[f]) for c, f in zip(cells.cuts, K.FEATURES)])
        want = pd.DataFrame(bins).assign(y=some["congestion"].to_numpy()).value_counts().to_dict()
        got = {(*map(int, b), y): int(n) for b, r in zip(cells.bins, cells.rows) for y, n in enumerate(r) if n}
        assert got == want
        assert all(len(c) == ce.MAX_BINS - 1 for c in cells.cuts)
    for c, f in zip(every.cuts, K.FEATURES):
        held = np.bincount(np.searchsorted(c, have[f]))
        assert held.min() > 0.8 * 3000 / 32 and held.max() < 1.2 * 3000 / 32


def test_cuts_of_few_and_of_heavy_values():
    few = np.arange(5.0)
    assert ce.equal_cuts(few, few, np.ones(5)).tolist() == [0.5, 1.5, 2.5, 3.5]
    many, w = np.arange(1000.0), np.ones(1000)
    w[0] = 1000.0  # half of the weight: the other half still gets its bins
    cuts = ce.equal_cuts(many, many, w)
    assert cuts[0] == 0.5 and len(cuts) == 16 and np.diff(cuts[1:]).max() < 65


def test_a_tree_by_hand():
    cells = ce.Cells([np.array([1.0, 2.0]), np.array([]), np.array([])], np.array([[0, 0, 0], [1, 0, 0], [2, 0, 0]]), np.array([[10**6, 0], [0, 10**6], [10**6, 0]]))
    for seed in range(12):
        t = ce.grow(cells, (1.0, 1.0), 5, 1, np.random.default_rng(seed))
        assert t["id"].tolist() == list(range(len(t)))
        if len(t) > 1:  # both drawn features were without a cut else
            assert t["left"].tolist()[0] == 1 and t.iloc[0]["raw"] == t[t["left"] < 0]["raw"].sum()
            leaves = t[t["left"] < 0]
            assert set(leaves["prediction"]) == {0.0, 1.0}
            for _, n in t[t["left"] >= 0].iterrows():
                l, r = (t[t["id"] == n[c]].iloc[0] for c in ("left", "right"))
                total = n["w0"] + n["w1"]
                assert l["w0"] + r["w0"] == n["w0"] and l["raw"] + r["raw"] == n["raw"]
                assert n["gain"] == pytest.approx(n["impurity"] - ((l["w0"] + l["w1"]) * l["impurity"] + (r["w0"] + r["w1"]) * r["impurity"]) / total)
    same = ce.Cells(cells.cuts, cells.bins, np.array([[9000, 1000], [8000, 2000], [7000, 3000]]))
    t = ce.grow(same, (1.0, 1.0), 5, 1, np.random.default_rng(1))
    assert len(t) == 1 and t.iloc[0]["left"] == -1  # leaves of one prediction are one
