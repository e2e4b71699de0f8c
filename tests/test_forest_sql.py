"""The model keys, row by row, against SQL that descends the stored node table."""

import duckdb
import pytest

from flowtide.functions import constants as K
from flowtide.operators import ml
from flowtide.plans import catalog
from flowtide.plans import sqlforest as Q
from flowtide.plans import sqlparts as S

SF = "/root/testdata/sf0.001"
TEST = Q.model_rows("test", f"{Q.unit(K.SPLIT_SEED)} < 0.2")
SCORED = Q.descend("scored", "test", f"{S.ORDER}, congestion")


@pytest.fixture(scope="module")
def run(spark):
    """A smaller ladder, trained and stored as the registered keys do it."""
    old, K.RF_CANDIDATES[:] = list(K.RF_CANDIDATES), [{"numTrees": 20, "maxDepth": 9, "minInstancesPerNode": 2}, {"numTrees": 12, "maxDepth": 2, "minInstancesPerNode": 200}]
    path = catalog.training_run(spark, SF)
    yield path
    K.RF_CANDIDATES[:] = old


@pytest.fixture(scope="module")
def sql(run):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{SF}/lineitem.parquet'")
    con.execute(f"CREATE VIEW nodes AS SELECT * FROM '{run.removeprefix('file:')}/nodes/*.parquet'")
    con.execute(f"CREATE VIEW terms AS SELECT * FROM '{run.removeprefix('file:')}/logistic/*.parquet'")

    def rows(*parts, select):
        got = con.execute(Q.query(*parts, select=select))
        names = [c[0] for c in got.description]
        return [dict(zip(names, r)) for r in got.fetchall()]

    return rows


def _same(spark, key, want, on):
    got = [r.asDict() for r in catalog.QUERIES[key](spark, SF).collect()]
    assert len(got) == len(want) > 0
    name = lambda r: (*(str(r[c]) for c in on), round(r.get("prob") or 0.0, 4))  # noqa: E731  the four keys repeat now and then
    for a, b in zip(sorted(got, key=name), sorted(want, key=name)):
        assert set(a) == set(b)
        for c in a:
            assert a[c] == (pytest.approx(b[c], abs=1.1e-6) if isinstance(a[c], float) else b[c]), (key, c, a, b)


KEYS = [k.strip() for k in S.KEYS.split(",")]
PRED = "CAST(prob > {t} AS INTEGER) AS pred"


def test_scores_and_thresholds(spark, sql):
    one = sql(TEST, SCORED, select=f"SELECT {S.KEYS}, congestion, prob, {PRED.format(t=0.5)} FROM scored")
    _same(spark, "forest_scores", one, KEYS)
    _same(spark, "node_scores", one, KEYS)
    many = " UNION ALL ".join(f"SELECT {S.KEYS}, CAST({t} AS DOUBLE) AS threshold, prob, {PRED.format(t=t)} FROM scored" for t in (0.3, 0.5, 0.7))
    _same(spark, "thresholded_predictions", sql(TEST, SCORED, select=many), [*KEYS, "threshold"])


def test_metrics_and_gate(spark, sql):
    want = sql(TEST, SCORED, select=Q.metrics("scored"))
    _same(spark, "holdout_metrics", want, ["tp"])
    _same(spark, "metric_gate", [r | {"min_accuracy": K.MIN_ACCURACY, "passed": r["accuracy"] >= K.MIN_ACCURACY} for r in want], ["tp"])


def test_batch_scores_with_overrides(spark, sql):
    rows = Q.model_rows("every")
    over = f"""so1 AS (SELECT *, CAST(prob > 0.5 AS INTEGER) AS pred FROM scored),
so2 AS (SELECT *, CASE WHEN pred = 0 AND latency <= 50 AND packet_loss <= 0.02 THEN least(prob, 0.02) ELSE prob END AS prob0,
  greatest(CASE WHEN packet_loss >= 0.15 AND throughput <= 0.3 THEN 0.8 END, CASE WHEN packet_loss >= 0.5 THEN 0.95 WHEN packet_loss >= 0.3 THEN 0.8 END,
           CASE WHEN latency >= 3000 AND packet_loss >= 0.2 THEN 0.95 END) AS floor FROM so1 JOIN every USING ({S.ORDER}))"""
    select = f"SELECT {S.KEYS}, prob, pred, CASE WHEN floor IS NULL THEN prob0 ELSE greatest(prob0, floor) END AS final_prob, CASE WHEN floor IS NULL THEN pred ELSE 1 END AS final_pred FROM so2"
    _same(spark, "score_batch", sql(rows, Q.descend("scored", "every", S.ORDER), over, select=select), KEYS)


def test_importance_and_floors(spark, sql):
    got = {K.FEATURES[r["feature"]]: r["importance"] for r in sql(select=Q.importance())}
    ranked = sorted(K.FEATURES, key=lambda f: -got.get(f, 0.0))
    _same(spark, "feature_importance", [{"feature": f, "importance": got.get(f, 0.0), "rank": i + 1} for i, f in enumerate(ranked)], ["feature"])
    floors = [{"feature": f, "importance": got.get(f, 0.0), "floor": K.MIN_IMPORTANCE[f], "ok": got.get(f, 0.0) >= K.MIN_IMPORTANCE[f]} for f in K.FEATURES]
    _same(spark, "importance_floors", floors, ["feature"])
    from flowtide.operators.forest import node_importance

    own = node_importance(ml.run_nodes(spark, catalog.training_run(spark, SF))).collect()
    assert {r["feature"]: r["importance"] for r in own} == pytest.approx({f: got.get(f, 0.0) for f in K.FEATURES})


def test_probes(spark, sql):
    values = ", ".join(f"('{n}', {a}, {b}, {c})" for n, a, b, c in K.PROBES)
    probes = f"probes AS (SELECT scenario, CAST(latency AS DOUBLE) AS latency, CAST(throughput AS DOUBLE) AS throughput, CAST(packet_loss AS DOUBLE) AS packet_loss FROM (VALUES {values}) p(scenario, latency, throughput, packet_loss))"
    rows = sql(probes, Q.descend("scored", "probes", "scenario"), select="SELECT * FROM probes JOIN scored USING (scenario)")
    base = next(r["prob"] for r in rows if r["scenario"] == "healthy")
    for r in rows:
        r["pred"], r["delta_from_healthy"] = int(r["prob"] > 0.5), r["prob"] - base
        r["ok"] = {
            "high_latency": r["delta_from_healthy"] >= K.MIN_PROBABILITY_DELTA["latency"],
            "high_packet_loss": r["delta_from_healthy"] >= K.MIN_PROBABILITY_DELTA["packet_loss"],
            "healthy": r["pred"] == 0,
            "combined_failure": r["pred"] == 1,
        }.get(r["scenario"])
    _same(spark, "sensitivity_report", rows, ["scenario"])


def test_ladder(spark, sql):
    """Every candidate's metrics on the validation rows and its importances."""
    want = []
    valid = Q.model_rows("valid", f"{Q.unit(K.SPLIT_SEED)} >= 0.2 AND {Q.unit(K.MODEL_SEED)} < 0.2")
    for i, p in enumerate(K.RF_CANDIDATES):
        m = sql(valid, Q.descend("scored", "valid", f"{S.ORDER}, congestion", i), select=Q.metrics("scored"))[0]
        imp = {K.FEATURES[r["feature"]]: r["importance"] for r in sql(select=Q.importance(i))}
        row = {"candidate": i, "num_trees": p["numTrees"], "max_depth": p["maxDepth"], "min_instances": p["minInstancesPerNode"]}
        want.append(row | {k: m[k] for k in ("accuracy", "precision", "recall", "f1")} | {f"importance_{f}": imp.get(f, 0.0) for f in K.FEATURES})
        if m["accuracy"] <= K.ACCURACY_BAND[1]:
            break
    _same(spark, "candidate_report", want, ["candidate"])


def test_logistic(spark, sql):
    z = "intercept + coefficient_latency * latency + coefficient_throughput * throughput + coefficient_packet_loss * packet_loss"
    p = f"lo AS (SELECT *, 1 / (1 + exp(-({z}))) AS prob FROM test, terms)"
    imp = ", ".join(f"importance_{c}" for c in K.FEATURES)
    _same(spark, "logistic_scores", sql(TEST, p, select=f"SELECT {S.KEYS}, prob, {PRED.format(t=0.5)}, {imp} FROM lo"), KEYS)


def test_attribution(spark, sql):
    """Shapley values from eight descents of every row."""
    masks = [f"{a}{b}{c}" for a in (0, 1) for b in (0, 1) for c in (0, 1)]
    mean = "bg AS (SELECT avg(latency) AS bl, avg(throughput) AS bt, avg(packet_loss) AS bp FROM feat)"
    pick = lambda m, i, c, b: c if m[i] == "1" else f"{b} AS {c}"
    eight = "eight AS (" + " UNION ALL ".join(f"SELECT {S.ORDER}, '{m}' AS mask, {pick(m, 0, 'latency', 'bl')}, {pick(m, 1, 'throughput', 'bt')}, {pick(m, 2, 'packet_loss', 'bp')} FROM test, bg" for m in masks) + ")"
    wide = f"wide AS (SELECT {S.ORDER}, " + ", ".join(f"max(prob) FILTER (WHERE mask = '{m}') AS v{m}" for m in masks) + f" FROM scored GROUP BY {S.ORDER})"
    phi = {
        "latency": "(v100 - v000) / 3 + (v110 - v010) / 6 + (v101 - v001) / 6 + (v111 - v011) / 3",
        "throughput": "(v010 - v000) / 3 + (v110 - v100) / 6 + (v011 - v001) / 6 + (v111 - v101) / 3",
        "packet_loss": "(v001 - v000) / 3 + (v101 - v100) / 6 + (v011 - v010) / 6 + (v111 - v110) / 3",
    }
    select = f"SELECT {S.KEYS}, " + ", ".join(f"{e} AS phi_{c}" for c, e in phi.items()) + ", v000 AS base_value, v111 AS f_x FROM wide"
    local = sql(TEST, mean, eight, Q.descend("scored", "eight", f"{S.ORDER}, mask"), wide, select=select)
    _same(spark, "model_local_attribution", local, KEYS)
    share = {c: sum(abs(r[f"phi_{c}"]) for r in local) / len(local) for c in K.FEATURES}
    ranked = sorted(K.FEATURES, key=lambda c: (-share[c], c))
    _same(spark, "model_global_attribution", [{"feature": c, "mean_abs_attribution": share[c], "rank": i + 1} for i, c in enumerate(ranked)], ["feature"])
