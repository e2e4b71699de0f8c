"""Fits that go on side by side: the ladder's order, its stop and what is given up."""

import threading
import time
from types import SimpleNamespace

import numpy as np
import pytest

from flowtide.operators import ml


def stub(monkeypatch, accuracies, meet):
    """Fits that need no rows; the first two end only once both have begun."""
    begun = []

    def fit(train, params, target):
        begun.append(params["numTrees"])
        if len(begun) <= 2:
            meet.wait(timeout=30)
        return SimpleNamespace(n=params["numTrees"], featureImportances=SimpleNamespace(toArray=lambda: np.zeros(3)))

    monkeypatch.setattr(ml, "fit_forest", fit)
    monkeypatch.setattr(ml, "evaluate", lambda model, valid, target: dict.fromkeys(("accuracy", "precision", "recall", "f1"), accuracies[model.n]))
    return begun


@pytest.mark.parametrize("accuracies, chosen", [([1.0, 1.0, 0.9, 0.8], 2), ([0.9, 0.8, 0.7, 0.6], 0), ([1.0, 1.0, 1.0, 1.0], 3)])
def test_ladder_fits_two_at_once_and_keeps_its_order(spark, monkeypatch, accuracies, chosen):
    begun = stub(monkeypatch, accuracies, threading.Barrier(2))
    candidates = [{"numTrees": i, "maxDepth": 1, "minInstancesPerNode": 1} for i in range(4)]
    params, models, report = ml.candidate_ladder(spark.range(1), None, candidates)
    assert params == candidates[chosen]
    assert [m.n for m in models] == list(range(chosen + 1)) == [r[0] for r in report]
    assert [r[4] for r in report] == accuracies[: chosen + 1]
    assert len(begun) == len(set(begun)) >= 2


def test_what_is_not_needed_is_cancelled(spark):
    def slow():
        return spark.range(0, 1, 1, 1).rdd.map(lambda r: time.sleep(40)).count()

    t = time.time()
    with ml.side_by_side(spark) as start:
        first, second, third = start(spark.range(10).count), start(slow), start(slow)
        assert first.result() == 10
    assert time.time() - t < 35
    assert second.cancelled() or second.exception() is not None
    assert third.cancelled() or third.exception() is not None
    assert spark.range(5).count() == 5  # other jobs go on


def test_a_failed_call_is_raised(spark):
    with pytest.raises(ZeroDivisionError), ml.side_by_side(spark) as start:
        start(lambda: 1 // 0).result()
