"""Connected components: random graphs against union-find, and the tasks that a small graph takes."""

import random

import pytest

from flowtide.llm.components import LEAST_TASKS, connected


def union_find(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for e in edges for x in e}


def graph(kind: str) -> list[tuple[int, int]]:
    r = random.Random(kind)
    if kind == "chain":
        names = r.sample(range(-1000, 1000), 60)
        return list(zip(names, names[1:]))
    if kind == "low hub":
        return [(i, -5) for i in range(300)] * 2
    if kind == "high hub":
        return [(900, i) for i in range(300)] + [(i, i + 1000) for i in range(0, 300, 7)]
    return [(r.randrange(-300, 300), r.randrange(-300, 300)) for _ in range(260)]


@pytest.mark.parametrize("kind", ["chain", "low hub", "high hub", "random"])
def test_roots_are_the_least_reachable_nodes(spark, kind):
    edges = graph(kind)
    rows = connected(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    real = [e for e in edges if e[0] != e[1]]
    assert len(rows) == len({r["node"] for r in rows})
    assert {r["node"]: r["root"] for r in rows} == union_find(real)


def test_no_edges(spark):
    none = spark.createDataFrame([(3, 3), (None, 4)], "a long, b long")
    assert connected(none, "a", "b").collect() == []


def test_a_round_of_a_small_graph_has_few_tasks(spark):
    """Partitions held at 64: a round's tasks write for all of them, but are not as many themselves."""
    sc, group = spark.sparkContext, "tasks of connected"
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    edges = spark.createDataFrame(graph("chain"), "a long, b long").coalesce(1)
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        sc.setJobGroup(group, group)
        connected(edges, "a", "b")
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    track = sc.statusTracker()
    stages = {s for j in track.getJobIdsForGroup(group) for s in track.getJobInfo(j).stageIds}
    done = [info.numCompletedTasks for s in stages if (info := track.getStageInfo(s)) is not None]
    assert sum(n > LEAST_TASKS for n in done) <= 6  # the first edges only: reading them, their dealing, two scans
