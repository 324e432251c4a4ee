"""Closures and sets along dependencies: chains, cycles, random graphs; outcomes of jobs."""

import random

import pytest
from pyspark.sql import functions as F

from brinelog.operators import products

EDGES, PIDS = "downstream long, upstream long", "pid long"


def plain(edges, seed):
    """Everything one or more steps up from a node."""
    up = {}
    for a, b in edges:
        up.setdefault(a, set()).add(b)
    seen, todo = set(), [seed]
    while todo:
        for n in up.get(todo.pop(), ()):
            if n not in seen:
                seen.add(n)
                todo.append(n)
    return seen


def test_a_chain_of_ten_thousand_edges(spark):
    chain = spark.range(10_000).select((F.col("id") + 1).alias("downstream"), F.col("id").alias("upstream"))
    seeds = spark.createDataFrame([(10_000,), (9_000,)], PIDS)
    got = products.reachable(chain, seeds)
    assert got.count() == got.distinct().count() == 10_000
    assert products.reachable(chain, seeds, up=False).agg(F.min("pid"), F.count("*")).first()[:] == (9001, 1000)
    kept = products.delete_tree(spark.range(10_001).withColumnRenamed("id", "pid"), chain, spark.createDataFrame([(9_000,)], PIDS))
    assert sorted(r.pid for r in kept.collect()) == list(range(9001, 10_001))


@pytest.mark.parametrize("seed", [3, 4])
def test_random_graphs_with_cycles_and_loops(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(90)] + [(7, 7), (200, 201), (201, 200)] + [(i + 1, i) for i in range(300, 340)]
    df = spark.createDataFrame(edges + edges[:5] + [(None, 3), (3, None)], EDGES)
    seeds = [0, 5, 7, 200, 340, 999]
    asked = spark.createDataFrame([(s,) for s in [*seeds, 5]], PIDS)
    got = sorted(map(tuple, products.ancestors(df, asked).collect()))
    assert got == sorted((s, n) for s in seeds for n in plain(edges, s))
    down = sorted(map(tuple, products.descendants(df, asked).collect()))
    assert down == sorted((s, n) for s in seeds for n in plain([(b, a) for a, b in edges], s))
    assert sorted(r.pid for r in products.reachable(df, asked).collect()) == sorted(set().union(*(plain(edges, s) for s in seeds)))


def test_no_edges_and_no_seeds(spark):
    none, some = spark.createDataFrame([], EDGES), spark.createDataFrame([(2, 1)], EDGES)
    assert products.ancestors(none, spark.createDataFrame([(1,)], PIDS)).collect() == []
    assert products.reachable(some, spark.createDataFrame([], PIDS)).collect() == []


def test_levels_are_deleted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("brinelog.session.shared_dir", lambda spark: f"file://{tmp_path}")
    chain = spark.range(100).select((F.col("id") + 1).alias("downstream"), F.col("id").alias("upstream"))
    got = products.reachable(chain, spark.createDataFrame([(100,)], PIDS))
    left = [p.name for p in tmp_path.iterdir() if p.name.startswith(("edges-", "reached-"))]
    assert len(left) == 1 and got.count() == 100


def test_outcome_by_expression_and_by_function(spark):
    jobs = spark.createDataFrame([(1, 5), (2, 50), (3, None)], "pid long, priority int")

    def work(row):
        if row["priority"] and row["priority"] > 40:
            raise ValueError("too large")

    plan = products.work_outcome(jobs, F.when(F.col("priority") > 40, "ValueError: too large"), "done")
    want = [(1, "available", "completed", "done"), (2, "error", "exception", "ValueError: too large"), (3, "available", "completed", "done")]
    assert sorted(map(tuple, plan.collect())) == want == sorted(map(tuple, products.work_outcome(jobs, work, "done").collect()))
    assert "Python" not in plan._jdf.queryExecution().toString() and "MapInPandas" not in plan._jdf.queryExecution().toString()
