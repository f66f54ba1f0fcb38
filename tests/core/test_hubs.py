"""Hub labels against heap searches."""

import random

import pytest

from loopwright.operators import graph, hubs

EDGES = "area string, edge int, a bigint, b bigint, length double, street string"


@pytest.mark.parametrize("first,growth", [(3, 5), (8, 8)])
def test_distances_by_hubs_are_those_of_heap_searches(spark, first, growth):
    draw = random.Random(first)
    rows = []
    grid = lambda i, j: 100 + 9 * i + j
    rows += [("grid", grid(i, j), grid(i + di, j + dj), draw.choice([1.0, 1.0, 2.5])) for i in range(9) for j in range(9) for di, dj in ((0, 1), (1, 0)) if i + di < 9 and j + dj < 9]
    rows += [("line", i, i + 1, draw.random()) for i in range(30)] + [("line", 90, 91, 3.0)]
    rows += [("star", 0, i, float(i)) for i in range(1, 20)] + [("star", 1, 1 + i % 5, 0.5) for i in range(1, 9)]
    e = spark.createDataFrame([(area, k, a, b, w, "s") for k, (area, a, b, w) in enumerate(rows) if a != b], EDGES)
    nodes = graph.ends_of(e).selectExpr("area", "node").distinct()
    want = {(r["area"], r["source"], r["node"]): round(r["metres"], 9) for r in graph.dijkstra(e, nodes.withColumnRenamed("node", "source")).collect()}
    labels = hubs.hub_labels(e, first, growth)
    pairs = nodes.withColumnRenamed("node", "a").join(nodes.withColumnRenamed("node", "b"), "area")
    got = {(r["area"], r["a"], r["b"]): round(r["metres"], 9) for r in hubs.distances(labels, pairs).collect()}
    assert got == want
    assert labels.where("area = 'star'").count() <= 20 * 8 and labels.where("area = 'grid'").count() < 81 * 40


def test_no_edges(spark):
    assert hubs.hub_labels(spark.createDataFrame([], EDGES)).collect() == []
