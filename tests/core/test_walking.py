"""The nearest houses by walking against the distances of all pairs."""

import random

import pytest

from loopwright.operators import graph, neighbours, snap, walking

EDGES = "area string, edge int, a bigint, b bigint, length double, street string"
SNAPS = "area string, house_id string, edge int, along double, side int, offset double"


def town(draw, area, n_nodes, n_houses, lengths):
    """A random connected graph, with houses crowded on a few of its edges."""
    edges = [(area, i - 1, draw.randrange(i), i, draw.choice(lengths), "s") for i in range(1, n_nodes)]
    edges += [(area, len(edges) + k, *draw.sample(range(n_nodes), 2), draw.choice(lengths), "s") for k in range(n_nodes // 3)]
    edges = [(area, k, a, b, w, s) for k, (_, _, a, b, w, s) in enumerate(edges)]
    crowded = draw.sample(edges, min(4, len(edges)))
    houses = []
    for h in range(n_houses):
        e = draw.choice(crowded if draw.random() < 0.6 else edges)
        houses.append((area, f"h{h}", e[1], draw.choice([0.0, 0.5, 1.0, draw.random()]) * e[4], draw.choice([-1, 1]), draw.choice([0.0, 5.0, draw.random() * 30])))
    return edges, houses


@pytest.mark.parametrize("k,lengths", [(1, [10.0, 20.0]), (4, [10.0, 20.0, 33.3]), (8, [0.0, 7.5, 100.0])])
def test_nearest_houses_are_those_of_all_pairs(spark, k, lengths):
    draw = random.Random(k)
    edges, houses = [], []
    for area, n, m in (("a", 25, 60), ("b", 3, 12), ("c", 2, 1), ("d", 40, 5)):
        e, h = town(draw, area, n, m, lengths)
        edges, houses = edges + e, houses + h
    e, s = spark.createDataFrame(edges, EDGES), spark.createDataFrame(houses, SNAPS)
    nodes = graph.ends_of(e).selectExpr("area", "node AS source").distinct()
    dist = snap.house_distances(s, e, graph.dijkstra(e, nodes))
    want = {(r["area"], r["i"], r["rank"], r["j"]) for r in neighbours.nearest_by_metres(dist, k).collect()}
    got = {(r["area"], r["i"], r["rank"], r["j"]) for r in walking.nearest_houses(s, e, k).collect()}
    assert got == want


def test_houses_out_of_reach_and_none(spark):
    e = spark.createDataFrame([("a", 0, 1, 2, 10.0, "s"), ("a", 1, 3, 4, 10.0, "s")], EDGES)
    s = spark.createDataFrame([("a", "x", 0, 1.0, 1, 0.0), ("a", "y", 1, 1.0, 1, 0.0)], SNAPS)
    assert walking.nearest_houses(s, e, 3).collect() == []
    assert walking.nearest_houses(s.limit(0), e, 3).collect() == []
