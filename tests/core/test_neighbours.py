"""Nearest neighbours on adaptive cells against brute force."""

import numpy as np
from pyspark.sql import functions as F

from loopwright.operators import neighbours, quadtree

POINTS = "area string, h bigint, x double, y double"


def brute(points, k, others=None):
    others = points if others is None else others
    found = set()
    for area, h, x, y in points:
        if x is None or y is None:
            continue
        near = sorted({(float(np.sqrt((x - ox) * (x - ox) + (y - oy) * (y - oy))), j) for a, j, ox, oy in others if a == area and j != h and ox is not None and oy is not None})
        found |= {(area, h, j, rank) for rank, (_, j) in enumerate(near[:k], 1)}
    return found


def told(df):
    rows = [(r["area"], r["h"], r["j"], r["rank"]) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def town(draw, n, m, at=(0.3, 0.7), width=1e-6):
    """n points in a small square, m all over the unit square."""
    xy = np.concatenate([np.array(at) + draw.random((n, 2)) * width, draw.random((m, 2))])
    return [("t", i, float(x), float(y)) for i, (x, y) in enumerate(xy)]


def test_nearest_is_that_of_brute_force(spark):
    """Many areas at once: a town in an empty county, a grid of ties, a line that gets ever denser, copies, a circle with its middle, a few points."""
    draw = np.random.default_rng(5)
    points = town(draw, 400, 40) + [("u", i, float(x), 5.0) for i, x in enumerate(draw.random(60))]
    points += [("g", 30 * i + j, float(i), float(j)) for i in range(20) for j in range(15)]
    points += [("l", i, 2.0**-i, -(2.0**-i)) for i in range(120)]
    points += [("c", i, 1.0, 2.0) for i in range(150)] + [("c", 500 + i, float(i % 7), float(i // 7)) for i in range(40)] + [("c", 900, None, 1.0), ("c", 901, 1.0, None)]
    points += [("one", 1, 3.0, 3.0), ("two", 1, 0.0, 0.0), ("two", 2, 1e9, -1e9), ("three", 1, 1.0, 1.0), ("three", 2, 1.0, 1.0), ("three", 3, 1.0, 1.0)]
    points += [("o", i, float(np.cos(a)), float(np.sin(a))) for i, a in enumerate(np.linspace(0, 2 * np.pi, 200, endpoint=False))] + [("o", 999, 0.0, 0.0)]
    assert told(neighbours.nearest(spark.createDataFrame(points, POINTS), 3)) == brute(points, 3)
    asking, others = [p for p in points if p[1] % 3 == 0], [p for p in points if p[1] % 3]
    assert told(neighbours.nearest(spark.createDataFrame(asking, POINTS), 2, spark.createDataFrame(others, POINTS))) == brute(asking, 2, others)


def test_points_far_from_all_others(spark):
    others = town(np.random.default_rng(1), 300, 0)
    asking = [("t", 1000 + i, float(x), float(y)) for i, (x, y) in enumerate(np.random.default_rng(2).random((40, 2)) * 100 - 50)]
    assert told(neighbours.nearest(spark.createDataFrame(asking, POINTS), 4, spark.createDataFrame(others, POINTS))) == brute(asking, 4, others)
    assert neighbours.nearest(spark.createDataFrame([], POINTS), 4).collect() == []
    assert neighbours.nearest(spark.createDataFrame(asking, POINTS), 4, spark.createDataFrame([], POINTS)).collect() == []


def test_a_town_in_an_empty_county_meets_itself_by_leaves(spark):
    """Of 10,000 points 99 % lie in a millionth of the box: leaves stay small, and a leaf meets a bounded number of others."""
    df = spark.createDataFrame(town(np.random.default_rng(3), 9_900, 100, width=1e-3), POINTS)
    k = 6
    places = quadtree._places(df, df, k)
    tree = quadtree._tree(places, 2 * (k + 1))
    depth = tree.agg(F.max("level")).first()[0]
    dealt = quadtree._dealt(places, tree, depth)
    met = quadtree._pairs(tree, dealt, depth, k).groupBy("p_id", "p_x", "p_y").agg(F.count("*").alias("boxes"), F.sum("q_n").alias("n")).agg(F.max("boxes"), F.avg("boxes"), F.max("n")).first()
    assert depth > 10 and met[0] < 200 and met[1] < 40 and met[2] < 1500
