"""Order along chains against a walk."""

import random

from pyspark.sql import functions as F

from loopwright.operators import chains, graph

EDGES = "area string, edge int, a bigint, b bigint, length double, street string"


def test_list_ranking(spark):
    draw = random.Random(2)
    items = draw.sample(range(10_000), 700)
    lists = [items[:1], items[1:3], items[3:300], items[300:700]]
    metres = {i: draw.random() for i in items}
    rows = [(i, own[k + 1] if k + 1 < len(own) else None, metres[i]) for own in lists for k, i in enumerate(own)]
    got = {r["item"]: (r["last"], r["after"], round(r["metres"], 6)) for r in chains.ranked(spark.createDataFrame(rows, "item bigint, next bigint, metres double")).collect()}
    assert got == {i: (own[-1], len(own) - 1 - k, round(sum(metres[j] for j in own[k:]), 6)) for own in lists for k, i in enumerate(own)}


def test_edges_lie_along_open_and_closed_chains(spark):
    draw = random.Random(3)

    def chain(area, nodes, closed, street, first):
        pairs = list(zip(nodes, nodes[1:] + ([nodes[0]] if closed else [])))[: len(nodes) if closed else len(nodes) - 1]
        ids = draw.sample(range(first, first + len(pairs)), len(pairs))
        return [(area, e, *(p if draw.random() < 0.5 else p[::-1]), float(draw.randint(1, 9)), street) for e, p in zip(ids, pairs)]

    rows = chain("a", draw.sample(range(100), 40), False, "s", 0) + chain("b", draw.sample(range(100), 17), True, "t", 0) + chain("c", [1, 2], False, "u", 0)
    rows += chain("d", [5, 6, 7, 8], False, "x", 0) + chain("d", [8, 9, 10], False, "y", 10) + chain("d", [8, 11, 12, 8], False, "z", 20)
    e = spark.createDataFrame(rows, EDGES)
    found = chains.along(e, graph.segments(e)).collect()
    assert len(found) == len(rows)
    lengths = {(r[0], r[1]): (r[2], r[3], r[4]) for r in rows}
    segments = {}
    for r in found:
        segments.setdefault((r["area"], r["segment"]), []).append(r)
    for (area, _), own in segments.items():
        own.sort(key=lambda r: r["place"])
        assert [r["place"] for r in own] == list(range(len(own)))
        walked, at = [], 0.0
        for r in own:
            a, b, w = lengths[area, r["edge"]]
            walked.append((a, b) if r["a_first"] else (b, a))
            assert r["start_m"] == at
            at += w
        assert all(x[1] == y[0] for x, y in zip(walked, walked[1:]))
        nodes = [n for p in walked for n in p]
        if walked[0][0] == walked[-1][1]:
            assert walked[0][0] == min(nodes) and own[0]["edge"] < own[-1]["edge"]
        else:
            assert walked[0][0] < walked[-1][1]
    assert len(segments) == 6


def test_a_long_chain_and_none(spark):
    n = 20_000
    items = spark.range(n).select(F.col("id").alias("item"), F.when(F.col("id") + 1 < n, F.col("id") + 1).alias("next"), F.lit(1.0).alias("metres"))
    assert chains.ranked(items).where(F.col("after") != n - 1 - F.col("item")).count() == 0
    e = spark.createDataFrame([], EDGES)
    assert chains.along(e, graph.segments(e)).collect() == []
