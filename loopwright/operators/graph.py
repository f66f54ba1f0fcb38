"""Street graph: edges, segments, components, shortest paths."""

from __future__ import annotations

import heapq


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loopwright.checkpoints import renamed, written
from loopwright.functions import geo
from loopwright.operators import joins
from loopwright.schema import UNREACHABLE


def edges(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """area, edge, a, b, length, street: consecutive nodes of ways, each pair once (the first by way and place).

    Pairs with an unknown node or with itself are no edges; the gap isn't bridged. Streets are the first way's raw names.
    """
    once = nodes.groupBy("area", "node_id").agg(F.min_by(F.struct("lat", "lon"), "ord").alias("at"))
    steps = ways.select("area", "way_ord", "name", F.posexplode(F.zip_with(F.slice("nodes", 1, F.greatest(F.size("nodes") - 1, F.lit(0))), F.expr("slice(nodes, 2, greatest(size(nodes) - 1, 0))"), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("pos", "p"))
    pairs = steps.select("area", "way_ord", "pos", "name", "p.a", "p.b").where("a <> b")
    # each undirected pair once, the first by way and place
    key = [F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")]
    firsts = pairs.select("*", *key).groupBy("area", "lo", "hi").agg(F.min_by(F.struct("a", "b", "name"), F.struct("way_ord", "pos")).alias("e"), F.min(F.struct("way_ord", "pos")).alias("place"))
    end = lambda k: once.select("area", F.col("node_id").alias(k), F.col("at").alias(f"at_{k}"))
    flat = firsts.select("area", "place", "e.a", "e.b", F.col("e.name").alias("street")).join(end("a"), ["area", "a"]).join(end("b"), ["area", "b"])
    order = Window.partitionBy("area").orderBy("place")
    return flat.select("area", (F.row_number().over(order) - 1).alias("edge"), "a", "b", geo.haversine(F.col("at_a.lat"), F.col("at_a.lon"), F.col("at_b.lat"), F.col("at_b.lon")).alias("length"), "street")


def ends_of(edge_table: DataFrame) -> DataFrame:
    """area, node, other, edge, length, street: every edge from both of its ends."""
    one = lambda x, y: edge_table.select("area", F.col(x).alias("node"), F.col(y).alias("other"), "edge", "length", "street")
    return one("a", "b").unionByName(one("b", "a"))


def components(pairs: DataFrame, vertices: DataFrame) -> DataFrame:
    """area, v, label: the least vertex of each component of undirected pairs (area, x, y); vertices alone are their own."""
    end = lambda k: F.struct("area", F.col(k).alias("v"))
    found = joins.components(pairs.select(end("x").alias("a"), end("y").alias("b"))).select("node.area", "node.v", F.col("label.v").alias("label"))
    return vertices.select("area", "v").distinct().join(found, ["area", "v"], "left").select("area", "v", F.coalesce("label", "v").alias("label"))


def node_components(nodes: DataFrame, edge_table: DataFrame) -> DataFrame:
    """area, node_id, component: numbered by the lowest node (by its ordinal) in them."""
    ids = nodes.groupBy("area", "node_id").agg(F.min("ord").alias("v"))
    at = lambda k, to: ids.select("area", F.col("node_id").alias(k), F.col("v").alias(to))
    pairs = edge_table.join(at("a", "x"), ["area", "a"]).join(at("b", "y"), ["area", "b"]).select("area", "x", "y")
    labels = components(pairs, ids)
    number = F.dense_rank().over(Window.partitionBy("area").orderBy("label")) - 1
    return ids.join(labels, ["area", "v"]).select("area", "node_id", number.alias("component"))


def segments(edge_table: DataFrame) -> DataFrame:
    """area, edge, segment, key: chains of edges that meet at nodes of degree two under one raw street name.

    Segments are numbered by their first edge. A key is 'street:lo-hi' of the chain's end nodes (of its smallest node twice,
    if it is closed); further segments with the same key get '#1', '#2' ... by their sorted edge lists.
    """
    at = ends_of(edge_table)
    met = at.groupBy("area", "node").agg(F.count("*").alias("n"), F.min("edge").alias("x"), F.max("edge").alias("y"), F.min("street").alias("s"), F.max("street").alias("t"))
    labels = components(met.where("n = 2 and x <> y and s = t").select("area", "x", "y"), edge_table.select("area", F.col("edge").alias("v")))
    own = edge_table.join(labels.withColumnRenamed("v", "edge"), ["area", "edge"])
    number = F.dense_rank().over(Window.partitionBy("area").orderBy("label")) - 1
    degrees = own.select("area", "label", F.explode(F.array("a", "b")).alias("node")).groupBy("area", "label", "node").count()
    tips = degrees.groupBy("area", "label").agg(F.min(F.when(F.col("count") != 2, F.col("node"))).alias("lo"), F.max(F.when(F.col("count") != 2, F.col("node"))).alias("hi"), F.min("node").alias("least"))
    pair = F.concat_ws("-", F.least("a", "b").cast("string"), F.greatest("a", "b").cast("string"))
    chains = own.groupBy("area", "label").agg(F.min_by("street", "edge").alias("street"), F.array_join(F.sort_array(F.collect_list(pair)), ",").alias("sig")).join(tips, ["area", "label"])
    base = F.concat(F.col("street"), F.lit(":"), F.coalesce("lo", "least").cast("string"), F.lit("-"), F.coalesce("hi", "least").cast("string"))
    turn = F.row_number().over(Window.partitionBy("area", "base").orderBy("sig")) - 1
    keyed = chains.withColumn("base", base).withColumn("turn", turn).select("area", "label", F.when(F.col("turn") == 0, F.col("base")).otherwise(F.concat("base", F.lit("#"), F.col("turn").cast("string"))).alias("key"))
    return own.join(keyed, ["area", "label"]).select("area", "edge", number.alias("segment"), "key")


def shortest_paths(edge_table: DataFrame, sources: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """area, source, node, metres of every node within reach of the sources (area, source). Relaxation rounds to a fixpoint.

    Only the nodes that came nearer in a round are relaxed in the next one.
    """
    links = written(ends_of(edge_table).groupBy("area", "node", "other").agg(F.min("length").alias("w")))
    best = written(sources.select("area", "source", F.col("source").alias("node"), F.lit(0.0).alias("metres"), F.lit(True).alias("new")).distinct())
    rounds = 0
    while max_rounds is None or rounds < max_rounds:
        rounds += 1
        reached = best.where("new").join(links, ["area", "node"]).groupBy("area", "source", F.col("other").alias("node")).agg(F.min(F.col("metres") + F.col("w")).alias("metres"))
        merged = best.select("area", "source", "node", F.col("metres").alias("old")).join(reached, ["area", "source", "node"], "full_outer")
        nearer = F.col("metres").isNotNull() & (F.col("old").isNull() | (F.col("metres") < F.col("old")))
        best = written(merged.select("area", "source", "node", F.when(nearer, F.col("metres")).otherwise(F.col("old")).alias("metres"), nearer.alias("new")))
        if best.where("new").limit(1).count() == 0:
            break
    return best.select("area", "source", "node", "metres")


def _dijkstra(near: dict[int, list[tuple[int, float]]], source: int) -> dict[int, float]:
    done, heap, best = {}, [(0.0, source)], {source: 0.0}
    while heap:
        d, v = heapq.heappop(heap)
        if v in done:
            continue
        done[v] = d
        for u, w in near.get(v, ()):
            if d + w < best.get(u, np.inf):
                best[u] = d + w
                heapq.heappush(heap, (d + w, u))
    return done


def dijkstra(edge_table: DataFrame, sources: DataFrame, chunk: int = 64) -> DataFrame:
    """As shortest_paths, by one heap search a source: each task holds one area's edges and a chunk of its sources.

    An area's graph is the unit that has to fit a task; areas with many sources are dealt to several tasks.
    """
    dealt = sources.select("area", "source").distinct().withColumn("part", F.floor((F.row_number().over(Window.partitionBy("area").orderBy("source")) - 1) / chunk).cast("int"))
    parts = dealt.groupBy("area", "part").agg(F.collect_list("source").alias("sources"))
    links = ends_of(edge_table).select("area", "node", "other", "length")
    spread = links.join(renamed(parts.select("area", "part")), "area")

    def run(key: tuple, own: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, list[tuple[int, float]]] = {}
        for v, u, w in zip(own["node"], own["other"], own["length"]):
            near.setdefault(v, []).append((u, w))
        rows = [(key[0], s, v, d) for ss in wanted["sources"] for s in ss for v, d in _dijkstra(near, s).items()]
        return pd.DataFrame(rows, columns=["area", "source", "node", "metres"])

    return spread.groupBy("area", "part").cogroup(renamed(parts).groupBy("area", "part")).applyInPandas(run, "area string, source bigint, node bigint, metres double")


def path(edge_table: DataFrame, wanted: DataFrame) -> DataFrame:
    """area, a, b, nodes: a shortest node sequence of each wanted pair (area, a, b), both ends included; empty out of reach.

    Walks back from b through the tightest edge. One task holds an area's graph.
    """

    def run(own: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, list[tuple[int, float]]] = {}
        for v, u, w in own.sort_values("edge")[["node", "other", "length"]].itertuples(index=False):
            near.setdefault(v, []).append((u, w))
        known: dict[int, dict[int, float]] = {}
        rows = []
        for area, a, b in pairs[["area", "a", "b"]].itertuples(index=False):
            d = known.setdefault(a, {}) or known.__setitem__(a, _dijkstra(near, a)) or known[a]
            found = [b] if b in d else []
            while found and found[-1] != a and len(found) <= len(near):
                cur = found[-1]
                found.append(min(((abs(d.get(u, np.inf) + w - d[cur]), k, u) for k, (u, w) in enumerate(near[cur])))[2])
            rows.append((area, a, b, found[::-1] if found and found[-1] == a else []))
        return pd.DataFrame(rows, columns=["area", "a", "b", "nodes"])

    links = ends_of(edge_table).select("area", "node", "other", "edge", "length")
    return links.groupBy("area").cogroup(renamed(wanted).groupBy("area")).applyInPandas(run, "area string, a bigint, b bigint, nodes array<bigint>")


def main_component(house_components: DataFrame) -> DataFrame:
    """area, main: the component with most houses (area, component), the lowest of equal ones."""
    sizes = house_components.groupBy("area", "component").count()
    return sizes.groupBy("area").agg(F.max_by("component", F.struct("count", -F.col("component"))).alias("main"))


def capped(metres):
    return F.least(F.coalesce(metres, F.lit(UNREACHABLE)), F.lit(UNREACHABLE))


__all__ = ["capped", "components", "dijkstra", "edges", "ends_of", "main_component", "node_components", "path", "segments", "shortest_paths"]
