"""Shortest distances by hub labels: a table that says of each node how far it is to some hubs, such that any two nodes share one on a shortest way.

Nodes are ranked by degree, then by hash. Batches of hubs, each `growth` times as large as the one before, search the graph in relaxation rounds, all hubs of a batch at once. A node
that earlier hubs already tell the distance to isn't labelled and isn't gone through, so later searches end near where they began. Labels that an earlier hub of the same batch makes needless are
dropped after it. Of the hubs on shortest ways between two nodes, one of the first batch among them is in the labels of both, which is why the least sum over common hubs is the distance.

Scale: no area's graph is in a task; rounds are joins on (area, node) and (area, node, hub). Labels a node are few where the graph has a hierarchy, and about the root of the
number of nodes on a plain grid. Rounds are the hops of the widest search of each batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loopwright.checkpoints import drop, written
from loopwright.operators.graph import ends_of
from loopwright.operators.numbering import placed

FIRST, GROWTH = 8, 8


def _batches(links: DataFrame, first: int, growth: int) -> DataFrame:
    """area, node, pos (rank from 0), batch of each node."""
    order = links.groupBy("area", "node").agg((-F.count("*")).alias("fewer"), F.xxhash64("node").alias("mixed"))
    at = placed(written(order), ["area", "fewer", "mixed", "node"])
    starts = at.groupBy(F.col("area").alias("a")).agg(F.min("at").alias("first"))
    pos = F.col("at") - F.col("first")
    batch, size, upto = F.lit(0), first, first
    for _ in range(14):
        batch = batch + F.when(pos >= upto, 1).otherwise(0)
        size *= growth
        upto += size
    return written(at.join(starts, F.col("area") == F.col("a")).select("area", "node", pos.alias("pos"), batch.alias("batch")))


def _told(found: DataFrame, labels: DataFrame, slack: float = 1e-12) -> DataFrame:
    """a, h, n: those of found (area, hub, v, d, pos) whose distance common hubs before theirs (labels: area, v, hub, d, pos) tell as well or better."""
    at = labels.select(F.col("area").alias("va"), F.col("v").alias("vv"), F.col("hub").alias("x"), F.col("d").alias("dv"), F.col("pos").alias("px"))
    of = labels.select(F.col("area").alias("ha"), F.col("v").alias("hv"), F.col("hub").alias("hx"), F.col("d").alias("dh"))
    met = found.join(at, (F.col("area") == F.col("va")) & (F.col("v") == F.col("vv"))).where("px < pos")
    both = met.join(of, (F.col("area") == F.col("ha")) & (F.col("hub") == F.col("hv")) & (F.col("x") == F.col("hx")))
    return both.where(F.col("dv") + F.col("dh") <= F.col("d") * (1 + slack)).select(F.col("area").alias("a"), F.col("hub").alias("h"), F.col("v").alias("n")).distinct()


def _without(found: DataFrame, told: DataFrame) -> DataFrame:
    return found.join(told, (F.col("area") == F.col("a")) & (F.col("hub") == F.col("h")) & (F.col("v") == F.col("n")), "left_anti")


def hub_labels(edge_table: DataFrame, first: int = FIRST, growth: int = GROWTH) -> DataFrame:
    """area, v, hub, d, pos: node v is d metres from a hub, which has rank pos. Nodes without edges have no labels."""
    links = written(ends_of(edge_table).groupBy("area", "node", "other").agg(F.min("length").alias("w")))
    hubs = _batches(links, first, growth)
    labels = None
    for batch in range((hubs.agg(F.max("batch")).first()[0] or 0) + 1):
        best = written(hubs.where(F.col("batch") == batch).select("area", F.col("node").alias("hub"), F.col("node").alias("v"), F.lit(0.0).alias("d"), "pos", F.lit(True).alias("new")))
        while True:
            pushed = best.where("new").join(links, (best["area"] == links["area"]) & (F.col("v") == F.col("node"))).select(best["area"], "hub", F.col("other").alias("v"), (F.col("d") + F.col("w")).alias("d"), "pos")
            known = best.select(F.col("area").alias("a"), F.col("hub").alias("h"), F.col("v").alias("n"), F.col("d").alias("old"))
            nearer = pushed.groupBy("area", "hub", "v", "pos").agg(F.min("d").alias("d")).join(known, (F.col("area") == F.col("a")) & (F.col("hub") == F.col("h")) & (F.col("v") == F.col("n")), "left").where("old is null or d < old").select("area", "hub", "v", "d", "pos")
            if labels is not None:
                nearer = written(nearer)
                kept = _without(nearer, _told(nearer, labels))
            else:
                kept = nearer
            both = best.withColumn("new", F.lit(False)).unionByName(kept.withColumn("new", F.lit(True)))
            grown = written(both.groupBy("area", "hub", "v", "pos").agg(F.min(F.struct("d", "new")).alias("m")).select("area", "hub", "v", "m.d", "pos", "m.new"))
            drop(best, nearer)
            best = grown
            if best.where("new").isEmpty():
                break
        found = best.select("area", "v", "hub", "d", "pos")
        left = _without(found, _told(found, found))
        grown = written(left.select("area", "v", "hub", "d", "pos") if labels is None else labels.unionByName(left.select("area", "v", "hub", "d", "pos")))
        drop(best)
        if labels is not None:
            drop(labels)
        labels = grown
    drop(links, hubs)
    return labels


def distances(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """area, a, b, metres of pairs (area, a, b) within reach of each other: the least sum over the hubs that both are labelled with."""
    side = lambda c, d: labels.select(F.col("area").alias(f"area_{c}"), F.col("v").alias(f"v_{c}"), F.col("hub").alias(f"hub_{c}"), F.col("d").alias(d))
    same: Column = (F.col("area") == F.col("area_b")) & (F.col("b") == F.col("v_b")) & (F.col("hub_a") == F.col("hub_b"))
    met = pairs.select("area", "a", "b").distinct().join(side("a", "da"), (F.col("area") == F.col("area_a")) & (F.col("a") == F.col("v_a"))).join(side("b", "db"), same)
    return met.groupBy("area", "a", "b").agg(F.min(F.col("da") + F.col("db")).alias("metres"))
