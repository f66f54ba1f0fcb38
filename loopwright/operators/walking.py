"""The k nearest houses by walking, without the distances of all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loopwright.checkpoints import drop, written
from loopwright.operators.graph import ends_of
from loopwright.operators.snap import _same_edge


def _kept(labels: DataFrame, k: int) -> DataFrame:
    """Of each node's labels (area, node, house, edge, d) those that may matter: the k nearest of each edge, and of these the 2k nearest.

    Whoever stands on an edge reaches others of it along it, not through a node, so for them the labels of one edge don't count; k of an edge are then enough, and of 2k that are
    nearer, k at least count. Distances are compared as the float32 numbers that rank them, and ties stay.
    """
    at = F.col("d").cast("float")
    of_edge = F.rank().over(Window.partitionBy("area", "node", "edge").orderBy(at))
    of_node = F.rank().over(Window.partitionBy("area", "node").orderBy(at))
    return labels.withColumn("r", of_edge).where(F.col("r") <= k).withColumn("r", of_node).where(F.col("r") <= 2 * k).drop("r")


def node_labels(snaps: DataFrame, edge_table: DataFrame, k: int) -> DataFrame:
    """area, node, house, edge (of the house), d: the houses that walk to each node soonest; a search from all houses at once that keeps a bounded number of labels a node.

    Only labels that are new or nearer go on in the next round, so the rounds end with the last node that learns of one of its nearest houses.
    """
    links = written(ends_of(edge_table).groupBy("area", "node", "other").agg(F.min("length").alias("w")))
    on = snaps.join(edge_table.select("area", "edge", "a", "b", "length"), ["area", "edge"])
    door = F.explode(F.array(F.struct(F.col("a").alias("node"), (F.col("offset") + F.col("along")).alias("d")), F.struct(F.col("b").alias("node"), (F.col("offset") + F.col("length") - F.col("along")).alias("d"))))
    start = on.select("area", F.col("house_id").alias("house"), "edge", door.alias("e")).groupBy("area", "e.node", "house", "edge").agg(F.min("e.d").alias("d"))
    best = written(_kept(start, k).withColumn("new", F.lit(True)))
    while True:
        pushed = best.where("new").join(links, ["area", "node"]).select("area", F.col("other").alias("node"), "house", "edge", (F.col("d") + F.col("w")).alias("d"), F.lit(True).alias("new"))
        both = best.withColumn("new", F.lit(False)).unionByName(pushed).groupBy("area", "node", "house", "edge").agg(F.min(F.struct("d", "new")).alias("m")).select("area", "node", "house", "edge", "m.d", "m.new")
        grown = written(_kept(both, k))
        drop(best)
        best = grown
        if best.where("new").isEmpty():
            break
    drop(links)
    return best.drop("new")


def nearest_houses(snaps: DataFrame, edge_table: DataFrame, k: int, crossing_penalty: float = 8.0) -> DataFrame:
    """area, i, j, metres (float32), rank: the k nearest houses of each house by walking, then by j. Houses out of reach aren't neighbours.

    Work is in proportion to houses, nodes and k; houses of one edge meet each other.
    """
    labels = node_labels(snaps, edge_table, k)
    on = snaps.join(edge_table.select("area", "edge", "a", "b", "length"), ["area", "edge"])
    door = F.explode(F.array(F.struct(F.col("a").alias("node"), (F.col("offset") + F.col("along")).alias("leg")), F.struct(F.col("b").alias("node"), (F.col("offset") + F.col("length") - F.col("along")).alias("leg"))))
    doors = on.select("area", F.col("house_id").alias("i"), F.col("edge").alias("own"), door.alias("e")).select("area", "i", "own", "e.node", "e.leg")
    through = doors.join(labels, ["area", "node"]).where("own <> edge").groupBy("area", "i", F.col("house").alias("j")).agg(F.min(F.col("leg") + F.col("d")).alias("metres"))
    side = lambda x, h: snaps.select("area", "edge", F.col("house_id").alias(h), F.col("along").alias(f"along_{x}"), F.col("side").alias(f"side_{x}"), F.col("offset").alias(f"o{x}"))
    beside = side("a", "i").join(side("b", "j"), ["area", "edge"]).where("i <> j").select("area", "i", "j", _same_edge(F.abs(F.col("along_a") - F.col("along_b")), crossing_penalty).alias("metres"))
    both = through.unionByName(beside).withColumn("metres", F.col("metres").cast("float"))
    rank = F.row_number().over(Window.partitionBy("area", "i").orderBy("metres", "j"))
    return both.withColumn("rank", rank).where(F.col("rank") <= k).select("area", "i", "j", "metres", "rank")
