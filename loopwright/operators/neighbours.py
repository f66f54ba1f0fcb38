"""Nearest neighbours, links that cross groups, adoption by the nearest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loopwright.operators import quadtree
from loopwright.schema import COMPACT_K


def nearest(points: DataFrame, k: int = COMPACT_K, others: DataFrame | None = None) -> DataFrame:
    """area, h, j, d, rank: the k nearest others (area, h, x, y; else the points themselves) of each point, by distance, then by j; see quadtree."""
    return quadtree.nearest(points, k, others)


def nearest_by_metres(dist: DataFrame, k: int) -> DataFrame:
    """area, i, j, rank: the k nearest houses by walking distance (area, i, j, metres), then by j."""
    rank = F.row_number().over(Window.partitionBy("area", "i").orderBy("metres", "j"))
    return dist.where("i <> j").withColumn("rank", rank).where(F.col("rank") <= k).select("area", "i", "j", "rank")


def segment_mates(placed: DataFrame, dist: DataFrame) -> DataFrame:
    """area, i, j, rank: the other houses of a house's segment (area, house_id, segment) by walking distance (area, i, j, metres), then by j."""
    side = lambda h, s: placed.select("area", F.col("house_id").alias(h), F.col("segment").alias(s))
    met = dist.where("i <> j").join(side("i", "si"), ["area", "i"]).join(side("j", "sj"), ["area", "j"]).where("si = sj")
    rank = F.row_number().over(Window.partitionBy("area", "i").orderBy("metres", "j"))
    return met.select("area", "i", "j", "metres", rank.alias("rank"))


def cut_links(links: DataFrame, assignment: DataFrame) -> DataFrame:
    """area, links, cut: directed links (area, h, j) and those between two groups (area, h, g)."""
    met = _grouped(links, assignment)
    return met.groupBy("area").agg(F.count("*").alias("links"), F.count_if(F.col("g") != F.col("gj")).alias("cut"))


def _grouped(links: DataFrame, assignment: DataFrame) -> DataFrame:
    g = assignment.select("area", "h", "g")
    return links.select("area", "h", "j").join(g, ["area", "h"]).join(g.select("area", F.col("h").alias("j"), F.col("g").alias("gj")), ["area", "j"])


def cut_delta(links: DataFrame, assignment: DataFrame, moves: DataFrame) -> DataFrame:
    """area, delta: change of the cut by moves (area, h, to), over the links that touch a moved point, each once."""
    to = moves.groupBy("area", "h").agg(F.max("to").alias("to"))
    met = _grouped(links, assignment).join(to, ["area", "h"], "left").join(to.select("area", F.col("h").alias("j"), F.col("to").alias("to_j")), ["area", "j"], "left")
    touched = met.where(F.col("to").isNotNull() | F.col("to_j").isNotNull())
    after = F.coalesce("to", "g") != F.coalesce("to_j", "gj")
    return touched.groupBy("area").agg(F.sum(after.cast("long") - (F.col("g") != F.col("gj")).cast("long")).alias("delta"))


def adopt_nearest(assignment: DataFrame, dist: DataFrame, groups: int) -> DataFrame:
    """area, h, g, changed: unassigned points take the group of their nearest point that was assigned from the start (then the least).

    An area where nothing is assigned is left alone.
    """
    valid = F.col("g").between(0, groups - 1)
    anchors = assignment.where(valid).select("area", F.col("h").alias("j"), F.col("g").alias("gj"))
    lost = assignment.where(~F.coalesce(valid, F.lit(False))).select("area", "h")
    met = lost.join(dist.select("area", F.col("i").alias("h"), "j", "metres"), ["area", "h"]).join(anchors, ["area", "j"])
    found = met.groupBy("area", "h").agg(F.min_by("gj", F.struct("metres", "j")).alias("adopted"))
    return assignment.join(found, ["area", "h"], "left").select("area", "h", F.coalesce("adopted", "g").alias("g"), F.col("adopted").isNotNull().alias("changed"))


def adopt_spatial(points: DataFrame, groups: int) -> DataFrame:
    """area, h, g, changed: as adopt_nearest(), by the plane distance of points (area, h, x, y, g)."""
    valid = F.coalesce(F.col("g").between(0, groups - 1), F.lit(False))
    anchors = points.where(valid)
    found = nearest(points.where(~valid), 1, anchors).join(anchors.select("area", F.col("h").alias("j"), F.col("g").alias("adopted")), ["area", "j"]).select("area", "h", "adopted")
    return points.join(found, ["area", "h"], "left").select("area", "h", F.coalesce("adopted", "g").alias("g"), F.col("adopted").isNotNull().alias("changed"))
