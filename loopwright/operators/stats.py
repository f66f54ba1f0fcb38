"""Statistics of groups, loops and streets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loopwright.functions.geo import in_hull
from loopwright.functions.text import eval_norm, normalize_street
from loopwright.schema import COMPACT_SPACING_M, SIZE_SOFT_M, Weights


def all_groups(df: DataFrame, groups: int) -> DataFrame:
    """area, g of every group of every area of df."""
    return df.select("area").distinct().select("area", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))


def members(assignment: DataFrame, groups: int) -> DataFrame:
    """area, g, members: ordered houses of every group, the empty ones too; groups out of range are left out."""
    lists = assignment.groupBy("area", "g").agg(F.sort_array(F.collect_list("h")).alias("m"))
    empty = F.array().cast(lists.schema["m"].dataType)
    return all_groups(assignment, groups).join(lists, ["area", "g"], "left").select("area", "g", F.coalesce("m", empty).alias("members"))


def tour_legs(stops: DataFrame, columns: list[str]) -> DataFrame:
    """Stops (area, g, pos, ...) each with its next stop's columns (prefixed n_), the last with the first's."""
    order = Window.partitionBy("area", "g").orderBy("pos")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nexts = [F.when(F.lead("pos").over(order).isNull(), F.first(c).over(whole)).otherwise(F.lead(c).over(order)).alias(f"n_{c}") for c in columns]
    return stops.select("*", *nexts, F.count("*").over(whole).alias("n_stops"))


def tour_lengths(stops: DataFrame, dist: DataFrame) -> DataFrame:
    """area, g, length: closed loops over stops (area, g, pos, h); one stop alone has none."""
    legs = tour_legs(stops, ["h"]).where("n_stops > 1")
    met = legs.join(dist.select("area", F.col("i").alias("h"), F.col("j").alias("n_h"), "metres"), ["area", "h", "n_h"])
    lengths = met.groupBy("area", "g").agg(F.sum(F.col("metres").cast("double")).alias("length"))
    return stops.select("area", "g").distinct().join(lengths, ["area", "g"], "left").select("area", "g", F.coalesce("length", F.lit(0.0)).alias("length"))


def rotate_tours(stops: DataFrame, dist: DataFrame) -> DataFrame:
    """The stops with `pos` counted from the one after the longest leg (the first of equal ones); tours under three stops as they are."""
    legs = tour_legs(stops, ["h"]).join(dist.select("area", F.col("i").alias("h"), F.col("j").alias("n_h"), "metres"), ["area", "h", "n_h"], "left")
    longest = legs.groupBy("area", "g").agg(F.max_by("pos", F.struct("metres", -F.col("pos"))).alias("last"), F.first("n_stops").alias("n"))
    pos = F.when(F.col("n") < 3, F.col("pos")).otherwise(F.pmod(F.col("pos") - F.col("last") - 1, F.col("n").cast("int")))
    return stops.join(longest, ["area", "g"]).select("area", "g", pos.alias("pos"), "h")


def street_changes(stops: DataFrame) -> DataFrame:
    """area, g, changes: changes of the canonical street along each closed loop of stops (area, g, pos, street)."""
    named = stops.withColumn("name", normalize_street(F.col("street")))
    legs = tour_legs(named.select("area", "g", "pos", "name"), ["name"])
    changed = F.when(F.col("n_stops") >= 2, (F.col("name") != F.col("n_name")).cast("long")).otherwise(F.lit(0))
    return legs.groupBy("area", "g").agg(F.sum(changed).alias("changes"))


def group_stats(assignment: DataFrame, lengths: DataFrame, groups: int, walk_speed: float = 1.2, sec_per_house: float = 20.0, changes: DataFrame | None = None) -> DataFrame:
    """area, g, houses, length, minutes, delta (from the mean size), street_changes (-1: unknown) of every group."""
    sizes = assignment.where(F.col("g").between(0, groups - 1)).groupBy("area", "g").agg(F.count("*").alias("houses"))
    df = all_groups(assignment, groups).join(sizes, ["area", "g"], "left").join(lengths.select("area", "g", "length"), ["area", "g"], "left")
    df = df.select("area", "g", F.coalesce("houses", F.lit(0)).alias("houses"), F.coalesce("length", F.lit(0.0)).alias("length"))
    minutes = (F.col("length") / walk_speed + F.col("houses") * sec_per_house) / 60
    df = df.select("*", minutes.alias("minutes"), (F.col("houses") - F.avg("houses").over(Window.partitionBy("area"))).alias("delta"))
    if changes is None:
        return df.withColumn("street_changes", F.lit(-1).cast("long"))
    return df.join(changes.select("area", "g", F.col("changes").alias("street_changes")), ["area", "g"], "left").fillna({"street_changes": -1})


def off_balance(stats: DataFrame, tolerance: Column) -> DataFrame:
    """area, g, houses, delta of the first group of each area that is off by more than the tolerance."""
    off = stats.where(F.abs("delta") > tolerance)
    return off.groupBy("area").agg(F.min(F.struct("g", "houses", "delta")).alias("f")).select("area", "f.*")


def split_streets(houses: DataFrame) -> DataFrame:
    """area, split, streets: canonical streets in more than one group, and all, of houses (area, street, g >= 0)."""
    named = houses.where("g >= 0").withColumn("name", normalize_street(F.col("street"))).where("name <> ''")
    each = named.groupBy("area", "name").agg(F.count_distinct("g").alias("n"))
    return each.groupBy("area").agg(F.count_if(F.col("n") > 1).alias("split"), F.count("*").alias("streets"))


def selection_summary(selected: DataFrame, assignment: DataFrame, groups: int) -> DataFrame:
    """area, g, n: how many selected (area, h) are in each group; g -1: in none."""
    met = selected.join(assignment, ["area", "h"], "left").select("area", F.when(F.col("g").between(0, groups - 1), F.col("g")).otherwise(F.lit(-1)).alias("g"))
    counts = met.groupBy("area", "g").agg(F.count("*").alias("n"))
    every = selected.select("area").distinct().select("area", F.explode(F.sequence(F.lit(-1), F.lit(groups - 1))).alias("g"))
    return every.join(counts, ["area", "g"], "left").select("area", "g", F.coalesce("n", F.lit(0)).alias("n"))


def majority_groups(houses: DataFrame) -> DataFrame:
    """area, segment, g: the group with most houses (area, segment, ord, g), of equal ones the first seen; -1 where none is assigned."""
    votes = houses.groupBy("area", "segment", "g").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    best = F.max_by("g", F.when(F.col("g") >= 0, F.struct("n", -F.col("first"))))
    return votes.groupBy("area", "segment").agg(F.coalesce(best, F.lit(-1)).alias("g"))


def objective(stats: DataFrame, cut: DataFrame, weights: Weights = Weights()) -> DataFrame:
    """area, score, spread, violation, objective from group_stats() rows and cut_links() rows."""
    over = F.greatest(F.lit(0.0), F.abs("delta") - _tolerance(F.avg("houses").over(Window.partitionBy("area")), weights))
    sums = stats.withColumn("over", over).groupBy("area").agg((weights.maxRoute * F.max("length") + weights.total * F.sum("length")).alias("score"), F.sum(F.abs("delta")).alias("spread"), F.sum("over").alias("violation"))
    met = sums.join(cut.select("area", "cut"), "area", "left").withColumn("cut", F.coalesce("cut", F.lit(0)))
    return met.select("area", "score", "spread", "violation", (F.col("score") + weights.compact * COMPACT_SPACING_M * F.col("cut") + SIZE_SOFT_M * F.col("spread")).alias("objective"))


def _tolerance(mean: Column, weights: Weights) -> Column:
    return F.greatest(F.lit(float(max(0.0, weights.tolerance))), F.floor(F.lit(float(max(0.0, weights.toleranceFrac))) * F.greatest(mean, F.lit(0.0))).cast("double"))


def hull_overlap(points: DataFrame, hulls: DataFrame) -> DataFrame:
    """area, overlap: over ordered pairs of groups, the share of one's points (area, g, x, y) inside the other's hull (area, g, hull)."""
    other = hulls.select("area", F.col("g").alias("b"), "hull")
    met = points.join(other, "area").where("g <> b")
    each = met.groupBy("area", "g", "b").agg(F.avg(in_hull(F.col("hull"), F.col("x"), F.col("y")).cast("double")).alias("share"))
    sums = each.groupBy("area").agg(F.sum("share").alias("overlap"))
    return points.select("area").distinct().join(sums, "area", "left").select("area", F.coalesce("overlap", F.lit(0.0)).alias("overlap"))


def centroids(points: DataFrame) -> DataFrame:
    """area, g, x, y: the mean of each group's points (area, g, x, y)."""
    return points.groupBy("area", "g").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


def regrets(points: DataFrame, centres: DataFrame) -> DataFrame:
    """area, h, nearest, regret: each point's nearest centre (the least of equal ones) and how much farther the next one is; null where there is one centre only.

    An area's centres are an array of one row, which meets all points of the area.
    """
    listed = centres.groupBy("area").agg(F.collect_list(F.struct("g", "x", "y")).alias("centres"))
    own = points.select("area", "h", F.col("x").alias("px"), F.col("y").alias("py")).join(listed, "area")
    far = F.array_sort(F.transform("centres", lambda c: F.struct(F.sqrt((F.col("px") - c["x"]) * (F.col("px") - c["x"]) + (F.col("py") - c["y"]) * (F.col("py") - c["y"])).alias("d"), c["g"].alias("g"))))
    return own.select("area", "h", far.alias("far")).select("area", "h", F.col("far")[0]["g"].alias("nearest"), (F.get("far", F.lit(1))["d"] - F.col("far")[0]["d"]).alias("regret"))


def valid_start(houses: DataFrame, assignment: DataFrame, groups: int) -> DataFrame:
    """area, valid: whether an assignment (area, h, g) can start a solve: every house of the area (area, h) has a group in range, and every group a house."""
    met = houses.select("area", "h").join(assignment.select("area", "h", "g"), ["area", "h"], "left")
    good = F.bool_and(F.coalesce(F.col("g").between(0, groups - 1), F.lit(False)))
    return met.groupBy("area").agg((good & (F.count_distinct("g") == groups)).alias("valid"))


def warnings(houses: DataFrame, cut_off: DataFrame) -> DataFrame:
    """area, flagged, disconnected: counts to warn of."""
    lost = cut_off.groupBy("area").agg(F.count("*").alias("disconnected"))
    return houses.groupBy("area").agg(F.count_if("flagged").alias("flagged")).join(lost, "area", "left").fillna({"disconnected": 0})


def evaluation(houses: DataFrame) -> DataFrame:
    """area and the figures of a solution, from houses (area, street, g, segment, offset, edge_street)."""
    named = houses.withColumn("name", eval_norm(F.col("street"))).withColumn("edge_name", eval_norm(F.col("edge_street")))
    streets = named.groupBy("area", "name").agg(F.count_distinct("g").alias("k"), F.count("*").alias("n"))
    by_street = streets.groupBy("area").agg(F.count("*").alias("streets"), F.count_if(F.col("k") > 1).alias("split_streets"), F.coalesce(F.sum(F.when(F.col("k") > 1, F.col("n"))), F.lit(0)).alias("split_street_houses"))
    by_segment = named.groupBy("area", "segment").agg(F.count_distinct("g").alias("k")).groupBy("area").agg(F.count("*").alias("segments"), F.count_if(F.col("k") > 1).alias("split_segments"))
    sums = named.groupBy("area").agg(F.count("*").alias("houses"), F.avg("offset").alias("mean_offset"), F.avg((F.col("name") != F.col("edge_name")).cast("double")).alias("wrong_rate"), F.count_if(F.col("edge_street") == "").alias("unnamed"))
    return sums.join(by_street, "area").join(by_segment, "area")
