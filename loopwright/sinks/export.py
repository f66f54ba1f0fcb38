"""Stop lists as CSV text, saved projects as JSON, boxes and overview tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loopwright.functions import text as T

# The colours of groups, in order, and of what has none.
COLOURS = ["#e6194b", "#3cb44b", "#4363d8", "#f58231", "#911eb4", "#42d4f4", "#f032e6", "#9a6324", "#008080", "#808000", "#000075", "#e6b800"]
NO_COLOUR = "#888888"
HEADER = ["group", "order", "address", "lat", "lon"]


def address(houses: DataFrame) -> Column:
    """Label, or the street (own, else that of the segment) with a remark, of houses (label, street, flagged, segment_street)."""
    known = ~F.col("flagged") & (F.coalesce("label", F.lit("")) != "") & (F.col("label") != T.NO_ADDRESS)
    blank = lambda c: F.when(F.col(c) != "", F.col(c))
    return F.when(known, F.col("label")).otherwise(F.concat(F.coalesce(blank("street"), blank("segment_street"), F.lit("unnamed street")), F.lit(f" {T.NO_ADDRESS}")))


def rows(tours: DataFrame, houses: DataFrame) -> DataFrame:
    """area, group, order (both from 1), address, lat, lon of the stops of tours (area, g, order: array of house_id)."""
    stops = tours.select("area", "g", F.posexplode("order").alias("pos", "house_id"))
    met = stops.join(houses, ["area", "house_id"])
    return met.select("area", (F.col("g") + 1).alias("group"), (F.col("pos") + 1).alias("order"), address(met).alias("address"), "lat", "lon")


def csv_lines(stop_rows: DataFrame) -> DataFrame:
    """area, csv: one text an area: header, CRLF line ends, quotes only where needed, formulas neutralised."""
    fields = [F.col("group").cast("string"), F.col("order").cast("string"), T.csv_field(T.neutralise(F.col("address"))), F.col("lat").cast("string"), F.col("lon").cast("string")]
    lines = stop_rows.select("area", F.struct("group", "order", F.concat_ws(",", *fields).alias("line")).alias("l"))
    lists = lines.groupBy("area").agg(F.sort_array(F.collect_list("l")).alias("ls"))
    return lists.select("area", F.concat(F.array_join(F.concat(F.array(F.lit(",".join(HEADER))), F.transform("ls", lambda x: x["line"])), "\r\n"), F.lit("\r\n")).alias("csv"))


def write_csv(stop_rows: DataFrame, path: str) -> None:
    """One folder an area with the CSV's text. Without a stop there is nothing to write, which is an error."""
    if stop_rows.isEmpty():
        raise ValueError("no stops to export: solve an area first")
    csv_lines(stop_rows).select("area", F.regexp_replace("csv", "\r\n$", "\r").alias("value")).write.partitionBy("area").text(path)


def project_json(projects: DataFrame) -> DataFrame:
    """area, json: saved projects; `projects` has area and the parts of the state."""
    parts = [F.col(c) for c in projects.columns if c not in ("area", "version")]
    return projects.select("area", F.to_json(F.struct(F.lit(1).alias("version"), *parts), {"ignoreNullFields": "false"}).alias("json"))


def fit_box(points: DataFrame, least_span: float = 0.002) -> DataFrame:
    """area, south, west, north, east: the points' box, each axis widened about its middle to a least span."""
    box = points.groupBy("area").agg(F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e"))

    def grown(lo: str, hi: str, sign: int) -> Column:
        end = F.col(lo) if sign < 0 else F.col(hi)
        narrow = F.col(hi) - F.col(lo) < least_span
        return F.coalesce(F.when(narrow, (F.col(lo) + F.col(hi)) / 2 + sign * least_span / 2).otherwise(end), F.lit(0.0))

    return box.select("area", grown("s", "n", -1).alias("south"), grown("w", "e", -1).alias("west"), grown("s", "n", 1).alias("north"), grown("w", "e", 1).alias("east"))


def colour(group: Column) -> Column:
    return F.when(group < 0, F.lit(NO_COLOUR)).otherwise(F.element_at(F.array(*map(F.lit, COLOURS)), (group % len(COLOURS) + 1).cast("int")))


def overview(stats: DataFrame) -> DataFrame:
    """area, name, houses, loop, time, colour, off: the overview's table. `stats` may have a column tolerance."""
    off = F.abs("delta") > F.col("tolerance") if "tolerance" in stats.columns else F.lit(None).cast("boolean")
    return stats.select("area", "g", F.concat(F.lit("Group "), (F.col("g") + 1).cast("string")).alias("name"), "houses", T.format_distance(F.col("length")).alias("loop"), F.concat(F.floor(F.col("minutes") + 0.5).cast("string"), F.lit(" min")).alias("time"), colour(F.col("g")).alias("colour"), off.alias("off"))


def stop_table(legs: DataFrame) -> DataFrame:
    """area, g, name, colour, stop (from 1), leg, walked: a group's page: its numbered stops, the way to the next one (from the last to the first) and the way so far, of legs (area, g, pos, metres)."""
    upto = F.sum("metres").over(Window.partitionBy("area", "g").orderBy("pos"))
    name = F.concat(F.lit("Group "), (F.col("g") + 1).cast("string"))
    return legs.select("area", "g", name.alias("name"), colour(F.col("g")).alias("colour"), (F.col("pos") + 1).alias("stop"), T.format_distance(F.col("metres")).alias("leg"), T.format_distance(upto).alias("walked"))


def leg_polylines(legs: DataFrame) -> DataFrame:
    """Adds `line`, the points of each leg: beside the road, across it, or along it, and straight where there is no way.

    `legs` has door_a, door_b, point_a, point_b (struct lat, lon), same_edge, same_side and nodes (points of the way, null for none).
    """
    a, b, pa, pb = (F.col(c) for c in ("door_a", "door_b", "point_a", "point_b"))
    line = F.when(F.col("same_edge") & F.col("same_side"), F.array(a, b)).when(F.col("same_edge"), F.array(a, pa, pb, b)).when(F.col("nodes").isNull(), F.array(a, b)).otherwise(F.concat(F.array(a, pa), F.col("nodes"), F.array(pb, b)))
    return legs.withColumn("line", line)


def tour_polylines(legs: DataFrame) -> DataFrame:
    """area, g, line: legs (area, g, pos, line) in order, repeated points dropped."""
    lists = legs.groupBy("area", "g").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"])).alias("all"))
    return lists.select("area", "g", F.filter("all", lambda p, i: (i == 0) | (p != F.get(F.col("all"), i - 1))).alias("line"))
