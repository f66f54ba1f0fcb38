"""Queries that put the readers, parsers, sinks and the edit log to work on documents built from the star-schema tables."""

from __future__ import annotations

import atexit
import json
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from loopwright.checkpoints import remove, shared_dir, written
from loopwright.functions import text as T
from loopwright.operators import edits, graph, stats
from loopwright.plans import views as V
from loopwright.plans.registry import ORACLE_SQL, registered, rounded
from loopwright.schema import ELEMENTS, FEATURES
from loopwright.sinks import export, stoplists
from loopwright.sources import elements, houses, project, remote


def _json(df, name: str, kind: str, items):
    """area and a column of nested rows that went through JSON text; `items` are structs in the order of `ord`."""
    in_order = lambda a, b: F.when(a["ord"] < b["ord"], -1).when(a["ord"] > b["ord"], 1).otherwise(0)
    lists = df.select("area", F.struct("ord", items.alias("x")).alias("e")).groupBy("area").agg(F.array_sort(F.collect_list("e"), in_order).alias("es"))
    return lists.select("area", F.from_json(F.to_json(F.transform("es", lambda e: e["x"])), kind).alias(name))


def _element(kind: str, ident, lat=None, lon=None, nodes=None, tags=None):
    none = F.lit(None)
    return F.struct(
        F.lit(kind).alias("type"), ident.cast("bigint").alias("id"), (none.cast("double") if lat is None else lat).alias("lat"), (none.cast("double") if lon is None else lon).alias("lon"),
        (none.cast("array<bigint>") if nodes is None else nodes).alias("nodes"), (none.cast("map<string,string>") if tags is None else tags).alias("tags"),
    )


def _tags(**values):
    return F.map_filter(F.create_map(*[x for k, v in values.items() for x in (F.lit(k.replace("_", ":")), v)]), lambda _, v: v.isNotNull())


@registered("""SELECT g AS way_id, row_number() OVER (PARTITION BY g ORDER BY min(pos)) - 1 AS way_ord, arg_min(h, pos) AS first, arg_max(h, pos) AS last, count(*) AS stops FROM (
  SELECT g, pos, h, street, sum((street = 'click')::INT) OVER (PARTITION BY g ORDER BY pos) AS island FROM stops) WHERE street <> 'click' GROUP BY g, island HAVING count(*) >= 2""", V.STOPS_SQL)
def parse_ways(spark, sf_dir):
    """Each user's events as a way over nodes of which the clicks are missing: it is split there, and pieces of two nodes and more stay."""
    s = V.stops(spark, sf_dir).select(F.col("g").cast("string").alias("area"), F.col("g").alias("way"), "pos", "h", "street")
    nodes = s.where("street <> 'click'").select("area", F.col("pos").alias("ord"), _element("node", F.col("h"), F.col("pos") * 1e-4 + 42, F.lit(-88.3)).alias("x"))
    whole = s.groupBy("area", "way").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "h"))), lambda x: x["h"]).alias("nodes"))
    ways = whole.select("area", F.lit(1 << 30).alias("ord"), _element("way", F.col("way"), nodes=F.col("nodes"), tags=_tags(highway=F.lit("path"))).alias("x"))
    bodies = _json(nodes.unionByName(ways), "elements", ELEMENTS, F.col("x"))
    got = elements.parse_elements(bodies)["ways"]
    return got.select("way_id", F.col("way_ord").cast("bigint").alias("way_ord"), F.element_at("nodes", 1).alias("first"), F.element_at("nodes", -1).alias("last"), F.size("nodes").cast("bigint").alias("stops"))


@registered("""SELECT c_mktsegment AS area, CASE WHEN k % 3 = 0 OR k % 4 = 0 OR k % 5 = 0 THEN 'w' || k ELSE 'n' || (k + 1000000000) END AS house_id,
    CASE WHEN k % 3 = 0 THEN k || ' Oak St' WHEN k % 4 = 0 OR k % 5 <> 0 THEN k || ' Elm St' ELSE '(no address)' END AS label, NOT (k % 3 = 0 OR k % 4 = 0 OR k % 5 <> 0) AS flagged
  FROM (SELECT c_mktsegment, c_custkey AS k FROM customer) WHERE k % 3 = 0 OR k % 4 = 0 OR k % 5 = 0 OR k % 7 = 0""")
def build_houses(spark, sf_dir):
    """Customers as buildings: with an address of their own, with that of a node inside, lived in without one; and loose address nodes."""
    k = F.col("c_custkey")
    lat, lon = 42 + F.floor(k / 500) * 1e-3, -88.3 + k % 500 * 1e-3
    corner = lambda i, a, o: F.struct((lat + a * 1e-4).alias("lat"), (lon + o * 1e-4).alias("lon"))
    own = k % 3 == 0
    buildings = V.table(spark, sf_dir, "customer").where(own | (k % 4 == 0) | (k % 5 == 0)).select(
        F.col("c_mktsegment").alias("area"), k.alias("id"), k.cast("int").alias("ord"), F.array(corner(0, 0, 0), corner(1, 0, 1), corner(2, 1, 1), corner(3, 1, 0)).alias("ring"),
        _tags(building=F.when(own | (k % 4 == 0), F.lit("yes")).otherwise(F.lit("house")), addr_housenumber=F.when(own, k.cast("string")), addr_street=F.when(own, F.lit("Oak St"))).alias("tags"),
    )
    inside = ~own & (k % 4 == 0)
    loose = ~own & (k % 4 != 0) & (k % 5 != 0) & (k % 7 == 0)
    at = F.struct((lat + 5e-5).alias("lat"), (lon + 5e-5).alias("lon"))
    nodes = V.table(spark, sf_dir, "customer").where(inside | loose).select(F.col("c_mktsegment").alias("area"), (k + 1000000000).alias("id"), k.cast("int").alias("ord"), at.alias("pos"), k.cast("string").alias("number"), F.lit("Elm St").alias("street"))
    return houses.build_houses(buildings, nodes).select("area", "house_id", "label", "flagged")


#: Areas of parcels by part, so that an area holds as many lines at any scale.
PARTS = 100
_PARCELS = f"parcels AS (SELECT *, (l_partkey // {PARTS})::VARCHAR AS area, l_partkey || '-' || l_suppkey AS pin FROM lineitem WHERE l_returnflag <> 'A' AND l_linenumber <> 2)"


@registered("SELECT area, 'k' || pin AS house_id, l_linenumber || ' N River St' AS label, 'N River St' AS street, round(41 + l_orderkey * 1e-6::DOUBLE + 5e-5::DOUBLE, 6) AS lat FROM (SELECT *, row_number() OVER (PARTITION BY area, pin ORDER BY l_orderkey, l_linenumber) AS k FROM parcels) WHERE k = 1", _PARCELS)
def parse_parcels(spark, sf_dir):
    """Lines of orders as parcels, by part and supplier: other uses and blank addresses drop out, and the first of each PIN that is left wins."""
    got = houses.parse_parcels(_json(_parcel_lines(spark, sf_dir), "features", FEATURES, F.col("x")))
    return got.select("area", "house_id", "label", "street", rounded("lat", 6).alias("lat"))


def _parcel_lines(spark, sf_dir):
    o, n = F.col("l_orderkey"), F.col("l_linenumber")
    lat = 41 + o * 1e-6
    ring = F.array(*[F.array(F.lit(-88.3) + x * 1e-4, lat + y * 1e-4) for x, y in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))])
    feature = F.struct(
        F.struct(F.concat_ws("-", "l_partkey", "l_suppkey").alias("PIN"), F.when(n == 2, F.lit(" ")).otherwise(F.concat(n.cast("string"), F.lit(" N RIVER ST"))).alias("SiteAddress"), F.when(F.col("l_returnflag") == "A", F.lit("Farm")).otherwise(F.lit(houses.RESIDENTIAL)).alias("UseCodeDescription")).alias("attributes"),
        F.struct(F.array(ring).alias("rings")).alias("geometry"),
    )
    return V.table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_partkey") / PARTS).cast("string").alias("area"), F.struct(o, n).alias("ord"), feature.alias("x"))


def _folder(spark) -> str:
    path = f"{shared_dir(spark)}/loopwright/{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


@registered("SELECT a, b, street, CASE WHEN a // 40 % 3 = 0 THEN 1 WHEN a // 40 % 3 = 1 THEN 2 ELSE 0 END::INTEGER AS source FROM edges", V.NODES_SQL, V.EDGES_SQL)
def source_fallback(spark, sf_dir):
    """The streets of each block as map bodies at three mirrors: the first fails softly for one block of three and gives rubbish for another, the second is empty for that one."""
    nodes = V.nodes(spark, sf_dir, blocks=True).select("area", F.struct(F.lit(0).alias("kind"), F.col("ord").alias("n")).alias("ord"), _element("node", F.col("node_id"), F.col("lat"), F.col("lon")).alias("x"))
    ways = V.ways(spark, sf_dir, blocks=True).select("area", F.struct(F.lit(1).alias("kind"), F.col("way_ord").alias("n")).alias("ord"), _element("way", F.col("way_id"), nodes=F.col("nodes"), tags=_tags(highway=F.col("highway"), name=F.col("name"))).alias("x"))
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("ord", F.to_json("x").alias("j")))), lambda e: e["j"])
    good = written(nodes.unionByName(ways).groupBy("area").agg(F.concat(F.lit('{"elements": ['), F.array_join(in_order, ", "), F.lit("]}")).alias("value")))
    kind = F.col("area").cast("bigint") % 3
    soft, empty, rubbish = F.lit('{"remark": "runtime error: Query timed out", "elements": []}'), F.lit('{"elements": []}'), F.lit("<html>busy</html>")
    answers = [F.when(kind == 0, soft).when(kind == 1, rubbish).otherwise(F.col("value")), F.when(kind == 1, empty).otherwise(F.col("value")), F.col("value")]
    folders = [_folder(spark) for _ in answers]
    for folder, answer in zip(folders, answers):
        good.select("area", answer.alias("value")).repartition("area").write.partitionBy("area").text(folder)
    spark.dataSource.register(remote.Bodies)
    bodies = written(spark.read.format("map_bodies").option("sources", json.dumps(folders)).load())
    parsed = elements.parse_elements(bodies)
    return graph.edges(parsed["nodes"], parsed["ways"]).join(bodies.select("area", "source"), "area").select("a", "b", "street", "source")


@registered("SELECT area, 'k' || pin AS house_id, l_linenumber || ' N River St' AS label, CASE WHEN area::INTEGER % 2 = 0 THEN 1 ELSE 0 END AS source FROM (SELECT *, row_number() OVER (PARTITION BY area, pin ORDER BY l_orderkey, l_linenumber) AS k FROM parcels) WHERE k = 1", _PARCELS)
def source_pages(spark, sf_dir):
    """Lines of orders as pages of parcels, a thousand a page; the first server fails for every other area. Pages behind the last one by its own word aren't read."""
    turn = F.row_number().over(Window.partitionBy("area").orderBy("ord")) - 1
    total = F.count("*").over(Window.partitionBy("area"))
    lines_ = _parcel_lines(spark, sf_dir).withColumn("offset", (F.floor(turn / 1000) * 1000).cast("bigint")).withColumn("n", total)
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("ord", F.to_json("x").alias("j")))), lambda e: e["j"])
    pages = lines_.groupBy("area", "offset", "n").agg(F.concat(F.lit('{"features": ['), F.array_join(in_order, ", "), F.lit('], "exceededTransferLimit": '), (F.col("offset") + 1000 < F.col("n")).cast("string"), F.lit("}")).alias("value"))
    behind = pages.groupBy("area").agg((F.max("offset") + 1000).alias("offset"), F.first("n").alias("n")).withColumn("value", F.lit('{"features": [{"attributes": {"PIN": 1, "SiteAddress": "1 Never Read", "UseCodeDescription": "Residential Improved Lot"}, "geometry": {"rings": []}}]}'))
    pages = written(pages.unionByName(behind).select("area", "offset", "value"))
    error = F.when(F.col("area").cast("bigint") % 2 == 0, F.lit('{"error": {"message": "try again"}}')).otherwise(F.col("value"))
    folders = [_folder(spark), _folder(spark)]

    def serve(rows):
        for area, offset, *bodies in rows:
            for folder, body in zip(folders, bodies):
                remote.put(f"{folder}/area={area}/offset={offset}/page.json", body)

    # very many small files: Spark's writers would start a process or two for each on a local disk
    pages.select("area", "offset", error, "value").foreachPartition(serve)
    spark.dataSource.register(remote.Pages)
    read = written(spark.read.format("parcel_pages").option("sources", json.dumps(folders)).load())
    got = houses.parse_parcels(houses.all_pages(read))
    return got.join(read.groupBy("area").agg(F.min("source").alias("source")), "area").select("area", "house_id", "label", "source")


@registered("""SELECT k::VARCHAR AS area, CASE WHEN k % 10 = 0 THEN 'Unsupported project version 2' WHEN k % 10 = 1 THEN 'houses[0] needs string id, label and street' WHEN k % 10 = 2 THEN 'assignment["' || k || '"] must be an integer' END AS error,
    CASE WHEN k % 10 > 2 THEN least(12, greatest(2, c_nationkey)) END::BIGINT AS groups, CASE WHEN k % 10 > 2 THEN least(600, greatest(0, c_acctbal)) END AS sec_per_house, CASE WHEN k % 10 > 2 THEN k % 6 END::INTEGER AS g, CASE WHEN k % 10 > 2 THEN c_name END AS label
  FROM (SELECT *, c_custkey AS k FROM customer)""")
def parse_projects(spark, sf_dir):
    """A saved project for each customer: versions, houses and assignments are checked, settings clamped."""
    k = F.col("c_custkey")
    text = F.format_string(
        '{"version": %d, "houses": [{"id": %s, "lat": 42, "lon": -88.3, "label": "%s", "street": ""}], "assignment": {"%d": %s}, "config": {"groups": %d, "secPerHouse": %s}}',
        F.when(k % 10 == 0, 2).otherwise(1), F.when(k % 10 == 1, k.cast("string")).otherwise(F.concat(F.lit('"'), k.cast("string"), F.lit('"'))), "c_name", k,
        F.when(k % 10 == 2, F.lit("1.5")).otherwise((k % 6).cast("string")), "c_nationkey", F.col("c_acctbal").cast("string"),
    )
    got = project.parse_projects(V.table(spark, sf_dir, "customer").select(k.cast("string").alias("area"), text.alias("json")))
    return got.select("area", "error", "config.groups", F.col("config.secPerHouse").alias("sec_per_house"), F.try_element_at("assignment", "area").alias("g"), F.col("houses")[0]["label"].alias("label"))


@registered("SELECT c_custkey::VARCHAR AS area, c_name AS label, (c_custkey % 6)::INTEGER AS g, least(12, greatest(2, c_nationkey))::BIGINT AS groups FROM customer WHERE c_custkey % 10 > 2")
def project_round_trip(spark, sf_dir):
    """Good projects, written as JSON and read again."""
    k = F.col("c_custkey")
    text = F.format_string('{"version": 1, "houses": [{"id": "%d", "lat": 42, "lon": -88.3, "label": "%s", "street": ""}], "assignment": {"%d": %d}, "config": {"groups": %d}}', k, "c_name", k, k % 6, "c_nationkey")
    read = project.parse_projects(V.table(spark, sf_dir, "customer").where(k % 10 > 2).select(k.cast("string").alias("area"), text.alias("json")))
    again = project.parse_projects(written(export.project_json(written(read.drop("error")))))
    return again.where("error is null").select("area", F.col("houses")[0]["label"].alias("label"), F.try_element_at("assignment", "area").alias("g"), "config.groups")


@registered("""SELECT area, 'group,order,address,lat,lon' || chr(13) || chr(10) || string_agg(g + 1 || ',' || turn || ',' || CASE WHEN contains(safe, ',') THEN '"' || safe || '"' ELSE safe END || ',' || house_id || '.5,-' || g || '.25', chr(13) || chr(10) ORDER BY g, turn) || chr(13) || chr(10) AS csv
  FROM (SELECT *, row_number() OVER (PARTITION BY area, g ORDER BY house_id) AS turn, CASE house_id % 4 WHEN 0 THEN '''=' || house_id || ' Oak, rear' WHEN 1 THEN '-' || house_id WHEN 2 THEN house_id || ' Oak, rear' ELSE label END AS safe FROM houses) GROUP BY area""", V.HOUSES_SQL)
def export_csv(spark, sf_dir):
    """Stop lists as CSV text: fields with commas are quoted, formulas are made harmless, numbers aren't."""
    return export.csv_lines(_stop_rows(spark, sf_dir))


def _stop_rows(spark, sf_dir):
    h = V.houses(spark, sf_dir)
    k = F.col("house_id")
    address = F.when(k % 4 == 0, F.concat(F.lit("="), k.cast("string"), F.lit(" Oak, rear"))).when(k % 4 == 1, F.concat(F.lit("-"), k.cast("string"))).when(k % 4 == 2, F.concat(k.cast("string"), F.lit(" Oak, rear"))).otherwise(F.col("label"))
    turn = F.row_number().over(Window.partitionBy("area", "g").orderBy("house_id"))
    return h.select("area", (F.col("g") + 1).alias("group"), turn.alias("order"), address.alias("address"), (k + 0.5).alias("lat"), (-(F.col("g") + 0.25)).alias("lon"))


@registered("SELECT area, unnest(str_split(rtrim(csv, chr(13) || chr(10)), chr(13) || chr(10))) AS line FROM (" + ORACLE_SQL["export_csv"].removeprefix(f"WITH {V.HOUSES_SQL} ") + ")", V.HOUSES_SQL)
def export_files(spark, sf_dir):
    """The same stop lists as files, written by the sink and read again line by line."""
    folder = _folder(spark)
    stoplists.write_stop_lists(_stop_rows(spark, sf_dir), folder)
    return spark.read.option("lineSep", stoplists.END).text(folder).select("area", F.col("value").alias("line"))


@registered("""SELECT o_custkey::VARCHAR AS area, o_orderkey AS seq FROM (
    SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS turn, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WHERE o_orderstatus <> 'F') e
  LEFT JOIN (SELECT o_custkey AS c, count(*) AS undone FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) u ON u.c = e.o_custkey
  WHERE turn <= n - least(coalesce(undone, 0), n, 100) + (CASE WHEN coalesce(undone, 0) > 0 AND n > 0 THEN 1 ELSE 0 END)""")
def edit_history(spark, sf_dir):
    """A customer's orders as an edit log: open ones are edits; then each finished one takes an edit back, and one that was taken back last is brought again."""
    o = V.table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("area"), F.col("o_orderkey").alias("seq"), (F.col("o_orderstatus") == "F").alias("undo"))
    log = o.select("area", F.when(F.col("undo"), F.col("seq") + (1 << 40)).otherwise(F.col("seq")).alias("seq"), F.when(F.col("undo"), F.lit("undo")).otherwise(F.lit("edit")).alias("kind"))
    redo = log.where("kind = 'undo'").select("area", F.lit(1 << 41).alias("seq"), F.lit("redo").alias("kind")).distinct()
    return edits.undone(log.unionByName(redo)).select("area", "seq")


@registered("SELECT c_custkey::VARCHAR AS area, c_custkey % 5 <> 0 AS stale FROM customer")
def edit_staleness(spark, sf_dir):
    """Fingerprints of a customer's state before and after: one part changes for four of five of them, a null that stays a null doesn't count."""
    k = F.col("c_custkey")
    c = V.table(spark, sf_dir, "customer")
    inputs = T.input_signature(F.lit("{}"), F.array(F.col("c_name")), F.array().cast("array<string>"), F.array().cast("array<string>"))
    key = T.model_key(F.array(F.col("c_name")), F.array().cast("array<string>"), F.lit(8.0))
    before = c.select(k.cast("string").alias("area"), F.lit("s").alias("state"), F.lit(6).alias("groups"), key.alias("model_key"), F.lit(None).cast("string").alias("osm"), inputs.alias("inputs"))
    changed = lambda i, c, other: F.when(k % 5 == i, other).otherwise(c)
    now = c.select(k.cast("string").alias("area"), F.lit("s").alias("state"), changed(1, F.lit(6), F.lit(5)).alias("groups"), changed(2, key, F.concat(key, F.lit("x"))).alias("model_key"), changed(3, F.lit(None).cast("string"), F.lit("o")).alias("osm"), changed(4, inputs, F.upper(inputs)).alias("inputs"))
    return edits.is_stale(before, now)


@registered("""SELECT g::BIGINT AS g, CASE WHEN count(*) = 1 THEN 1 ELSE count(*) + 1 END AS points, round(CASE WHEN count(*) = 1 THEN min(value) ELSE sum(value) + arg_min(value, pos) END, 3) AS total FROM stops GROUP BY g""", V.STOPS_SQL)
def tour_polylines(spark, sf_dir):
    """Loops drawn as straight legs from stop to stop: each stop once, and the first again at the end."""
    s = V.stops(spark, sf_dir)
    legs = stats.tour_legs(s, ["pos", "value"])
    point = lambda lat, lon: F.struct(F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"))
    none = F.lit(None).cast("array<struct<lat:double,lon:double>>")
    doors = legs.select("area", "g", "pos", point("pos", "value").alias("door_a"), point("n_pos", "n_value").alias("door_b"), point("pos", "value").alias("point_a"), point("n_pos", "n_value").alias("point_b"), F.lit(False).alias("same_edge"), F.lit(False).alias("same_side"), none.alias("nodes"))
    drawn = export.tour_polylines(export.leg_polylines(doors))
    total = F.aggregate("line", F.lit(0.0), lambda acc, p: acc + p["lon"])
    return drawn.select(F.col("g").cast("bigint").alias("g"), F.size("line").cast("bigint").alias("points"), rounded(total, 3).alias("total"))
