"""Map elements (nested JSON) to roads, buildings and address nodes; query text, cache keys and fallback of sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loopwright.functions import text as T
from loopwright.schema import ELEMENTS

# Classes of ways that aren't walked, and what a server says when it failed softly.
SKIPPED_HIGHWAYS = ["motorway", "motorway_link", "construction", "proposed", "abandoned", "raceway"]
SKIPPED_SERVICES = ["driveway", "parking_aisle"]
SOFT_FAILURE = r"(?i)error|timed out|out of memory"
CACHE_VERSIONS = {"map": "v2", "parcels": "v1"}
QUERY = """[out:json][timeout:90];
(
  way["highway"]["highway"!~"{skipped}"](poly:"{ring}");
  way["building"](poly:"{ring}");
  way["addr:housenumber"](poly:"{ring}");
  node["addr:housenumber"](poly:"{ring}");
);
out body;
>;
out skel qt;"""


def build_query(ring: Column) -> Column:
    """The map server's query for a ring of struct(lat, lon)."""
    return F.replace(F.lit(QUERY.replace("{skipped}", "|".join(SKIPPED_HIGHWAYS))), F.lit("{ring}"), T.poly_string(ring))


def cache_key(ring: Column, namespace: str = "map") -> Column:
    return F.concat(F.lit(f"{namespace}:{CACHE_VERSIONS[namespace]}:"), T.hash_text(T.poly_string(ring)))


def ring_of(coordinates: Column) -> Column:
    """struct(lat, lon) vertices of a polygon's outer ring given as [lon, lat] positions; null for none."""
    return F.transform(F.try_element_at(coordinates, F.lit(1)), lambda p: F.struct(p[1].alias("lat"), p[0].alias("lon")))


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """JSON bodies, one a file, as (area, remark, elements); the area is the file's name."""
    raw = spark.read.schema(f"remark string, elements {ELEMENTS}").option("multiLine", True).option("mode", "FAILFAST").json(path)
    return raw.select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.json)?$", 1).alias("area"), "remark", "elements")


def check_bodies(bodies: DataFrame) -> DataFrame:
    """Adds `failure`: why a body is no data, or null."""
    failure = (
        F.when(F.col("elements").isNull(), F.lit("not a map answer: it has no list of elements"))
        .when(F.col("remark").rlike(SOFT_FAILURE), F.concat(F.lit("the map server failed softly: "), F.col("remark")))
        .when(F.size("elements") == 0, F.lit("no element came back; the area may be empty or the server busy"))
    )
    return bodies.withColumn("failure", failure)


def first_good(sources: list[Callable[[], DataFrame]]) -> DataFrame:
    """Bodies of the first source, in order, that has a good one; failures of all are in the error otherwise."""
    said = []
    for source in sources:
        try:
            checked = check_bodies(source())
            found = checked.select("failure").limit(1).collect()
            bad = checked.where(F.col("failure").isNotNull()).select("failure").limit(1).collect()
        except Exception as error:  # a source that can't be read is one that failed
            said.append(str(error).splitlines()[0])
            continue
        if found and not bad:
            return checked.drop("failure")
        said.append(bad[0]["failure"] if bad else "no body")
    raise ValueError("all sources failed: " + "; ".join(said))


def cached(spark: SparkSession, folder: str, key: str, fetch: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The table under a key, or what fetch() gives, kept for the next time. force skips reading, not keeping; a broken cache never fails."""
    path = f"{folder.rstrip('/')}/{key.replace(':', '/')}"
    if not force:
        try:
            return spark.read.parquet(path)
        except Exception:  # not there, or not readable: fetch
            pass
    found = fetch()
    try:
        found.write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)
    except Exception:  # a cache that can't be written only costs time
        return found


def _exploded(bodies: DataFrame) -> DataFrame:
    return bodies.select("area", F.posexplode("elements").alias("ord", "e")).select("area", "ord", "e.*")


def _tag(name: str) -> Column:
    return F.try_element_at("tags", F.lit(name))


def parse_elements(bodies: DataFrame) -> dict[str, DataFrame]:
    """Relations nodes, ways, buildings, addr_nodes of bodies (area, elements).

    The last positioned copy of a node gives its place; its address is that of the last copy that has one. The first copy
    of a way counts. A way is split where a node is missing; pieces keep its id and have two nodes at least.
    """
    each = _exploded(bodies)
    placed = each.where((F.col("type") == "node") & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    last = placed.groupBy("area", "id").agg(F.max_by(F.struct("lat", "lon"), "ord").alias("pos")).select("area", F.col("id").alias("node_id"), "pos")
    numbered = placed.where(F.coalesce(_tag("addr:housenumber"), F.lit("")) != "")
    addr = numbered.groupBy("area", "id").agg(
        F.max_by(F.struct(F.struct("lat", "lon").alias("pos"), _tag("addr:housenumber").alias("number"), F.coalesce(_tag("addr:street"), F.lit("")).alias("street")), "ord").alias("a"),
        F.min("ord").alias("ord"),
    )
    addr_nodes = addr.select("area", "id", "ord", "a.pos", "a.number", "a.street")

    once = each.where((F.col("type") == "way") & F.col("nodes").isNotNull()).withColumn("copy", F.row_number().over(Window.partitionBy("area", "id").orderBy("ord"))).where("copy = 1")
    road = F.coalesce(_tag("highway"), F.lit("")) != ""
    ways = once.where(road & ~_tag("highway").isin(SKIPPED_HIGHWAYS) & ~F.coalesce(_tag("service"), F.lit("")).isin(SKIPPED_SERVICES))
    stops = ways.select("area", "ord", "id", _tag("name").alias("name"), _tag("highway").alias("highway"), F.posexplode("nodes").alias("pos", "node_id"))
    met = stops.join(last.withColumnRenamed("pos", "at"), ["area", "node_id"], "left")
    along = Window.partitionBy("area", "ord").orderBy("pos")
    islands = met.withColumn("island", F.sum(F.col("at").isNull().cast("int")).over(along)).where("at is not null")
    pieces = islands.groupBy("area", "ord", "id", "name", "highway", "island").agg(F.sort_array(F.collect_list(F.struct("pos", "node_id"))).alias("run")).where(F.size("run") >= 2)
    order = Window.partitionBy("area").orderBy("ord", "island")
    roads = pieces.select("area", F.col("id").alias("way_id"), (F.row_number().over(order) - 1).alias("way_ord"), F.coalesce("name", F.lit("")).alias("name"), "highway", F.transform("run", lambda r: r["node_id"]).alias("nodes"))

    used = roads.select("area", "way_ord", F.posexplode("nodes").alias("pos", "node_id")).groupBy("area", "node_id").agg(F.min(F.struct("way_ord", "pos")).alias("first"))
    by_use = Window.partitionBy("area").orderBy("first")
    nodes = used.join(last, ["area", "node_id"]).select("area", "node_id", (F.row_number().over(by_use) - 1).alias("ord"), "pos.lat", "pos.lon")

    shells = once.where(~road & ((F.coalesce(_tag("building"), F.lit("")) != "") | (F.coalesce(_tag("addr:housenumber"), F.lit("")) != "")))
    corners = shells.select("area", "ord", "id", "tags", F.posexplode("nodes").alias("pos", "node_id")).join(last.withColumnRenamed("pos", "at"), ["area", "node_id"])
    rings = corners.groupBy("area", "ord", "id").agg(F.first("tags").alias("tags"), F.sort_array(F.collect_list(F.struct("pos", "at"))).alias("ring"))
    buildings = rings.where(F.size("ring") >= 3).select("area", "id", "ord", F.transform("ring", lambda r: r["at"]).alias("ring"), "tags")
    return {"nodes": nodes, "ways": roads, "buildings": buildings, "addr_nodes": addr_nodes}
