"""Houses from buildings and address nodes, from parcel features, and the choice between both sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loopwright.checkpoints import written
from loopwright.functions import geo
from loopwright.functions.text import NO_ADDRESS, format_address
from loopwright.schema import FEATURES
from loopwright.sources.elements import _tag, parse_elements

# Kinds of buildings that are no houses, kinds that are, and the land use of lived-in parcels.
NON_HOUSE = ["garage", "garages", "shed", "service", "roof", "carport", "cabin", "hut", "greenhouse", "barn", "industrial", "commercial", "retail", "church", "school", "public", "civic", "government"]
HOUSE = ["house", "residential", "detached", "semidetached_house", "terrace", "bungalow", "apartments", "townhouse"]
RESIDENTIAL = "Residential Improved Lot"

_COLUMNS = ["area", "house_id", "ord", "lat", "lon", "label", "street", "flagged", "manual"]


def _in_boundary(df: DataFrame, boundaries: DataFrame | None, lat, lon) -> DataFrame:
    """Rows inside their area's boundary (area, boundary ring); areas without one keep all."""
    if boundaries is None:
        return df
    met = df.join(boundaries.select("area", "boundary"), "area", "left")
    return met.where(F.col("boundary").isNull() | geo.point_in_ring(lat, lon, F.col("boundary"))).drop("boundary")


def _cells(low, high, size: float):
    return F.explode(F.sequence(F.floor(low / size), F.floor(high / size)))


def build_houses(buildings: DataFrame, addr_nodes: DataFrame, boundaries: DataFrame | None = None, cell: float = 0.002) -> DataFrame:
    """Houses of an area: buildings with an address or of a lived-in kind, and address nodes that no building holds.

    Buildings meet address nodes by grid cells of `cell` degrees, an equi-join; the ring test decides.
    """
    kind = _tag("building")
    central = buildings.withColumn("kind", kind).where(F.coalesce("kind", F.lit("")).isin(NON_HOUSE) == F.lit(False)).withColumn("c", geo.ring_centroid(F.col("ring")))
    central = _in_boundary(central, boundaries, F.col("c.lat"), F.col("c.lon"))
    bounds = lambda f, k: f(F.transform("ring", lambda v: v[k]))
    boxed = central.select("area", F.col("ord").alias("b_ord"), "ring", *[bounds(f, k).alias(f"{n}_{k}") for f, n in ((F.array_min, "lo"), (F.array_max, "hi")) for k in ("lat", "lon")])
    rows = boxed.select("*", _cells(F.col("lo_lat"), F.col("hi_lat"), cell).alias("row")).select("*", _cells(F.col("lo_lon"), F.col("hi_lon"), cell).alias("col"))
    nodes = addr_nodes.select("area", "id", "ord", "pos", "number", "street", F.floor(F.col("pos.lat") / cell).alias("row"), F.floor(F.col("pos.lon") / cell).alias("col"))
    inside = rows.join(nodes, ["area", "row", "col"]).where(geo.point_in_ring(F.col("pos.lat"), F.col("pos.lon"), F.col("ring")))
    first = inside.groupBy("area", "b_ord").agg(F.min_by(F.struct("id", "number", "street"), F.struct("ord", "id")).alias("an"))
    met = central.join(first.withColumnRenamed("b_ord", "ord"), ["area", "ord"], "left")
    number = F.coalesce(_tag("addr:housenumber"), F.col("an.number"))
    street = F.coalesce(_tag("addr:street"), F.col("an.street"), F.lit(""))
    addressed = F.coalesce(number, F.lit("")) != ""
    lived = F.when(F.coalesce("kind", F.lit("")) != "", F.col("kind").isin(HOUSE) | ((F.col("kind") == "yes") & addressed)).otherwise(addressed)
    shells = met.where(addressed | lived).select(
        "area", F.concat(F.lit("w"), F.col("id").cast("string")).alias("house_id"), F.struct(F.lit(0), "ord").alias("place"), F.col("c.lat").alias("lat"), F.col("c.lon").alias("lon"),
        F.when(addressed, F.trim(F.concat_ws(" ", number, street))).otherwise(F.lit(NO_ADDRESS)).alias("label"), street.alias("street"), (~addressed).alias("flagged"),
    )
    consumed = first.select("area", F.col("an.id").alias("id")).distinct()
    loose = _in_boundary(addr_nodes.join(consumed, ["area", "id"], "left_anti"), boundaries, F.col("pos.lat"), F.col("pos.lon"))
    points = loose.select("area", F.concat(F.lit("n"), F.col("id").cast("string")).alias("house_id"), F.struct(F.lit(1), "ord").alias("place"), F.col("pos.lat").alias("lat"), F.col("pos.lon").alias("lon"), F.trim(F.concat_ws(" ", "number", "street")).alias("label"), "street", F.lit(False).alias("flagged"))
    order = Window.partitionBy("area").orderBy("place")
    return shells.unionByName(points).withColumn("ord", F.row_number().over(order) - 1).withColumn("manual", F.lit(False)).select(_COLUMNS)


def parse_parcels(features: DataFrame, boundaries: DataFrame | None = None) -> DataFrame:
    """Houses of parcel features (area, features): lived-in lots with an address, the first of each PIN that passes."""
    each = features.select("area", F.posexplode("features").alias("ord", "f"))
    pin, site = F.trim(F.col("f.attributes.PIN")), F.trim(F.col("f.attributes.SiteAddress"))
    lots = each.where((F.col("f.attributes.UseCodeDescription") == RESIDENTIAL) & (F.coalesce(pin, F.lit("")) != "") & (F.coalesce(site, F.lit("")) != ""))
    rings = F.transform("f.geometry.rings", lambda r: F.transform(r, lambda p: F.struct(p[1].alias("lat"), p[0].alias("lon"))))
    sized = lots.withColumn("pin", pin).withColumn("site", site).withColumn("rings", rings).where(F.size("rings") > 0)
    # the largest ring; of equal ones the first
    outer = F.element_at(F.array_sort(F.transform("rings", lambda r, i: F.struct((-geo.ring_area(r)).alias("size"), i.alias("i"), r.alias("ring")))), 1)["ring"]
    central = _in_boundary(sized.withColumn("c", geo.ring_centroid(outer)).where("c is not null"), boundaries, F.col("c.lat"), F.col("c.lon"))
    once = central.withColumn("copy", F.row_number().over(Window.partitionBy("area", "pin").orderBy("ord"))).where("copy = 1").withColumn("a", format_address(F.col("site")))
    order = Window.partitionBy("area").orderBy("place")
    return once.withColumnRenamed("ord", "place").select(
        "area", F.concat(F.lit("k"), "pin").alias("house_id"), (F.row_number().over(order) - 1).alias("ord"), F.col("c.lat").alias("lat"), F.col("c.lon").alias("lon"),
        F.col("a.label").alias("label"), F.col("a.street").alias("street"), F.lit(False).alias("flagged"), F.lit(False).alias("manual"),
    )


PAGE = f"features {FEATURES}, exceededTransferLimit boolean, error struct<message:string>"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages of a parcel server as (area, offset, features, exceeded), from JSON files named area-offset.json. A page that is an error body is an error."""
    raw = spark.read.schema(PAGE).option("multiLine", True).option("mode", "FAILFAST").json(path)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)-\d+\.json$", 1)
    pages = raw.select(name.alias("area"), F.regexp_extract(F.input_file_name(), r"-(\d+)\.json$", 1).cast("bigint").alias("offset"), "features", F.col("exceededTransferLimit").alias("exceeded"), F.col("error.message").alias("said"))
    bad = pages.where(F.col("said").isNotNull()).select("said").limit(1).collect()
    if bad:
        raise ValueError(f"a parcel page is an error: {bad[0]['said']}")
    return pages.drop("said")


def house_data(roads: Callable[[], DataFrame], parcels: Callable[[], DataFrame], boundaries: DataFrame | None = None) -> dict[str, DataFrame]:
    """nodes, ways and houses (with source and note): roads are always those of the map, and a failure of theirs is final; houses are those of
    the parcels, or of the map in areas without any, and everywhere if parcels can't be read. `roads` gives bodies, `parcels` (area, features).
    """
    parsed = parse_elements(roads())
    mapped = build_houses(parsed["buildings"], parsed["addr_nodes"], boundaries)
    try:
        own = written(parse_parcels(parcels(), boundaries))
    except Exception as error:  # parcels are the better source, not a needed one
        reason = str(error).splitlines()[0]
        found = mapped.withColumn("source", F.lit("map")).withColumn("note", F.lit(f"parcels can't be read: {reason}"))
    else:
        found = choose_source(own, mapped)
    return {"nodes": parsed["nodes"], "ways": parsed["ways"], "houses": found}


def choose_source(parcels: DataFrame, mapped: DataFrame) -> DataFrame:
    """Each area's houses: those of its parcels, or of the map where it has no parcels; with `source` and a `note`."""
    covered = parcels.select("area").distinct()
    own = parcels.withColumn("source", F.lit("parcels")).withColumn("note", F.lit(None).cast("string"))
    other = mapped.join(covered, "area", "left_anti").withColumn("source", F.lit("map")).withColumn("note", F.lit("no parcels in this area; houses are those of the map"))
    return own.unionByName(other)


def all_pages(pages: DataFrame) -> DataFrame:
    """Features of paged answers (area, offset, features, exceeded), up to the first page that is empty or the last one by its own word."""
    turn = Window.partitionBy("area").orderBy("offset")
    ended = F.max((~F.coalesce("exceeded", F.lit(False)) | (F.size("features") == 0)).cast("int")).over(turn.rowsBetween(Window.unboundedPreceding, -1))
    read = pages.withColumn("ended", F.coalesce(ended, F.lit(0))).where("ended = 0")
    lists = read.groupBy("area").agg(F.sort_array(F.collect_list(F.struct("offset", "features"))).alias("pages"))
    return lists.select("area", F.flatten(F.transform("pages", lambda p: p["features"])).alias("features"))


def bounding_polygon(points: DataFrame, margin: float = 0.0005) -> DataFrame:
    """area, boundary: a closed box about the points, wider by a margin."""
    box = points.groupBy("area").agg(*[f(k).alias(f"{n}_{k}") for f, n in ((F.min, "lo"), (F.max, "hi")) for k in ("lat", "lon")])
    corner = lambda a, o: F.struct((F.col(f"{a}_lat") + (margin if a == "hi" else -margin)).alias("lat"), (F.col(f"{o}_lon") + (margin if o == "hi" else -margin)).alias("lon"))
    return box.select("area", F.array(corner("lo", "lo"), corner("lo", "hi"), corner("hi", "hi"), corner("hi", "lo"), corner("lo", "lo")).alias("boundary"))
