"""Saved projects: JSON text to a checked, clamped state; all or nothing."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loopwright.schema import CONFIG_LIMITS, PROJECT_VERSION, WEIGHT_LIMITS, Config

HOUSE = "array<struct<id:string,lat:double,lon:double,label:string,street:string,flagged:boolean,manual:boolean>>"
OSM = "struct<nodes:array<array<double>>,ways:array<struct<id:bigint,name:string,highway:string,nodes:array<bigint>>>>"
BOUNDARY = "struct<type:string,coordinates:array<array<array<double>>>>"


def _kind(v: Column) -> Column:
    """What a variant holds: OBJECT, ARRAY<...>, STRING, BIGINT, DOUBLE, DECIMAL, BOOLEAN, VOID; null if it isn't there."""
    return F.schema_of_variant(v)


def _get(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _is(v: Column, *starts: str) -> Column:
    kind = _kind(v)
    hit = F.lit(False)
    for s in starts:
        hit = hit | kind.startswith(s)
    return F.coalesce(hit, F.lit(False))


# What callers are told about a bad project. Those that begin with "]" follow the place of an item.
SAID_NOT_JSON = "not valid JSON"
SAID_NOT_OBJECT = "expected a JSON object"
SAID_VERSION = "Unsupported project version "
SAID_BOUNDARY = "boundary must be null or a GeoJSON Polygon"
SAID_POSITIONS = "] must be an array of [lon, lat] positions"
SAID_OSM_PARTS = "osm must be null or {nodes: [], ways: []}"
SAID_OSM_NODE = "] must be [id, lat, lon] numbers"
SAID_OSM_WAY = "] must be {id: number, name: string, highway: string, nodes: number[]}"
SAID_HOUSE_OBJECT = "] is not an object"
SAID_HOUSE_PLACE = "] needs finite lat and lon"
SAID_HOUSE_TEXTS = "] needs string id, label and street"
SAID_HOUSES = "houses must be an array"
SAID_ASSIGNMENT = "assignment must be an object"

_NUMBER = ("BIGINT", "DOUBLE", "DECIMAL", "FLOAT")


def _none(v: Column) -> Column:
    return v.isNull() | _is(v, "VOID")


def _number(v: Column, path: str) -> Column:
    """A number, or text that reads as one; null for all else."""
    own = _get(v, path)
    plain = F.try_variant_get(v, path, "double")
    text = F.trim(F.try_variant_get(v, path, "string"))
    return F.when(_is(own, *_NUMBER), plain).when(_is(own, "STRING") & text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))


def config(v: Column) -> Column:
    """The configuration: numbers clamped to their limits, whole ones rounded half up; defaults for all else."""
    default = asdict(Config())
    fields = []
    for name, (low, high, whole) in CONFIG_LIMITS.items():
        n = _number(v, f"$.config.{name}")
        n = F.floor(n + 0.5).cast("double") if whole else n
        held = F.coalesce(F.when(n.isNotNull(), F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), n))), F.lit(float(default[name])))
        fields.append((held.cast("bigint") if whole else held).alias(name))
    weights = []
    for name, start in default["weights"].items():
        n = _number(v, f"$.config.weights.{name}")
        low, high = WEIGHT_LIMITS.get(name, (None, None))
        # least() and greatest() would pass over a null
        held = F.when(n >= 0, n) if low is None else F.when(n.isNotNull(), F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), n)))
        weights.append(F.coalesce(held, F.lit(float(start))).alias(name))
    return F.struct(*fields, F.struct(*weights).alias("weights"))


def _first(items: Column, bad) -> Column:
    """Index of the first bad item of an array of variants; null if all are good."""
    return F.array_min(F.filter(F.transform(items, lambda x, i: F.when(bad(x), i)), lambda i: i.isNotNull()))


def _items(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "array<variant>")


def _said(index: Column, before: str, after: str) -> Column:
    return F.when(index.isNotNull(), F.concat(F.lit(before), index.cast("string"), F.lit(after)))


def _position(p: Column) -> Column:
    xs = F.try_variant_get(p, "$", "array<variant>")
    return _is(p, "ARRAY") & (F.size(xs) >= 2) & _is(F.get(xs, 0), *_NUMBER) & _is(F.get(xs, 1), *_NUMBER)


def errors(v: Column) -> Column:
    """What is wrong with a project, the first thing by the order of its parts; null if nothing is."""
    not_object = F.when(~_is(v, "OBJECT"), F.lit(SAID_NOT_OBJECT))
    version = _get(v, "$.version")
    wrong_version = F.when(~(_is(version, *_NUMBER) & F.coalesce(F.try_variant_get(v, "$.version", "double") == PROJECT_VERSION, F.lit(False))), F.concat(F.lit(SAID_VERSION), F.coalesce(F.try_variant_get(v, "$.version", "string"), F.lit("undefined"))))
    boundary, rings = _get(v, "$.boundary"), _items(v, "$.boundary.coordinates")
    is_polygon = _is(boundary, "OBJECT") & F.coalesce(F.try_variant_get(v, "$.boundary.type", "string") == "Polygon", F.lit(False)) & _is(_get(v, "$.boundary.coordinates"), "ARRAY")
    bad_ring = _first(rings, lambda r: ~(_is(r, "ARRAY") & F.coalesce(F.forall(F.try_variant_get(r, "$", "array<variant>"), _position), F.lit(False))))
    boundary_error = F.when(~_none(boundary), F.when(~is_polygon, F.lit(SAID_BOUNDARY)).otherwise(_said(bad_ring, "boundary.coordinates[", SAID_POSITIONS)))
    osm = _get(v, "$.osm")
    whole = _is(osm, "OBJECT") & _is(_get(v, "$.osm.nodes"), "ARRAY") & _is(_get(v, "$.osm.ways"), "ARRAY")
    numbers = lambda x: F.coalesce(F.forall(F.try_variant_get(x, "$", "array<variant>"), lambda n: _is(n, *_NUMBER)), F.lit(False))
    bad_node = _first(_items(v, "$.osm.nodes"), lambda n: ~(_is(n, "ARRAY") & numbers(n) & (F.size(F.try_variant_get(n, "$", "array<variant>")) == 3)))
    bad_way = _first(_items(v, "$.osm.ways"), lambda w: ~(_is(w, "OBJECT") & _is(_get(w, "$.id"), *_NUMBER) & _is(_get(w, "$.name"), "STRING") & _is(_get(w, "$.highway"), "STRING") & _is(_get(w, "$.nodes"), "ARRAY") & numbers(_get(w, "$.nodes"))))
    osm_error = F.when(~_none(osm), F.when(~whole, F.lit(SAID_OSM_PARTS)).otherwise(F.coalesce(_said(bad_node, "osm.nodes[", SAID_OSM_NODE), _said(bad_way, "osm.ways[", SAID_OSM_WAY))))
    houses, each = _get(v, "$.houses"), _items(v, "$.houses")
    bad_house = [
        (_first(each, lambda h: ~_is(h, "OBJECT")), SAID_HOUSE_OBJECT),
        (_first(each, lambda h: ~(_is(_get(h, "$.lat"), *_NUMBER) & _is(_get(h, "$.lon"), *_NUMBER))), SAID_HOUSE_PLACE),
        (_first(each, lambda h: ~(_is(_get(h, "$.id"), "STRING") & _is(_get(h, "$.label"), "STRING") & _is(_get(h, "$.street"), "STRING"))), SAID_HOUSE_TEXTS),
    ]
    first_bad = F.array_min(F.array(*[F.struct(F.coalesce(i, F.lit(1 << 30)).alias("i"), F.lit(k).alias("k"), F.coalesce(_said(i, "houses[", said), F.lit("")).alias("said")) for k, (i, said) in enumerate(bad_house)]))["said"]
    houses_error = F.when(houses.isNotNull(), F.when(~_is(houses, "ARRAY"), F.lit(SAID_HOUSES)).otherwise(F.when(first_bad != "", first_bad)))

    def strings(name: str) -> Column:
        own = _get(v, f"$.{name}")
        good = _is(own, "ARRAY") & F.coalesce(F.forall(_items(v, f"$.{name}"), lambda x: _is(x, "STRING")), F.lit(False))
        return F.when(own.isNotNull() & ~good, F.lit(f"{name} must be an array of strings"))

    assignment = _get(v, "$.assignment")
    entries = F.map_entries(F.try_variant_get(v, "$.assignment", "map<string,variant>"))
    whole_number = lambda x: F.coalesce(_is(x, *_NUMBER) & (F.try_variant_get(x, "$", "double") % 1 == 0), F.lit(False))
    bad_entry = F.get(F.filter(entries, lambda e: ~whole_number(e["value"])), 0)["key"]
    assignment_error = F.when(assignment.isNotNull(), F.when(~_is(assignment, "OBJECT"), F.lit(SAID_ASSIGNMENT)).when(bad_entry.isNotNull(), F.concat(F.lit('assignment["'), bad_entry, F.lit('"] must be an integer'))))
    return F.coalesce(not_object, wrong_version, boundary_error, osm_error, houses_error, strings("removed"), assignment_error, strings("locked"), strings("lockedHouses"))


def parse_projects(texts: DataFrame) -> DataFrame:
    """area, error and the state's parts of projects (area, json): either all parts, or an error and none."""
    v = F.col("v")
    read = texts.select("area", F.try_parse_json("json").alias("v"))
    judged = read.withColumn("error", F.when(v.isNull(), F.lit(SAID_NOT_JSON)).otherwise(errors(v)))
    good = F.col("error").isNull()
    houses = F.transform(F.coalesce(F.try_variant_get(v, "$.houses", HOUSE), F.array().cast(HOUSE)), lambda h: h.withField("flagged", F.coalesce(h["flagged"], F.lit(False))).withField("manual", F.coalesce(h["manual"], F.lit(False))))
    strings = lambda name: F.coalesce(F.try_variant_get(v, f"$.{name}", "array<string>"), F.array().cast("array<string>"))
    parts = {
        "boundary": F.try_variant_get(v, "$.boundary", BOUNDARY),
        "osm": F.try_variant_get(v, "$.osm", OSM),
        "houses": houses,
        "removed": strings("removed"),
        "assignment": F.coalesce(F.try_variant_get(v, "$.assignment", "map<string,int>"), F.create_map().cast("map<string,int>")),
        "locked": strings("locked"),
        "lockedHouses": strings("lockedHouses"),
        "config": config(v),
    }
    return judged.select("area", "error", *[F.when(good, c).alias(n) for n, c in parts.items()])
