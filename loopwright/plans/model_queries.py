"""Queries that apply operators of the model, the solver's inputs, the map's queries and the printed pages to the views."""

from __future__ import annotations

from pyspark.sql import functions as F

from loopwright.checkpoints import written
from loopwright.functions import text as T
from loopwright.operators import edits, graph, neighbours, snap, stats
from loopwright.plans import views as V
from loopwright.plans.queries import _HOOD, _HOOD_PAIRS, _SNAPS, _edges, _grid_houses, _neighbourhoods, _snaps, many_areas
from loopwright.plans.registry import registered, rounded
from loopwright.sinks import export
from loopwright.sources import elements, houses

_ORDERS = f"orders_g AS (SELECT o_custkey AS house_id, (max(o_orderkey) % {V.GROUPS})::INTEGER AS g FROM orders GROUP BY o_custkey)"


def _orders_g(spark, sf_dir):
    return V.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("house_id")).agg((F.max("o_orderkey") % V.GROUPS).cast("int").alias("g"))


@registered("SELECT h.area, h.house_id, coalesce(o.g, -1)::INTEGER AS g FROM houses h LEFT JOIN orders_g o USING (house_id)", V.HOUSES_SQL, _ORDERS)
def edit_assigned(spark, sf_dir):
    """Houses with the group of their last order; -1 for those without one."""
    h = V.houses(spark, sf_dir).drop("g")
    return edits.assigned(h, h.select("area", "house_id").join(_orders_g(spark, sf_dir), "house_id")).select("area", "house_id", "g")


@registered(f"SELECT h.area, bool_and(o.g IS NOT NULL) AND count(DISTINCT o.g) = {V.GROUPS} AS valid FROM (SELECT area || '/' || (house_id // 200) AS area, house_id FROM houses) h LEFT JOIN orders_g o ON o.house_id = h.house_id GROUP BY h.area", V.HOUSES_SQL, _ORDERS)
def seed_validity(spark, sf_dir):
    """Whether the groups of last orders could start a solve, in each block of each area."""
    h = V.houses(spark, sf_dir).select(F.concat_ws("/", "area", F.floor(F.col("house_id") / 200).cast("string")).alias("area"), F.col("house_id").alias("h"))
    return stats.valid_start(h, h.join(_orders_g(spark, sf_dir).withColumnRenamed("house_id", "h"), "h"), V.GROUPS)


@registered("SELECT area, g, round(avg(x), 4) + 0 AS x, round(avg(y), 4) + 0 AS y FROM points GROUP BY area, g", V.POINTS_SQL)
def seed_centroids(spark, sf_dir):
    return stats.centroids(V.points(spark, sf_dir)).select("area", "g", rounded("x").alias("x"), rounded("y").alias("y"))


@registered("""SELECT h, arg_min(g, {'d': d, 'g': g}) AS nearest, round(min(d) FILTER (turn = 2) - min(d), 4) + 0 AS regret FROM (
    SELECT p.h, c.g, sqrt((p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y)) AS d, row_number() OVER (PARTITION BY p.h ORDER BY sqrt((p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y)), c.g) AS turn
    FROM points p, (SELECT g, avg(x) AS x, avg(y) AS y FROM points GROUP BY g) c) GROUP BY h""", V.POINTS_SQL)
def seed_regret(spark, sf_dir):
    """How much farther a point's second nearest centre is than its nearest."""
    p = V.points(spark, sf_dir)
    return stats.regrets(p, stats.centroids(p)).select("h", "nearest", rounded("regret").alias("regret"))


@registered("""SELECT i::VARCHAR AS i, row_number() OVER (PARTITION BY i ORDER BY metres, j::VARCHAR) AS rank, round(metres::DOUBLE, 2) AS metres FROM (
    SELECT i, j, (CASE WHEN beside THEN gap ELSE gap + 2 * off + 8 END)::FLOAT AS metres FROM pairs WHERE same AND i <> j)""", _HOOD, _HOOD_PAIRS)
@many_areas
def segment_mates(spark, sf_dir):
    """The houses of each house's segment by walking distance; in a neighbourhood every stretch between crossings is a segment."""
    m = _neighbourhoods(spark, sf_dir)[1]
    return neighbours.segment_mates(m.snaps, m.dist).select("i", F.col("rank").cast("bigint").alias("rank"), rounded(F.col("metres").cast("double"), 2).alias("metres"))


_BLOCKS = [
    "far AS (SELECT *, min(d) OVER (PARTITION BY house_id) AS bd FROM (SELECT house_id, same, block, sqrt(pow(px - (ax + t * (bx - ax)), 2) + pow(py - (ay + t * (by_ - ay)), 2)) AS d FROM ("
    " SELECT h.house_id, h.street = e.street AS same, e.block, px, py, ax, ay, bx, by_, least(1, greatest(0, ((px - ax) * (bx - ax) + (py - ay) * (by_ - ay)) / ((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)))) AS t"
    " FROM (SELECT house_id, street, (lon - rlon) * kx AS px, (lat - rlat) * ky AS py FROM houses, ref) h,"
    " (SELECT street, a // 40 AS block, (lon1 - rlon) * kx AS ax, (lat1 - rlat) * ky AS ay, (lon2 - rlon) * kx AS bx, (lat2 - rlat) * ky AS by_ FROM edges, ref) e)))",
    "on_block AS (SELECT house_id, coalesce(arg_min(block, d) FILTER (same AND d <= bd + 15), arg_min(block, d)) AS block FROM far GROUP BY house_id)",
    "main AS (SELECT arg_max(block, {'n': n, 'b': -block}) AS block FROM (SELECT block, count(*) AS n FROM on_block GROUP BY block))",
]


def _cut_off(spark, sf_dir):
    e = written(_edges(spark, sf_dir))
    return snap.disconnected(_snaps(spark, sf_dir), e, graph.node_components(V.nodes(spark, sf_dir), e))


@registered("SELECT house_id FROM on_block WHERE block <> (SELECT block FROM main)", V.HOUSES_SQL, V.NODES_SQL, V.EDGES_SQL, _SNAPS[0], *_BLOCKS)
def model_disconnected(spark, sf_dir):
    """Houses that are snapped to another part of the street network than most."""
    return _cut_off(spark, sf_dir).select("house_id")


@registered("""SELECT 'grid' AS area, (SELECT count(*) FROM houses WHERE flagged) AS flagged, n AS disconnected,
    CASE WHEN n > 0 THEN n || ' house(s) not connected to the main street network: remove them, or widen the boundary so that the road is inside' END AS reason FROM (SELECT count(*) AS n FROM on_block WHERE block <> (SELECT block FROM main))""", V.HOUSES_SQL, V.NODES_SQL, V.EDGES_SQL, _SNAPS[0], *_BLOCKS)
def model_warnings(spark, sf_dir):
    """What to warn of, and whether the area can be solved, by real snaps."""
    h, lost = _grid_houses(spark, sf_dir), written(_cut_off(spark, sf_dir))
    return stats.warnings(h, lost).join(snap.can_solve(h, lost), "area").select("area", "flagged", "disconnected", "reason")


@registered("SELECT DISTINCT area, house_id FROM houses WHERE (lat BETWEEN 42.00205 AND 42.00705 AND lon BETWEEN -88.29795 AND -88.29305 AND NOT flagged) OR manual", V.HOUSES_SQL)
def select_area(spark, sf_dir):
    """A rectangle's houses besides those that were chosen before."""
    h = V.houses(spark, sf_dir)
    found = edits.in_bounds(h, h.where("flagged"), 42.00205, -88.29795, 42.00705, -88.29305)
    return edits.select_area(h.where("manual"), found, True)


_RINGS = """rings AS (SELECT area, g, printf('%.6f %.6f %.6f %.6f %.6f %.6f %.6f %.6f', s, w, s, e, n, e, n, w) AS ring FROM (
    SELECT area, g, min(lat) - 0.0005::DOUBLE AS s, max(lat) + 0.0005::DOUBLE AS n, min(lon) - 0.0005::DOUBLE AS w, max(lon) + 0.0005::DOUBLE AS e FROM houses GROUP BY area, g))"""


@registered("""SELECT area, g, ring, '[out:json][timeout:90];' || chr(10) || '(' || chr(10)
    || '  way["highway"]["highway"!~"motorway|motorway_link|construction|proposed|abandoned|raceway"](poly:"' || ring || '");' || chr(10) || '  way["building"](poly:"' || ring || '");' || chr(10)
    || '  way["addr:housenumber"](poly:"' || ring || '");' || chr(10) || '  node["addr:housenumber"](poly:"' || ring || '");' || chr(10) || ');' || chr(10) || 'out body;' || chr(10) || '>;' || chr(10) || 'out skel qt;' AS query,
    'map:v2:' || format('{:x}', h.a::BIGINT) || format('{:x}', h.b::BIGINT) || '-' || format('{:x}', length(ring)) AS key
  FROM (SELECT area, g, ring, list_reduce(list_prepend({'a': 5381::HUGEINT, 'b': 2166136261::HUGEINT}, list_transform(str_split(ring, ''), lambda c: {'a': ascii(c)::HUGEINT, 'b': 0::HUGEINT})),
    lambda x, c: {'a': (x.a * 33 + c.a) % 4294967296, 'b': (xor(x.b, c.a) * 16777619) % 4294967296}) AS h FROM rings)""", V.HOUSES_SQL, _RINGS)
def map_query(spark, sf_dir):
    """The map server's query about the box of each group's houses, and the key that its answer is kept under."""
    box = houses.bounding_polygon(V.houses(spark, sf_dir).select(F.concat_ws("/", "area", F.col("g").cast("string")).alias("area"), "lat", "lon"))
    coordinates = F.array(F.transform("boundary", lambda v: F.array(v["lon"], v["lat"])))
    ring = elements.ring_of(coordinates)
    area = F.split("area", "/")
    return box.select(area[0].alias("area"), area[1].cast("int").alias("g"), T.poly_string(ring).alias("ring"), elements.build_query(ring).alias("query"), elements.cache_key(ring).alias("key"))


_COLOURS = ", ".join(f"'{c}'" for c in export.COLOURS)


@registered(f"""SELECT g, 'Group ' || (g + 1) AS name, CASE WHEN g < 0 THEN '{export.NO_COLOUR}' ELSE [{_COLOURS}][(g % {len(export.COLOURS)} + 1)::INTEGER] END AS colour, pos + 1 AS stop,
    printf('%.2f mi (%d m)', metres / 1609.344, floor(metres + 0.5)::BIGINT) AS leg, printf('%.2f mi (%d m)', walked / 1609.344, floor(walked + 0.5)::BIGINT) AS walked FROM (
      SELECT *, sum(metres) OVER (PARTITION BY g ORDER BY pos) AS walked FROM (
        SELECT g, pos, abs(value - coalesce(lead(value) OVER w, first_value(value) OVER w)) * 97.3137731::DOUBLE AS metres FROM stops WINDOW w AS (PARTITION BY g ORDER BY pos)))""", V.STOPS_SQL)
def export_stops(spark, sf_dir):
    """Each group's printed page: numbered stops, the way to the next one and the way so far."""
    legs = stats.tour_legs(V.stops(spark, sf_dir), ["value"]).withColumn("metres", F.abs(F.col("value") - F.col("n_value")) * 97.3137731)
    return export.stop_table(legs).select("g", "name", "colour", F.col("stop").cast("bigint").alias("stop"), "leg", "walked")

