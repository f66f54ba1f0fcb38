"""Queries that apply the operators to the views, each with its SQL where SQL can say it."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from loopwright.checkpoints import written
from loopwright.functions import geo
from loopwright.functions import text as T
from loopwright.operators import chains, cover, edits, graph, hubs, neighbours, snap, solver, stats, walking
from loopwright.operators.joins import merging
from loopwright.plans import views as V
from loopwright.plans.model import build_model
from loopwright.plans.registry import ORACLE_SQL, registered, rounded
from loopwright.schema import NEIGHBORS, Config, Weights
from loopwright.sinks import export
from loopwright.sources import synthetic

_HAVERSINE = "2 * 6371008.8::DOUBLE * asin(least(1, sqrt(pow(sin(radians(42.002::DOUBLE - lat) / 2), 2) + cos(radians(lat)) * cos(radians(42.002::DOUBLE)) * pow(sin(radians(-88.296::DOUBLE - lon) / 2), 2))))"


@registered(f"SELECT house_id, round({_HAVERSINE}, 4) AS metres FROM houses", V.HOUSES_SQL)
def geo_haversine(spark, sf_dir):
    return V.houses(spark, sf_dir).select("house_id", rounded(geo.haversine(F.col("lat"), F.col("lon"), F.lit(42.002), F.lit(-88.296))).alias("metres"))


@registered("SELECT house_id, round((lon + 88.3::DOUBLE) * (cos(radians(42::DOUBLE)) * (6371008.8::DOUBLE * pi() / 180)), 4) + 0 AS x, round((lat - 42::DOUBLE) * (6371008.8::DOUBLE * pi() / 180), 4) + 0 AS y FROM houses", V.HOUSES_SQL)
def geo_project(spark, sf_dir):
    x, y = geo.project(F.col("lat"), F.col("lon"), F.lit(42.0), F.lit(-88.3))
    return V.houses(spark, sf_dir).select("house_id", rounded(x).alias("x"), rounded(y).alias("y"))


@registered("""SELECT h, round(t, 4) + 0 AS t, round(sqrt((x - t * 0.5::DOUBLE) * (x - t * 0.5::DOUBLE) + (y - t * 0.25::DOUBLE) * (y - t * 0.25::DOUBLE)), 4) AS dist,
  CASE WHEN 0.5::DOUBLE * y - 0.25::DOUBLE * x >= 0 THEN 1 ELSE -1 END AS side FROM (SELECT *, least(1, greatest(0, (x * 0.5::DOUBLE + y * 0.25::DOUBLE) / 0.3125::DOUBLE)) AS t FROM points)""", V.POINTS_SQL)
def geo_point_to_segment(spark, sf_dir):
    t, d, side = geo.segment_projection(F.col("x"), F.col("y"), F.lit(0.0), F.lit(0.0), F.lit(0.5), F.lit(0.25))
    return V.points(spark, sf_dir).select("h", rounded(t).alias("t"), rounded(d).alias("dist"), side.alias("side"))


def _square() -> Column:
    return F.array(*[F.struct(F.lit(a).alias("lat"), F.lit(o).alias("lon")) for a, o in ((42.0005, -88.2995), (42.0005, -88.2945), (42.00655, -88.2945), (42.00655, -88.2995))])


@registered("SELECT house_id, lat > 42.0005 AND lat <= 42.00655 AND lon >= -88.2995 AND lon < -88.2945 AS inside FROM houses", V.HOUSES_SQL.replace("1e-4::DOUBLE AS lat", "1e-4::DOUBLE + 3e-5::DOUBLE AS lat").replace("1e-4::DOUBLE AS lon", "1e-4::DOUBLE + 3e-5::DOUBLE AS lon"))
def geo_point_in_ring(spark, sf_dir):
    return V.houses(spark, sf_dir).select("house_id", geo.point_in_ring(F.col("lat") + 3e-5, F.col("lon") + 3e-5, _square()).alias("inside"))


@registered("""SELECT o_orderkey AS pid, s_suppkey AS rid FROM (SELECT o_orderkey, 40 + o_orderkey * 7919 % 10007 * 1e-3::DOUBLE AS lat, -90 + o_orderkey * 104729 % 10009 * 1e-3::DOUBLE AS lon FROM orders)
  JOIN (SELECT s_suppkey, 40 + s_suppkey * 37 % 101 * 0.1::DOUBLE + 5e-5::DOUBLE AS y, -90 + s_suppkey * 53 % 103 * 0.1::DOUBLE + 5e-5::DOUBLE AS x, (s_suppkey % 7 + 1) * 0.1003::DOUBLE + 3.3e-5::DOUBLE AS r FROM supplier) ON abs(lat - y) + abs(lon - x) < r""")
def geo_points_in_rings(spark, sf_dir):
    """Orders as points in overlapping rings, one a supplier: squares on a corner."""
    k = F.col("o_orderkey")
    points = V.table(spark, sf_dir, "orders").select(k.alias("pid"), (40 + k * 7919 % 10007 * 1e-3).alias("lat"), (-90 + k * 104729 % 10009 * 1e-3).alias("lon"))
    s = F.col("s_suppkey")
    y, x, r = 40 + s * 37 % 101 * 0.1 + 5e-5, -90 + s * 53 % 103 * 0.1 + 5e-5, (s % 7 + 1) * 0.1003 + 3.3e-5
    corner = lambda dy, dx: F.struct((y + r * dy).alias("lat"), (x + r * dx).alias("lon"))
    rings = V.table(spark, sf_dir, "supplier").select(s.alias("rid"), F.array(corner(-1, 0), corner(0, 1), corner(1, 0), corner(0, -1)).alias("ring"))
    return cover.points_in_rings(points, rings)


@registered("SELECT area, g, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon FROM houses GROUP BY area, g", V.HOUSES_SQL)
def geo_ring_centroid(spark, sf_dir):
    rings = V.houses(spark, sf_dir).groupBy("area", "g").agg(F.collect_list(F.struct("lat", "lon")).alias("ring"))
    c = geo.ring_centroid(F.col("ring"))
    return rings.select("area", "g", rounded(c["lat"], 6).alias("lat"), rounded(c["lon"], 6).alias("lon"))


@registered("""SELECT g, round(abs(sum(plon * lat - lon * plat)) / 2, 4) AS area_deg FROM (
  SELECT g, value AS lat, pos::DOUBLE AS lon, coalesce(lag(value) OVER w, last_value(value) OVER f) AS plat, coalesce(lag(pos) OVER w, last_value(pos) OVER f)::DOUBLE AS plon FROM stops
  WINDOW w AS (PARTITION BY g ORDER BY pos), f AS (PARTITION BY g ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) GROUP BY g""", V.STOPS_SQL)
def geo_ring_area(spark, sf_dir):
    rings = V.stops(spark, sf_dir).groupBy("g").agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("s"))
    ring = F.transform("s", lambda s: F.struct(s["value"].alias("lat"), s["pos"].cast("double").alias("lon")))
    return rings.select("g", rounded(geo.ring_area(ring)).alias("area_deg"))


@registered("""SELECT area, round(CASE WHEN n - s < 0.02::DOUBLE THEN (n + s) / 2 - 0.01::DOUBLE ELSE s END, 6) AS south, round(CASE WHEN e - w < 0.02::DOUBLE THEN (w + e) / 2 - 0.01::DOUBLE ELSE w END, 6) AS west,
  round(CASE WHEN n - s < 0.02::DOUBLE THEN (n + s) / 2 + 0.01::DOUBLE ELSE n END, 6) AS north, round(CASE WHEN e - w < 0.02::DOUBLE THEN (w + e) / 2 + 0.01::DOUBLE ELSE e END, 6) AS east
  FROM (SELECT area, min(lat) s, max(lat) n, min(lon) w, max(lon) e FROM houses GROUP BY area)""", V.HOUSES_SQL)
def geo_bbox_fit(spark, sf_dir):
    box = export.fit_box(V.houses(spark, sf_dir), 0.02)
    return box.select("area", *[rounded(k, 6).alias(k) for k in ("south", "west", "north", "east")])


_MASKED = "& 4294967295::HUGEINT"


@registered(f"""SELECT k, xor(t3, t3 >> 14)::BIGINT / 4294967296::DOUBLE AS draw FROM (
  SELECT k, xor(t2, (t2 + ((xor(t2, t2 >> 7) * (t2 | 61::HUGEINT)) {_MASKED})) {_MASKED}) AS t3 FROM (
  SELECT k, (xor(s, s >> 15) * (s | 1::HUGEINT)) {_MASKED} AS t2 FROM (
  SELECT o_orderkey AS k, (o_custkey::HUGEINT + (o_orderkey::HUGEINT + 1) * 1831565813::HUGEINT) {_MASKED} AS s FROM orders)))""")
def rng_mulberry32(spark, sf_dir):
    o = V.table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("k"), geo.mulberry32(F.col("o_custkey"), F.col("o_orderkey")).alias("draw"))


#: Part names with a direction and a suffix around them, as street spellings.
_STREET_SQL = """streets AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name || ' St.' WHEN 1 THEN 'W ' || p_name || ' Ave' WHEN 2 THEN p_name || ' Cir W' ELSE p_name END AS street,
  regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g') AS p FROM part)"""


def _streets(spark, sf_dir):
    k, p = F.col("p_partkey"), F.col("p_name")
    spelled = F.when(k % 4 == 0, F.concat(p, F.lit(" St."))).when(k % 4 == 1, F.concat(F.lit("W "), p, F.lit(" Ave"))).when(k % 4 == 2, F.concat(p, F.lit(" Cir W"))).otherwise(p)
    return V.table(spark, sf_dir, "part").select("p_partkey", spelled.alias("street"), p.alias("p_name"), "p_brand")


@registered("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN trim(p) || ' street' WHEN 1 THEN 'west ' || trim(p) || ' avenue' WHEN 2 THEN 'west ' || trim(p) || ' circle' ELSE trim(p) END AS name FROM streets", _STREET_SQL)
def text_normalize_street(spark, sf_dir):
    return _streets(spark, sf_dir).select("p_partkey", T.normalize_street(F.col("street")).alias("name"))


@registered("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN trim(p) || ' street' WHEN 1 THEN trim(p) || ' avenue' WHEN 2 THEN trim(p) || ' circle' ELSE trim(p) END AS base FROM streets", _STREET_SQL)
def text_street_base(spark, sf_dir):
    return _streets(spark, sf_dir).select("p_partkey", T.street_base(F.col("street")).alias("base"))


@registered("SELECT p_partkey, CASE WHEN levenshtein(p_name, p_type) > 12 THEN 13 ELSE levenshtein(p_name, p_type)::INTEGER END AS distance FROM part")
def text_edit_distance(spark, sf_dir):
    return V.table(spark, sf_dir, "part").select("p_partkey", T.edit_distance(F.col("p_name"), F.col("p_type"), 12).alias("distance"))


@registered("""SELECT a.n AS a, b.n AS b FROM names a JOIN names b ON a.n < b.n AND length(a.n) >= 6 AND length(b.n) >= 6 AND a.n[1] = b.n[1] AND levenshtein(a.n, b.n) <= 2""", "names AS (SELECT DISTINCT lower(n_name) AS n FROM nation UNION SELECT DISTINCT lower(p_brand) FROM part)")
def text_fuzzy_pairs(spark, sf_dir):
    """Distinct names only, and only those of one first letter meet: an equi-join."""
    names = V.table(spark, sf_dir, "nation").select(F.lower("n_name").alias("n")).union(V.table(spark, sf_dir, "part").select(F.lower("p_brand"))).distinct().withColumn("first", F.substring("n", 1, 1))
    return names.select("first", F.col("n").alias("a")).join(names.select("first", F.col("n").alias("b")), "first").where((F.col("a") < F.col("b")) & T.fuzzy_same_street(F.col("a"), F.col("b"))).select("a", "b")


@registered("""SELECT p_partkey, p_partkey || 'W' || (p_partkey % 10) || ' ' || t || ' St' AS label, t || ' St' AS street FROM (
  SELECT p_partkey, array_to_string(list_transform(str_split_regex(trim(p_name), '\\s+'), lambda w: CASE WHEN regexp_matches(w, '\\d') OR regexp_matches(upper(w), '^(N|S|E|W|NE|NW|SE|SW|II|III|IV|VI|VII|VIII|IX|XI|XII)$') THEN upper(w) ELSE upper(w[1]) || lower(w[2:]) END), ' ') AS t FROM part)""")
def text_format_address(spark, sf_dir):
    raw = F.concat(F.col("p_partkey").cast("string"), F.lit("w"), (F.col("p_partkey") % 10).cast("string"), F.lit(" "), F.upper("p_name"), F.lit(" ST"))
    a = T.format_address(raw)
    return V.table(spark, sf_dir, "part").select("p_partkey", a["label"].alias("label"), a["street"].alias("street"))


@registered("SELECT c_custkey, CASE WHEN s[1] IN ('=', '+', '@', chr(9), chr(13)) OR (s[1] = '-' AND NOT regexp_matches(s, '^-[0-9]')) THEN '''' || s ELSE s END AS safe FROM raw", "raw AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '=' || c_name WHEN 1 THEN '-' || c_name WHEN 2 THEN '-' || c_custkey WHEN 3 THEN '@' || c_name ELSE c_name END AS s FROM customer)")
def csv_neutralise(spark, sf_dir):
    k, n = F.col("c_custkey"), F.col("c_name")
    s = F.when(k % 5 == 0, F.concat(F.lit("="), n)).when(k % 5 == 1, F.concat(F.lit("-"), n)).when(k % 5 == 2, F.concat(F.lit("-"), k.cast("string"))).when(k % 5 == 3, F.concat(F.lit("@"), n)).otherwise(n)
    return V.table(spark, sf_dir, "customer").select("c_custkey", T.neutralise(s).alias("safe"))


@registered("SELECT g::BIGINT AS g, printf('%.2f mi (%d m)', total / 1609.344, floor(total + 0.5)::BIGINT) AS shown FROM (SELECT user_id AS g, sum(round(value * 1000)) AS total FROM events GROUP BY user_id)")
def text_format_distance(spark, sf_dir):
    e = V.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("g")).agg(F.sum(F.round(F.col("value") * 1000)).alias("total"))
    return e.select("g", T.format_distance(F.col("total")).alias("shown"))


def _removed(spark, sf_dir):
    return V.table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "P").select(F.col("o_custkey").alias("house_id")).join(V.houses(spark, sf_dir).select("area", "house_id"), "house_id").distinct()


@registered("SELECT area, house_id FROM houses WHERE house_id NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')", V.HOUSES_SQL)
def filter_visible(spark, sf_dir):
    return edits.visible(V.houses(spark, sf_dir), _removed(spark, sf_dir)).select("area", "house_id")


@registered("SELECT area, house_id FROM houses WHERE lat BETWEEN 42.00205 AND 42.00705 AND lon BETWEEN -88.29795 AND -88.29305 AND house_id NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')", V.HOUSES_SQL)
def filter_bounds(spark, sf_dir):
    return edits.in_bounds(V.houses(spark, sf_dir), _removed(spark, sf_dir), 42.00205, -88.29795, 42.00705, -88.29305).select("area", "house_id")


@registered("SELECT area, house_id, segment IN (3, 11) OR house_id IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') AS locked FROM houses", V.HOUSES_SQL)
def filter_locked_flags(spark, sf_dir):
    h = V.houses(spark, sf_dir).withColumn("segment_key", F.col("segment").cast("string"))
    segments = h.select("area", "segment_key").where(F.col("segment_key").isin("3", "11")).distinct()
    own = V.table(spark, sf_dir, "orders").where(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_custkey").alias("house_id")).join(h.select("area", "house_id"), "house_id")
    return edits.locked_flags(h, segments, own).select("area", "house_id", "locked")


def _edges(spark, sf_dir):
    return graph.edges(V.nodes(spark, sf_dir), V.ways(spark, sf_dir))


def _block_edges(spark, sf_dir):
    return graph.edges(V.nodes(spark, sf_dir, blocks=True), V.ways(spark, sf_dir, blocks=True))


@registered("SELECT a, b, street, round(length, 4) AS length FROM edges", V.NODES_SQL, V.EDGES_SQL)
def graph_edges(spark, sf_dir):
    return _block_edges(spark, sf_dir).select("a", "b", "street", rounded("length").alias("length"))


@registered("SELECT node, count(*) AS degree FROM (SELECT a AS node FROM edges UNION ALL SELECT b FROM edges) GROUP BY node", V.NODES_SQL, V.EDGES_SQL)
def graph_degree(spark, sf_dir):
    return graph.ends_of(_block_edges(spark, sf_dir)).groupBy("node").agg(F.count("*").alias("degree"))


@registered("""SELECT node_id, dense_rank() OVER (PARTITION BY node_id // 40 ORDER BY label) - 1 AS component FROM (SELECT node_id, min(m) AS label FROM (
  SELECT n.node_id, r.node_id AS m FROM nodes n JOIN nodes r ON
    CASE WHEN (n.node_id // 10) % 4 = 3 THEN r.node_id = n.node_id ELSE (r.node_id // 40 = n.node_id // 40 AND (r.node_id // 10) % 4 <> 3) END) GROUP BY node_id)""", V.NODES_SQL)
def graph_components(spark, sf_dir):
    """The grid falls into blocks of three rows, and every fourth row into single nodes."""
    n = V.nodes(spark, sf_dir, blocks=True)
    return graph.node_components(n, _block_edges(spark, sf_dir)).select("node_id", F.col("component").cast("bigint").alias("component"))


_CHAINS = [
    "numbered AS (SELECT *, row_number() OVER (PARTITION BY a // 40 ORDER BY way_ord) - 1 AS edge, a // 40 AS block FROM edges)",
    "tips AS (SELECT block, edge, street, unnest([a, b]) AS node FROM numbered)",
    "joints AS (SELECT block, node, min(edge) AS x, max(edge) AS y FROM tips GROUP BY block, node HAVING count(*) = 2 AND min(street) = max(street) AND min(edge) < max(edge))",
    "beside AS (SELECT block, x, y FROM joints UNION ALL SELECT block, y, x FROM joints)",
    "l0 AS (SELECT block, edge, edge AS label FROM numbered)",
    *[f"l{i} AS MATERIALIZED (SELECT block, edge, min(label) AS label FROM (SELECT * FROM l{i - 1} UNION ALL SELECT l.block, b.y, l.label FROM l{i - 1} l JOIN beside b ON b.block = l.block AND b.x = l.edge) GROUP BY block, edge)" for i in range(1, 10)],
    "ends AS (SELECT t.block, label, node, count(*) AS n FROM tips t JOIN l9 USING (block, edge) GROUP BY t.block, label, node)",
    "chains AS (SELECT e.block, e.label, s.street || ':' || min(node) FILTER (n <> 2) || '-' || max(node) FILTER (n <> 2) AS key FROM ends e JOIN numbered s ON s.block = e.block AND s.edge = e.label GROUP BY e.block, e.label, s.street)",
]


@registered("SELECT n.a, n.b, dense_rank() OVER (PARTITION BY n.block ORDER BY l.label) - 1 AS segment, c.key FROM numbered n JOIN l9 l USING (block, edge) JOIN chains c ON c.block = n.block AND c.label = l.label", V.NODES_SQL, V.EDGES_SQL, *_CHAINS)
def graph_segments(spark, sf_dir):
    e = _block_edges(spark, sf_dir)
    return graph.segments(e).join(e.select("area", "edge", "a", "b"), ["area", "edge"]).select("a", "b", F.col("segment").cast("bigint").alias("segment"), "key")


@registered("""SELECT a, b, place, round(start_m, 4) + 0 AS start_m, a_first FROM (
    WITH RECURSIVE starts AS (SELECT block, label, min(node) FILTER (n <> 2) AS node FROM ends GROUP BY block, label),
    walk AS (
      SELECT e.block, l.label, e.edge, e.a, e.b, e.length, CASE WHEN e.a = s.node THEN e.b ELSE e.a END AS node, 0::BIGINT AS place, 0::DOUBLE AS start_m, e.a = s.node AS a_first
      FROM starts s JOIN l9 l ON l.block = s.block AND l.label = s.label JOIN numbered e ON e.block = l.block AND e.edge = l.edge WHERE s.node IN (e.a, e.b)
      UNION ALL
      SELECT e.block, w.label, e.edge, e.a, e.b, e.length, CASE WHEN e.a = w.node THEN e.b ELSE e.a END, w.place + 1, w.start_m + w.length, e.a = w.node
      FROM walk w JOIN l9 l ON l.block = w.block AND l.label = w.label JOIN numbered e ON e.block = l.block AND e.edge = l.edge WHERE w.node IN (e.a, e.b) AND e.edge <> w.edge)
    SELECT * FROM walk)""", V.NODES_SQL, V.EDGES_SQL, *_CHAINS)
def graph_along(spark, sf_dir):
    """Where each edge lies in its chain: its place, the metres before it, and which way it is walked."""
    e = written(_block_edges(spark, sf_dir))
    return chains.along(e, written(graph.segments(e))).join(e.select("area", "edge", "a", "b"), ["area", "edge"]).select("a", "b", "place", rounded("start_m").alias("start_m"), "a_first")


def _first_nodes(spark, sf_dir):
    return V.nodes(spark, sf_dir, blocks=True).groupBy("area").agg(F.min("node_id").alias("source"))


_WALK = [
    "ends AS (SELECT a, b, length FROM edges UNION ALL SELECT b, a, length FROM edges)", "w0 AS (SELECT min(node_id) AS node, 0::DOUBLE AS metres FROM nodes GROUP BY block)",
    *[f"w{i} AS MATERIALIZED (SELECT node, min(metres) AS metres FROM (SELECT node, metres FROM w{i - 1} UNION ALL SELECT b, metres + length FROM w{i - 1} JOIN ends ON a = node) GROUP BY node)" for i in range(1, 16)],
    "walk AS (SELECT * FROM w15)",
]


@registered("SELECT node, round(min(metres), 3) AS metres FROM walk GROUP BY node", V.NODES_SQL, V.EDGES_SQL, *_WALK)
def graph_shortest_path(spark, sf_dir):
    """From the first node of each block."""
    return graph.shortest_paths(_block_edges(spark, sf_dir), _first_nodes(spark, sf_dir)).select("node", rounded("metres", 3).alias("metres"))


@registered(ORACLE_SQL["graph_shortest_path"])
def graph_dijkstra(spark, sf_dir):
    return graph.dijkstra(_block_edges(spark, sf_dir), _first_nodes(spark, sf_dir)).select("node", rounded("metres", 3).alias("metres"))


@registered(ORACLE_SQL["graph_shortest_path"])
def graph_hub_distance(spark, sf_dir):
    """From the first node of each block to all within reach, by hub labels of all nodes."""
    labels = hubs.hub_labels(_block_edges(spark, sf_dir))
    nodes, first = V.nodes(spark, sf_dir, blocks=True), _first_nodes(spark, sf_dir)
    pairs = nodes.join(first, "area").select("area", F.col("source").alias("a"), F.col("node_id").alias("b"))
    alone = first.select(F.col("source").alias("node"), F.lit(0.0).alias("metres"))
    told = hubs.distances(labels, pairs.where("a <> b")).select(F.col("b").alias("node"), rounded("metres", 3).alias("metres"))
    return told.unionByName(alone)


@registered(ORACLE_SQL["graph_shortest_path"])
def graph_path(spark, sf_dir):
    """Paths from the first node of each block to all nodes within reach: the lengths of their edges add up to the shortest distance."""
    e, first = _block_edges(spark, sf_dir), _first_nodes(spark, sf_dir)
    wanted = V.nodes(spark, sf_dir, blocks=True).join(first, "area").select("area", F.col("source").alias("a"), F.col("node_id").alias("b"))
    steps = graph.path(e, wanted).where(F.size("nodes") > 0).select("area", "b", F.explode(F.expr("transform(nodes, (v, i) -> struct(v AS node, coalesce(get(nodes, i + 1), v) AS other))")).alias("s")).select("area", "b", "s.*")
    lengths = graph.ends_of(e).groupBy("area", "node", "other").agg(F.min("length").alias("length"))
    return steps.join(lengths, ["area", "node", "other"], "left").groupBy(F.col("b").alias("node")).agg(rounded(F.coalesce(F.sum("length"), F.lit(0.0)), 3).alias("metres"))


def _grid_houses(spark, sf_dir):
    return V.houses(spark, sf_dir).withColumn("area", F.lit("grid"))


_SNAPS = [
    "ref AS (SELECT lat AS rlat, lon AS rlon, cos(radians(lat)) * (6371008.8::DOUBLE * pi() / 180) AS kx, 6371008.8::DOUBLE * pi() / 180 AS ky FROM nodes ORDER BY node_id LIMIT 1)",
    """near AS (SELECT *, min(d) OVER (PARTITION BY house_id) AS bd FROM (
      SELECT house_id, same, sqrt(pow(px - (ax + t * (bx - ax)), 2) + pow(py - (ay + t * (by_ - ay)), 2)) AS d FROM (
        SELECT h.house_id, h.street = e.street AS same, px, py, ax, ay, bx, by_, least(1, greatest(0, ((px - ax) * (bx - ax) + (py - ay) * (by_ - ay)) / ((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)))) AS t
        FROM (SELECT house_id, street, (lon - rlon) * kx AS px, (lat - rlat) * ky AS py FROM houses, ref) h,
             (SELECT street, (lon1 - rlon) * kx AS ax, (lat1 - rlat) * ky AS ay, (lon2 - rlon) * kx AS bx, (lat2 - rlat) * ky AS by_ FROM edges, ref) e)))""",
    "snaps AS (SELECT house_id, coalesce(min(CASE WHEN same AND d <= bd + 15 THEN d END), min(bd)) AS metres, coalesce(bool_or(same AND d <= bd + 15), false) AS own FROM near GROUP BY house_id)",
]


def _snaps(spark, sf_dir):
    e = _edges(spark, sf_dir)
    h = _grid_houses(spark, sf_dir)
    found = snap.snap(h, V.nodes(spark, sf_dir), e, e.select("area", "edge", F.lit(0).alias("segment")))
    return found.join(e.select("area", "edge", F.col("street").alias("edge_street")), ["area", "edge"]).join(h.select("area", "house_id", "street"), ["area", "house_id"])


@registered("SELECT house_id, round(metres, 3) AS metres, own FROM snaps", V.HOUSES_SQL, V.NODES_SQL, V.EDGES_SQL, *_SNAPS)
def snap_nearest_tiered(spark, sf_dir):
    """Offset of each house, and whether it was snapped to its own street, which ties of nearest edges don't touch."""
    return _snaps(spark, sf_dir).select("house_id", rounded("offset", 3).alias("metres"), (F.col("street") == F.col("edge_street")).alias("own"))


@registered("SELECT own, count(*) AS houses, round(avg(metres), 3) AS mean_offset FROM snaps GROUP BY own", V.HOUSES_SQL, V.NODES_SQL, V.EDGES_SQL, *_SNAPS)
def snap_offset_summary(spark, sf_dir):
    met = _snaps(spark, sf_dir).groupBy((F.col("street") == F.col("edge_street")).alias("own"))
    return met.agg(F.count("*").alias("houses"), rounded(F.avg("offset"), 3).alias("mean_offset"))


def many_areas(query):
    """A query over tables of very many like areas, that compress to a small part of what their rows take in memory: no side of a join is broadcast for the size of its file, neither in the steps nor in the last one, which is written too."""

    @wraps(query)
    def run(spark, sf_dir):
        with merging(spark):
            return written(query(spark, sf_dir))

    return run


#: On a grid of streets the shortest way goes straight up and over, along the northern of both rows, which is the shorter by a hair.
_HOOD = f"""hood AS (
  SELECT c_custkey AS k, c_custkey // {V.NEIGHBOURHOOD} AS area, slot, r, rest // {2 * V.PER_EDGE} AS c, (rest % {2 * V.PER_EDGE} // 2 + 0.1::DOUBLE + c_custkey * 31 % 89 / 89.0::DOUBLE * 0.8::DOUBLE) / {V.PER_EDGE} AS f,
         CASE WHEN slot % 2 = 0 THEN 1 ELSE -1 END AS side, 2 * 6371008.8::DOUBLE * asin(cos(radians(42 + r * 0.0009::DOUBLE)) * sin(radians(0.0012::DOUBLE) / 2)) AS step
  FROM (SELECT c_custkey, c_custkey % {V.NEIGHBOURHOOD} AS slot, c_custkey % {V.NEIGHBOURHOOD} // {V.NEIGHBOURHOOD // V.ROWS} AS r, c_custkey % {V.NEIGHBOURHOOD} % {V.NEIGHBOURHOOD // V.ROWS} AS rest FROM customer))"""
_HOOD_PAIRS = """pairs AS (
  SELECT a.k AS i, b.k AS j, a.area, a.r = b.r AND a.c = b.c AS same, a.side = b.side AS beside, abs(a.f - b.f) * a.step AS gap, 0.00015::DOUBLE * 6371008.8::DOUBLE * pi() / 180 AS off,
         abs(a.r - b.r) * radians(0.0009::DOUBLE) * 6371008.8::DOUBLE AS over, greatest(a.step, 0) AS sa, b.step AS sb, least(a.step, b.step) AS s, a.c AS ca, b.c AS cb, a.f AS fa, b.f AS fb
  FROM hood a JOIN hood b ON a.area = b.area)"""


@registered("""SELECT i::VARCHAR AS i, j::VARCHAR AS j, round((CASE WHEN i = j THEN 0 WHEN same AND beside THEN gap WHEN same THEN gap + 2 * off + 8
    ELSE 2 * off + over + least(fa * sa + abs(ca - cb) * s + fb * sb, fa * sa + abs(ca - cb - 1) * s + (1 - fb) * sb, (1 - fa) * sa + abs(ca + 1 - cb) * s + fb * sb, (1 - fa) * sa + abs(ca - cb) * s + (1 - fb) * sb) END)::FLOAT::DOUBLE, 2) AS metres FROM pairs""", _HOOD, _HOOD_PAIRS)
def dist_house_pairs(spark, sf_dir):
    """All walking distances inside every neighbourhood."""
    return _neighbourhoods(spark, sf_dir)[1].dist.select("i", "j", rounded(F.col("metres").cast("double"), 2).alias("metres"))


@registered("""SELECT i::VARCHAR AS i, rank, round(metres::DOUBLE, 2) AS metres FROM (SELECT i, metres, row_number() OVER (PARTITION BY i ORDER BY metres, j::VARCHAR) AS rank FROM (
    SELECT i, j, (CASE WHEN same AND beside THEN gap WHEN same THEN gap + 2 * off + 8
      ELSE 2 * off + over + least(fa * sa + abs(ca - cb) * s + fb * sb, fa * sa + abs(ca - cb - 1) * s + (1 - fb) * sb, (1 - fa) * sa + abs(ca + 1 - cb) * s + fb * sb, (1 - fa) * sa + abs(ca - cb) * s + (1 - fb) * sb) END)::FLOAT AS metres FROM pairs WHERE i <> j)) WHERE rank <= 8""", _HOOD, _HOOD_PAIRS)
@many_areas
def dist_nearest(spark, sf_dir):
    """The eight nearest houses of every house by walking: a truncated search from all houses, no pairs of an area."""
    g = V.neighbourhoods(spark, sf_dir)
    e = written(graph.edges(g["nodes"], g["ways"]))
    s = written(snap.snap(g["houses"], g["nodes"], e, e.select("area", "edge", F.lit(0).alias("segment"))))
    return walking.nearest_houses(s, e, NEIGHBORS).select("i", F.col("rank").cast("bigint").alias("rank"), rounded(F.col("metres").cast("double"), 2).alias("metres"))


_KNN = "knn AS (SELECT h, j, rank FROM (SELECT a.h, b.h AS j, row_number() OVER (PARTITION BY a.h ORDER BY sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), b.h) AS rank FROM points a JOIN points b ON a.h <> b.h) WHERE rank <= 6)"


def _knn(spark, sf_dir):
    return neighbours.nearest(V.points(spark, sf_dir))


@registered("SELECT h, j, rank::INTEGER AS rank FROM knn", V.POINTS_SQL, _KNN)
def knn_spatial(spark, sf_dir):
    return _knn(spark, sf_dir).select("h", "j", "rank")


@registered("SELECT count(*) AS links, count(*) FILTER (a.g <> b.g) AS cut FROM knn JOIN points a ON a.h = knn.h JOIN points b ON b.h = knn.j", V.POINTS_SQL, _KNN)
def knn_cut_links(spark, sf_dir):
    return neighbours.cut_links(_knn(spark, sf_dir), V.points(spark, sf_dir)).select("links", "cut")


@registered("SELECT a.g, count(*) FILTER (a.g <> b.g) AS cut FROM knn JOIN points a ON a.h = knn.h JOIN points b ON b.h = knn.j GROUP BY a.g", V.POINTS_SQL, _KNN)
def knn_cut_by_group(spark, sf_dir):
    met = neighbours._grouped(_knn(spark, sf_dir), V.points(spark, sf_dir))
    return met.groupBy("g").agg(F.count_if(F.col("g") != F.col("gj")).alias("cut"))


@registered("""SELECT coalesce(sum((coalesce(ma, a.g) <> coalesce(mb, b.g))::INT - (a.g <> b.g)::INT), 0)::BIGINT AS delta FROM knn JOIN p a ON a.h = knn.h JOIN p b ON b.h = knn.j, LATERAL (SELECT a.m AS ma, b.m AS mb) WHERE a.m IS NOT NULL OR b.m IS NOT NULL""",
            V.POINTS_SQL, _KNN, f"p AS (SELECT *, CASE WHEN h % 11 = 0 THEN (g + 1) % {V.GROUPS} END AS m FROM points)")
def knn_cut_delta(spark, sf_dir):
    p = V.points(spark, sf_dir)
    moves = p.where(F.col("h") % 11 == 0).select("area", "h", ((F.col("g") + 1) % V.GROUPS).alias("to"))
    return neighbours.cut_delta(_knn(spark, sf_dir), p, moves).select("delta")


@registered("""SELECT p.h, arg_min(q.g, {'d': sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)), 'j': q.h}) AS g FROM points p JOIN points q ON q.h % 7 <> 0 WHERE p.h % 7 = 0 GROUP BY p.h""", V.POINTS_SQL)
def adopt_nearest(spark, sf_dir):
    """Points without a group take that of their nearest one with a group."""
    p = V.points(spark, sf_dir).withColumn("g", F.when(F.col("h") % 7 == 0, F.lit(-1)).otherwise(F.col("g")))
    return neighbours.adopt_spatial(p, V.GROUPS).where("changed").select("h", "g")


_EVERY = f"every AS (SELECT a.area, r.g::INTEGER AS g FROM (SELECT DISTINCT area FROM houses) a, (SELECT unnest(range({V.GROUPS})) AS g) r)"
_SIZES = "sizes AS (SELECT e.area, e.g, count(h.house_id) AS houses, coalesce(sum(h.house_id % 1000), 0)::DOUBLE AS length FROM every e LEFT JOIN houses h ON h.area = e.area AND h.g = e.g GROUP BY e.area, e.g)"


def _stats(spark, sf_dir):
    h = V.houses(spark, sf_dir)
    lengths = h.groupBy("area", "g").agg(F.sum(F.col("h") % 1000).cast("double").alias("length"))
    return stats.group_stats(h, lengths, V.GROUPS)


@registered("""SELECT area, g, houses, length, round((length / 1.2::DOUBLE + houses * 20) / 60, 4) AS minutes, round(houses - avg(houses) OVER (PARTITION BY area), 4) AS delta, -1::BIGINT AS street_changes FROM sizes""", V.HOUSES_SQL, _EVERY, _SIZES)
def stats_group(spark, sf_dir):
    return _stats(spark, sf_dir).select("area", "g", "houses", "length", rounded("minutes").alias("minutes"), rounded("delta").alias("delta"), "street_changes")


@registered("SELECT e.area, e.g, e.g || ':' || coalesce(string_agg(h.h::VARCHAR, ',' ORDER BY h.h), '') AS signature FROM every e LEFT JOIN houses h ON h.area = e.area AND h.g = e.g GROUP BY e.area, e.g", V.HOUSES_SQL, _EVERY)
def tour_signature(spark, sf_dir):
    return stats.members(V.houses(spark, sf_dir), V.GROUPS).select("area", "g", T.members_signature(F.col("g"), F.col("members")).alias("signature"))


@registered("SELECT area, count(*) FILTER (n > 1) AS split, count(*) AS streets FROM (SELECT area, street, count(DISTINCT g) AS n FROM houses WHERE NOT flagged GROUP BY area, street) GROUP BY area", V.HOUSES_SQL)
def stats_split_streets(spark, sf_dir):
    return stats.split_streets(V.houses(spark, sf_dir).where(~F.col("flagged")))


@registered("""SELECT g, sum(CASE WHEN n >= 2 AND street <> coalesce(next, first) THEN 1 ELSE 0 END)::BIGINT AS changes FROM (
  SELECT g, street, lead(street) OVER w AS next, first_value(street) OVER w AS first, count(*) OVER (PARTITION BY g) AS n FROM stops WINDOW w AS (PARTITION BY g ORDER BY pos)) GROUP BY g""", V.STOPS_SQL)
def stats_street_changes(spark, sf_dir):
    return stats.street_changes(V.stops(spark, sf_dir)).select("g", "changes")


@registered("""SELECT area, segment, coalesce(arg_max(g, {'n': n, 'f': -first}), -1)::INTEGER AS g FROM (SELECT area, segment, g, count(*) AS n, min(ord) AS first FROM houses GROUP BY area, segment, g) GROUP BY area, segment""", V.HOUSES_SQL)
def stats_majority_group(spark, sf_dir):
    return stats.majority_groups(V.houses(spark, sf_dir))


@registered("SELECT area, arg_max(component, {'n': n, 'c': -component}) AS main FROM (SELECT area, segment % 7 AS component, count(*) AS n FROM houses GROUP BY area, segment % 7) GROUP BY area", V.HOUSES_SQL)
def stats_main_component(spark, sf_dir):
    return graph.main_component(V.houses(spark, sf_dir).select("area", (F.col("segment") % 7).alias("component")))


@registered("""SELECT area, round(score, 4) AS score, round(spread, 4) AS spread, round(violation, 4) AS violation, round(score + 2.5::DOUBLE * 30 * cut + 3 * spread, 4) AS objective FROM (
  SELECT area, max(length) + 0.3::DOUBLE * sum(length) AS score, sum(abs(houses - mean)) AS spread, sum(greatest(0, abs(houses - mean) - greatest(2, floor(0.1::DOUBLE * mean)))) AS violation, max(houses) AS cut
  FROM (SELECT *, avg(houses) OVER (PARTITION BY area) AS mean FROM sizes) GROUP BY area)""", V.HOUSES_SQL, _EVERY, _SIZES)
def stats_objective(spark, sf_dir):
    s = _stats(spark, sf_dir)
    cut = s.groupBy("area").agg(F.max("houses").alias("cut"))
    return stats.objective(s, cut, Weights()).select("area", *[rounded(c).alias(c) for c in ("score", "spread", "violation", "objective")])


@registered("""SELECT area, g, houses, round(houses - mean, 4) AS delta FROM (SELECT *, avg(houses) OVER (PARTITION BY area) AS mean FROM sizes) WHERE abs(houses - mean) > 1 QUALIFY row_number() OVER (PARTITION BY area ORDER BY g) = 1""", V.HOUSES_SQL, _EVERY, _SIZES)
def stats_off_balance(spark, sf_dir):
    return stats.off_balance(_stats(spark, sf_dir), F.lit(1.0)).select("area", "g", "houses", rounded("delta").alias("delta"))


@registered("""SELECT e.area, e.g, count(s.house_id) AS n FROM (SELECT a.area, r.g::INTEGER AS g FROM (SELECT DISTINCT area FROM sel) a, (SELECT unnest(range(-1, 4)) AS g) r) e LEFT JOIN sel s ON s.area = e.area AND s.grp = e.g GROUP BY e.area, e.g""",
            V.HOUSES_SQL, "sel AS (SELECT area, house_id, CASE WHEN g < 4 THEN g ELSE -1 END AS grp FROM houses WHERE flagged)")
def stats_selection_summary(spark, sf_dir):
    h = V.houses(spark, sf_dir)
    return stats.selection_summary(h.where("flagged").select("area", "h"), h.select("area", "h", "g"), 4)


@registered("SELECT area, count(*) FILTER (flagged) AS flagged, count(*) FILTER (segment = 39) AS disconnected FROM houses GROUP BY area", V.HOUSES_SQL)
def stats_warnings(spark, sf_dir):
    h = V.houses(spark, sf_dir)
    return stats.warnings(h, h.where("segment = 39"))


_LEGS = "legs AS (SELECT g, pos, h, abs(value - coalesce(lead(value) OVER w, first_value(value) OVER w)) AS metres, count(*) OVER (PARTITION BY g) AS n FROM stops WINDOW w AS (PARTITION BY g ORDER BY pos))"


def _leg_metres(spark, sf_dir):
    s = V.stops(spark, sf_dir)
    return s, stats.tour_legs(s, ["h", "value"]).select("area", F.col("h").alias("i"), F.col("n_h").alias("j"), F.abs(F.col("value") - F.col("n_value")).alias("metres"))


@registered("SELECT g, round(CASE WHEN max(n) > 1 THEN sum(metres) ELSE 0 END, 4) AS length FROM legs GROUP BY g", V.STOPS_SQL, _LEGS)
def tour_length(spark, sf_dir):
    s, d = _leg_metres(spark, sf_dir)
    return stats.tour_lengths(s, d).select("g", rounded("length").alias("length"))


@registered("""SELECT g, h, (CASE WHEN n < 3 THEN pos ELSE (pos - last - 1 + 2 * n) % n END)::INTEGER AS pos FROM (SELECT *, arg_max(pos, {'m': metres, 'p': -pos}) OVER (PARTITION BY g) AS last FROM legs)""", V.STOPS_SQL, _LEGS)
def tour_rotate(spark, sf_dir):
    s, d = _leg_metres(spark, sf_dir)
    return stats.rotate_tours(s, d).select("g", "h", F.col("pos").cast("int").alias("pos"))


@registered("SELECT o_custkey AS house_id, max(o_orderkey) % 6 AS g FROM orders GROUP BY o_custkey HAVING arg_max(o_orderstatus, o_orderkey) <> 'F'")
def edit_overlay(spark, sf_dir):
    """Orders as an edit log: the last edit of a house holds; a finished order clears it."""
    log = V.table(spark, sf_dir, "orders").select(F.lit("a").alias("area"), F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("house_id"), F.when(F.col("o_orderstatus") != "F", F.col("o_orderkey") % 6).alias("g"))
    return edits.state_at(log, ["house_id"], "g").select("house_id", "g")


@registered("SELECT coalesce(h.house_id, u.house_id) AS house_id, coalesce(u.g, h.g)::BIGINT AS g FROM (SELECT house_id, g FROM houses WHERE NOT flagged) h FULL JOIN (SELECT o_custkey AS house_id, max(o_orderkey % 6) AS g FROM orders GROUP BY o_custkey) u ON u.house_id = h.house_id", V.HOUSES_SQL)
def edit_move(spark, sf_dir):
    h = V.houses(spark, sf_dir).where(~F.col("flagged")).select(F.lit("a").alias("area"), "house_id", F.col("g").cast("bigint").alias("g"))
    u = V.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("house_id")).agg(F.max(F.col("o_orderkey") % 6).alias("g")).withColumn("area", F.lit("a"))
    return edits.move(h, u).select("house_id", "g")


@registered("SELECT area, house_id FROM houses WHERE NOT flagged UNION ALL SELECT area, house_id FROM houses WHERE manual", V.HOUSES_SQL)
def edit_merge_fetched(spark, sf_dir):
    h = V.houses(spark, sf_dir)
    return edits.merge_fetched(h.where(~F.col("flagged")), h).select("area", "house_id")


@registered("""SELECT area, house_id FROM houses h WHERE (flagged OR manual) AND NOT (manual AND area IN (SELECT area FROM houses WHERE manual GROUP BY area HAVING bool_and(flagged)))""", V.HOUSES_SQL)
def edit_toggle_lock(spark, sf_dir):
    h = V.houses(spark, sf_dir)
    return edits.toggle_locks(h.where("flagged"), h.where("manual"))


@registered("""SELECT area, g + 1 AS "group", row_number() OVER (PARTITION BY area, g ORDER BY house_id) AS "order", CASE WHEN flagged THEN street || ' (no address)' ELSE label END AS address, lat, lon FROM houses""", V.HOUSES_SQL)
def export_rows(spark, sf_dir):
    h = V.houses(spark, sf_dir).withColumn("segment_street", F.lit(None).cast("string"))
    tours = h.groupBy("area", "g").agg(F.sort_array(F.collect_list("house_id")).alias("order"))
    got = export.rows(tours, h.drop("g"))
    return got.select("area", "group", F.col("order").cast("bigint").alias("order"), "address", "lat", "lon")


@registered("""SELECT area, g, 'Group ' || (g + 1) AS name, houses, printf('%.2f mi (%d m)', length / 1609.344, floor(length + 0.5)::BIGINT) AS loop, floor((length / 1.2::DOUBLE + houses * 20) / 60 + 0.5)::BIGINT || ' min' AS time FROM sizes""", V.HOUSES_SQL, _EVERY, _SIZES)
def export_overview(spark, sf_dir):
    return export.overview(_stats(spark, sf_dir)).select("area", "g", "name", "houses", "loop", "time")


@registered("""SELECT r * 5 + c + 1 AS node_id, round(42 + r * 0.0009::DOUBLE, 6) AS lat, round(-88.3 + c * 0.0012::DOUBLE, 6) AS lon FROM (SELECT unnest(range(5)) AS r) a, (SELECT unnest(range(5)) AS c) b""")
def synthetic_nodes(spark, sf_dir):
    return synthetic.grid(spark, 5, 5, 3)["nodes"].select("node_id", rounded("lat", 6).alias("lat"), rounded("lon", 6).alias("lon"))


@registered("""SELECT 'h' || r || '_' || c || '_' || k || '_' || s AS house_id, (k + 1) || ' Row ' || r AS label, round(42 + r * 0.0009::DOUBLE + CASE WHEN s = '+' THEN 0.00015::DOUBLE ELSE -0.00015::DOUBLE END, 6) AS lat, round(-88.3 + (c + (k + 0.5::DOUBLE) / 3) * 0.0012::DOUBLE, 6) AS lon
  FROM (SELECT unnest(range(5)) AS r) a, (SELECT unnest(range(4)) AS c) b, (SELECT unnest(range(3)) AS k) d, (SELECT unnest(['+', '-']) AS s) e""")
def synthetic_houses(spark, sf_dir):
    return synthetic.grid(spark, 5, 5, 3)["houses"].select("house_id", "label", rounded("lat", 6).alias("lat"), rounded("lon", 6).alias("lon"))


def _neighbourhoods(spark, sf_dir):
    """The customers' neighbourhoods and their model; see many_areas."""
    g = V.neighbourhoods(spark, sf_dir)
    with merging(spark):
        return g, build_model(g["houses"], g["nodes"], g["ways"])


def _wrong_lengths(found, dist):
    """Adds `wrong`: whether a loop's length isn't the sum of its legs. `found` has area, run, g, tour, length."""
    stops = found.select(F.col("area").alias("own"), F.concat_ws("/", "area", F.col("run").cast("string")).alias("area"), "run", "g", F.posexplode("tour").alias("pos", "h"))
    legs = stats.tour_legs(stops, ["h"]).where("n_stops > 1").join(dist.select(F.col("area").alias("own"), F.col("i").alias("h"), F.col("j").alias("n_h"), "metres"), ["own", "h", "n_h"])
    sums = legs.groupBy(F.col("own").alias("area"), "run", "g").agg(F.sum(F.col("metres").cast("double")).alias("legs"))
    return found.join(sums, ["area", "run", "g"], "left").withColumn("wrong", F.abs(F.col("length") - F.coalesce("legs", F.lit(0.0))) > 0.01)


@registered("SELECT (c_custkey // 48)::VARCHAR AS area, run, count(*) AS houses, count(*) AS different, 6::BIGINT AS groups, 0::BIGINT AS empty, 0::BIGINT AS off, true AS feasible, 0::BIGINT AS wrong FROM customer, (SELECT unnest([0, 1]) AS run) GROUP BY c_custkey // 48, run")
@many_areas
def solve_partition(spark, sf_dir):
    """Groups and loops of every area under two seeds, told by what must hold: each house in one loop, sizes within tolerance, lengths of loops that are those of their legs."""
    g, m = _neighbourhoods(spark, sf_dir)
    config = Config()
    runs = solver.sweep(g["houses"], [1, 2], config.groups, config.iterations, [config.weights])
    found = written(solver.solve_runs(m.solver_houses(), m.dist, runs))
    size = F.size("tour")
    mean = F.avg(size).over(Window.partitionBy("area", "run"))
    judged = _wrong_lengths(found, m.dist).withColumn("off", F.abs(size - mean) > F.greatest(F.lit(config.weights.tolerance), F.floor(config.weights.toleranceFrac * mean)))
    sums = judged.groupBy("area", "run").agg(F.sum(size).alias("houses"), F.count("*").alias("groups"), F.count_if(size == 0).alias("empty"), F.count_if("off").alias("off"), F.bool_and("feasible").alias("feasible"), F.count_if("wrong").alias("wrong"))
    different = found.select("area", "run", F.explode("tour").alias("h")).groupBy("area", "run").agg(F.count_distinct("h").alias("different"))
    return sums.join(different, ["area", "run"]).select("area", "run", "houses", "different", "groups", "empty", "off", "feasible", "wrong")


@registered("SELECT a.area, a.g, count(c_custkey) AS stops, count(c_custkey) AS different, false AS wrong, false AS longer FROM (SELECT DISTINCT (c_custkey // 48)::VARCHAR AS area, g FROM customer, (SELECT unnest(range(4))::INTEGER AS g)) a LEFT JOIN customer ON (c_custkey // 48)::VARCHAR = a.area AND c_custkey % 48 // 12 = a.g GROUP BY a.area, a.g")
@many_areas
def solve_tours(spark, sf_dir):
    """Re-routing: a loop for each street row of every area, one task a group; it holds each house once, has its legs' length, and is no longer than the houses in their order."""
    g, m = _neighbourhoods(spark, sf_dir)
    row = F.regexp_extract("street", r"(\d+)$", 1).cast("int")
    a = g["houses"].select("area", F.col("house_id").alias("h"), row.alias("g"))
    found = _wrong_lengths(written(solver.route_groups(a, m.dist, V.ROWS)).withColumn("run", F.lit(0)), m.dist)
    in_order = stats.tour_lengths(a.withColumn("pos", F.row_number().over(Window.partitionBy("area", "g").orderBy("h"))), m.dist).withColumnRenamed("length", "plain")
    longer = F.coalesce(F.col("length") > F.col("plain") + 0.01, F.lit(False))
    return found.join(in_order, ["area", "g"], "left").select("area", "g", F.size("tour").cast("bigint").alias("stops"), F.size(F.array_distinct("tour")).cast("bigint").alias("different"), "wrong", longer.alias("longer"))


@registered("""SELECT area, round(sum(share), 6) AS overlap FROM (SELECT area, g, b, avg(inside::INT) AS share FROM (
    SELECT area, h, g, b, max(gap) <= pi() AS inside FROM (
      SELECT p.area, p.h, p.g, q.g AS b, atan2(q.y - p.y, q.x - p.x) AS angle, coalesce(lead(atan2(q.y - p.y, q.x - p.x)) OVER w, first_value(atan2(q.y - p.y, q.x - p.x)) OVER w + 2 * pi()) - atan2(q.y - p.y, q.x - p.x) AS gap
      FROM points p JOIN points q ON p.g <> q.g WINDOW w AS (PARTITION BY p.h, q.g ORDER BY atan2(q.y - p.y, q.x - p.x))) GROUP BY area, h, g, b) GROUP BY area, g, b) GROUP BY area""", V.POINTS_SQL)
def eval_hull_overlap(spark, sf_dir):
    """A point is inside a hull if, seen from it, the hull's points leave no gap of more than half a turn: so says the SQL."""
    p = V.points(spark, sf_dir)
    return stats.hull_overlap(p, solver.hulls(p)).select("area", rounded("overlap", 6).alias("overlap"))


@registered("""SELECT area, count(*) AS houses, round(avg(house_id % 31), 4) AS mean_offset, round(avg((street <> 'Row 1')::INT), 6) AS wrong_rate, 0::BIGINT AS unnamed,
  (SELECT count(DISTINCT street) FROM houses x WHERE x.area = h.area) AS streets, (SELECT count(*) FROM (SELECT street FROM houses x WHERE x.area = h.area GROUP BY street HAVING count(DISTINCT g) > 1)) AS split_streets,
  (SELECT coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n FROM houses x WHERE x.area = h.area GROUP BY street HAVING count(DISTINCT g) > 1)) AS split_street_houses,
  (SELECT count(DISTINCT segment) FROM houses x WHERE x.area = h.area) AS segments, (SELECT count(*) FROM (SELECT segment FROM houses x WHERE x.area = h.area GROUP BY segment HAVING count(DISTINCT g) > 1)) AS split_segments
  FROM houses h GROUP BY area""", V.HOUSES_SQL)
def eval_report(spark, sf_dir):
    h = V.houses(spark, sf_dir).withColumn("offset", (F.col("h") % 31).cast("double")).withColumn("edge_street", F.lit("Row 1"))
    r = stats.evaluation(h)
    return r.withColumn("mean_offset", rounded("mean_offset")).withColumn("wrong_rate", rounded("wrong_rate", 6))
