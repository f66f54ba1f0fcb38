"""Snapping houses to street edges, and walking distances between snapped houses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loopwright.checkpoints import drop, written
from loopwright.functions import geo
from loopwright.functions import text as T
from loopwright.operators.graph import capped
from loopwright.schema import SAME_STREET_TOLERANCE_M

#: Width of the cells that houses and edges meet in first.
CELL_M = 150.0


def _names(df: DataFrame) -> DataFrame:
    """Distinct streets of an area with canonical and base names: names are worked out once, not once a row."""
    return df.select("area", "street").distinct().withColumn("name", T.normalize_street(F.col("street"))).withColumn("base", T.street_base(F.col("street")))


def street_matches(houses: DataFrame, edge_table: DataFrame) -> DataFrame:
    """area, house_street, edge_street, tier: 1 canonical, 2 base, 3 near spelling of the base. Distinct names meet distinct names."""
    h = _names(houses).select("area", F.col("street").alias("house_street"), F.col("name").alias("hn"), F.col("base").alias("hb")).where("hn <> ''")
    e = _names(edge_table).select("area", F.col("street").alias("edge_street"), F.col("name").alias("en"), F.col("base").alias("eb"))
    tier = F.when(F.col("hn") == F.col("en"), 1).when(F.col("hb") == F.col("eb"), 2).when(T.fuzzy_same_street(F.col("eb"), F.col("hb")), 3)
    return h.join(e, "area").select("area", "house_street", "edge_street", tier.cast("int").alias("tier")).where("tier is not null")


def _places(nodes: DataFrame, edge_table: DataFrame) -> DataFrame:
    """Edges with the coordinates of their ends, projected about the area's first node."""
    at = nodes.groupBy("area", "node_id").agg(F.min_by(F.struct("lat", "lon"), "ord").alias("at"))
    ref = nodes.groupBy("area").agg(F.min_by(F.struct("lat", "lon"), "ord").alias("ref"))
    end = lambda k: at.select("area", F.col("node_id").alias(k), F.col("at").alias(f"p{k}"))
    met = edge_table.join(end("a"), ["area", "a"]).join(end("b"), ["area", "b"]).join(ref, "area")
    xy = [c.alias(n) for k in ("a", "b") for c, n in zip(geo.project(F.col(f"p{k}.lat"), F.col(f"p{k}.lon"), F.col("ref.lat"), F.col("ref.lon")), (f"{k}x", f"{k}y"))]
    return met.select("*", *xy)


def snap(houses: DataFrame, nodes: DataFrame, edge_table: DataFrame, segment_table: DataFrame, cell_m: float = CELL_M, tolerance: float = SAME_STREET_TOLERANCE_M) -> DataFrame:
    """area, house_id, edge, along, side, segment, point, offset: each house's edge.

    Of the edges on the house's own street within `tolerance` of the nearest edge, the one of the best tier, then the nearest, then
    the first; else the nearest edge. Houses meet the edges of the grid cells around them, which is exact for houses that have an
    edge within a cell's width less the tolerance; the others go on with cells four times as wide, until a cell spans the area.
    """
    e = _places(nodes, edge_table)
    ref = e.select("area", "ref").distinct()
    placed = houses.select("area", "house_id", "lat", "lon", F.col("street").alias("house_street")).join(ref, "area")
    px, py = geo.project(F.col("lat"), F.col("lon"), F.col("ref.lat"), F.col("ref.lon"))
    todo = written(placed.select("area", "house_id", "lat", "lon", "house_street", px.alias("px"), py.alias("py")))
    edges_ = written(e.select("area", "edge", "length", F.col("street").alias("edge_street"), "pa", "pb", "ax", "ay", "bx", "by"))
    tiers = written(street_matches(houses, edge_table))
    ends = edges_.agg(*[f(g(x, y)) for f, g, x, y in ((F.max, F.greatest, "ax", "bx"), (F.min, F.least, "ax", "bx"), (F.max, F.greatest, "ay", "by"), (F.min, F.least, "ay", "by"))]).first()
    own = todo.agg(F.max("px"), F.min("px"), F.max("py"), F.min("py")).first()
    size, parts = float(cell_m), []
    while ends[0] is not None:
        span = max([abs(x) for x in (*ends, *own) if x is not None]) * 2
        cell = lambda c: F.floor(c / size)  # noqa: B023, E731
        stretch = lambda lo, hi: F.explode(F.sequence(cell(lo), cell(hi)))  # noqa: B023, E731
        gridded = edges_.withColumn("cx", stretch(F.least("ax", "bx"), F.greatest("ax", "bx"))).withColumn("cy", stretch(F.least("ay", "by"), F.greatest("ay", "by")))
        around = todo.withColumn("cx", F.explode(F.array(*[cell(F.col("px")) + d for d in (-1, 0, 1)]))).withColumn("cy", F.explode(F.array(*[cell(F.col("py")) + d for d in (-1, 0, 1)])))
        # an edge that is met in several cells counts once, for only least distances are kept
        close = _chosen(around.join(gridded, ["area", "cx", "cy"]), tiers, segment_table, tolerance)
        last = size - tolerance > span
        part = written(close if last else close.where(F.col("nearest") <= size - tolerance))
        parts.append(part.drop("nearest"))
        left = written(todo.join(part.select("area", "house_id"), ["area", "house_id"], "left_anti"))
        drop(todo)
        todo = left
        if last or todo.isEmpty():
            break
        size *= 4
    found = parts[0] if parts else _chosen(todo.join(edges_, "area"), tiers, segment_table, tolerance).drop("nearest")
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def _chosen(pairs: DataFrame, tiers: DataFrame, segment_table: DataFrame, tolerance: float) -> DataFrame:
    t, d, side = geo.segment_projection(*[F.col(c) for c in ("px", "py", "ax", "ay", "bx", "by")])
    judged = pairs.join(tiers, ["area", "house_street", "edge_street"], "left").select("area", "house_id", "tier", F.struct(d.alias("d"), "edge", t.alias("t"), side.alias("side"), "length", "pa", "pb").alias("c"))
    # least distance, then least edge, of all edges and of each tier
    best = judged.groupBy("area", "house_id").agg(F.min("c").alias("any"), *[F.min(F.when(F.col("tier") == k, F.col("c"))).alias(f"t{k}") for k in (1, 2, 3)])
    pick = F.col("any")
    for k in (3, 2, 1):
        pick = F.when(F.col(f"t{k}.d") <= F.col("any.d") + tolerance, F.col(f"t{k}")).otherwise(pick)
    own = best.select("area", "house_id", pick.alias("c"), F.col("any.d").alias("nearest"))
    point = F.struct(*[(F.col(f"c.pa.{k}") + (F.col(f"c.pb.{k}") - F.col(f"c.pa.{k}")) * F.col("c.t")).alias(k) for k in ("lat", "lon")])
    flat = own.select("area", "house_id", F.col("c.edge").alias("edge"), (F.col("c.t") * F.col("c.length")).alias("along"), F.col("c.side").alias("side"), point.alias("point"), F.col("c.d").alias("offset"), "nearest")
    return flat.join(segment_table.select("area", "edge", "segment"), ["area", "edge"]).select("area", "house_id", "edge", "along", "side", "segment", "point", "offset", "nearest")


def _same_edge(gap: Column, crossing_penalty: float) -> Column:
    oa, ob = F.col("oa"), F.col("ob")
    return F.when(F.col("side_a") == F.col("side_b"), F.sqrt(gap * gap + (oa - ob) * (oa - ob))).otherwise(gap + oa + ob + crossing_penalty)


def house_distances(snaps: DataFrame, edge_table: DataFrame, node_metres: DataFrame, crossing_penalty: float = 8.0) -> DataFrame:
    """area, i, j, metres (float32), na, nb for every ordered pair of houses of an area, the diagonal 0.

    `node_metres` has the shortest paths between end nodes of snapped edges. na and nb are the end nodes of the best way.
    Each unordered pair is worked out once and mirrored. Pairs are the product the solver needs, within areas only.
    """
    s = snaps.join(edge_table.select("area", "edge", "a", "b", "length"), ["area", "edge"])
    side = lambda x: s.select("area", F.col("house_id").alias(f"h{x}"), F.col("edge").alias(f"e{x}"), F.col("along").alias(f"along_{x}"), F.col("side").alias(f"side_{x}"), F.col("offset").alias(f"o{x}"), F.array(F.struct(F.col("a").alias("n"), F.col("along").alias("leg"), F.lit(0).alias("k")), F.struct(F.col("b").alias("n"), (F.col("length") - F.col("along")).alias("leg"), F.lit(1).alias("k"))).alias(f"ends_{x}"))
    pairs = side("a").join(side("b"), "area").where("ha < hb")
    same = pairs.where("ea = eb").select("area", F.col("ha").alias("i"), F.col("hb").alias("j"), _same_edge(F.abs(F.col("along_a") - F.col("along_b")), crossing_penalty).alias("metres"), F.lit(None).cast("bigint").alias("na"), F.lit(None).cast("bigint").alias("nb"))
    # the best way between two edges is worked out over edge pairs' four end nodes
    apart = pairs.where("ea <> eb").select("area", "ha", "hb", "oa", "ob", F.explode("ends_a").alias("x"), "ends_b").select("area", "ha", "hb", "oa", "ob", "x", F.explode("ends_b").alias("y"))
    met = apart.select("*", F.col("x.n").alias("source"), F.col("y.n").alias("node")).join(node_metres, ["area", "source", "node"], "left")
    total = F.col("x.leg") + F.col("metres") + F.col("y.leg")
    best = met.groupBy("area", "ha", "hb").agg(F.first("oa").alias("oa"), F.first("ob").alias("ob"), F.min(F.when(total.isNotNull(), F.struct(total.alias("total"), F.col("x.k").alias("kx"), F.col("y.k").alias("ky"), F.col("source").alias("na"), F.col("node").alias("nb")))).alias("best"))
    far = best.select("area", F.col("ha").alias("i"), F.col("hb").alias("j"), capped(F.col("oa") + F.col("best.total") + F.col("ob")).alias("metres"), F.col("best.na").alias("na"), F.col("best.nb").alias("nb"))
    half = same.unionByName(far)
    mirror = half.select("area", F.col("j").alias("i"), F.col("i").alias("j"), "metres", F.col("nb").alias("na"), F.col("na").alias("nb"))
    diagonal = snaps.select("area", F.col("house_id").alias("i"), F.col("house_id").alias("j"), F.lit(0.0).alias("metres"), F.lit(None).cast("bigint").alias("na"), F.lit(None).cast("bigint").alias("nb"))
    return half.unionByName(mirror).unionByName(diagonal).withColumn("metres", F.col("metres").cast("float"))


def disconnected(snaps: DataFrame, edge_table: DataFrame, component_table: DataFrame) -> DataFrame:
    """area, house_id of the houses whose edge isn't in the area's main component (most houses, then the lowest)."""
    from loopwright.operators.graph import main_component

    at = snaps.join(edge_table.select("area", "edge", F.col("a").alias("node_id")), ["area", "edge"]).join(component_table, ["area", "node_id"]).select("area", "house_id", "component")
    return at.join(main_component(at), "area").where("component <> main").select("area", "house_id")


def can_solve(houses: DataFrame, cut_off: DataFrame) -> DataFrame:
    """area, reason: why an area can't be solved yet, or null."""
    lost = cut_off.groupBy("area").agg(F.count("*").alias("n"))
    reason = F.when(F.col("n") > 0, F.format_string("%d house(s) not connected to the main street network: remove them, or widen the boundary so that the road is inside", F.col("n")))
    return houses.select("area").distinct().join(lost, "area", "left").select("area", reason.alias("reason"))
