"""Sources with their fallbacks, caches, staleness, polylines and the solver at its real size."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from loopwright.functions import text as T
from loopwright.operators import edits, graph, joins, loops, neighbours, snap, solver, stats
from loopwright.schema import ELEMENTS, FEATURES, Weights
from loopwright.sinks import export
from loopwright.sources import elements, houses, synthetic

POINTS = "array<struct<lat:double,lon:double>>"
RING = [(42.0, -88.3), (42.0, -88.2), (42.1, -88.2), (42.0, -88.3)]


def bodies(spark, rows):
    return spark.createDataFrame([(a, r, json.dumps(e) if e is not None else None) for a, r, e in rows], "area string, remark string, j string").select("area", "remark", F.from_json("j", ELEMENTS).alias("elements"))


NODE = {"type": "node", "id": 1, "lat": 42.0, "lon": -88.3}


def test_query_text_and_cache_keys(spark):
    r = spark.createDataFrame([(RING,), (RING[:3],), (RING[:2],)], f"ring {POINTS}").select(elements.build_query(F.col("ring")).alias("q"), elements.cache_key(F.col("ring")).alias("k"), elements.cache_key(F.col("ring"), "parcels").alias("p")).collect()
    assert r[0]["q"].count('(poly:"42.000000 -88.300000 42.000000 -88.200000 42.100000 -88.200000")') == 4 and r[0]["q"].endswith("out skel qt;") and "motorway|motorway_link" in r[0]["q"]
    assert r[0]["k"] == r[1]["k"] != r[2]["k"] and r[0]["k"].startswith("map:v2:") and r[0]["p"].startswith("parcels:v1:")


def brute_hash(s):
    a, b = 5381, 0x811C9DC5
    for c in s.encode():
        a, b = (a * 33 + c) & 0xFFFFFFFF, (b ^ c) * 16777619 & 0xFFFFFFFF
    return f"{a:x}{b:x}-{len(s):x}"


def test_hash_of_text(spark):
    texts = ["", "a", "42.000000 -88.300000", "x" * 500]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(T.hash_text(F.col("t")).alias("h")).collect()
    assert [r["h"] for r in got] == [brute_hash(t) for t in texts]


def test_rings_and_boxes(spark):
    df = spark.createDataFrame([([[[-88.3, 42.0], [-88.2, 42.1]]],), ([],)], "c array<array<array<double>>>")
    got = [r["r"] for r in df.select(elements.ring_of(F.col("c")).alias("r")).collect()]
    assert [(p["lat"], p["lon"]) for p in got[0]] == [(42.0, -88.3), (42.1, -88.2)] and got[1] is None
    box = houses.bounding_polygon(spark.createDataFrame([("a", 42.0, -88.3), ("a", 42.1, -88.2)], "area string, lat double, lon double"), 0.5).first()["boundary"]
    assert len(box) == 5 and box[0] == box[4] and {round(p["lat"], 6) for p in box} == {41.5, 42.6}


def test_bodies_that_are_no_data(spark):
    got = [r["failure"] for r in elements.check_bodies(bodies(spark, [("a", None, [NODE]), ("b", None, None), ("c", "runtime error: Timed Out", [NODE]), ("d", None, []), ("e", "all well", [NODE])])).collect()]
    assert got[0] is None and got[4] is None and all(got[1:4]) and "Timed Out" in got[2]


def test_first_good_source_wins(spark):
    def broken():
        raise OSError("no route")

    good, empty = bodies(spark, [("a", None, [NODE])]), bodies(spark, [("a", None, [])])
    assert elements.first_good([broken, lambda: empty, lambda: good]).count() == 1
    with pytest.raises(ValueError, match="no route.*no element"):
        elements.first_good([broken, lambda: empty])


def test_cache_reads_before_it_fetches(spark, tmp_path):
    calls = []

    def fetch():
        calls.append(1)
        return spark.range(len(calls)).select("id")

    read = lambda **k: elements.cached(spark, str(tmp_path), "map:v2:x", fetch, **k).count()
    assert read() == 1 and read() == 1 and len(calls) == 1
    assert read(force=True) == 2 and read() == 2 and len(calls) == 2
    (tmp_path / "file").write_text("")  # a folder that can't be written
    assert elements.cached(spark, str(tmp_path / "file"), "k", fetch).count() == 3


def test_bodies_from_files(spark, tmp_path):
    (tmp_path / "north.json").write_text(json.dumps({"elements": [NODE]}))
    r = elements.read_bodies(spark, str(tmp_path)).first()
    assert (r["area"], r["remark"], r["elements"][0]["id"]) == ("north", None, 1)


def feature(pin):
    ring = [[-88.38, 41.86], [-88.379, 41.86], [-88.379, 41.861], [-88.38, 41.86]]
    return {"attributes": {"PIN": pin, "SiteAddress": "1 OAK ST", "UseCodeDescription": houses.RESIDENTIAL}, "geometry": {"rings": [ring]}}


def test_pages_until_the_last_one(spark, tmp_path):
    for offset, pins, more in ((0, ["1", "2"], True), (1000, ["3"], False), (2000, ["4"], False)):
        (tmp_path / f"north-{offset}.json").write_text(json.dumps({"features": [feature(p) for p in pins], "exceededTransferLimit": more}))
    (tmp_path / "south-0.json").write_text(json.dumps({"features": [], "exceededTransferLimit": True}))
    got = {r["area"]: [f["attributes"]["PIN"] for f in r["features"]] for r in houses.all_pages(houses.read_pages(spark, str(tmp_path))).collect()}
    assert got == {"north": ["1", "2", "3"], "south": []}
    (tmp_path / "west-0.json").write_text(json.dumps({"error": {"message": "Token Required"}}))
    with pytest.raises(ValueError, match="Token Required"):
        houses.read_pages(spark, str(tmp_path))


def test_houses_fall_back_to_the_map_and_roads_do_not(spark):
    square = [{"type": "node", "id": i, "lat": 42 + a * 1e-4, "lon": -88.3 + o * 1e-4} for i, (a, o) in enumerate(((0, 0), (0, 1), (1, 1), (1, 0)), 1)]
    house = {"type": "way", "id": 9, "nodes": [1, 2, 3, 4, 1], "tags": {"building": "house", "addr:housenumber": "7", "addr:street": "Elm St"}}
    road = {"type": "way", "id": 8, "nodes": [1, 2], "tags": {"highway": "residential"}}
    maps = bodies(spark, [("a", None, [*square, house, road]), ("b", None, [*square, house, road])])
    parcels = spark.createDataFrame([("a", json.dumps([feature("1")]))], "area string, j string").select("area", F.from_json("j", FEATURES).alias("features"))
    got = houses.house_data(lambda: maps, lambda: parcels)
    assert {(r["area"], r["house_id"], r["source"], r["note"] is None) for r in got["houses"].collect()} == {("a", "k1", "parcels", True), ("b", "w9", "map", False)} and got["ways"].count() == 2

    def broken():
        raise OSError("no route")

    assert {(r["source"], "no route" in r["note"]) for r in houses.house_data(lambda: maps, broken)["houses"].collect()} == {("map", True)}
    with pytest.raises(OSError):
        houses.house_data(broken, lambda: parcels)


def test_areas_that_cannot_be_solved(spark):
    h = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z")], "area string, house_id string")
    got = {r["area"]: r["reason"] for r in snap.can_solve(h, h.where("house_id = 'y'")).collect()}
    assert got["b"] is None and got["a"].startswith("1 house")


def test_disconnected_houses(spark):
    g = synthetic.grid(spark, 3, 3, 1)
    nodes = g["nodes"].unionByName(spark.createDataFrame([("0", 900, 900, 42.05, -88.3), ("0", 901, 901, 42.05, -88.2985)], "area string, node_id bigint, ord int, lat double, lon double"))
    ways = g["ways"].unionByName(spark.createDataFrame([("0", 999, 999, "Island Rd", "residential", [900, 901])], "area string, way_id bigint, way_ord int, name string, highway string, nodes array<bigint>"))
    own = g["houses"].unionByName(spark.createDataFrame([("0", f"o{k}", 100 + k, 42.05005, -88.2999 + k * 0.0004, "", "Island Rd", False, False) for k in range(3)], g["houses"].schema))
    e = graph.edges(nodes, ways)
    s = snap.snap(own, nodes, e, graph.segments(e))
    assert sorted(r["house_id"] for r in snap.disconnected(s, e, graph.node_components(nodes, e)).collect()) == ["o0", "o1", "o2"] and s.count() == own.count()


def test_selection_and_segments(spark):
    ids = lambda xs: spark.createDataFrame([("a", x) for x in xs], "area string, house_id string")
    names = lambda df: sorted(r["house_id"] for r in df.collect())
    assert names(edits.select_area(ids("xy"), ids("yz"), True)) == ["x", "y", "z"] and names(edits.select_area(ids("xy"), ids("yz"), False)) == ["y", "z"]
    h = spark.createDataFrame([("a", "x", "s:1-2", 0), ("a", "y", "s:1-2", 1), ("a", "z", "t:1-2", 1)], "area string, house_id string, segment_key string, g int")
    assert {(r["house_id"], r["g"]) for r in edits.move_segment(h.select("area", "house_id", "g"), h, "s:1-2", 5).collect()} == {("x", 5), ("y", 5), ("z", 1)}
    assert {(r["house_id"], r["g"]) for r in edits.assigned(h.drop("g"), h.where("g = 1").select("area", "house_id", "g")).collect()} == {("x", -1), ("y", 1), ("z", 1)}


def test_staleness_and_replacement(spark):
    row = lambda **k: spark.createDataFrame([("a", "s", 6, "m", None, "i")], "area string, state string, groups int, model_key string, osm string, inputs string").withColumns({n: F.lit(v) for n, v in k.items()})
    stale = lambda now: edits.is_stale(row(), now).first()["stale"]
    assert not stale(row()) and all(stale(row(**{c: "9"})) for c in ("state", "groups", "model_key", "osm", "inputs"))
    none = spark.createDataFrame([], "area string, house_id string, g int")
    edits.fetch_replaces(none, False)
    some = spark.createDataFrame([("a", "x", 1)], none.schema)
    edits.fetch_replaces(some, True)
    with pytest.raises(ValueError, match="overwrite"):
        edits.fetch_replaces(some, False)


def test_signatures(spark):
    strings = "array<string>"
    got = spark.range(1).select(
        T.input_signature(F.lit("{}"), F.array(F.lit("a"), F.lit("b")), F.array().cast(strings), F.array(F.lit("c"))).alias("i"), T.model_key(F.array(F.lit("x")), F.array(F.lit("y"), F.lit("z")), F.lit(8.0)).alias("m"), T.members_signature(F.lit(2), F.array(F.lit(10), F.lit(9))).alias("t")
    ).first()
    assert got["i"] == "{}|a\x01b||c" and got["m"] == "x|y\x01z|8.0" and got["t"] == "2:9,10"


def test_colours_and_polylines(spark):
    c = spark.createDataFrame([(-1,), (0,), (11,), (12,)], "g int").select(export.colour(F.col("g")).alias("c")).collect()
    assert [r["c"] for r in c] == [export.NO_COLOUR, export.COLOURS[0], export.COLOURS[11], export.COLOURS[0]]
    p = lambda k: (float(k), 0.0)
    kind = "struct<lat:double,lon:double>"
    legs = spark.createDataFrame(
        [("a", 0, 0, p(0), p(1), p(10), p(11), True, True, None), ("a", 0, 1, p(1), p(2), p(11), p(12), True, False, None), ("a", 0, 2, p(2), p(3), p(12), p(13), False, False, [p(50), p(51)]), ("a", 0, 3, p(3), p(0), p(13), p(10), False, False, None)],
        f"area string, g int, pos int, door_a {kind}, door_b {kind}, point_a {kind}, point_b {kind}, same_edge boolean, same_side boolean, nodes array<{kind}>",
    )
    drawn = export.leg_polylines(legs)
    assert [[int(x["lat"]) for x in r["line"]] for r in drawn.orderBy("pos").collect()] == [[0, 1], [1, 11, 12, 2], [2, 12, 50, 51, 13, 3], [3, 0]]
    assert [int(x["lat"]) for x in export.tour_polylines(drawn).first()["line"]] == [0, 1, 11, 12, 2, 12, 50, 51, 13, 3, 0]


def test_csv_needs_stops(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 1, "1 Oak", 42.0, -88.3)], "area string, group int, order int, address string, lat double, lon double")
    export.write_csv(rows, str(tmp_path / "csv"))
    assert "1,1,1 Oak,42.0,-88.3" in next((tmp_path / "csv" / "area=a").glob("*.txt")).read_text()
    with pytest.raises(ValueError, match="solve an area first"):
        export.write_csv(rows.limit(0), str(tmp_path / "none"))


def test_nearest_by_walking(spark):
    d = spark.createDataFrame([("a", i, j, float(abs(i - j))) for i in range(6) for j in range(6)], "area string, i int, j int, metres double")
    got = sorted((r["i"], r["rank"], r["j"]) for r in neighbours.nearest_by_metres(d, 2).where("i in (0, 3)").collect())
    assert got == [(0, 1, 1), (0, 2, 2), (3, 1, 2), (3, 2, 4)]


def brute_nearest(points, others, k):
    out = []
    for h, x, y in points:
        ranked = sorted((((x - u) ** 2 + (y - v) ** 2) ** 0.5, j) for j, u, v in others if j != h)[:k]
        out += [(h, n + 1, j) for n, (_, j) in enumerate(ranked)]
    return sorted(out)


def test_nearest_with_far_points_lines_and_few_others(spark):
    r = np.random.default_rng(5)
    dense = [(i, *map(float, r.random(2))) for i in range(120)] + [(500 + i, 1000.0 + i, 0.0) for i in range(3)]
    line = [(i, float(i * i), 7.0) for i in range(3)]
    for rows, k in ((dense, 6), (line, 6), ([(1, 0.0, 0.0), (2, 0.0, 0.0)], 1)):
        df = spark.createDataFrame([("a", *p) for p in rows], "area string, h int, x double, y double")
        assert sorted((x["h"], x["rank"], x["j"]) for x in neighbours.nearest(df, k).collect()) == brute_nearest(rows, rows, k)
    few = spark.createDataFrame([("a", *p) for p in dense[:4]], "area string, h int, x double, y double")
    every = spark.createDataFrame([("a", *p) for p in dense], few.schema)
    assert sorted((x["h"], x["rank"], x["j"]) for x in neighbours.nearest(every, 1, few).collect()) == brute_nearest(dense, dense[:4], 1)


def test_spatial_adoption(spark):
    rows = [("a", i, float(x), 0.0, g) for i, (x, g) in enumerate([(0, 0), (1, -1), (10, 1), (11, -1), (12, None)])] + [("b", 9, 0.0, 0.0, -1)]
    got = neighbours.adopt_spatial(spark.createDataFrame(rows, "area string, h int, x double, y double, g int"), 2).orderBy("area", "h").collect()
    assert [(r["g"], r["changed"]) for r in got] == [(0, False), (0, True), (1, False), (1, True), (1, True), (-1, False)]


def test_meet_keeps_rows_of_hot_and_null_keys(spark):
    keys = [None] * 3000 + ["hot"] * 2500 + [f"k{i}" for i in range(3000)]
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key string, i int")
    found = rows.groupBy("key").agg(F.count("*").alias("n")).withColumn("twice", F.col("n") * 2)
    got = joins.meet(rows, found, ["key"], "n")
    assert got.columns == ["key", "i", "twice"] and got.count() == len(keys)
    assert {(r["key"], r["twice"]) for r in got.where("twice > 2").collect()} == {(None, 6000), ("hot", 5000)}


def areas_of(n, seed=3):
    r = np.random.default_rng(seed)
    xy = r.random((n, 2)) * 1100
    return xy, np.abs(xy[:, None] - xy[None]).sum(axis=2), (xy[:, 0] // 180).astype(int) * 10 + (xy[:, 1] // 180).astype(int)


def test_annealing_gains_three_per_cent_on_560_houses():
    xy, d, segment = areas_of(560)
    p = solver.Problem(d, xy, segment, 6, Weights(), np.zeros(560, bool))
    seed, found = solver.solve(p, 1, 0), solver.solve(p, 1, 8000)
    assert found["feasible"] and found["score"] <= 0.97 * seed["score"]
    assert sorted(np.concatenate(found["tours"]).tolist()) == list(range(560))
    sizes = np.array([len(t) for t in found["tours"]])
    assert np.abs(sizes - 560 / 6).max() <= 9 and found["lengths"] == pytest.approx([loops.length(t, d) for t in found["tours"]])
    links = solver._nearest(np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(axis=2)), 6)
    assert found["cut"] == int((found["assign"][links] != found["assign"][:, None]).sum())


def test_chain_keeps_its_figures():
    xy, d, segment = areas_of(80)
    p = solver.Problem(d, xy, segment, 4, Weights(), np.zeros(80, bool))
    draw = loops.Draws(4)
    chain = solver.Chain(p, solver.seed_partition(xy, 4, draw, 2.0))
    for _ in range(400):
        move = chain.propose(draw)
        if move is None:
            continue
        *change, sizes, over = move
        new, to, cut, score = chain.evaluate(*change, sizes)
        if chain.splits(*change):
            continue
        chain.accept(new, to, cut, sizes, over)
        fresh = solver.Chain(p, np.array(chain.assign))
        assert (chain.cut, chain.sizes, chain.pieces, sorted(chain.border)) == (fresh.cut, fresh.sizes, fresh.pieces, sorted(fresh.border))
        for g, tour in enumerate(chain.tours):
            assert sorted(tour) == [h for h in range(80) if chain.assign[h] == g] and chain.lengths[g] == pytest.approx(loops.length(np.array(tour), d))
        assert chain.score == pytest.approx(chain.objective(chain.lengths, chain.sizes, chain.cut))


def test_unreachable_houses_are_an_error(spark):
    h = spark.createDataFrame([("a", f"h{k}", k, float(k), 0.0, 0) for k in range(4)], "area string, house_id string, ord int, x double, y double, segment int")
    d = spark.createDataFrame([("a", f"h{i}", f"h{j}", 0.0 if i == j else 1e6 if 3 in (i, j) else 10.0) for i in range(4) for j in range(4)], "area string, i string, j string, metres double")
    with pytest.raises(Exception, match="not connected"):
        solver.solve_runs(h, d, solver.sweep(h, [1], 2, 10, [Weights()])).collect()


def test_rebalance_and_seed_defaults():
    xy = np.random.default_rng(1).random((30, 2))
    a = solver.rebalance(np.zeros(30, int), xy, 3, 2.0)
    assert solver.violation(np.bincount(a, minlength=3), 2.0) == 0
    assert solver.solve(solver.Problem(np.abs(xy[:, :1] - xy[:, 0]), xy, np.zeros(30), 3, Weights(), np.zeros(30, bool)), 1, 50, np.zeros(30, int))["feasible"]


def test_cached_loops_are_taken_and_forgotten(spark):
    a = spark.createDataFrame([("a", f"h{k}", k % 2) for k in range(8)], "area string, h string, g int")
    d = spark.createDataFrame([("a", f"h{i}", f"h{j}", float(abs(i - j))) for i in range(8) for j in range(8)], "area string, i string, j string, metres double")
    routed = solver.route_groups(a, d, 2)
    known = solver.seed_cache(routed.where("g = 0")).withColumn("length", F.lit(-1.0))
    got = {r["g"]: r["length"] for r in solver.route_groups(a, d, 2, cached=known).collect()}
    assert got == {0: -1.0, 1: 12.0}
    assert solver.remember(known, routed).count() == 2 and solver.remember(known, routed.where("g = 1"), most=1).count() == 1


def test_walking_mates_and_matrix(spark):
    stops = spark.createDataFrame([("a", 0, k, f"h{k}") for k in range(3)], "area string, g int, pos int, h string")
    d = spark.createDataFrame([("a", f"h{i}", f"h{j}", float(i + j)) for i in range(3) for j in range(3)], "area string, i string, j string, metres double")
    assert stats.tour_lengths(stops, d).first()["length"] == 6.0
