"""Parsing, graph, snapping, distances and the solver on small fixtures."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loopwright.operators import edits, graph, loops, neighbours, snap, solver, stats
from loopwright.plans.model import build_model
from loopwright.schema import ELEMENTS, FEATURES, HOUSES, NODES, WAYS, Weights, effective_tolerance
from loopwright.sinks import export
from loopwright.sources import elements, houses as house_sources, project, synthetic


@pytest.fixture(scope="session")
def small(spark):
    g = synthetic.grid(spark, 3, 3, 2)
    return g, build_model(g["houses"], g["nodes"], g["ways"])


def ways_of(spark, rows):
    return spark.createDataFrame([("a", 1000 + i, i, name, "residential", nodes) for i, (name, nodes) in enumerate(rows)], WAYS)


def nodes_of(spark, ids):
    return spark.createDataFrame([("a", n, i, 42 + 0.001 * n, -88.3 + 0.0001 * (n % 3)) for i, n in enumerate(ids)], NODES)


def keys(spark, ids, rows):
    e = graph.edges(nodes_of(spark, ids), ways_of(spark, rows))
    return sorted({r["key"] for r in graph.segments(e).collect()}), e.count()


def test_segments_of_hand_made_graphs(spark):
    assert keys(spark, [1, 2, 3, 4], [("A", [1, 2, 3, 4])]) == (["A:1-4"], 3)
    assert keys(spark, [1, 2, 3], [("A", [1, 2]), ("B", [2, 3])]) == (["A:1-2", "B:2-3"], 2)
    assert keys(spark, [1, 2, 4], [("A", [1, 2, 3, 4])]) == (["A:1-2"], 1)
    assert keys(spark, [1, 2], [("A", [1, 2]), ("B", [2, 1])]) == (["A:1-2"], 1)
    assert keys(spark, [1, 2, 3, 4, 5, 6], [("Main St", [1, 2, 3, 4, 5]), ("Side St", [3, 6])])[0] == ["Main St:1-3", "Main St:3-5", "Side St:3-6"]
    loop = [("Loop", [1, 2, 3]), ("Loop", [1, 4, 3]), ("X", [1, 5]), ("X", [3, 6])]
    assert keys(spark, [1, 2, 3, 4, 5, 6], loop)[0][:2] == ["Loop:1-3", "Loop:1-3#1"]
    assert keys(spark, [1, 2, 3], [("R", [1, 2, 3, 1])]) == (["R:1-1"], 3)


def test_components_and_paths_agree(spark):
    g = synthetic.grid(spark, 4, 5, 1, areas=2)
    e = graph.edges(g["nodes"], g["ways"])
    assert e.count() == 2 * 31
    comps = graph.node_components(g["nodes"], e)
    assert comps.select("area", "component").distinct().count() == 2
    sources = spark.createDataFrame([("0", 1), ("1", 7)], "area string, source bigint")
    key = lambda df: sorted((r["area"], r["source"], r["node"], round(r["metres"], 6)) for r in df.collect())
    a, b = key(graph.shortest_paths(e, sources)), key(graph.dijkstra(e, sources))
    assert a == b and len(a) == 40
    found = graph.path(e, spark.createDataFrame([("0", 1, 20), ("0", 3, 3), ("1", 1, 99)], "area string, a bigint, b bigint")).collect()
    by = {(r["area"], r["b"]): r["nodes"] for r in found}
    assert len(by[("0", 20)]) == 8 and by[("0", 20)][0] == 1 and by[("0", 3)] == [3] and by[("1", 99)] == []


def test_islands_are_unreachable(spark):
    e = graph.edges(nodes_of(spark, [1, 2, 3, 4]), ways_of(spark, [("A", [1, 2]), ("B", [3, 4])]))
    comps = {r["node_id"]: r["component"] for r in graph.node_components(nodes_of(spark, [1, 2, 3, 4]), e).collect()}
    assert comps == {1: 0, 2: 0, 3: 1, 4: 1}


def test_parse_elements_splits_ways_at_gaps(spark):
    node = lambda i, **tags: {"type": "node", "id": i, "lat": 42 + i * 1e-4, "lon": -88.3, "tags": tags or None}
    way = lambda i, nodes, **tags: {"type": "way", "id": i, "nodes": nodes, "tags": tags}
    els = [node(i) for i in (1, 2, 4, 5, 6, 7)] + [node(30, **{"addr:housenumber": "9", "addr:street": "Elm St"}), {"type": "node", "id": 30, "lat": 42.5, "lon": -88.3}]
    els += [way(10, [1, 2, 3, 4, 5], highway="residential", name="Gap"), way(11, [1, 2], highway="motorway"), way(12, [1, 2], highway="service", service="driveway"), way(13, [1, 3, 5], highway="footway"), way(10, [6, 7], highway="path")]
    els += [way(20, [1, 2, 4, 5, 1], building="house", **{"addr:housenumber": "12", "addr:street": "Oak St"})]
    body = spark.createDataFrame([("a", json.dumps(els))], "area string, j string").select("area", F.from_json("j", ELEMENTS).alias("elements"))
    got = elements.parse_elements(body)
    assert [(r["way_id"], r["nodes"]) for r in got["ways"].orderBy("way_ord").collect()] == [(10, [1, 2]), (10, [4, 5])]
    assert [r["node_id"] for r in got["nodes"].orderBy("ord").collect()] == [1, 2, 4, 5]
    assert [(r["id"], len(r["ring"])) for r in got["buildings"].collect()] == [(20, 5)]
    a = got["addr_nodes"].first()
    assert (a["number"], a["street"], a["pos"]["lat"]) == ("9", "Elm St", 42.003)


def test_build_houses_decisions(spark):
    square = lambda k: [(42 + k, -88.3), (42 + k, -88.2999), (42.0001 + k, -88.2999), (42.0001 + k, -88.3)]
    cases = [(1, {"building": "house", "addr:housenumber": "12", "addr:street": "Oak St"}), (2, {"building": "garage", "addr:housenumber": "3"}), (3, {"building": "yes"}), (4, {"building": "house"}), (5, {"building": "yes"}), (6, {"building": "warehouse", "addr:housenumber": "7"})]
    rows = [("a", i, i, square(0.001 * i), tags) for i, tags in cases]
    b = spark.createDataFrame(rows, "area string, id bigint, ord int, ring array<struct<lat:double,lon:double>>, tags map<string,string>")
    n = spark.createDataFrame([("a", 50, 0, (42.00505, -88.29995), "7", "Elm St"), ("a", 51, 1, (42.5, -88.3), "8", "")], "area string, id bigint, ord int, pos struct<lat:double,lon:double>, number string, street string")
    got = {r["house_id"]: (r["label"], r["flagged"]) for r in house_sources.build_houses(b, n).collect()}
    assert got == {"w1": ("12 Oak St", False), "w4": ("(no address)", True), "w5": ("7 Elm St", False), "w6": ("7", False), "n51": ("8", False)}


def test_parcels_first_of_each_pin_that_passes(spark):
    ring = lambda x: [[[x, 41.86], [x + 0.001, 41.86], [x + 0.001, 41.861], [x, 41.861], [x, 41.86]]]
    f = lambda pin, site, use, rings: {"attributes": {"PIN": pin, "SiteAddress": site, "UseCodeDescription": use}, "geometry": {"rings": rings}}
    lot = house_sources.RESIDENTIAL
    feats = [f("1111", "39W514 BEALER CIR", lot, ring(-88.38)), f("1111", "1 COPY ST", lot, ring(-88.38)), f("2222", " ", lot, ring(-88.38)), f(None, "1 X ST", lot, ring(-88.38)), f("4444", "1 X ST", "Farm", ring(-88.38)), f("5555", "1 FAR ST", lot, ring(-80.0)), f("6666", "2 TWO ST", lot, [ring(-88.3755)[0], [[-88.0, 41.0], [-88.0, 41.0001], [-88.0001, 41.0]]])]
    df = spark.createDataFrame([("a", json.dumps(feats))], "area string, j string").select("area", F.from_json("j", FEATURES).alias("features"))
    box = [(41.857, -88.386), (41.857, -88.37), (41.866, -88.37), (41.866, -88.386)]
    bounds = spark.createDataFrame([("a", box)], "area string, boundary array<struct<lat:double,lon:double>>")
    got = house_sources.parse_parcels(df, bounds).orderBy("ord").collect()
    assert [(r["house_id"], r["label"], r["street"]) for r in got] == [("k1111", "39W514 Bealer Cir", "Bealer Cir"), ("k6666", "2 Two St", "Two St")]
    assert {r["house_id"] for r in house_sources.parse_parcels(df).collect()} == {"k1111", "k5555", "k6666"}


def test_snapping_prefers_the_own_street_within_tolerance(spark):
    n = spark.createDataFrame([("a", 1, 0, 42.0, -88.3), ("a", 2, 1, 42.0, -88.299), ("a", 3, 2, 42.00025, -88.3), ("a", 4, 3, 42.00025, -88.299)], NODES)
    e = graph.edges(n, ways_of(spark, [("Oak Street", [1, 2]), ("Halliday Circle", [3, 4])]))
    seg = graph.segments(e)
    rows = [("a", f"h{k}", k, 42.0001, -88.2995, "", street, False, False) for k, street in enumerate(["Halliday Cir", "Haladay Cir", "", "Elm St", "E Halliday Cir"])]
    h = spark.createDataFrame(rows, HOUSES)
    for cell in (150.0, 20.0):
        got = {r["house_id"]: r["edge"] for r in snap.snap(h, n, e, seg, cell).collect()}
        assert got == {"h0": 1, "h1": 1, "h2": 0, "h3": 0, "h4": 1}


def test_grid_model(small):
    g, m = small
    assert m.houses.count() == 24 and m.edges.count() == 12
    assert all(15 < r["offset"] < 18.5 for r in m.snaps.collect())
    d = {(r["i"], r["j"]): r["metres"] for r in m.dist.collect()}
    assert len(d) == 24 * 24 and all(d[i, j] == d[j, i] for i, j in d) and all(d[i, i] == 0 for i, _ in d)
    assert m.disconnected.count() == 0 and max(d.values()) < 1e6


def test_house_distance_values(spark):
    s = spark.createDataFrame([("a", "p", 0, 10.0, 1, 0, (0.0, 0.0), 10.0), ("a", "q", 0, 40.0, 1, 0, (0.0, 0.0), 50.0), ("a", "r", 0, 30.0, -1, 0, (0.0, 0.0), 15.0)], "area string, house_id string, edge int, along double, side int, segment int, point struct<lat:double,lon:double>, offset double")
    e = spark.createDataFrame([("a", 0, 1, 2, 100.0, "S")], "area string, edge int, a bigint, b bigint, length double, street string")
    none = spark.createDataFrame([], "area string, source bigint, node bigint, metres double")
    d = {(r["i"], r["j"]): r["metres"] for r in snap.house_distances(s, e, none).collect()}
    assert d["p", "q"] == 50.0 and d["p", "r"] == 20 + 10 + 15 + 8 and d["q", "q"] == 0


def test_solver_keeps_groups_balanced_and_is_repeatable(small):
    g, m = small
    runs = solver.sweep(g["houses"], [1, 2], 3, 150, [Weights()])
    rows = solver.solve_runs(m.solver_houses(), m.dist, runs).collect()
    again = solver.solve_runs(m.solver_houses(), m.dist, runs).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again)) and len(rows) == 6
    for run in (0, 1):
        own = [r for r in rows if r["run"] == run]
        assert sorted(h for r in own for h in r["tour"]) == sorted(r["house_id"] for r in g["houses"].collect())
        assert all(r["feasible"] and abs(len(r["tour"]) - 8) <= effective_tolerance(8, Weights()) for r in own)
    best = solver.best_runs(solver.solve_runs(m.solver_houses(), m.dist, runs))
    assert best.select("run").distinct().count() == 1


def test_annealing_gains_on_the_seed(small):
    _, m = small
    ids = [r["house_id"] for r in m.houses.orderBy("ord").collect()]
    at = {h: k for k, h in enumerate(ids)}
    d = np.zeros((len(ids), len(ids)))
    for r in m.dist.collect():
        d[at[r["i"]], at[r["j"]]] = r["metres"]
    xy = np.zeros((len(ids), 2))
    for r in m.xy.collect():
        xy[at[r["house_id"]]] = r["x"], r["y"]
    p = solver.Problem(d, xy, np.zeros(len(ids)), 3, Weights(), np.zeros(len(ids), bool))
    for seed in (1, 2, 3):
        start = solver.solve(p, seed, 0)
        assert solver.solve(p, seed, 300)["score"] <= start["score"] + 1e-9
    locked = np.zeros(len(ids), bool)
    locked[:10] = True
    initial = solver.solve(p, 1, 0)["assign"]
    p.locked = locked
    assert (solver.solve(p, 5, 200, initial)["assign"][:10] == initial[:10]).all()
    with pytest.raises(ValueError, match="not connected"):
        solver.solve(solver.Problem(np.full((2, 2), 1e6), xy[:2], np.zeros(2), 1, Weights(), np.zeros(2, bool)), 1, 1)


def test_loops_are_locally_best():
    r = np.random.default_rng(1)
    xy = r.random((30, 2))
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(axis=2))
    t, length = loops.solve_tour(np.arange(30), d)
    assert sorted(t) == list(range(30)) and length == pytest.approx(loops.length(t, d))
    assert length <= loops.length(loops.nearest_neighbour(np.arange(30), d, 0), d)
    assert loops._two_opt(t, d) is None and loops._or_opt(t, d) is None
    w = loops.warm_start(t[:10], np.r_[t[2:10], 29 if 29 not in t[:10] else t[12]], d)
    assert list(w[np.isin(w, t[2:10])]) == list(t[2:10])
    line = np.abs(np.subtract.outer([0, 1, 2, 9], [0, 1, 2, 9])).astype(float)
    assert list(loops.rotate_to_start(np.array([0, 1, 2, 3]), line)) == [0, 1, 2, 3]
    assert loops.count_components(np.arange(4), line, 1) == 2


def test_statistics(spark):
    a = spark.createDataFrame([("a", f"h{i}", 0 if i < 10 else 1) for i in range(30)], "area string, h string, g int")
    lengths = spark.createDataFrame([("a", 0, 1200.0), ("a", 1, 600.0)], "area string, g int, length double")
    got = {r["g"]: r for r in stats.group_stats(a, lengths, 2).collect()}
    assert [(r["houses"], round(r["minutes"], 6), r["delta"], r["street_changes"]) for r in (got[0], got[1])] == [(10, 20.0, -5.0, -1), (20, 15.0, 5.0, -1)]
    stops = lambda names: spark.createDataFrame([("a", 0, k, s) for k, s in enumerate(names)], "area string, g int, pos int, street string")
    assert stats.street_changes(stops(["A St", "A Street", "B", "B"])).first()["changes"] == 2
    assert stats.street_changes(stops(["A", "B", "A", "B"])).first()["changes"] == 4
    assert stats.street_changes(stops(["A"])).first()["changes"] == 0
    cut = spark.createDataFrame([("a", 3)], "area string, cut bigint")
    o = stats.objective(stats.group_stats(a, spark.createDataFrame([("a", 0, 100.0), ("a", 1, 200.0)], "area string, g int, length double"), 2), cut).first()
    assert o["score"] == pytest.approx(290) and o["spread"] == 10 and o["violation"] == 6 and o["objective"] == pytest.approx(200 + 90 + 225 + 30)
    assert [effective_tolerance(x, Weights()) for x in (78, 20, 0, 30, 12)] == [7, 2, 2, 3, 2]


def test_adopt_nearest_does_not_chain(spark):
    at = [0.0, 1.0, 10.0, 11.0]
    a = spark.createDataFrame([("a", i, g) for i, g in enumerate([0, -1, 1, -1])], "area string, h bigint, g int")
    d = spark.createDataFrame([("a", i, j, abs(x - y)) for i, x in enumerate(at) for j, y in enumerate(at)], "area string, i bigint, j bigint, metres double")
    assert [r["g"] for r in neighbours.adopt_nearest(a, d, 2).orderBy("h").collect()] == [0, 0, 1, 1]


def test_edit_history(spark):
    kinds = ["edit", "edit", "undo", "edit", "redo", "edit", "undo", "redo", "undo", "undo"]
    log = spark.createDataFrame([("a", i, k, f"h{i % 2}", i) for i, k in enumerate(kinds)], "area string, seq bigint, kind string, house_id string, g int")
    assert sorted(r["seq"] for r in edits.undone(log).collect()) == [0]
    held = edits.undone(log.where("seq < 6"))
    assert sorted(r["seq"] for r in held.collect()) == [0, 3, 5]
    assert sorted((r["house_id"], r["g"]) for r in edits.state_at(held, ["house_id"], "g").collect()) == [("h0", 0), ("h1", 5)]
    many = spark.createDataFrame([("a", i, "edit") for i in range(120)] + [("a", 120 + i, "undo") for i in range(119)], "area string, seq bigint, kind string")
    assert edits.undone(many).count() == 20


def test_toggle_locks(spark):
    ids = lambda xs: spark.createDataFrame([("a", x) for x in xs], "area string, house_id string")
    got = lambda a, b: sorted(r["house_id"] for r in edits.toggle_locks(ids(a), ids(b)).collect())
    assert got(["x", "y"], ["x"]) == ["y"] and got(["x"], ["x", "z"]) == ["x", "z"]


def test_csv_and_box(spark):
    rows = spark.createDataFrame([("a", 1, 1, "=1, Oak", 42.0, -88.3), ("a", 1, 2, "2 Elm", 42.1, -88.2)], "area string, group int, order int, address string, lat double, lon double")
    assert export.csv_lines(rows).first()["csv"] == 'group,order,address,lat,lon\r\n1,1,"\'=1, Oak",42.0,-88.3\r\n1,2,2 Elm,42.1,-88.2\r\n'
    box = export.fit_box(spark.createDataFrame([("a", 42.0, -88.3)], "area string, lat double, lon double")).first()
    assert math.isclose(box["north"] - box["south"], 0.002, rel_tol=1e-6) and math.isclose(box["east"] - box["west"], 0.002, rel_tol=1e-6)


GOOD = {"version": 1, "boundary": None, "osm": None, "houses": [{"id": "h", "lat": 1, "lon": 2.5, "label": "l", "street": "s"}], "assignment": {"h": 2}, "config": {"groups": 99.6, "iterations": -5, "seed": 3.7, "walkSpeed": 0, "crossingPenalty": "4", "weights": {"compact": -3, "total": -1}}}


def test_project_config_and_round_trip(spark):
    r = project.parse_projects(spark.createDataFrame([("a", json.dumps(GOOD))], "area string, json string")).first()
    c = r["config"]
    assert r["error"] is None and (c["groups"], c["iterations"], c["seed"], c["walkSpeed"], c["crossingPenalty"]) == (12, 0, 4, 0.1, 4.0)
    assert (c["weights"]["compact"], c["weights"]["total"], c["weights"]["tolerance"]) == (0.0, 0.3, 2.0)
    assert r["assignment"] == {"h": 2} and r["houses"][0]["flagged"] is False and r["removed"] == []
    again = export.project_json(project.parse_projects(spark.createDataFrame([("a", json.dumps(GOOD))], "area string, json string")).drop("error"))
    assert json.loads(again.first()["json"])["assignment"] == {"h": 2}


@pytest.mark.parametrize("change, message", [
    ("{", "not valid JSON"), ([1], "expected a JSON object"), ({"version": 2}, "Unsupported project version 2"),
    ({"houses": 3}, "houses must be an array"), ({"houses": [3]}, "houses[0] is not an object"), ({"houses": [{"id": "x", "label": "", "street": "", "lat": "1", "lon": 2}]}, "houses[0] needs finite lat and lon"),
    ({"houses": [{"id": 1, "label": "", "street": "", "lat": 1, "lon": 2}]}, "houses[0] needs string id, label and street"), ({"removed": [1]}, "removed must be an array of strings"), ({"locked": "x"}, "locked must be an array of strings"),
    ({"assignment": []}, "assignment must be an object"), ({"assignment": {"q": 1.5}}, 'assignment["q"] must be an integer'), ({"osm": {"nodes": []}}, "osm must be null or {nodes: [], ways: []}"),
    ({"osm": {"nodes": [[1, 2]], "ways": []}}, "osm.nodes[0] must be [id, lat, lon] numbers"), ({"osm": {"nodes": [], "ways": [{"id": 1}]}}, "osm.ways[0] must be {id: number, name: string, highway: string, nodes: number[]}"),
    ({"boundary": {"type": "Point"}}, "boundary must be null or a GeoJSON Polygon"), ({"boundary": {"type": "Polygon", "coordinates": [[[1]]]}}, "boundary.coordinates[0] must be an array of [lon, lat] positions"),
])
def test_project_errors(spark, change, message):
    text = change if isinstance(change, str) else json.dumps(change if isinstance(change, list) else GOOD | change)
    r = project.parse_projects(spark.createDataFrame([("a", text)], "area string, json string")).first()
    assert r["error"] == message and r["config"] is None
