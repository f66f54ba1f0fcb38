"""The data sources of bodies and pages, and the sink of stop lists."""

import json
import os

import pytest

from loopwright.sinks import export, stoplists
from loopwright.sources import elements, houses, remote

NODE = {"type": "node", "id": 1, "lat": 42.0, "lon": -88.0, "tags": {"addr:housenumber": 7}}
GOOD = {"elements": [NODE, {"type": "way", "id": 5, "nodes": [1, 2]}, {"type": "relation", "id": 9}]}


def put(folder, area, body, name="part-0.txt", offset=None):
    path = folder / f"area={area}" / (f"offset={offset}" if offset is not None else "")
    path.mkdir(parents=True, exist_ok=True)
    (path / name).write_text(body if isinstance(body, str) else json.dumps(body))


def read(spark, kind, sources, **options):
    spark.dataSource.register(remote.Bodies)
    spark.dataSource.register(remote.Pages)
    return spark.read.format(kind).option("sources", json.dumps(sources)).options(**options).load()


def test_the_first_good_copy_of_each_area_is_read(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    put(a, "one", GOOD)
    put(b, "one", {"elements": [NODE]})
    put(a, "two", {"elements": [], "remark": "runtime error: out of memory"})
    put(b, "two", {"elements": [NODE], "remark": "fine"})
    put(a, "three", "<html>")
    put(b, "three", GOOD)
    put(b, "a b%2Fc", GOOD)
    put(a, "one", "not read", "_SUCCESS")
    got = {r["area"]: r for r in read(spark, "map_bodies", [str(tmp_path / "missing"), f"file://{a}", str(b)]).collect()}
    assert {k: (r["source"], len(r["elements"]), r["remark"]) for k, r in got.items()} == {"one": (1, 3, None), "two": (2, 1, "fine"), "three": (2, 3, None), "a b/c": (2, 3, None)}
    first, way, _ = got["one"]["elements"]
    assert (first["id"], first["lat"], first["tags"], way["nodes"], way["tags"]) == (1, 42.0, {"addr:housenumber": "7"}, [1, 2], None)
    assert read(spark, "map_bodies", [str(a), str(b)]).select("area").rdd.getNumPartitions() == 4
    assert elements.parse_elements(read(spark, "map_bodies", [str(b)]))["addr_nodes"].count() == 4


def test_failures_of_all_sources_are_told_and_retried(spark, tmp_path, monkeypatch):
    put(tmp_path, "x", {"elements": []})
    with pytest.raises(Exception, match="all sources failed.*no element came back"):
        read(spark, "map_bodies", [str(tmp_path)]).collect()
    with pytest.raises(Exception, match="no file in any"):
        read(spark, "map_bodies", [str(tmp_path / "none")]).collect()
    asked = []
    monkeypatch.setattr(remote, "fetched", lambda address: asked.append(address) or (_ for _ in ()).throw(OSError("down")) if len(asked) < 3 else json.dumps(GOOD).encode())
    reader = remote.Bodies({"sources": json.dumps(["x"]), "retries": "3"}).reader(read(spark, "map_bodies", [str(tmp_path)]).schema)
    batch = next(iter(reader.read(remote.Wanted("a", 0, [(0, "x/1")]))))
    assert batch.num_rows == 1 and len(asked) == 3


def test_pages_are_read_apart_and_end_by_their_own_word(spark, tmp_path):
    feature = lambda pin: {"attributes": {"PIN": pin, "SiteAddress": "1 N OAK ST", "UseCodeDescription": houses.RESIDENTIAL}, "geometry": {"rings": [[[0, 0], [1, 0], [1, 1.5]]]}}
    a, b = tmp_path / "a", tmp_path / "b"
    for k, exceeded in ((0, True), (1000, False), (2000, False)):
        put(b, "t", {"features": [feature(k + i) for i in range(3)], "exceededTransferLimit": exceeded}, offset=k)
    put(a, "t", {"error": {"message": "busy"}}, offset=1000)
    pages = read(spark, "parcel_pages", [str(a), str(b)])
    assert sorted((r["offset"], r["source"], r["exceeded"]) for r in pages.collect()) == [(0, 1, True), (1000, 1, False), (2000, 1, False)]
    got = houses.parse_parcels(houses.all_pages(pages))
    assert sorted(r["house_id"] for r in got.collect()) == ["k0", "k1", "k1000", "k1001", "k1002", "k2"]
    with pytest.raises(Exception, match="a parcel page is an error: busy"):
        read(spark, "parcel_pages", [str(a)]).collect()


STOPS = 'area string, `group` int, `order` int, address string, lat double, lon double'


def told(folder):
    return {d[5:]: "".join((folder / d / f).read_text(newline="") for f in sorted(os.listdir(folder / d)) if f.endswith(".csv")) for d in os.listdir(folder) if d.startswith("area=")}


def test_files_are_the_csv_text_of_each_area(spark, tmp_path):
    rows = [(f"a{k % 3}" if k % 7 else "b b", k % 4 + 1, k, 'say "=x", ok' if k % 2 else "-5 Oak", k + 0.5, -k / 4) for k in range(500)]
    df = spark.createDataFrame(rows, STOPS).repartition(5)
    stoplists.write_stop_lists(df, str(tmp_path / "out"))
    want = {r["area"]: r["csv"] for r in export.csv_lines(df).collect()}
    assert told(tmp_path / "out") == want and not [d for d in os.listdir(tmp_path / "out") if d.startswith("_")]
    stoplists.write_stop_lists(df.where("area = 'a1'"), f"file://{tmp_path}/out", overwrite=True)
    assert told(tmp_path / "out") == {"a1": want["a1"]}
    with pytest.raises(ValueError, match="solve an area first"):
        stoplists.write_stop_lists(df.limit(0), str(tmp_path / "out"))


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    bad = spark.createDataFrame([("a", 1, 1, "x\n"), ("b", 1, 1, None)], "area string, `group` int, `order` int, line string").coalesce(1)
    spark.dataSource.register(stoplists.StopLists)
    with pytest.raises(Exception):
        bad.write.format("stop_lists").option("path", str(tmp_path / "out")).mode("append").save()
    assert [f for _, _, files in os.walk(tmp_path / "out") for f in files] == []
