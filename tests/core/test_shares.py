"""Very many small files are fetched by few tasks."""

import json

from loopwright.sources import remote

FEATURE = {"attributes": {"PIN": 5, "SiteAddress": None}, "geometry": {"rings": [[[0, 1], [2, 3.5]]]}}


def test_many_pages_are_dealt_to_few_tasks_and_all_read(spark, tmp_path):
    for k in range(300):
        remote.put(f"{tmp_path}/area={k % 7}/offset={k}/page.json", json.dumps({"features": [FEATURE, {"attributes": None}], "exceededTransferLimit": k % 2 == 0}))
    spark.dataSource.register(remote.Pages)
    pages = spark.read.format("parcel_pages").option("sources", json.dumps([str(tmp_path)])).load()
    assert pages.rdd.getNumPartitions() == remote.MOST == 64
    got = pages.collect()
    assert sorted((r["area"], r["offset"], r["exceeded"]) for r in got) == sorted((str(k % 7), k, k % 2 == 0) for k in range(300))
    full, bare = got[0]["features"]
    assert full.asDict(recursive=True) == {"attributes": {"PIN": "5", "SiteAddress": None, "UseCodeDescription": None}, "geometry": {"rings": [[[0.0, 1.0], [2.0, 3.5]]]}}
    assert bare.asDict(recursive=True) == {"attributes": {"PIN": None, "SiteAddress": None, "UseCodeDescription": None}, "geometry": {"rings": None}}
    assert pages.where("source = 0").count() == 300
