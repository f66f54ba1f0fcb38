"""Distances as text against C's printf, which the SQL prints with."""

import random

import duckdb
from pyspark.sql import functions as F

from loopwright.catalog import ORACLE_SQL, QUERIES
from loopwright.functions import text as T


def test_two_places_are_those_of_c(spark):
    draw = random.Random(3)
    xs = [draw.uniform(0, 10 ** draw.randint(-6, 12)) for _ in range(2000)] + [k / 8 for k in range(400)] + [k / 200 for k in range(2000)] + [-k / 1000 for k in range(20)]
    xs += [0.995, 0.9949999999999999, 1.005, 2.675, -0.0, 1e15 + 0.125, 5e-324, 9007199254740991.0, 9007199254740992.0, 4503599627370496.5, 9.2e18]
    got = {r["i"]: r["s"] for r in spark.createDataFrame(list(enumerate(xs)), "i int, x double").select("i", T.two_places(F.col("x")).alias("s")).collect()}
    assert [got[i] for i in range(len(xs))] == ["%.2f" % x for x in xs]


def test_ties_and_nulls_print_as_the_sql_says(spark, tmp_path):
    rows = [(1, 125.73), (2, 3 * 125.73), (3, 5 * 125.73), (4, None), (5, 0.0), (6, 25.146), (6, 100.584)]
    spark.createDataFrame([(i, u, v) for i, (u, v) in enumerate(rows)], "event_id bigint, user_id bigint, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r["g"]: r["shown"] for r in QUERIES["text_format_distance"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert got == dict(con.sql(ORACLE_SQL["text_format_distance"]).fetchall())
    assert got[1] == "78.12 mi (125730 m)" and got[4] is None
