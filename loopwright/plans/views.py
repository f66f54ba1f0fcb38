"""The star-schema tables read as houses, streets, points, tours and edits, by integer arithmetic that any engine repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loopwright.sources import synthetic

GROUPS = 6
#: A neighbourhood: rows and columns of its streets, places on each side of a block, and houses in all.
ROWS, COLS, PER_EDGE = 4, 4, 2
NEIGHBOURHOOD = ROWS * (COLS - 1) * PER_EDGE * 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def houses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as houses: a segment is an area, a lattice of places the neighbourhood."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.col("c_mktsegment").alias("area"), k.alias("house_id"), k.alias("h"), k.alias("ord"), (42.0 + (k % 97) * 1e-4).alias("lat"), (-88.3 + (k * 31 % 89) * 1e-4).alias("lon"),
        F.concat(k.cast("string"), F.lit(" Row "), (k % 10).cast("string")).alias("label"), F.concat(F.lit("Row "), (k % 10).cast("string")).alias("street"),
        (F.col("c_acctbal") < 0).alias("flagged"), (k % 17 == 0).alias("manual"), (F.col("c_nationkey") % GROUPS).alias("g"), (k % 40).alias("segment"),
    )


HOUSES_SQL = f"""houses AS (
  SELECT c_mktsegment AS area, c_custkey AS house_id, c_custkey AS h, c_custkey AS ord, 42.0::DOUBLE + (c_custkey % 97) * 1e-4::DOUBLE AS lat,
         -88.3::DOUBLE + (c_custkey * 31 % 89) * 1e-4::DOUBLE AS lon, c_custkey || ' Row ' || (c_custkey % 10) AS label, 'Row ' || (c_custkey % 10) AS street,
         c_acctbal < 0 AS flagged, c_custkey % 17 = 0 AS manual, c_nationkey % {GROUPS} AS g, c_custkey % 40 AS segment FROM customer)"""


def neighbourhoods(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """nodes, ways and houses: customers dealt by key into neighbourhoods of at most NEIGHBOURHOOD houses, along a grid of streets for each.

    The number of areas grows with the table. A house stands within its place by its key, so areas differ.
    """
    k = F.col("c_custkey")
    slot = F.pmod(k, F.lit(NEIGHBOURHOOD)).cast("int")
    row, rest = F.floor(slot / (NEIGHBOURHOOD // ROWS)).cast("int"), slot % (NEIGHBOURHOOD // ROWS)
    along = F.floor(rest / (2 * PER_EDGE)) + (F.floor(rest % (2 * PER_EDGE) / 2) + 0.1 + k * 31 % 89 / 89 * 0.8) / PER_EDGE
    street = F.concat(F.lit("Row "), row.cast("string"))
    houses = table(spark, sf_dir, "customer").select(
        F.floor(k / NEIGHBOURHOOD).cast("string").alias("area"), k.cast("string").alias("house_id"), slot.alias("ord"),
        (synthetic.LAT0 + row * synthetic.D_LAT + F.when(slot % 2 == 0, F.lit(synthetic.OFF)).otherwise(F.lit(-synthetic.OFF))).alias("lat"), (synthetic.LON0 + along * synthetic.D_LON).alias("lon"),
        F.concat(k.cast("string"), F.lit(" "), street).alias("label"), street.alias("street"), (F.col("c_acctbal") < 0).alias("flagged"), (k % 17 == 0).alias("manual"),
    )
    areas = houses.select("area").distinct()
    streets = synthetic.grid(spark, ROWS, COLS, 0)
    return {"houses": houses} | {name: areas.crossJoin(F.broadcast(streets[name].drop("area"))) for name in ("nodes", "ways")}


#: Nodes of a block: four rows of the grid, of which the last one is alone.
BLOCK = 40


def nodes(spark: SparkSession, sf_dir: str, blocks: bool = False) -> DataFrame:
    """Suppliers as crossings of a grid ten wide, by rows; one area, or an area for each block, for no street leads out of one."""
    k = F.col("s_suppkey")
    area = F.floor(k / BLOCK).cast("string") if blocks else F.lit("grid")
    return table(spark, sf_dir, "supplier").select(area.alias("area"), k.alias("node_id"), k.alias("ord"), (42.0 + F.floor(k / 10) * 9e-4).alias("lat"), (-88.3 + k % 10 * 12e-4).alias("lon"))


NODES_SQL = f"""nodes AS (SELECT s_suppkey // {BLOCK} AS block, s_suppkey AS node_id, 42.0::DOUBLE + (s_suppkey // 10) * 9e-4::DOUBLE AS lat, -88.3::DOUBLE + s_suppkey % 10 * 12e-4::DOUBLE AS lon FROM supplier)"""


def ways(spark: SparkSession, sf_dir: str, blocks: bool = False) -> DataFrame:
    """One way a step of the grid, along rows and, at every third crossing, across them; some rows are missing, so that the grid falls into blocks."""
    k = F.col("s_suppkey")
    across = table(spark, sf_dir, "supplier").where((k % 10 != 9) & (F.floor(k / 10) % 4 != 3)).select(k, (k + 1).alias("to"), F.concat(F.lit("Row "), F.floor(k / 10).cast("string")).alias("name"), (2 * k).alias("way_ord"))
    along = table(spark, sf_dir, "supplier").where((F.floor(k / 10) % 4 < 2) & (k % 10 % 3 == 0)).select(k, (k + 10).alias("to"), F.concat(F.lit("Col "), (k % 10).cast("string")).alias("name"), (2 * k + 1).alias("way_ord"))
    both = across.unionByName(along)
    area = F.floor(k / BLOCK).cast("string") if blocks else F.lit("grid")
    return both.select(area.alias("area"), F.col("way_ord").alias("way_id"), F.col("way_ord"), "name", F.lit("residential").alias("highway"), F.array(k, F.col("to")).alias("nodes"))


EDGES_SQL = """edges AS (
  SELECT w.*, s.lat AS lat1, s.lon AS lon1, t.lat AS lat2, t.lon AS lon2,
         2 * 6371008.8::DOUBLE * asin(least(1, sqrt(pow(sin(radians(t.lat - s.lat) / 2), 2) + cos(radians(s.lat)) * cos(radians(t.lat)) * pow(sin(radians(t.lon - s.lon) / 2), 2)))) AS length
  FROM (SELECT s_suppkey AS a, s_suppkey + 1 AS b, 'Row ' || (s_suppkey // 10) AS street, 2 * s_suppkey AS way_ord FROM supplier WHERE s_suppkey % 10 <> 9 AND (s_suppkey // 10) % 4 <> 3
        UNION ALL SELECT s_suppkey, s_suppkey + 10, 'Col ' || (s_suppkey % 10), 2 * s_suppkey + 1 FROM supplier WHERE (s_suppkey // 10) % 4 < 2 AND s_suppkey % 10 % 3 = 0) w
  JOIN nodes s ON s.node_id = w.a JOIN nodes t ON t.node_id = w.b)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors' first two elements as points of the plane, the label as group."""
    return table(spark, sf_dir, "embeddings").select(F.lit("plane").alias("area"), F.col("vec_id").alias("h"), F.element_at("embedding", 1).cast("double").alias("x"), F.element_at("embedding", 2).cast("double").alias("y"), (F.col("label") % GROUPS).alias("g"))


POINTS_SQL = f"""points AS (SELECT 'plane' AS area, vec_id AS h, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, label % {GROUPS} AS g FROM embeddings)"""


def stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as the stops of a loop, in order of time; the event's type is the street."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(F.lit("walk").alias("area"), F.col("user_id").alias("g"), pos.alias("pos"), F.col("event_id").alias("h"), F.col("event_type").alias("street"), "value")


STOPS_SQL = """stops AS (
  SELECT 'walk' AS area, user_id AS g, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, event_id AS h, event_type AS street, value FROM events)"""
