"""The synthetic neighbourhood: a grid of streets with houses on both sides of each row's blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LAT0, LON0, D_LAT, D_LON, OFF = 42.0, -88.3, 0.0009, 0.0012, 0.00015


def grid(spark: SparkSession, rows: int, cols: int, per_edge: int, areas: int = 1) -> dict[str, DataFrame]:
    """nodes, ways and houses of so many equal areas ('0', '1', ...)."""
    area = spark.range(areas).select(F.col("id").cast("string").alias("area"))
    cells = F.explode(F.sequence(F.lit(0), F.lit(rows * cols - 1)))
    nodes = area.select("area", cells.alias("ord")).select("area", (F.col("ord") + 1).cast("bigint").alias("node_id"), "ord", (LAT0 + F.floor(F.col("ord") / cols) * D_LAT).alias("lat"), (LON0 + (F.col("ord") % cols) * D_LON).alias("lon"))
    ways = area.select("area", F.explode(F.sequence(F.lit(0), F.lit(rows + cols - 1))).alias("way_ord"))
    across = F.col("way_ord") < rows
    line = F.when(across, F.transform(F.sequence(F.lit(0), F.lit(cols - 1)), lambda c: (F.col("way_ord") * cols + c + 1).cast("bigint"))).otherwise(F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda k: (k * cols + F.col("way_ord") - rows + 1).cast("bigint")))
    name = F.when(across, F.concat(F.lit("Row "), F.col("way_ord").cast("string"))).otherwise(F.concat(F.lit("Col "), (F.col("way_ord") - rows).cast("string")))
    ways = ways.select("area", (F.col("way_ord") + 1000).cast("bigint").alias("way_id"), "way_ord", name.alias("name"), F.lit("residential").alias("highway"), line.alias("nodes"))
    per_row = (cols - 1) * per_edge * 2
    slots = area.select("area", F.explode(F.sequence(F.lit(0), F.lit(rows * per_row - 1))).alias("ord")) if per_row else area.select("area", F.lit(0).alias("ord")).limit(0)
    row, rest = F.floor(F.col("ord") / per_row) if per_row else F.lit(0), F.col("ord") % max(per_row, 1)
    placed = slots.select("area", "ord", row.cast("int").alias("r"), F.floor(rest / (2 * per_edge)).cast("int").alias("c"), F.floor(rest % (2 * per_edge) / 2).cast("int").alias("k"), (F.col("ord") % 2 == 0).alias("up"))
    houses = placed.select(
        "area", F.concat(F.lit("h"), F.concat_ws("_", F.col("r"), F.col("c"), F.col("k"), F.when(F.col("up"), "+").otherwise("-"))).alias("house_id"), "ord",
        (LAT0 + F.col("r") * D_LAT + F.when(F.col("up"), F.lit(OFF)).otherwise(F.lit(-OFF))).alias("lat"), (LON0 + (F.col("c") + (F.col("k") + 0.5) / per_edge) * D_LON).alias("lon"),
        F.concat((F.col("k") + 1).cast("string"), F.lit(" Row "), F.col("r").cast("string")).alias("label"), F.concat(F.lit("Row "), F.col("r").cast("string")).alias("street"),
        F.lit(False).alias("flagged"), F.lit(False).alias("manual"),
    )
    return {"nodes": nodes, "ways": ways, "houses": houses}
