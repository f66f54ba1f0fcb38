"""Places of rows in an order, without a window over all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loopwright.checkpoints import written

#: monotonically_increasing_id() counts rows in so many low bits.
_LOW = 33


def placed(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows with `at`, their place from 0 in the order of `by` (nulls first, strings by bytes; rows that agree in it stand side by side).

    A range sort deals the rows, copies of one key too, over the tasks; each range is counted and set off by those before it. rows must be a table: it is read twice.
    The one window without a partition holds a row a range.
    """
    order = [F.col(c).asc_nulls_first() for c in by]
    salted = rows.withColumn("_salt", F.monotonically_increasing_id())
    ranged = written(salted.repartitionByRange(*order, "_salt").sortWithinPartitions(*order, "_salt").drop("_salt").withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", _LOW)
    counts = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))
    before = counts.select(F.col("_part").alias("_p"), (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))
    at = F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << _LOW) - 1))
    return ranged.join(F.broadcast(before), part == F.col("_p")).withColumn("at", at).drop("_id", "_p", "_before")
