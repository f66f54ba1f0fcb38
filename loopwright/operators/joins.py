"""Joins and components that hold under hot keys."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loopwright.checkpoints import drop, written

#: A key with more than one of so many rows is hot: there can't be more such keys than this.
HOT = 1000


@contextmanager
def merging(spark: SparkSession) -> Iterator[None]:
    """Within it, sides that aren't marked for a broadcast are merged at any size, so that many small joins, and tables that are small only as compressed files, don't gather on the driver."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "-1")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def meet(rows: DataFrame, found: DataFrame, keys: list[str], n: str, merged: bool = False) -> DataFrame:
    """Inner join of rows with `found`: one row a key (null is a key) whose column `n`, which is dropped, says how many of the rows carry it.

    Hot keys, fewer than HOT by their definition, are broadcast, so that their rows stay where they are; all others are shuffled. `rows` is read twice
    if there is a hot key. `merged` has the others joined by a sort-merge at any size, so that wide rows cost the same part of a small table as of a large one.
    """
    total, most = found.agg(F.sum(n), F.max(n)).first()
    named = found.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in found.columns if c not in keys])
    few, many = named.where(F.col(n) * HOT > F.lit(total)).drop(n), named.where(F.col(n) * HOT <= F.lit(total)).drop(n)
    many = many.hint("merge") if merged else many
    own = [f"_{k}" for k in keys]
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    if not total or most * HOT <= total:
        return rows.join(many, same, "inner").drop(*own)
    hot = rows.join(F.broadcast(few), same, "inner").drop(*own)
    rest = rows.join(F.broadcast(few.select(*own)), same, "left_anti").join(many, same, "inner").drop(*own)
    return hot.unionByName(rest)


def components(edges: DataFrame) -> DataFrame:
    """node, label (the least node of its component) of every node of edges (a, b)."""
    hung = stars(edges)
    return hung.unionByName(hung.select(F.col("label").alias("node"), "label").distinct())


def stars(edges: DataFrame) -> DataFrame:
    """As components(), without the least nodes themselves. Large-star and small-star rounds."""
    work = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    while True:
        # done when every node hangs on one root and no root hangs on another
        ends = work.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(0).alias("hangs")), F.struct(F.col("b").alias("node"), F.lit(1).alias("hangs")))).alias("end")).select("end.*")
        if ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.min("hangs").alias("least")).where("hangs > least").isEmpty():
            break
        # every neighbour that is larger goes to the least of a node's neighbours and itself
        both = work.select(F.col("a").alias("n"), F.col("b").alias("m")).unionByName(work.select(F.col("b").alias("n"), F.col("a").alias("m")))
        least = both.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("low"))
        large = both.where("m > n").join(least, "n").select(F.col("m").alias("b"), F.col("low").alias("a")).where("a <> b").distinct()
        down = large.groupBy("b").agg(F.min("a").alias("low"))
        new = written(large.join(down, "b").select(F.when(F.col("a") == F.col("low"), F.col("b")).otherwise(F.col("a")).alias("b"), F.col("low").alias("a")).where("a <> b").distinct())
        drop(work)
        work = new
    return work.select(F.col("b").alias("node"), F.col("a").alias("label"))
