"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loopwright.checkpoints import drop, shared_dir
from loopwright.checkpoints import written as materialise
from loopwright.functions.text import let
from loopwright.operators.joins import HOT, components, meet, merging, stars

#: Java form of the word class: anything but space, tab, line feed, vertical tab, form feed and carriage return.
SPACES = r"[ \t\n\x0B\f\r]+"

#: The characters of SPACES, for trim().
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chosen(docs: DataFrame, **wanted: str) -> DataFrame:
    """The wanted columns (new name = column of docs) alone. Other columns may have any names, also such as differ in case only or have dots."""
    rows = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return rows.select(*[F.col(f"c{place(docs, name)}").alias(new) for new, name in wanted.items()])


def place(docs: DataFrame, name: str) -> int:
    """Which column has this name: the first that is spelled so, else the first that differs in case only."""
    for same in (str, str.lower):
        for i, c in enumerate(docs.columns):
            if same(c) == same(name):
                return i
    raise ValueError(f"no column {name!r} among {docs.columns}")


def with_row(docs: DataFrame, **wanted: str) -> DataFrame:
    """As chosen(), and `row`, a struct of all columns by place, which unpacked() gives back."""
    n = len(docs.columns)
    rows = docs.toDF(*[f"c{i}" for i in range(n)])
    return rows.select(F.struct(*[F.col(f"c{i}") for i in range(n)]).alias("row"), *[F.col(f"c{place(docs, name)}").alias(new) for new, name in wanted.items()])


def unpacked(rows: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of docs out of `row`; those in `changed` are replaced."""
    new = {place(docs, name): c for name, c in changed.items()}
    return rows.select(*[new.get(i, F.col("row").getField(f"c{i}")).alias(c) for i, c in enumerate(docs.columns)])


def text_or_empty(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words(text: Column) -> Column:
    """Array of the words of a text; empty for a text without one."""
    trimmed = F.trim(text, F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES))


def _running(values: Column, first: Column, step: Callable[[Column, Column], Column], block: int) -> Column:
    """Inclusive running results of an array<bigint>, in time linear in its length for practical sizes.

    The array is run through in blocks, so that the array being built is never copied as a whole. `first` changes nothing under step.
    """

    def running(xs: Column) -> Column:
        grown = F.aggregate(xs, F.array(first), lambda acc, x: F.concat(acc, F.array(step(F.element_at(acc, -1), x))))
        return F.slice(grown, 2, F.size(xs))

    last = F.greatest(F.floor((F.size(values) - 1) / F.lit(block)), F.lit(0)).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), last), lambda b: running(F.slice(values, b * block + 1, F.lit(block))))
    before = F.aggregate(blocks, F.array(first), lambda acc, x: F.concat(acc, F.array(step(F.element_at(acc, -1), F.element_at(x, -1)))))
    joined = F.flatten(F.zip_with(blocks, F.slice(before, 1, F.size(blocks)), lambda xs, b: F.transform(xs, lambda x: step(b, x))))
    return F.when(F.size(values) == 0, F.array().cast("array<bigint>")).otherwise(joined)


def prefix_sums(values: Column, block: int = 128) -> Column:
    """Inclusive running sums of an array<bigint>."""
    return _running(values, F.lit(0).cast("bigint"), lambda a, x: a + x, block)


def prefix_greatest(values: Column, block: int = 128) -> Column:
    """The greatest so far, for each place of an array<bigint> of no negative values."""
    return _running(values, F.lit(0).cast("bigint"), lambda a, x: F.greatest(a, x), block)


__all__ = ["HOT", "SPACES", "SPACE_CHARS", "chosen", "components", "drop", "let", "materialise", "meet", "merging", "place", "prefix_greatest", "prefix_sums", "shared_dir", "stars", "table", "text_or_empty", "unpacked", "with_row", "words"]
