"""Cutting lineage through the shared folder of the cluster."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's setting that removes the shuffle files of a query at its end.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_LOCAL: dict[str, str] = {}
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset a session on one machine gets a folder of its own, as in tests; a cluster gets an error."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not (context.master or "").startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset; it has to name a folder that all executors share")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="loopwright-")
    return _LOCAL[context.applicationId]


def remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended: the cluster's own retention clears its scratch folder
        pass


@contextmanager
def dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it, a query's shuffle files go when the query has ended: what it wrote is a table by then."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder. A lost executor costs a reread, never a recomputation.

    drop() removes the table once all that reads it is written itself; what is left goes when the driver exits.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loopwright/{uuid.uuid4().hex}"
    with dropping_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    atexit.register(remove, spark, path)
    table = spark.read.schema(df.schema).parquet(path)
    _PATHS[table] = path
    return table


def drop(*tables: DataFrame) -> None:
    """Removes tables that written() gave and that nothing will read again."""
    for table in tables:
        path = _PATHS.pop(table, None)
        if path:
            remove(table.sparkSession, path)


def renamed(df: DataFrame) -> DataFrame:
    """df with columns of the same names that are new to the analyser: for a side that meets what it was made from."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def path_of(table: DataFrame) -> str:
    """The folder of a table that written() gave, for who reads its files as a stream or by their names."""
    return _PATHS[table]
