"""Exact deduplication as a stream with keyed state.

Content store: each document's normalised bytes (white space deleted) with their SHA-256, written once. A row of it has a locator: file and row in the file.

Stream: the store's narrow columns are read as a stream of files, `files_per_batch` a batch. The state is keyed by digest, on disk (RocksDB, changes and snapshots in the
stream's checkpoint in the shared folder) and never expires. An entry keeps the identifier and locator of the row that stays so far, and how often the
digest was met. Batches are summed a task before they are dealt by digest, so a text in a third of all rows is an entry a task. A restarted
stream goes on from its checkpoint, and absorb() over a store that got more files reads these alone.

Hits: whatever digest was met more than once. The bytes at the locator are fetched, and every other row of the digest is compared with them byte by byte.
Rows whose bytes differ though their digests agree are grouped by the bytes themselves, apart.

Scale: bytes are dealt by digest once to find the hits and once to meet the located bytes, which stand once for every SLOT rows they are compared with,
so a group of any size is spread over tasks and no bytes are broadcast. Rows meet the state's entries by common.meet(), which broadcasts fewer than HOT fixed-size entries.

Defined results: null texts count as empty; all texts without other characters than white space are equal; the row with most code points stays, then that with the smallest doc_id
(null is the largest), then the first in the store, so that of repeated rows one stays; keep_id is null if a null doc_id stays; an empty table gives no rows; extra columns,
whatever their names, are ignored, and kept by keep().
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loopwright.checkpoints import path_of, remove
from loopwright.llm.common import SPACE_CHARS, chosen, drop, materialise, meet, shared_dir, text_or_empty, unpacked, with_row

#: Rows that are compared with one copy of the located bytes.
SLOT = 256

#: The state on disk, within a bound of memory an executor.
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


@contextmanager
def _set(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def normalised(text: Column) -> Column:
    """The text without white space."""
    for space in SPACE_CHARS:
        text = F.replace(text, F.lit(space), F.lit(""))
    return text


def content_store(rows: DataFrame, digest_chars: int = 64) -> DataFrame:
    """A written table: doc_id, n (code points), sha (of the normalised text), key (its first characters, all but in tests), body; of rows (doc_id, text, more)."""
    body = rows.withColumn("n", F.length("text").cast("bigint")).withColumn("body", normalised(F.col("text"))).drop("text")
    return materialise(body.withColumn("sha", F.sha2("body", 256)).withColumn("key", F.substring("sha", 1, digest_chars)))


def _located(store: DataFrame, *columns: str) -> DataFrame:
    return store.select(*columns, F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"))


def _best(file: str = "file", at: str = "at") -> Column:
    """What orders the rows of a group: the least stays."""
    return F.struct((-F.col("n")).alias("less"), F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col(file).alias("file"), F.col(at).alias("at"))


def absorb(spark: SparkSession, store_path: str, checkpoint: str, files_per_batch: int | None = None) -> None:
    """Takes the files of a content store that the state hasn't seen yet into it, batch by batch, and ends."""
    source = spark.readStream.schema("key string, n bigint, doc_id bigint")
    source = source.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else source
    rows = _located(source.parquet(store_path), "key", "n", "doc_id")
    state = rows.groupBy("key").agg(F.min(_best()).alias("head"), F.count("*").alias("copies"))
    with _set(spark, _STATE):
        query = state.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()


def entries(spark: SparkSession, checkpoint: str) -> DataFrame:
    """key, head_id, head_file, head_at, copies: what the state holds."""
    with _set(spark, _STATE):
        held = spark.read.format("statestore").load(checkpoint)
    head, copies = (F.col(f"value.{name}") for name in held.schema["value"].dataType.names)
    return held.select("key.key", head["id"].alias("head_id"), head["file"].alias("head_file"), head["at"].alias("head_at"), copies.alias("copies"))


def _differing(store: DataFrame, held: DataFrame) -> DataFrame:
    """key, doc_id, n, file, at, body of the rows whose bytes aren't those at their digest's locator."""
    again = held.where("copies > 1").select("key", "head_file", "head_at", "copies", F.col("copies").alias("n_copies"))
    hits = materialise(meet(_located(store, "key", "doc_id", "n", "body"), again, ["key"], "n_copies"))
    slots = F.ceil(F.col("copies") / SLOT).cast("int")
    is_head = (F.col("file") == F.col("head_file")) & (F.col("at") == F.col("head_at"))
    fetched = hits.where(is_head).select(F.col("key").alias("k"), F.col("body").alias("held"), F.explode(F.sequence(F.lit(0), slots - 1)).alias("s"))
    asking = hits.where(~is_head).withColumn("slot", F.pmod(F.xxhash64("file", "at"), slots.cast("bigint")).cast("int"))
    met = asking.join(fetched.hint("merge"), (F.col("key") == F.col("k")) & (F.col("slot") == F.col("s")))
    found = materialise(met.where("body <> held").select("key", "doc_id", "n", "file", "at", "body"))
    drop(hits)
    return found


def _classes(store: DataFrame, files_per_batch: int | None) -> DataFrame:
    """A row of the store each: its columns but body, keep_id, group_size, kept."""
    spark = store.sparkSession
    own = [c for c in store.columns if c != "body"]
    checkpoint = f"{shared_dir(spark)}/loopwright/state-{uuid.uuid4().hex}"
    absorb(spark, path_of(store), checkpoint, files_per_batch)
    held = materialise(entries(spark, checkpoint))
    remove(spark, checkpoint)
    odd = _differing(store, held)
    rows = _located(store, *own)
    result = lambda df, keep, size, kept: df.select(*own, keep.alias("keep_id"), size.alias("group_size"), kept.alias("kept"))
    if odd.isEmpty():
        met = meet(rows, held.withColumn("n_copies", F.col("copies")), ["key"], "n_copies")
        return result(met, F.col("head_id"), F.col("copies"), (F.col("file") == F.col("head_file")) & (F.col("at") == F.col("head_at")))
    # digests of several texts: the located one's rows are those that don't differ; all others group by their bytes
    fewer = odd.groupBy(F.col("key").alias("k")).agg(F.count("*").alias("others"))
    right = held.join(fewer, F.col("key") == F.col("k"), "left").select("key", "head_id", "head_file", "head_at", (F.col("copies") - F.coalesce("others", F.lit(0))).alias("copies"), F.col("copies").alias("n_copies"))
    places = odd.select(F.col("file").alias("f"), F.col("at").alias("a"))
    same = rows.join(places, (F.col("file") == F.col("f")) & (F.col("at") == F.col("a")), "left_anti")
    met = meet(same, right, ["key"], "n_copies")
    first = result(met, F.col("head_id"), F.col("copies"), (F.col("file") == F.col("head_file")) & (F.col("at") == F.col("head_at")))
    groups = materialise(odd.groupBy("key", "body").agg(F.min(_best()).alias("head"), F.count("*").alias("copies")).withColumn("n_copies", F.col("copies")))
    parted = meet(odd.select("key", "body", "file", "at"), groups, ["key", "body"], "n_copies").select(F.col("file").alias("f"), F.col("at").alias("a"), "head", "copies")
    others = rows.join(parted, (F.col("file") == F.col("f")) & (F.col("at") == F.col("a")))
    return first.unionByName(result(others, F.col("head.id"), F.col("copies"), (F.col("file") == F.col("head.file")) & (F.col("at") == F.col("head.at"))))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", files_per_batch: int | None = None, digest_chars: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: a row a document, dropped ones too. files_per_batch: all files in one batch if None."""
    rows = chosen(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    if rows.isEmpty():
        return rows.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), F.lit("").alias("text_sha256"))
    return _classes(content_store(rows, digest_chars), files_per_batch).select("doc_id", "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", files_per_batch: int | None = None) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    if docs.isEmpty():
        return docs
    rows = with_row(docs, doc_id=id_col, text=text_col).select("row", F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    return unpacked(_classes(content_store(rows), files_per_batch).where("kept"), docs)


__all__ = ["absorb", "content_store", "deduplicate", "entries", "keep"]
