"""The corpus pipeline: quality rules, near-duplicate removal, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before has kept; its table is written as Parquet and read
again as the docs of the next. All stages but the last return the columns of the documents they were given.

Defined results: documents with null or empty texts fail the quality rules and go; repeated rows are near duplicates, of which one stays; a null doc_id is kept
through all stages, and is the last choice of a group of near duplicates; null sources are a source, null languages are judged by characters alone; very
long texts are processed whole and packed in pieces; an empty table gives no rows; extra columns, whatever their names, go through all stages but the last.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from loopwright.checkpoints import remove
from loopwright.llm import minhash, mixing, packing, pii, quality
from loopwright.llm.common import shared_dir, table
from loopwright.llm.queries import tokenizer_path
from loopwright.shipping import ship


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or diverge from their language go."""
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return minhash.keep(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Confirmed personal data is replaced by its kind; n_chars, where there is one, is that of the new text where it changed."""
    return pii.redact(docs, length_col="n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by weighted fair queueing; a document stands as often as it is taken."""
    return mixing.mix(docs)[1]


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mix_sources", mix_sources),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents; stage tables are in the shared folder."""
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    folder, before = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:  # nothing reads it again
            remove(spark, before)
        before = path
    atexit.register(remove, spark, folder)
    return docs


#: Signatures, ids and packing are beyond SQL; tests/llm/test_pipeline.py checks that each stage does what its operator says, and the operators have brute-force tests of their own.
ORACLE_SQL = None
