"""Best-fit packing with vector capacities.

A piece is a vector (tokens, documents, attention cost), the last being its squared length. A sequence has a
capacity in each; a piece fits only if no capacity is exceeded. Pieces come in descending weighted norm; each
goes to the open sequence with the least weighted residual norm, or the greatest weighted dot-product of
residual and piece, of those that it fits.

Scale: texts are tokenized in one scan; from then on only small rows move. Pieces are dealt by hash into groups
of a set number of sequences, whatever the table's size or the cluster's partitions, and each group is packed
by itself. Sequences left with much room are opened again and their pieces packed across groups once more.

Defined results: null text is the empty text, one closing id; repeated rows are packed each; a null doc_id is kept, and ids of any type and
size stay as they are (groups are Arrow tables); an empty table gives no rows; ties are broken by the order of (doc_id, nulls first, piece,
ids_crc32); extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopwright.llm.common import chosen, drop, materialise, text_or_empty
from loopwright.llm.tokens import SharedCoder


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids and the end id, cut at every `capacity` ids: doc_id, piece, start, length, ids_crc32."""
    coder = SharedCoder(docs.sparkSession, tokenizer_path)
    rows = chosen(docs, doc_id=id_col, text=text_col).select("doc_id", text_or_empty().alias("text"))
    number = F.lit(0).cast("bigint")
    schema = rows.select("doc_id", F.lit(0).alias("piece"), number.alias("start"), number.alias("length"), number.alias("ids_crc32")).schema
    end, step = end_id.to_bytes(4, "little"), 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder.get()
        for batch in batches:
            of, piece, start, length, crc = [], [], [], [], []
            for at, text in enumerate(batch.column(1)):
                packed = own.pack(text.as_py()) + end
                for k, first in enumerate(range(0, len(packed), step)):
                    part = packed[first : first + step]
                    of.append(at)
                    piece.append(k)
                    start.append(first // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return rows.mapInArrow(cut, schema)


def best_fit(sizes: np.ndarray, capacity: np.ndarray, weights: np.ndarray, rule: str = "norm") -> np.ndarray:
    """Bin number of each row of `sizes` (already in descending order). Every row must fit an empty bin."""
    bins = np.empty(len(sizes), np.int64)
    if not len(sizes):
        return bins
    room = np.empty((64, sizes.shape[1]))
    names = np.empty(64, np.int64)
    n = made = 0
    # from the end: the least that any later piece needs, by which full bins are closed
    least = np.minimum.accumulate(sizes[::-1], axis=0)[::-1]
    scaled = weights / capacity
    for at, size in enumerate(sizes):
        if at % 256 == 0 and n:
            keep = (room[:n] >= least[at]).all(axis=1)
            if not keep.all():
                m = int(keep.sum())
                room[:m], names[:m] = room[:n][keep], names[:n][keep]
                n = m
        fits = np.flatnonzero((room[:n] >= size).all(axis=1))
        if len(fits):
            left = (room[fits] - size) * scaled if rule == "norm" else room[fits] * scaled
            score = (left * left).sum(axis=1) if rule == "norm" else -(left * (size * scaled)).sum(axis=1)
            chosen = fits[int(np.argmin(score))]
        else:
            if n == len(room):
                room, names = np.concatenate([room, np.empty_like(room)]), np.concatenate([names, np.empty_like(names)])
            chosen, n = n, n + 1
            room[chosen], names[chosen], made = capacity, made, made + 1
        room[chosen] -= size
        bins[at] = names[chosen]
    return bins


def pack(
    cut: DataFrame,
    capacity: int = 2048,
    max_documents: int | None = None,
    max_attention: int | None = None,
    weights: tuple[float, float, float] = (1.0, 0.05, 0.2),
    rule: str = "norm",
    bins_per_group: int = 1024,
    reopen_below: float = 0.99,
) -> DataFrame:
    """Adds sequence_id and offset to pieces (of at most `capacity` tokens each).

    The default document and attention capacities are those that any sequence of `capacity` tokens keeps:
    one document a token, and capacity squared. Lower them to bind. A piece that alone exceeds the attention
    capacity is an error, for no sequence could hold it.
    """
    caps = np.array([capacity, max_documents or capacity, max_attention or capacity * capacity], float)
    by = np.array(weights, float)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    cut = cut.select(*columns)
    whole = (F.col("length") == capacity) & F.lit(caps[2] >= capacity * capacity)
    # a full piece is a sequence by itself; its number is below zero, so that it meets no packed one
    full = cut.where(whole).select(*columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    open_pieces = cut.where(~whole)
    out_schema = open_pieces.select(*columns, F.lit(0).cast("bigint").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"), F.lit(False).alias("roomy")).schema

    def grouped(rows: DataFrame, level: int) -> DataFrame:
        tokens = rows.agg(F.sum("length")).first()[0] or 0
        groups = max(1, -(-tokens // (capacity * bins_per_group)))
        last = groups == 1

        def packed(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
            length = group["length"].to_numpy().astype(float)
            size = np.stack([length, np.ones_like(length), length * length], axis=1)
            if (size > caps).any():
                raise ValueError("a piece exceeds the capacity of an empty sequence")
            norm = ((size * by / caps) ** 2).sum(axis=1)
            keys = [("norm", "descending"), *[(c, "ascending") for c in ("doc_id", "piece", "ids_crc32")]]
            order = pc.sort_indices(group.append_column("norm", pa.array(norm)), keys, null_placement="at_start").to_numpy().astype(np.int64)
            size = size[order]
            bins = best_fit(size, caps, by, rule)
            inside = np.argsort(bins, kind="stable")
            bins, length = bins[inside], size[inside, 0].astype(np.int64)
            fill = np.bincount(bins, length)
            ends = np.cumsum(length)
            first = np.r_[True, bins[1:] != bins[:-1]]
            begin = (ends - length)[first][np.cumsum(first) - 1]
            out = group.select(columns).take(pa.array(order[inside]))
            out = out.append_column("sequence_id", pa.array((level << 56) + (key[0].as_py() << 24) + bins, pa.int64()))
            out = out.append_column("offset", pa.array(ends - length - begin, pa.int64()))
            return out.append_column("roomy", pa.array((not last) & (fill[bins] < reopen_below * capacity), pa.bool_()))

        dealt = rows.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(level)), F.lit(groups)))
        return materialise(dealt.groupBy("g").applyInArrow(packed, out_schema))

    first = grouped(open_pieces, 0)
    kept = first.where(~F.col("roomy")).drop("roomy")
    again = grouped(first.where("roomy").select(*columns), 1).drop("roomy")
    return full.unionByName(kept).unionByName(again)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Tokenizes and packs: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = materialise(pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col))
    return pack(cut, capacity, **options)
