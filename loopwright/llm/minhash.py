"""Near duplicates by BagMinHash: weighted-Jaccard signatures of the multiset of word shingles.

A text is the multiset of its windows of five words (of all its words, if it has fewer); the weight of a window is how
often it stands. Weights are discretised into the strips [0,1), [1,2), [2,4), [4,8) ... Each window and strip has a Poisson process of
its own whose rate is the strip's width: points in time with a register and a height within the strip, drawn
from hashes, so that all texts share them. A text uses the points below its weight: a whole strip takes each
point, the strip that the weight ends in takes those below it. A register keeps the first time that it is hit; the
chance that two texts agree in it is their weighted Jaccard similarity. Processes are followed only until
every register has been hit earlier.

Bands of registers propose pairs, the overlap of the whole multisets verifies them, and linking.classes joins them.

Multisets are kept as sorted 64-bit hashes, the k-th copy of a window hashed as another one: two different windows of a pair of texts
of n windows fall together with a chance of n*n/2^64. A pair at the threshold of 0.8 is missed by all bands
with a chance of 3e-6, at 0.9 below 1e-12.

Scale: one scan makes signatures; equal texts (same words) are one node from then on; all that is shuffled is a few numbers a band, then one text of
each node that shares a bucket, for its multiset, and multisets of proposed pairs. Rows of a text or class with very many copies stay where they are.

Defined results: null and empty texts, and those without words, are one class; texts of fewer than five words are alike
only if all words are the same; repeated rows are copies; class_id is the least doc_id of the class (nulls aside), null if all are
null; an empty table gives no rows; extra columns, whatever their names, are ignored by near_classes() and kept by keep().
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loopwright.llm.common import chosen, drop, materialise, meet, merging, text_or_empty, unpacked, with_row
from loopwright.llm.linking import classes, linked, members_of, verified_schema

WIDTH = 5
BANDS, ROWS = 32, 5
REGISTERS = BANDS * ROWS
#: Points drawn at once over all processes of a batch.
DRAWS = 1 << 16
#: Words whose hash a worker remembers; then it starts anew.
MEMO_WORDS = 500_000
#: Windows of texts that are signed together.
CHUNK_WINDOWS = 1 << 18

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= MEMO_WORDS:
            self.clear()
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


def windows(words: list[bytes], memo: _Words, width: int = WIDTH) -> np.ndarray:
    """Hash of every window of so many words; of all words, if they are fewer."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    width = min(width, len(words))
    out = np.zeros(len(h) - width + 1, np.uint64)
    for k in range(width):
        out = _mix(out * _U(0x100000001B3) + h[k : len(h) - width + 1 + k])
    return out


def signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """n rows of 64-bit register values for elements (hash, weight >= 1) of so many owners."""
    first = np.full((n, registers), np.inf)
    # strips: [0,1), then [2^(k-1), 2^k); the last one of an element may be cut by its weight
    parts = []
    low, width, k = 0, 1, 0
    while True:
        on = np.flatnonzero(weight > low)
        if not len(on):
            break
        strip = _U(k * int(_GOLDEN) & 0xFFFFFFFFFFFFFFFF)
        parts.append((owner[on], _mix(element[on] + strip), np.full(len(on), float(width)), np.minimum((weight[on] - low) / width, 1.0)))
        low, width, k = low + width, max(low + width, 1), k + 1
    if not parts:
        return np.zeros((n, registers), np.uint64)
    of, seed, rate, below = (np.concatenate(x) for x in zip(*parts))
    time, drawn = np.zeros(len(of)), np.zeros(len(of), np.uint64)
    flat = first.reshape(-1)
    with np.errstate(over="ignore"):
        while len(of):
            each = int(min(64, max(1, DRAWS // len(of))))
            steps = drawn[:, None] + np.arange(1, each + 1, dtype=np.uint64)
            bits = _mix(seed[:, None] + steps * _GOLDEN)
            wait = -np.log1p(-((bits >> _U(11)).astype(float) / 2**53)) / rate[:, None]
            # running sums in the order of the draws, whatever their number here
            times = np.cumsum(np.concatenate([time[:, None], wait], axis=1), axis=1)[:, 1:]
            more = _mix(bits + _GOLDEN)
            register = (more & _U(0xFFFFFFFF)) * _U(registers) >> _U(32)
            height = (more >> _U(32)).astype(float) / 2**32
            hit = height < below[:, None]
            np.minimum.at(flat, (of[:, None] * registers + register.astype(np.int64))[hit], times[hit])
            time, drawn = times[:, -1], drawn + _U(each)
            on = time < first.max(axis=1)[of]
            of, seed, rate, below, time, drawn = of[on], seed[on], rate[on], below[on], time[on], drawn[on]
    return _mix(first.view(np.uint64))


def multiset(hashes: np.ndarray) -> np.ndarray:
    """The sorted 64-bit hashes of all copies of all elements."""
    element, count = np.unique(hashes, return_counts=True)
    copy = np.arange(len(hashes)) - np.repeat(np.cumsum(count) - count, count)
    each = _mix(np.repeat(element, count) + copy.astype(np.uint64) * _GOLDEN)
    return np.sort(each)


def overlap(a: bytes, b: bytes) -> float:
    """Weighted Jaccard similarity of two packed multisets."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if not len(x) or not len(y):
        return 1.0 if len(x) == len(y) else 0.0
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return both / (len(x) + len(y) - both)


def overlaps(bags: list[bytes]):
    """A function that tells the similarities of bag number i to all bags, by the lists of bags that hold each of its elements."""
    sets = [np.frombuffer(b, np.uint64) for b in bags]
    size = np.array([len(x) for x in sets])
    element, at = np.unique(np.concatenate(sets), return_inverse=True)
    holder = np.repeat(np.arange(len(sets)), size)[np.argsort(at, kind="stable")]
    begin = np.searchsorted(np.sort(at), np.arange(len(element) + 1))
    own = np.split(at, np.cumsum(size)[:-1])

    def similar(i: int) -> np.ndarray:
        low, n = begin[own[i]], begin[own[i] + 1] - begin[own[i]]
        places = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.bincount(holder[places], minlength=len(sets))
        return both / (size[i] + size - both)

    return similar


def _hash() -> Column:
    return F.xxhash64(text_or_empty())


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """doc_id, h (hash of the text), node (16 bytes: which words), bands (hashes). Texts are read once, whole."""
    rows = chosen(docs, doc_id=id_col, text=text_col).select("doc_id", _hash().alias("h"), text_or_empty().alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, h bigint, node binary, bands array<bigint>"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Words()
        for batch in batches:
            nodes, bands = [], []
            waiting: list[tuple[np.ndarray, np.ndarray]] = []
            held = 0

            def sign() -> None:
                owner = np.repeat(np.arange(len(waiting)), [len(e) for e, _ in waiting])
                element, weight = (np.concatenate(x) for x in zip(*waiting))
                found = signatures(owner, element, weight, len(waiting)).reshape(len(waiting), BANDS, ROWS)
                keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(waiting), BANDS))
                for r in range(ROWS):
                    keys = _mix(keys * _GOLDEN + found[:, :, r])
                for (e, _), row in zip(waiting, keys.view(np.int64)):
                    bands.append(row if len(e) else None)
                waiting.clear()

            for text in batch.column(2):
                words = text.as_py().encode("utf-8", "surrogatepass").split()
                nodes.append(hashlib.md5(b" ".join(words), usedforsecurity=False).digest())
                element, count = np.unique(windows(words, memo, width), return_counts=True)
                waiting.append((element, count))
                held += len(element)
                if held > CHUNK_WINDOWS:
                    sign()
                    held = 0
            if waiting:
                sign()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "h", "node", "bands"])

    return rows.mapInArrow(read, schema)


def bags_of(texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """node, bag (packed multiset) of rows (node, text)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Words()
        for batch in batches:
            bags = [multiset(windows(t.as_py().encode("utf-8", "surrogatepass").split(), memo, width)).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bags, pa.binary())], names=["node", "bag"])

    return texts.select("node", "text").mapInArrow(read, "node binary, bag binary")


def _verifier(bags: DataFrame):
    def verify(pairs: DataFrame) -> DataFrame:
        met = pairs.join(bags.select(F.col("node").alias("a"), F.col("bag").alias("bag_a")), "a").join(bags.select(F.col("node").alias("b"), F.col("bag").alias("bag_b")), "b")
        names = [*pairs.columns, "sim"]

        def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sims = [overlap(x.as_buffer(), y.as_buffer()) for x, y in zip(batch.column(0), batch.column(1))]
                yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(sims, pa.float64())], names=names)

        return met.select("bag_a", "bag_b", *pairs.columns).mapInArrow(judged, verified_schema(pairs))

    return verify


def _linked(docs: DataFrame, threshold: float, width: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, h, node) of every row, (node, label, links, likest) of the nodes with a link, and the links (a, b, sim)."""
    with merging(docs.sparkSession):
        return _found(docs, threshold, width, id_col, text_col)


def _found(docs: DataFrame, threshold: float, width: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    known = materialise(sketch(docs, id_col, text_col, width))
    rows = materialise(known.select("doc_id", "h", "node"))
    # copies are one node: any row of it tells its bands
    nodes = materialise(known.where("bands is not null").groupBy("node").agg(F.array_distinct(F.first("bands")).alias("bands")))
    drop(known)
    members = members_of(nodes, once=True)
    drop(nodes)
    # only nodes in a bucket with another one are ever verified: of each, one text comes again for its multiset
    counted = rows.groupBy("node", "doc_id", "h").agg(F.count("*").alias("n")).groupBy("node").agg(F.min(F.struct("n", "doc_id", "h")).alias("one"))
    wanted = materialise(counted.join(members.select("node").distinct(), "node", "left_semi").select("node", "one.*"))
    texts = chosen(docs, doc_id=id_col, text=text_col).select("doc_id", _hash().alias("h"), text_or_empty().alias("text"))
    once, several = wanted.where("n = 1"), wanted.where("n > 1")
    bags = bags_of(meet(texts, once, ["doc_id", "h"], "n", merged=True), width)
    if not several.isEmpty():  # rows that share doc_id and text: one of them does
        bags = bags.unionByName(bags_of(meet(texts, several, ["doc_id", "h"], "n", merged=True), width).groupBy("node").agg(F.first("bag").alias("bag")))
    bags = materialise(bags)
    drop(wanted)
    labels, links = classes(members, _verifier(bags), threshold, lambda nodes: bags.join(nodes, "node", "left_semi").select("node", F.col("bag").alias("data")), overlaps)
    found = materialise(linked(labels, links))
    drop(bags, members)
    return rows, found, links


def _firsts(rows: DataFrame) -> DataFrame:
    """node, first (null, doc_id, h), copies: the row of each text with the least doc_id, nulls last."""
    return rows.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "h")).alias("first"), F.count("*").alias("copies"))


def near_classes(docs: DataFrame, threshold: float = 0.8, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id, copies, links, overlap of every row: texts connected by links of at least `threshold`.

    `copies` counts the rows with the same words, this one too; `links` the verified links of the text to other texts; `overlap` is the greatest of theirs,
    null without one. Links that would only repeat that two texts are of one class aren't looked for.
    """
    rows, labels, _ = _linked(docs, threshold, width, id_col, text_col)
    named = materialise(_firsts(rows).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    ids = materialise(named.groupBy("label").agg(F.min("first").alias("least"), F.count("*").alias("n")).select("label", F.col("least.doc_id").alias("class_id"), "n"))
    by_node = meet(named, ids, ["label"], "n").select("node", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.col("likest").alias("overlap"), F.col("copies").alias("n"))
    return meet(rows, materialise(by_node), ["node"], "n").select("doc_id", "class_id", "copies", "links", "overlap")


def near_links(docs: DataFrame, threshold: float = 0.8, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """a, b, overlap: the verified links between different texts, each text by its least doc_id. They hold the classes together."""
    rows, _, links = _linked(docs, threshold, width, id_col, text_col)
    ids = _firsts(rows).select("node", F.col("first.doc_id").alias("id"))
    named = links.join(ids.withColumnRenamed("node", "a").withColumnRenamed("id", "x"), "a").join(ids.withColumnRenamed("node", "b").withColumnRenamed("id", "y"), "b")
    return named.select(F.col("x").alias("a"), F.col("y").alias("b"), F.col("sim").alias("overlap"))


def keep(docs: DataFrame, threshold: float = 0.8, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with all their columns, one of each class: the one with the least doc_id (nulls last), of its repeated rows one."""
    rows, labels, _ = _linked(docs, threshold, width, id_col, text_col)
    firsts = _firsts(rows).join(labels.select("node", "label"), "node", "left")
    least = firsts.groupBy(F.coalesce("label", "node").alias("label")).agg(F.min("first").alias("first"))
    wanted = least.select(F.col("first.doc_id").alias("id"), F.col("first.h").alias("h")).distinct()
    copies = rows.groupBy(F.col("doc_id").alias("id"), "h").agg(F.count("*").alias("n"))
    named = wanted.select(F.col("id").alias("i"), F.col("h").alias("g"))
    counted = materialise(copies.join(named, F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("g")), "inner").select("id", "h", "n"))
    keyed = with_row(docs, id=id_col, text=text_col).select("row", "id", _hash().alias("h"))
    once, several = counted.where("n = 1"), counted.where("n > 1")
    # rows that share the chosen doc_id and text: one stays
    single = meet(keyed, once, ["id", "h"], "n", merged=True).select("row")
    first = meet(keyed, several, ["id", "h"], "n", merged=True).groupBy("id", "h").agg(F.first("row").alias("row")).select("row")
    return unpacked(single.unionByName(first), docs)
