"""Document fingerprints by randomised edit embedding.

Shared random walks read a text: at step j the walk stands on a character and stays or moves on by a coin that
depends on j and the character alone. The characters it stands on, step by step, are the embedding: texts at a small
edit distance fall back into step after each edit, so their embeddings differ at few steps (Hamming distance).

The fingerprint samples the embedding at SLOTS steps, half of them from each of two walks. Each slot has a fixed rising list of
steps, drawn so that the last one below the embedding's length is uniform over it: texts of different lengths
still sample mostly the same steps, and texts of any length are sampled over their whole. A slot holds 4 bits of the
step and its character. Likeness of two fingerprints is the share of equal slots, freed of chance (1/16), of
the walk that agrees better: 1 for equal texts, near 0 for unrelated ones.

Near copies: 64 bands of 8 sampled slots propose pairs, the likeness of whole fingerprints verifies them (from 0.6 on), by the linking that also
serves signatures, so no group is ever collected or paired off whole.

Scale: own fingerprints need one scan. The texts of a stretch walk together, a character of each at a time, as arrays. To meet the next document, the texts are range-sorted by doc_id, the one
shuffle of texts; each range gives all its results but the last, which meets the first text of the next
range in a join of one row a range.

Defined results: a null text is the empty one, whose fingerprint is all zeros, its likeness 1 to itself and 0 to any other; repeated rows
stand next to each other (order: doc_id descending, nulls last, then text's hash); a null doc_id is kept; class_id is the least doc_id of
the class, nulls aside; an empty table gives no rows; the single row of a table is its own next; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loopwright.llm.common import chosen, drop, materialise, meet, text_or_empty
from loopwright.llm.linking import classes, linked, members_of, verified_schema

SLOTS, WALKS = 256, 2
#: Coins repeat after so many steps; characters share so many rows of coins.
PERIOD, CLASSES = 1 << 16, 128
#: Steps are drawn up to here, more than any text has.
FAR = 1 << 42
#: Characters of texts that are walked at once, and how many texts make that worth while.
CHARS, TOGETHER = 1 << 23, 64
#: Bands, the slots that each samples, and the likeness from which two texts are near copies.
BANDS, SAMPLE, NEAR = 64, 8, 0.6
#: A range of documents has about so many bytes of text.
RANGE_BYTES = 32 << 20

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Walk:
    """One shared walk with its slots."""

    def __init__(self, number: int):
        draw = np.random.Generator(np.random.PCG64([20160, number]))
        coins = draw.integers(0, 2, (CLASSES, PERIOD), dtype=np.uint8)
        coins[:, ::200] = 1  # no stay longer than a byte can tell
        at = np.where(np.concatenate([coins, coins], axis=1) == 1, np.arange(2 * PERIOD, dtype=np.int64), 4 * PERIOD)
        following = np.minimum.accumulate(at[:, ::-1], axis=1)[:, ::-1][:, :PERIOD]
        #: By class of character and step: how far the coins make the walk stay.
        self.advance = (following - np.arange(PERIOD) + 1).astype(np.uint8)
        self._rows = [row.tobytes() for row in self.advance]
        steps = []
        for slot in range(SLOTS // WALKS):
            step = 0
            while step < FAR:
                steps.append((step, slot))
                step = int((step + 1) / (1.0 - draw.random()))  # the next record of a random order: uniform below any length
        steps.sort()
        self._steps = np.array([s for s, _ in steps], np.int64)
        # by number of steps that a walk has passed: each slot's last one
        self._last = np.full((len(steps) + 1, SLOTS // WALKS), -1, np.int64)
        for k, (step, slot) in enumerate(steps):
            self._last[k + 1] = self._last[k]
            self._last[k + 1, slot] = step

    def wanted(self, end: np.ndarray) -> np.ndarray:
        """The steps that the slots of walks of these lengths sample; -1 for a walk without a step."""
        return self._last[np.searchsorted(self._steps, end, side="left")]

    def go_alone(self, classes: np.ndarray, begin: int) -> np.ndarray:
        """The steps at which a walk that begins at a step leaves the characters."""
        j, mask, rows = begin, PERIOD - 1, self._rows
        return np.array([j := j + rows[c][j & mask] for c in classes.tolist()], np.int64)


def go(classes: np.ndarray, first: np.ndarray, length: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """One row a walk: the steps at which each character of all texts is left. Texts begin at `first` and have `length` characters in `classes`;
    the walks of each begin at a step (a row a walk). All texts advance together, one character at a time, while they are many; the
    rest of the longest ones goes by itself.
    """
    left = np.empty((WALKS, len(classes)), np.int32 if len(classes) < 1 << 28 else np.int64)
    order = np.argsort(-length, kind="stable")
    first, length, j = first[order], length[order], begin[:, order].copy()
    tables = np.stack([w.advance.reshape(-1) for w in walks()])
    mask = PERIOD - 1
    many = len(length)
    done = 0
    while True:
        while many and length[many - 1] <= done:
            many -= 1
        if many < TOGETHER:
            break
        until = int(length[many - 1])
        starts = first[:many]
        for t in range(done, until):
            at = starts + t
            row = classes[at].astype(np.int64) * PERIOD
            for w in range(WALKS):
                own = j[w, :many]
                own += tables[w].take(row + (own & mask))
                left[w, at] = own
        done = until
    for k in range(many):
        part = slice(int(first[k]) + done, int(first[k]) + int(length[k]))
        for w, walk in enumerate(walks()):
            left[w, part] = walk.go_alone(classes[part], int(j[w, k]))
    return left


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of all texts, their classes, and where each text begins (and the last one ends)."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    classes = ((codes.astype(np.uint64) * np.uint64(2654435761) >> np.uint64(9)) % np.uint64(CLASSES)).astype(np.int32)
    return codes, classes, np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)


def _values(char: np.ndarray, step: np.ndarray) -> np.ndarray:
    found = _mix(char.astype(np.uint64) * _GOLDEN ^ _mix(step.astype(np.uint64) + _GOLDEN)) & np.uint64(15)
    return np.where(step < 0, 0, found).astype(np.uint8)


def prints(texts: list[str]) -> np.ndarray:
    """A row of SLOTS values for each text."""
    return edited_prints(texts, [len(t) for t in texts], [""] * len(texts))[0]


def edited_prints(texts: list[str], cuts: list[int], tails: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of texts, and of their first characters up to a cut followed by a tail; the common part is walked once."""
    n = len(texts)
    own, other = np.zeros((n, SLOTS), np.uint8), np.zeros((n, SLOTS), np.uint8)
    codes, classes, first = _codes(texts)
    tail_codes, tail_classes, tail_first = _codes(tails)
    length, tail_length, cut = np.diff(first), np.diff(tail_first), np.asarray(cuts, np.int64)
    left = go(classes, first[:-1], length, np.zeros((WALKS, n), np.int64))
    # the step at which the cut is reached, and the texts' ends
    none = np.zeros((WALKS, n), np.int64)
    reached = np.where(cut > 0, left[:, np.maximum(first[:-1] + cut - 1, 0)], 0) if len(codes) else none
    ends = np.where(length > 0, left[:, np.maximum(first[1:] - 1, 0)], 0) if len(codes) else none
    tail_left = go(tail_classes, tail_first[:-1], tail_length, reached)
    tail_ends = np.where(tail_length > 0, tail_left[:, np.maximum(tail_first[1:] - 1, 0)], reached) if len(tail_codes) else reached
    half = SLOTS // WALKS
    both = np.concatenate([codes, tail_codes, np.zeros(1, np.uint32)])
    for w, walk in enumerate(walks()):
        for ended, into in ((ends[w], own), (tail_ends[w], other)):
            step = walk.wanted(ended)
            at = np.full((n, half), len(both) - 1, np.int64)
            for i in range(n):
                f, c = int(first[i]), int(cut[i])
                if into is own:
                    at[i] = f + left[w, f : f + int(length[i])].searchsorted(step[i], side="right")
                    continue
                inside = left[w, f : f + c].searchsorted(step[i], side="right")
                if tail_length[i]:
                    after = len(codes) + tail_first[i] + tail_left[w, tail_first[i] : tail_first[i + 1]].searchsorted(step[i], side="right")
                    at[i] = np.where(step[i] < reached[w, i], f + inside, after)
                else:
                    at[i] = f + inside
            into[:, w * half : (w + 1) * half] = _values(both[np.minimum(at, len(both) - 1)], step)
    return own, other


def shown(rows: np.ndarray) -> list[str]:
    return [row.tobytes().decode() for row in _HEX[rows]]


def read_print(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return np.where(raw > 57, raw - 87, raw - 48).astype(np.uint8)


_WALKS: list[Walk] = []


def walks() -> list[Walk]:
    if not _WALKS:
        _WALKS.extend(Walk(i) for i in range(WALKS))
    return _WALKS


_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def fingerprint(text: str) -> str:
    return shown(prints([text]))[0]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """0 to 1, of rows of slots; the empty text's row, all zeros, is like itself alone."""
    best = (a == b).reshape(*a.shape[:-1], WALKS, -1).mean(axis=-1).max(axis=-1)
    freed = np.maximum(0.0, (best - 1 / 16) / (15 / 16))
    whole = (a == b).all(axis=-1)
    return np.where(whole, 1.0, np.where(~a.any(axis=-1) | ~b.any(axis=-1), 0.0, freed))


def likenesses(found: list[bytes]):
    """A function that tells the likenesses of print number i to all prints, none of them the empty text's."""
    all_ = np.stack([np.frombuffer(p, np.uint8) for p in found]) - 48
    return lambda i: likeness(all_, all_[i])


def stretches(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Places of texts that are walked together: up to CHARS characters, or one text."""
    begin = held = 0
    for i, text in enumerate(texts):
        if i > begin and held + len(text) > CHARS:
            yield begin, i
            begin, held = i, 0
        held += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint of every document, in one scan."""
    rows = chosen(docs, doc_id=id_col, text=text_col).select("doc_id", text_or_empty().alias("text"))
    schema = rows.select("doc_id", F.lit("").alias("fingerprint")).schema

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [p for a, b in stretches(texts) for p in shown(prints(texts[a:b]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["doc_id", "fingerprint"])

    return rows.mapInArrow(read, schema)


_RESULT = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_FLAT = f"kind int, part int, doc_id bigint, {_RESULT}, text string"
_COLUMNS = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
#: Kinds of rows of a range: a whole result; the last document, which lacks its next; the text that the range begins with.
DONE, LAST, FIRST = 0, 1, 2


def _compared(texts: list[str], share: int) -> list[tuple]:
    """The result of each text but the last, which is only the next of the one before it."""
    lengths = [len(t) for t in texts]
    cuts = [n - n // share for n in lengths[:-1]] + lengths[-1:]
    tails = [following[: n // share] for n, following in zip(lengths, texts[1:])] + [""]
    own, other = edited_prints(texts, cuts, tails)
    near, after = likeness(own[:-1], other[:-1]), likeness(own[:-1], own[1:])
    shas = [hashlib.sha256((t[:c] + tail).encode("utf-8", "surrogatepass")).hexdigest() for t, c, tail in zip(texts[:-1], cuts, tails)]
    return list(zip(lengths, shas, shown(own[:-1]), shown(other[:-1]), near.tolist(), after.tolist()))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema) if rows else pa.RecordBatch.from_pylist([], schema=schema)


_FLAT_ARROW = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("text", pa.string())])
_RESULT_ARROW = pa.schema([f for f in _FLAT_ARROW if f.name not in ("kind", "part", "text")])


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = 3, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document.

    The edited text has the last floor(n_chars / share) characters replaced by the first as many (or all) of the next
    document, in descending doc_id and round to the first.
    """
    rows = chosen(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text").asc()]
    ranged = rows.repartitionByRange(int(size // range_bytes) + 1, *order).sortWithinPartitions(*order)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of a range in order; the last document of each stretch begins the next one."""
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held: tuple | None = None  # the last document so far
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if not texts:
                continue
            if held is None:
                yield _batch([(FIRST, part, None, None, None, None, None, None, None, texts[0])], _FLAT_ARROW)
            else:
                ids, texts = [held[0], *ids], [held[1], *texts]
            for a, b in stretches(texts):
                b = min(b + 1, len(texts))
                if b - a > 1:
                    yield _batch([(DONE, part, i, *found, None) for i, found in zip(ids[a:b], _compared(texts[a:b], share))], _FLAT_ARROW)
            held = (ids[-1], texts[-1])
        if held is not None:
            yield _batch([(LAST, part, held[0], None, None, None, None, None, None, held[1])], _FLAT_ARROW)

    flat = materialise(ranged.mapInArrow(read, _FLAT))
    # a row a range: which one follows, and the first one after the last
    order = Window.orderBy("part")
    firsts = flat.where(F.col("kind") == FIRST).select("part")
    links = firsts.select("part", F.coalesce(F.lead("part").over(order), F.min("part").over(Window.partitionBy())).alias("next_part"))
    heads = flat.where(F.col("kind") == FIRST).select(F.col("part").alias("next_part"), F.col("text").alias("following"))
    ends = flat.where(F.col("kind") == LAST).select("part", "doc_id", "text").join(links, "part").join(heads, "next_part")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _batch([(i, *_compared([t, f], share)[0]) for i, t, f in zip(*(c.to_pylist() for c in batch.columns))], _RESULT_ARROW)

    last = materialise(ends.select("doc_id", "text", "following").mapInArrow(finish, f"doc_id bigint, {_RESULT}"))
    return flat.where(F.col("kind") == DONE).select("doc_id", *_COLUMNS).unionByName(last)


def band_slots(bands: int = BANDS, sample: int = SAMPLE) -> np.ndarray:
    """The slots that each band samples, all of one walk; bands of both walks by turns."""
    draw = np.random.Generator(np.random.PCG64(20161))
    half = SLOTS // WALKS
    return np.stack([draw.choice(half, sample, replace=False) + half * (b % WALKS) for b in range(bands)])


def with_classes(known: DataFrame, threshold: float = NEAR, bands: int = BANDS, sample: int = SAMPLE) -> DataFrame:
    """Adds class_id, copies, links, likest to rows (doc_id, fingerprint, ...): classes are connected by links of at least `threshold` likeness.

    `copies` counts the rows of the same fingerprint, `links` its verified links to others, `likest` is the greatest of their likenesses, null without one.
    Bands of sampled slots propose; whole fingerprints verify, through linking.classes.
    """
    reps = materialise(known.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).withColumn("node", F.unhex(F.md5("fingerprint"))))
    slots = band_slots(bands, sample)

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.frombuffer("".join(batch.column(1).to_pylist()).encode(), np.uint8).reshape(-1, SLOTS).astype(np.uint64)
            keys = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(own), bands))
            for k in range(sample):
                keys = _mix(keys * _GOLDEN + own[:, slots[:, k]])
            flat = pa.array(keys.reshape(-1).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, bands, dtype=np.int32), flat)], names=["node", "bands"])

    # texts without a character have nothing to band
    banded = reps.where(F.col("fingerprint") != "0" * SLOTS).select("node", "fingerprint").mapInArrow(band, "node binary, bands array<bigint>")

    def verify(pairs: DataFrame) -> DataFrame:
        side = lambda x: reps.select(F.col("node").alias(x), F.col("fingerprint").alias(f"print_{x}"))
        names = [*pairs.columns, "sim"]

        def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a, b = (np.frombuffer("".join(batch.column(k).to_pylist()).encode(), np.uint8).reshape(-1, SLOTS) - 48 for k in (0, 1))
                yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(likeness(a, b), pa.float64())], names=names)

        return pairs.join(side("a"), "a").join(side("b"), "b").select("print_a", "print_b", *pairs.columns).mapInArrow(judged, verified_schema(pairs))

    payload = lambda nodes: reps.join(nodes, "node", "left_semi").select("node", F.col("fingerprint").alias("data"))
    members = members_of(banded)
    labels, links = classes(members, verify, threshold, payload, likenesses)
    drop(members)
    named = materialise(reps.join(linked(labels, links), "node", "left").withColumn("label", F.coalesce("label", "node")))
    ids = materialise(named.groupBy("label").agg(F.min("first_id").alias("class_id"), F.count("*").alias("n")))
    by_print = materialise(meet(named, ids, ["label"], "n").select("fingerprint", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"), "likest", F.col("copies").alias("n")))
    drop(named, ids, reps)
    return meet(known, by_print, ["fingerprint"], "n", merged=True)


def near_classes(docs: DataFrame, threshold: float = NEAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint, class_id, copies, links, likest of every document: near copies by edit distance.

    Measured by tests/llm/test_near.py: about 0.95 of texts of 200 to 20,000 characters with some ten scattered edits are found, nine in ten with
    25; beyond that the walks' drift, which grows with the square of the number of edits, costs recall.
    """
    return with_classes(materialise(fingerprints(docs, id_col, text_col)), threshold)
