"""Suffix-array deduplication as a depth-limited radix sort: repeated windows of so many bytes.

A window is a suffix cut at LENGTH bytes. Suffixes are sorted by passes over digits, the most significant first; digits reach ever deeper, a
group of one drops out after each pass, and a group that is equal at full depth is a repeated window. To sort by a digit is to deal and sort
rows by it, with all digits before it, which is how Spark groups; a digit is a 64-bit hash of its bytes, so the order inside a pass is that of the hashes.

First digit, GRAM bytes: windows are met at anchors. A window names one word of GRAM bytes in it by itself, the one of least hash (the leftmost of
equal ones); equal windows name equal words at the same place. The digit is the word, that is the leading bytes of the suffix at the anchor. Neighbouring windows
mostly name the same word: they are a run, one row for about 70 bytes.

Whole runs: runs that are equal with the bytes of all their windows are repeated as a whole, and done. Only words with several different runs,
one of which has no equal, go on, with one run of each kind.

Second digit, GRAM + (LENGTH - GRAM) / 2 bytes: those from the anchor, for windows that begin less than half of LENGTH - GRAM before it; those that end with the word, for
all others. A half of a run that is alone in it drops out.

Last digit, all LENGTH bytes, a row a window.

Scale: records, not texts, are dealt by digit, and are counted before they move: a passage in a third of all documents is a count a task, and its copies meet the count by
a broadcast (common.meet). Texts are dealt three times by document, to meet their open runs, their open halves and their spans; documents that very many rows repeat stay where they are.

Defined results: null and empty texts have nothing to remove; a text shorter than LENGTH neither; repeated rows
are copies of each other, each loses all windows; rows of one doc_id with different texts are different documents; a null doc_id is kept;
an empty table gives no rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopwright.llm.common import HOT, chosen, drop, materialise, meet, text_or_empty

LENGTH, GRAM = 200, 64
#: Bytes that are hashed together.
PIECE = 1 << 18
#: Bytes of text whose records a task gives out together: batches have as many rows at any length of texts and any number of their windows.
SLICE = 1 << 20

_U = np.uint64
_K = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return (x ^ (x >> _U(32))) * _U(0xBF58476D1CE4E5B9)


def _words(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes that start at each place; doubling from 8 bytes on."""
    n = len(data) - 7
    h = _mix(np.ndarray((n,), "<u8", np.ascontiguousarray(data), strides=(1,)) ^ _K)
    size = 8
    while size < GRAM:
        h = _mix(h[: len(h) - size] * _K + h[size:])
        size *= 2
    return h


def _slide_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[: len(x) - size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def _joined(h: np.ndarray, start: np.ndarray, length: np.ndarray | int, most: int) -> np.ndarray:
    """Hash of `length` bytes from each start, out of the words that cover them."""
    out = np.zeros(len(start), np.uint64)
    for at in range(0, most, GRAM):
        out = _mix(out * _K + h[start + np.minimum(at, length - GRAM)])
    return out


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each text begins and ends."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)), ends


def _slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most SLICE bytes of text (in this column), or of one row."""
    for batch in batches:
        _, ends = _texts(batch.column(column))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(ends, ends[i] + SLICE, side="right")) - 1)
            yield batch.slice(i, j - i)
            i = j


def _pieces(ends: np.ndarray, length: int) -> Iterator[tuple[int, int, int, int]]:
    """(first text, last text + 1, begin, end): stretches of bytes whose windows are taken together."""
    i = 0
    while i < len(ends) - 1:
        j = i + 1
        while j < len(ends) - 1 and ends[j + 1] - ends[i] <= PIECE:
            j += 1
        if ends[j] - ends[i] <= PIECE:
            yield i, j, int(ends[i]), int(ends[j])
        else:  # one long text: stretches that overlap by a window less one
            for begin in range(int(ends[i]), int(ends[j]), PIECE):
                yield i, j, begin, min(int(ends[j]), begin + PIECE + length - 1)
        i = j


def runs(data: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Of texts laid end to end: text, start in it, windows, first digit, whole run, and the anchor's place in it, of each run."""
    found = []
    for i, j, begin, end in _pieces(ends, length):
        size = end - begin
        if size < length:
            continue
        h = _words(data[begin:end])
        place = np.arange(len(h), dtype=np.uint64)
        named = (_slide_min((h & ~_U(0xFFFFFF)) | place, length - GRAM + 1) & _U(0xFFFFFF)).astype(np.int64)
        start = np.arange(size - length + 1)
        named = named[: len(start)]
        text = np.searchsorted(ends[i + 1 : j + 1], start + begin, side="right") + i
        inside = start + begin + length <= ends[text + 1]
        start, named, text = start[inside], named[inside], text[inside]
        if not len(start):
            continue
        new = np.flatnonzero(np.r_[True, (named[1:] != named[:-1]) | (start[1:] != start[:-1] + 1) | (text[1:] != text[:-1])])
        n = np.diff(np.r_[new, len(start)])
        first, word, of = start[new], named[new], text[new]
        shape = (n * 1024 + (word - first)).astype(np.uint64)
        whole = _mix(_joined(h, first, n - 1 + length, 2 * length - GRAM) + shape * _K)
        found.append((of, first + begin - ends[of], n, h[word], whole, word - first))
    if not found:
        none = np.empty(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), none
    return tuple(np.concatenate(x) for x in zip(*found))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_or_empty()
    return chosen(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))


def _first_digits(rows: DataFrame, length: int) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 2):
            of, start, n, word, whole, anchor = runs(*_texts(batch.column(2)), length)
            at = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(start, pa.int32()), pa.array(n, pa.int16()), pa.array(anchor, pa.int16()), pa.array(word.view(np.int64)), pa.array(whole.view(np.int64))], names=["doc_id", "h", "start", "n", "anchor", "word", "whole"])

    long = rows.where(F.octet_length("text") >= length)
    return long.mapInArrow(read, "doc_id bigint, h bigint, start int, n smallint, anchor smallint, word bigint, whole bigint")


def _stretches(column: pa.Array, texts: pa.Array, length: int) -> Iterator[tuple]:
    """Text, hashes of its words, place of the first of these, and the wanted runs (start, n, then all other fields) of each stretch of each text.

    Long texts are taken in stretches so that they need no more memory than a piece.
    """
    data, ends = _texts(texts)
    first = column.offsets[0].as_py()
    inner = column.values.slice(first, column.offsets[-1].as_py() - first)
    fields = [inner.field(k).to_numpy(zero_copy_only=False) for k in range(inner.type.num_fields)]
    at = column.offsets.to_numpy() - first
    for i in range(len(column)):
        own = [f[at[i] : at[i + 1]] for f in fields]
        order = np.argsort(own[0], kind="stable")
        s, n, *more = (f[order] for f in own)
        s, n, k = s.astype(np.int64), n.astype(np.int64), 0
        while k < len(s):
            last = int(np.searchsorted(s, s[k] + PIECE))
            low, high = int(s[k]), int((s[k:last] + n[k:last]).max()) - 1 + length
            yield i, _words(data[int(ends[i]) + low : int(ends[i]) + high]), low, s[k:last], n[k:last], *[f[k:last] for f in more]
            k = last


def _second_digits(texts: DataFrame, length: int) -> DataFrame:
    """A row a half of a run: whose it is, the windows of the half, the word and the half's digit. `texts` has doc_id, h, text, wanted (start, n, word, alone, anchor)."""
    half = (length - GRAM) // 2

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 2):
            out: list[list[np.ndarray]] = [[] for _ in range(6)]
            for i, h, low, s, n, word, alone, anchor in _stretches(batch.column(3), batch.column(2), length):
                a = anchor.astype(np.int64)
                # windows that begin `half` bytes and more before the anchor, then the nearer ones
                far = np.clip(a - half + 1, 0, n)
                for on, begin, many, place, depth, side in ((far > 0, s, far, s + a - half, GRAM + half, 1), (far < n, s + far, n - far, s + a, length - half, 2)):
                    digit = _mix(_joined(h, place[on] - low, depth, depth) + _U(side * int(_K) % (1 << 64)))
                    for column, value in zip(out, (np.full(int(on.sum()), i), begin[on], many[on], word[on], alone[on], digit.view(np.int64))):
                        column.append(value)
            of, start, n, word, alone, digit = (np.concatenate(x) if x else np.empty(0, np.int64) for x in out)
            at = pa.array(of.astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(start, pa.int32()), pa.array(n, pa.int16()), pa.array(word, pa.int64()), pa.array(alone.astype(bool)), pa.array(digit, pa.int64())], names=["doc_id", "h", "start", "n", "word", "alone", "half"])

    return texts.select("doc_id", "h", "text", "wanted").mapInArrow(read, "doc_id bigint, h bigint, start int, n smallint, word bigint, alone boolean, half bigint")


def _last_digits(texts: DataFrame, length: int) -> DataFrame:
    """A row a window of the wanted runs: word, window, and whose it is. `texts` has doc_id, h, text, wanted (start, n, word, alone)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 2):
            out: list[list[np.ndarray]] = [[] for _ in range(5)]
            for i, h, low, s, n, word, alone in _stretches(batch.column(3), batch.column(2), length):
                each = np.repeat(s, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                for column, value in zip(out, (np.full(len(each), i), each, np.repeat(word, n), _joined(h, each - low, length, length).view(np.int64), np.repeat(alone, n))):
                    column.append(value)
            of, each, word, window, alone = (np.concatenate(x) if x else np.empty(0, np.int64) for x in out)
            at = pa.array(of.astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(each, pa.int32()), pa.array(word, pa.int64()), pa.array(window, pa.int64()), pa.array(alone.astype(bool))], names=["doc_id", "h", "start", "word", "window", "alone"])

    return texts.select("doc_id", "h", "text", "wanted").mapInArrow(read, "doc_id bigint, h bigint, start int, word bigint, window bigint, alone boolean")


def _hot_documents(rows: DataFrame) -> DataFrame | None:
    """doc_id, h of the documents that more than one of HOT rows repeats: fewer than HOT of them; None if there is none."""
    crowds = materialise(rows.groupBy("doc_id", "h").agg(F.count("*").alias("n")).where("n > 1"))
    hot = crowds.where(F.col("n") * HOT > rows.count()).select("doc_id", "h")
    return hot if hot.limit(1).count() else None


def _meet(texts: DataFrame, lists: DataFrame, how: str, hot: DataFrame | None) -> DataFrame:
    """Joins texts with a list each, on doc_id (null too) and the text's hash. Hot documents' few lists are broadcast."""
    named = lists.withColumnRenamed("doc_id", "d").withColumnRenamed("h", "g")
    same = texts["doc_id"].eqNullSafe(named["d"]) & (texts["h"] == named["g"])
    if hot is None:
        return texts.join(named, same, how).drop("d", "g")
    own = hot.select(F.col("doc_id").alias("e"), F.col("h").alias("f"))
    is_hot = lambda df, a, b: df.join(F.broadcast(own), F.col(a).eqNullSafe(F.col("e")) & (F.col(b) == F.col("f")), "left_semi")
    not_hot = lambda df, a, b: df.join(F.broadcast(own), F.col(a).eqNullSafe(F.col("e")) & (F.col(b) == F.col("f")), "left_anti")
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g"))
    few = is_hot(texts, "doc_id", "h").join(F.broadcast(is_hot(named, "d", "g")), same, how)
    return few.unionByName(not_hot(texts, "doc_id", "h").join(not_hot(named, "d", "g"), same, how)).drop("d", "g")


def _lists(rows: DataFrame, columns: list[str], name: str) -> DataFrame:
    """doc_id, h and the set of all rows of a document: what copies of it say is said once."""
    return rows.groupBy("doc_id", "h").agg(F.collect_set(F.struct(*columns)).alias(name))


def repeated(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, h (hash of the text), start, n: the windows at start ... start+n-1 also start elsewhere."""
    rows = _rows(docs, id_col, text_col)
    return _repeated(rows, length, _hot_documents(rows))


def _repeated(rows: DataFrame, length: int, hot: DataFrame | None) -> DataFrame:
    if length < 2 * GRAM or length > 512:
        raise ValueError(f"windows of {2 * GRAM} to 512 bytes are supported")
    digits = materialise(_first_digits(rows, length))
    # first digit and whole runs: kinds of runs and their copies
    kinds = materialise(digits.groupBy("word", "whole").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "h", "start", "n", "anchor")).alias("first")))
    whole = materialise(meet(digits.select("doc_id", "h", "start", "n", "word", "whole"), kinds.where("copies > 1").select("word", "whole", "copies"), ["word", "whole"], "copies").select("doc_id", "h", "start", "n"))
    drop(digits)
    mixed = kinds.groupBy("word").agg(F.count("*").alias("kinds"), F.min("copies").alias("least")).where("kinds > 1 and least = 1").select("word", "kinds")
    open_ = meet(kinds, materialise(mixed), ["word"], "kinds").select("first.*", "word", (F.col("copies") == 1).alias("alone"))
    # second digit: halves of runs that another run shares
    runs_ = materialise(_lists(open_, ["start", "n", "word", "alone", "anchor"], "wanted"))
    drop(kinds)
    halves = materialise(_second_digits(_meet(rows, runs_, "inner", hot), length).distinct())
    drop(runs_)
    shared = materialise(halves.groupBy("word", "half").agg(F.count("*").alias("times")).where("times > 1"))
    wanted = materialise(_lists(meet(halves, shared, ["word", "half"], "times"), ["start", "n", "word", "alone"], "wanted"))
    drop(halves, shared)
    # last digit: windows that another run shares
    windows = _last_digits(materialise(_meet(rows, wanted, "inner", hot)), length).select("doc_id", "h", "start", "word", "window", "alone")
    drop(wanted)
    again = materialise(windows.select("doc_id", "h", "start", "word", "window").distinct().groupBy("word", "window").agg(F.count("*").alias("times")).where("times > 1")) if hot is not None else materialise(windows.groupBy("word", "window").agg(F.count("*").alias("times")).where("times > 1"))
    met = meet(windows.where("alone").drop("alone"), again, ["word", "window"], "times")
    return whole.unionByName(met.select("doc_id", "h", "start", F.lit(1).cast("smallint").alias("n")))


def _spans(start: np.ndarray, n: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal covered stretches: begins and ends."""
    order = np.argsort(start, kind="stable")
    begin, end = start[order].astype(np.int64), (start + n - 1 + length)[order].astype(np.int64)
    reach = np.maximum.accumulate(end)
    new = np.r_[True, begin[1:] > reach[:-1]]
    return begin[new], reach[np.r_[np.flatnonzero(new)[1:] - 1, len(reach) - 1]]


def removed(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document; with_kept: the kept bytes too."""
    rows = _rows(docs, id_col, text_col)
    hot = _hot_documents(rows)
    hits = materialise(_lists(_repeated(rows, length, hot), ["start", "n"], "hits"))
    texts = _meet(rows, hits, "left", hot).select("doc_id", "text", "hits")
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept binary" if with_kept else "")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 1):
            data, ends = _texts(batch.column(1))
            hits, out = batch.column(2), [[], [], [], [], []]
            for i in range(batch.num_rows):
                text = data[ends[i] : ends[i + 1]].tobytes()
                taken, spans, kept = 0, 0, text
                if hits[i].is_valid:
                    own = hits[i].values
                    begin, end = _spans(own.field(0).to_numpy().astype(np.int64), own.field(1).to_numpy().astype(np.int64), length)
                    edges = [0, *np.stack([begin, end], axis=1).reshape(-1).tolist(), len(text)]
                    kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                    taken, spans = int((end - begin).sum()), len(begin)
                for column, value in zip(out, (len(text), taken, spans, hashlib.sha256(kept).hexdigest(), kept)):
                    column.append(value)
            arrays = [batch.column(0), *[pa.array(c, pa.int64()) for c in out[:3]], pa.array(out[3], pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(out[4], pa.binary())] * with_kept, names=names + ["kept"] * with_kept)

    return texts.mapInArrow(read, schema)
