"""Phrase collocations from word-id suffix arrays.

Shard: the documents of a stretch of a partition, about `shard_bytes` of text. Its words become ids, with a barrier after every piece; prefix doubling by numpy (rank
words, then pairs of ranks one place, then two places apart) sorts all suffixes by their first four words. The common prefixes of neighbours in that order bound the
LCP intervals; an interval at depth k is a phrase of k words and its width the phrase's count in the shard. Counts of all shards are merged by key.

Passes: a phrase is no more frequent than its parts, so each depth asks only for phrases whose parts have reached `least` in the whole corpus. Words, then pairs of frequent words, then
triples of frequent pairs are counted by a 64-bit hash, which never undercounts. The last pass counts exactly, by (lang, phrase): frequent pairs, frequent triples, and four words whose
two triples are frequent, and the words of frequent pairs. What shards know of earlier passes are Bloom filters of at most `filter_bits` bits: they never lose a phrase; beyond
the size they are made for, shards emit more phrases than needed, and the exact count drops them.

Scale: the text is scanned four times and never shuffled. Counts are summed in the shard, the task, then by key, so a phrase in a third of all texts is a row a task. Tables
after the counts hold phrases that occur `least` times; the parts that very many phrases share meet them by common.meet(). Ranks are cut to `top` in each task before
they meet. A shard needs memory for its bytes and its longest text; nothing is broadcast but the filter.

Defined results: null texts are empty; null languages are `und`, and one with the texts of that name; repeated rows count each; an empty table
gives no rows; bytes of other letters than A-Z stay as they are; extra columns, whatever their names, are ignored. Arithmetic is in decimals of 38 digits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loopwright.llm.common import chosen, drop, materialise, meet, text_or_empty

LONGEST = 4
SHARD_BYTES = 4 << 20
#: Of the filter that shards get: 32 MB. It is made for one key in 16 bits.
FILTER_BITS = 1 << 28
_PROBES = 4

_U = np.uint64
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

#: What a byte is: 0 part of a word, 1 between words, 2 the end of a piece.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _hashed(data: np.ndarray, start: np.ndarray, length: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, eight bytes a round; rounds go on with the words that are longer."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(data),), "<u8", padded, strides=(1,)) if len(data) else np.empty(0, np.uint64)
    h = _mix(seed + length.astype(np.uint64) * _K1)
    on, at = np.arange(len(start)), 0
    while len(on):
        left = np.minimum(length[on] - at, 8).astype(np.uint64)
        part = eights[start[on] + at] & ((_U(1) << (left * _U(8) - _U(1))) * _U(2) - _U(1))
        h[on] = _mix((h[on] ^ part) * _K2)
        at += 8
        on = on[length[on] > at]
    return h


class Shard:
    """Words of documents laid end to end: where they start, how long they are, their document, their hash, and whether the next word is in the same piece."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, langs: list[str]):
        self.data = _LOWER[data]
        kind = _KIND[self.data]
        gap = np.concatenate([[True], kind != 0, [True]])
        inner = ends[1:-1]
        starts = (~gap[1:-1]) & gap[:-2]
        starts[inner[inner < len(data)]] |= kind[inner[inner < len(data)]] == 0
        self.start = np.flatnonzero(starts)
        gap_end = (~gap[1:-1]) & gap[2:]
        cut = inner[(inner > 0) & (inner < len(data))] - 1
        gap_end[cut] |= kind[cut] == 0
        self.length = np.flatnonzero(gap_end) + 1 - self.start
        self.doc = np.searchsorted(ends, self.start, side="right") - 1
        pieces = np.cumsum(kind == 2, dtype=np.int32)
        self.piece = pieces[self.start] if len(self.start) else np.empty(0, np.int32)
        self.langs = langs
        names = {name: i for i, name in enumerate(dict.fromkeys(langs))}
        self.lang = np.array([names[x] for x in langs], np.int64)[self.doc] if len(self.start) else np.empty(0, np.int64)
        seeds = np.array([hash_text(name) for name in names], np.uint64)
        self.word = _hashed(self.data, self.start, self.length, seeds[self.lang]) if len(self.start) else np.empty(0, np.uint64)
        self.linked = (self.piece[1:] == self.piece[:-1]) & (self.doc[1:] == self.doc[:-1])

    def phrases(self, at: np.ndarray, n: int) -> pa.Array:
        """The phrases of n words at these places, words joined by a space."""
        if not n or not len(at):
            return pa.array([""] * len(at), pa.string())
        words = (at[:, None] + np.arange(n)).reshape(-1)
        size = self.length[words] + 1
        size[n - 1 :: n] -= 1  # no space behind the last word
        end = np.cumsum(size)
        index = np.repeat(self.start[words] - (end - size), size) + np.arange(end[-1])
        out = self.data[np.minimum(index, len(self.data) - 1)]
        spaces = np.delete(end, np.arange(n - 1, len(end), n)) - 1
        out[spaces] = 0x20
        offsets = np.concatenate([[0], end[n - 1 :: n]]).astype(np.int32)
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(out))


def hash_text(text: str) -> int:
    data = np.frombuffer(text.encode(), np.uint8)
    return int(_hashed(data, np.zeros(1, np.int64), np.array([len(data)], np.int64), np.zeros(1, np.uint64))[0])


def _dense(keys: np.ndarray) -> np.ndarray:
    """Ranks from 1 of keys; 0, the barrier, stays 0."""
    ranks = np.unique(keys, return_inverse=True)[1].astype(np.int64)
    return ranks if len(keys) and keys.min() == 0 else ranks + 1


def suffix_array(word: np.ndarray, linked: np.ndarray, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of all suffixes by their first `longest` words; of each in that order, how many words it shares with the one before; of each place, how many of so many words follow in its piece.

    word: ids from 1 on, 0 for a barrier; linked: whether the next place goes on in the same piece. Behind the end of a piece stands the barrier. longest: a power of two.
    """
    n = len(word)
    joined = np.zeros(n, bool)
    joined[:-1] = linked & (word[1:] > 0) & (word[:-1] > 0)
    on = word > 0
    run = on.astype(np.int64)
    for k in range(1, longest):
        on = on.copy()
        on[: n - k + 1] &= joined[k - 1 :]
        on[n - k + 1 :] = False
        run += on
    rank, size = _dense(word), 1
    while size < longest:
        behind = np.zeros(n, np.int64)
        behind[: n - size] = rank[size:]
        behind[run <= size] = 0
        rank = _dense(np.where(rank > 0, rank * (n + 2) + behind, 0))
        size *= 2
    order = np.argsort(rank, kind="stable")
    a, b = order[1:], order[:-1]
    shared, same = np.zeros(n, np.int64), np.ones(len(a), bool)
    for k in range(longest):
        same &= (run[a] > k) & (run[b] > k)
        same[same] = word[a[same] + k] == word[b[same] + k]
        shared[1:] += same
    return order, shared, run


def intervals(order: np.ndarray, shared: np.ndarray, run: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """A place and the count of each phrase of `depth` words: the LCP intervals at that depth."""
    fits = run[order] >= depth
    begins = np.flatnonzero(fits & (shared < depth))
    if not len(begins):
        return begins, begins
    total = np.cumsum(fits)
    upto = np.concatenate([total[begins[1:] - 1], total[-1:]])
    return order[begins], upto - np.concatenate([[0], upto[:-1]])


class Filter:
    """A Bloom filter of 64-bit keys, as filled words of 64 bits."""

    def __init__(self, bits: int, blocks: np.ndarray, words: np.ndarray):
        self.bits = bits
        self.words = np.zeros(bits // 64, np.uint64)
        self.words[blocks] = words

    @staticmethod
    def places(keys: np.ndarray, bits: int) -> Iterator[np.ndarray]:
        a, b = _mix(keys), _mix(keys ^ _K1) | _U(1)
        for k in range(_PROBES):
            yield (a + _U(k) * b) & _U(bits - 1)

    def has(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for place in self.places(keys, self.bits):
            found &= (self.words[place >> _U(6)] >> (place & _U(63))) & _U(1) == 1
        return found


def _filter(keys: DataFrame, most_bits: int) -> Filter:
    """The filter of a table of keys (h bigint). Words of the filter come to the driver, at most most_bits / 64 of them, whatever the table's size."""
    bits = 1 << 12
    n = keys.count()
    while bits < 16 * n and bits < most_bits:
        bits *= 2

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).to_numpy().view(np.uint64)
            place = np.unique(np.concatenate(list(Filter.places(h, bits)))) if len(h) else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array((place >> _U(6)).astype(np.int64)), pa.array((_U(1) << (place & _U(63))).view(np.int64))], names=["block", "bit"])

    words = keys.mapInArrow(blocks, "block bigint, bit bigint").groupBy("block").agg(F.bit_or("bit").alias("bits")).toArrow()
    return Filter(bits, words.column(0).to_numpy(), words.column(1).to_numpy().view(np.uint64))


def _shards(batches: Iterator[pa.RecordBatch], shard_bytes: int) -> Iterator[Shard]:
    texts, langs, size = [], [], 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            raw = text.as_buffer()
            if size and size + raw.size > shard_bytes:
                yield _shard(texts, langs)
                texts, langs, size = [], [], 0
            texts.append(np.frombuffer(raw, np.uint8) if raw.size else np.empty(0, np.uint8))
            langs.append(lang)
            size += raw.size
    if texts:
        yield _shard(texts, langs)


def _shard(texts: list[np.ndarray], langs: list[str]) -> Shard:
    return Shard(np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])]), langs)


def _named(shard: Shard, parts: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """lang, n, phrase, f of (words, places, counts)."""
    names = pa.array(shard.langs, pa.string())
    columns = [(names.take(pa.array(shard.doc[at])), pa.array(np.full(len(at), n, np.int32)), shard.phrases(at, n), pa.array(many, pa.int64())) for n, at, many in parts]
    return pa.RecordBatch.from_arrays([pa.concat_arrays(list(c)) for c in zip(*columns)], names=["lang", "n", "phrase", "f"])


def _hash_counts(texts: DataFrame, shard_bytes: int, count: Callable[[Shard], Iterator[tuple[int, np.ndarray, np.ndarray]]], least: int) -> DataFrame:
    """n, h: what count() gives of shards (n, hashes, counts), where it reaches `least` in all."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches, shard_bytes):
            for n, h, many in count(shard):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), n, np.int8)), pa.array(h.view(np.int64)), pa.array(many.astype(np.int64))], names=["n", "h", "f"])

    counted = texts.mapInArrow(read, "n tinyint, h bigint, f bigint")
    return materialise(counted.groupBy("n", "h").agg(F.sum("f").alias("f")).where(F.col("f") >= least).select("n", "h"))


def _pair_keys(word: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Key of the words at each place and the next."""
    return _mix(word[at] * _K1 + _mix(word[at + 1]))


def _triple_keys(word: np.ndarray, at: np.ndarray) -> np.ndarray:
    return _mix(_pair_keys(word, at) * _K2 + _mix(word[at + 2]))


def _ids(shard: Shard, known: Filter) -> np.ndarray:
    """Word ids from 1 on; words that can't be frequent are barriers, 0."""
    distinct, inverse = np.unique(shard.word, return_inverse=True)
    kept = known.has(distinct)
    return np.where(kept, np.cumsum(kept), 0)[inverse]


def _without_single(ids: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the words that are linked to one beside them, their ids and links: what longer phrases need."""
    joined = linked & (ids[1:] > 0) & (ids[:-1] > 0)
    own = np.flatnonzero(np.concatenate([joined, [False]]) | np.concatenate([[False], joined]))
    return own, ids[own], joined[own[:-1]]


def _words(shard: Shard) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    yield 1, *np.unique(shard.word, return_counts=True)


def _pairs(known: Filter) -> Callable[[Shard], Iterator[tuple[int, np.ndarray, np.ndarray]]]:
    """Pairs of frequent words."""

    def count(shard: Shard) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if len(shard.word) > 1:
            own, ids, linked = _without_single(_ids(shard, known), shard.linked)
            at, many = intervals(*suffix_array(ids, linked, 2), 2)
            yield 2, _pair_keys(shard.word, own[at]), many

    return count


def _of_frequent_pairs(shard: Shard, known: Filter, pairs: Filter) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of the words of frequent pairs, and their suffix array."""
    ids = _ids(shard, known)
    linked = shard.linked & (ids[1:] > 0) & (ids[:-1] > 0)
    linked[linked] = pairs.has(_pair_keys(shard.word, np.flatnonzero(linked)))
    own, ids, linked = _without_single(ids, linked)
    return own, suffix_array(ids, linked)


def _triples(known: Filter, pairs: Filter, least: int) -> Callable[[Shard], Iterator[tuple[int, np.ndarray, np.ndarray]]]:
    """Triples of frequent pairs; and the words of frequent pairs, which all count as frequent."""

    def count(shard: Shard) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if len(shard.word) > 1:
            own, sorted_ = _of_frequent_pairs(shard, known, pairs)
            words = np.unique(shard.word[own])
            yield 1, words, np.full(len(words), least)
            at, many = intervals(*sorted_, 3)
            yield 3, _triple_keys(shard.word, own[at]), many

    return count


def _phrases(texts: DataFrame, known: Filter, words: Filter, pairs: Filter, triples: Filter, shard_bytes: int) -> DataFrame:
    """lang, n, phrase, f: phrases that may be frequent, the words of frequent pairs, and, as n = 0, all words of a language."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches, shard_bytes):
            langs, first, total = np.unique(shard.lang, return_index=True, return_counts=True)
            hashes, place, many = np.unique(shard.word, return_index=True, return_counts=True)
            kept = words.has(hashes)
            found = [(0, first, total), (1, place[kept], many[kept])]
            if len(shard.word) > 1:
                own, sorted_ = _of_frequent_pairs(shard, known, pairs)
                for n in range(2, LONGEST + 1):
                    at, many = intervals(*sorted_, n)
                    for k in range(n - 2):
                        kept = triples.has(_triple_keys(shard.word, own[at] + k))
                        at, many = at[kept], many[kept]
                    found.append((n, own[at], many))
            yield _named(shard, found)

    return texts.mapInArrow(read, "lang string, n int, phrase string, f bigint")


def _part(words: Column, first: Column | int, n: Column | int) -> Column:
    return F.array_join(F.slice(words, first, n), " ")


def _exact(x: str) -> Column:
    return F.col(x).cast("decimal(19,0)")


def collocations(docs: DataFrame, least: int = 30, top: int | None = 2000, absorb: tuple[int, int] = (80, 100), lang_col: str = "lang", text_col: str = "text", shard_bytes: int = SHARD_BYTES, filter_bits: int = FILTER_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases (all if None).

    A phrase goes if a longer one that holds it has at least absorb[0] of absorb[1] of its count.
    """
    texts = chosen(docs, lang=lang_col, text=text_col).select(F.coalesce("lang", F.lit("und")).alias("lang"), text_or_empty().alias("text")).where(F.col("text") != "")
    hashes = lambda table, n: table.where(F.col("n") == n).select("h")
    single = _hash_counts(texts, shard_bytes, _words, least)
    known = _filter(hashes(single, 1), filter_bits)
    double = _hash_counts(texts, shard_bytes, _pairs(known), least)
    pairs = _filter(hashes(double, 2), filter_bits)
    triple = _hash_counts(texts, shard_bytes, _triples(known, pairs, least), least)
    phrases = _phrases(texts, known, _filter(hashes(triple, 1), filter_bits), pairs, _filter(hashes(triple, 3), filter_bits), shard_bytes)
    drop(single, double, triple)
    counts = materialise(phrases.groupBy("lang", "n", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("n") == 0)))
    totals = counts.where("n = 0").select(F.col("lang").alias("tl"), F.col("f").alias("n"))
    counts = counts.where("n > 0")
    longer = counts.where("n > 1")
    held = F.split("phrase", " ")
    # the parts of each phrase at each cut
    cuts = longer.select("lang", F.col("n").alias("size"), "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k"))
    asked = cuts.select("*", _part(held, F.lit(1), F.col("k")).alias("left"), _part(held, F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    for side, f in (("left", "l"), ("right", "r")):
        times = asked.groupBy("lang", side).agg(F.count("*").alias("times"))
        parts = times.join(counts.select(F.col("lang").alias("pl"), F.col("phrase").alias("pp"), F.col("f").alias(f)), (F.col("lang") == F.col("pl")) & (F.col(side) == F.col("pp"))).select("lang", side, f, "times")
        asked = meet(asked, materialise(parts), ["lang", side], "times")
    score = F.expr("(cast(a as decimal(19,0)) * 2000000) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    least_cut = asked.withColumn("score", score).groupBy("lang", "size", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # what lies in a longer phrase that is nearly as frequent
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("n") - 1), lambda size: F.transform(F.sequence(F.lit(1), F.col("n") - size + 1), lambda at: _part(held, at, size))))
    covers = longer.where("n > 2").select(F.col("lang").alias("cl"), F.col("f").alias("cf"), F.explode(F.array_distinct(inner)).alias("cp")).groupBy("cl", "cp").agg(F.max("cf").alias("cover"))
    joined = least_cut.join(covers, (F.col("lang") == F.col("cl")) & (F.col("phrase") == F.col("cp")), "left")
    kept = joined.where(F.col("cover").isNull() | (_exact("cover") * absorb[1] < _exact("a") * absorb[0])).select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = kept.withColumn("rank", rank.cast("bigint"))
    ranked = ranked.where(F.col("rank") <= top) if top is not None else ranked
    return ranked.join(totals, F.col("lang") == F.col("tl")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


__all__ = ["Filter", "Shard", "collocations", "intervals", "suffix_array"]
