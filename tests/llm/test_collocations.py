"""Phrase collocations against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from loopwright.llm import collocations as C

SCHEMA = "doc_id bigint, text string, lang string, Lang_ string, `a.b` string, n string, f string"


def brute(rows, least=30, top=2000, absorb=(80, 100)):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, total = Counter(), Counter()
    for text, lang in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            total[lang] += len(words)
            f.update((lang, tuple(words[i : i + n])) for n in range(1, 5) for i in range(len(words) - n + 1))
    found = {}
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    cover = Counter()
    for (lang, words), a in candidates.items():
        for n in range(2, len(words)):
            for i in range(len(words) - n + 1):
                cover[lang, words[i : i + n]] = max(cover[lang, words[i : i + n]], a)
    for (lang, words), a in candidates.items():
        if absorb[1] * cover[lang, words] >= absorb[0] * a:
            continue
        cuts = [(2000000 * a // (f[lang, words[:k]] + f[lang, words[k:]]), k, f[lang, words[:k]], f[lang, words[k:]]) for k in range(1, len(words))]
        score, _, l, r = min(cuts)
        found.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), l, r))
    return sorted((lang, rank, p.decode(), -a, l, r, total[lang], -score) for lang, rows in found.items() for rank, (score, a, p, l, r) in enumerate(sorted(rows)[:top], 1))


def got(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def made(draw, n):
    phrases = ["red fox", "New York City", "in the end of", "é à ü", "a b c d", "x\ty  z", "half-life", "日本 語 文"]
    words = ["the", "of", "A", "b", "c", "d", "red", "end", "long-word-of-many-letters", "café", "."]
    return [("".join(draw.choice(phrases if draw.random() < 0.6 else words) + draw.choice([" ", " ", " ", "\t", ", ", "\n", "  ", ". "]) for _ in range(draw.randint(0, 40))), draw.choice(["en", "en", "de", None, "und"])) for _ in range(n)]


@pytest.mark.parametrize("shard_bytes,filter_bits", [(1 << 20, 1 << 20), (300, 1 << 12), (1, 64 * 64)])
def test_phrases_are_those_of_brute_force(spark, shard_bytes, filter_bits):
    rows = made(random.Random(5), 700) + [(None, "en"), ("", None), (" \t. ,", "en"), ("Red Fox red fox " * 9000, "en"), ("one", "fr")]
    rows += rows[:50]
    df = spark.createDataFrame([(i, t, lang, "x", "y", "z", "q") for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(3)
    want = brute(rows)
    assert len(want) > 60 and {w[0] for w in want} >= {"en", "de", "und"}
    assert got(C.collocations(df, shard_bytes=shard_bytes, filter_bits=filter_bits)) == want
    if shard_bytes > 300:
        assert got(C.collocations(df, least=10, top=5, absorb=(1, 2))) == brute(rows, 10, 5, (1, 2))
        assert got(C.collocations(df, top=None)) == brute(rows, 30, 10**9)


def test_empty_tables(spark):
    assert C.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert C.collocations(spark.createDataFrame([(1, None, None, "x", "y", "z", "q")], SCHEMA)).collect() == []


def test_intervals_of_suffix_arrays_are_counts():
    draw = np.random.default_rng(3)
    for n, kinds in ((1, 2), (2, 1), (50, 2), (400, 3), (400, 40)):
        word = draw.integers(0, kinds + 1, n)
        linked = draw.random(n - 1) < 0.8
        sorted_ = C.suffix_array(word, linked)
        for k in range(1, 5):
            want = Counter(tuple(word[i : i + k]) for i in range(n - k + 1) if (word[i : i + k] > 0).all() and linked[i : i + k - 1].all())
            at, many = C.intervals(*sorted_, k)
            assert {tuple(word[i : i + k]): c for i, c in zip(at, many)} == want and len(at) == len(want)


def test_words_of_a_shard_and_their_hashes():
    texts = ["A b", "c", ".d e.f\tg ", "a B", "longer-than-eight-bytes-word longer-than-eight-bytes-wore"]
    data = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    shard = C._shard(data, ["en", "en", "de", "en", "en"])
    assert [x.encode() for x in shard.phrases(np.arange(len(shard.start)), 1).to_pylist()] == [b"a", b"b", b"c", b"d", b"e", b"f", b"g", b"a", b"b", b"longer-than-eight-bytes-word", b"longer-than-eight-bytes-wore"]
    assert shard.phrases(np.array([0, 3]), 2).to_pylist() == ["a b", "d e"] and shard.phrases(np.array([], int), 3).to_pylist() == []
    assert shard.linked.tolist() == [True, False, False, True, False, True, False, True, False, True]
    assert shard.word[0] == shard.word[7] and len(set(shard.word.tolist())) == 9


def test_scores_beyond_64_bits(spark):
    big = 4 * 10**18
    row = spark.createDataFrame([(big, big, big + 1)], "a bigint, l bigint, r bigint").selectExpr("(cast(a as decimal(19,0)) * 2000000) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0))) AS s").first()
    assert row["s"] == 2000000 * big // (2 * big + 1)
