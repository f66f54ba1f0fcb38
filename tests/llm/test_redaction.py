"""Redaction: the union of the spans that find_spans() reports, cut by code point."""

import random

from pyspark.sql import functions as F

from loopwright.llm import pii

SCHEMA = "doc_id bigint, text string, N_Chars int, row string, spans string, own string, `a.b` string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, -1, "r", "s", "o", "d") for i, t in enumerate(texts)], SCHEMA)


def brute(text, spans):
    """Text with each maximal covered stretch replaced by the kind that starts it."""
    out, at, i = [], 0, 0
    spans = sorted(spans, key=lambda s: (s["start"], s["rank"]))
    while i < len(spans):
        start, end, kind = spans[i]["start"], spans[i]["end"], spans[i]["kind"]
        i += 1
        while i < len(spans) and spans[i]["start"] < end:
            end = max(end, spans[i]["end"])
            i += 1
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join(out) + text[at:]


def test_redaction_leaves_no_character_of_a_span(spark):
    draw = random.Random(8)
    parts = ["a.b@c.de", "5500005555555559", "4111 1111 1111 1111", "aa", "secret", "token ", "key=", "1.2.3.4", "+1 555 123 4567", " ", ".", "é", "\U0001f600", "DE89370400440532013000", "AbC9dEf8GhI7jKl6MnO5pQr4", "iban ", "-", "x1", "bb"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(1, 14))) for _ in range(500)]
    texts += [None, "", "mail a.b@c.de token 5500005555555559aa5500005555555559aabbcc", "\U0001f600 a@b.cd \U0001f600", "a@b.cd " * 3000]
    df = docs(spark, texts)
    spans = {r["doc_id"]: r["spans"] for r in pii.find_spans(df).collect()}
    found = pii.redact(df, length_col="n_chars")
    assert found.columns == df.columns
    overlapping = 0
    for r in found.collect():
        text, own = texts[r["doc_id"]], spans[r["doc_id"]]
        overlapping += any(a["end"] > b["start"] for a, b in zip(own, own[1:]))
        assert r["text"] == (brute(text, own) if own else text), (text, own)
        assert r["N_Chars"] == (len(r["text"]) if own else -1) and (r["row"], r["spans"], r["own"], r["a.b"]) == ("r", "s", "o", "d")
    assert overlapping > 20


def test_a_long_text_of_many_spans(spark):
    text = "a@b.cd, " * 40_000
    assert pii.redact(docs(spark, [text])).select(F.length("text")).first()[0] == len("[EMAIL], ") * 40_000
