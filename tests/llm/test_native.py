"""The other operators against brute force, the tokenizer library, their own SQL and held-out labels."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loopwright.llm import mixing, packing, pii, quality, queries, ranking, textstats, tokens, urls

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, spans string, row string"
LONG = " ".join(str(i * 7919) for i in range(30000))


def docs(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, None if i % 5 == 0 else f"s{i % 3}", None, "x") for i, t in enumerate(texts)], SCHEMA)


def luhn(s):
    return sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(map(int, reversed(s)))) % 10 == 0


def brute_base(text):
    n = lambda m: re.sub("[^0-9]", "", m.group())
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.group().split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(n(m)) <= 19 and luhn(n(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(n(m)) <= 15),
    ]
    found = [(m.start(), k, name, m.end()) for k, (name, pattern, ok) in enumerate(kinds) for m in re.finditer(pattern, text) if ok(m)]
    return ",".join(f"{name}:{s}:{e}" for s, _, name, e in sorted(found)), Counter(name for _, _, name, _ in found)


PII_TEXTS = [
    None, "", "mail a.b@c.de, x@y.z and bad@, @no.no a@b.c@d.ef", "é 1.2.3.4 and 300.1.1.1, 1.2.3.4.5.6.7.8 00255.1.1.1 1.2.3",
    "card 4111 1111 1111 1111; 4111-1111-1111-1112; 5500005555555559, card: 4222222222222, 30569309025904",
    "+1 (555) 123-4567, +44 20 7946 0958. +1+2 +12 +123456789012345678 +(1) ++4915112345678", "call 555-123-4567 or 555-123-4567", "IBAN DE89 3704 0044 0532 0130 00 x GB82WEST12345698765432 DE00370400440532013000",
    "1" * 5000, "a@" * 3000, "1.2." * 3000 + "3", "+1 " * 3000, "x" * 20000 + "@a.b", LONG, "\U0001f600\U0001f600 a@b.cd \U0001f600 4111111111111111",
]


def test_pii_base_spans_are_those_of_brute_force(spark):
    draw = random.Random(6)
    alphabet = ["1", "2", "45", "9", ".", "-", " ", "+", "@", "a", "b.c", "é", "(", ")", "4111111111111111", "1.1.1.1", "\n"]
    texts = PII_TEXTS + ["".join(draw.choice(alphabet) for _ in range(draw.randint(1, 60))) for _ in range(400)]
    df = docs(spark, texts)
    found = {r["doc_id"]: r for r in pii.find_spans(df).select("doc_id", pii.digest(F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))).alias("base"), pii.digest(F.col("spans")).alias("all"), "spans").collect()}
    for i, t in enumerate(texts):
        assert found[i]["base"] == brute_base(t or "")[0], (i, t[:200])
        assert all((t or "")[s["start"] : s["end"]] == s["text"] for s in found[i]["spans"])
    assert "card13" in found[4]["all"] and "phone_local:5:17" in found[6]["all"] and found[7]["all"].count("iban") == 2


def test_pii_redaction(spark):
    got = [r["text"] for r in pii.redact(docs(spark, ["write to a@b.cd now", None, "é 1.2.3.4!", "nothing"])).orderBy("doc_id").collect()]
    assert got == ["write to [EMAIL] now", None, "é [IP]!", "nothing"]


def iban(country, length, draw):
    body = "".join(draw.choice("0123456789") for _ in range(length - 4))
    value = int("".join(str(int(c, 36)) for c in f"{body}{country}00"))
    return f"{country}{98 - value % 97:02d}{body}"


def test_pii_iban_ends_at_its_countrys_length(spark):
    draw = random.Random(4)
    lengths = {"AT": 20, "BE": 16, "ES": 24, "CZ": 24, "SE": 24, "SK": 24, "LT": 20, "LU": 20, "RO": 24, "PL": 28, "CY": 28, "HU": 28, "DE": 22, "FR": 27, "NO": 15, "MT": 31, "CH": 21, "RU": 33, "MA": 28}
    known = [(c, n, after) for c, n in lengths.items() for after in ("", ".", " EUR", " 24 euros", " BIC", " 7", " 2024", " ABCD 12", "\n12") if c != "MA" or after in ("", ".", "\n12")]
    cases = [(iban(c, n, draw), after) for c, n, after in known]
    cases += [("AT611904300234573201", " EUR"), ("ES9121000418450200051332", " 24 euros"), ("BE68539007547034", " BIC")]
    rows = [(number if k % 2 else " ".join(number[i : i + 4] for i in range(0, len(number), 4)), after) for k, (number, after) in enumerate(cases)]
    two = [" ".join(number[i : i + 4] for i in range(0, len(number), 4)) for number in (iban("BE", 16, draw), iban("DE", 22, draw))]
    wrong = ["BE68539007547035 BIC", "BE6853900754703 4", "ES91210004184502000513322 4", "xBE68539007547034 EUR"]
    texts = [f"iban {number}{after}" for number, after in rows] + [" ".join(two)] + wrong
    df = docs(spark, texts)
    got = {r["doc_id"]: [(s["start"], s["text"]) for s in r["spans"] if s["kind"] == "iban"] for r in pii.find_spans(df).collect()}
    for i, (number, _) in enumerate(rows):
        assert got[i] == [(5, number)], texts[i]
    assert got[len(rows)] == [(0, two[0]), (len(two[0]) + 1, two[1])] and all(got[len(rows) + 1 + k] == [] for k in range(len(wrong)))
    clean = [r["text"] for r in pii.redact(docs(spark, ["to AT611904300234573201 EUR", "ES9121000418450200051332 24 euros"])).orderBy("doc_id").collect()]
    assert clean == ["to [IBAN] EUR", "[IBAN] 24 euros"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


TOKEN_TEXTS = [None, "", " ", "Hello, world!", "It's WE'LL don't I'D", "a<|endoftext|>b <|startoftext|> <|Endoftext|>", "naïve Ünïcode straße ŀŁſ İstanbul K ₂ ½ ª", "日本語テスト 한국어", "áè ﬁ Ω", "x y z\u0085w\x1cq", "1234567 3.14 ١٢٣", "emoji \U0001f600\U0001f469‍\U0001f680", "#*$%&|<>" * 50, "w" * 5000, LONG[:30000], "\u0000�", "don’t ‘quote’", "\x1f\x7f a​b"]


def test_token_counts_are_the_librarys(spark, library):
    draw = random.Random(1)
    alphabet = list("abcXYZ 019'.,<|>éßÀñ\n\t 日ſı") + ["the ", "<|endoftext|>", "'s", "'LL"]
    texts = TOKEN_TEXTS + ["".join(draw.choice(alphabet) for _ in range(draw.randint(1, 80))) for _ in range(500)]
    got = {r["doc_id"]: r for r in tokens.token_counts(docs(spark, texts), queries.tokenizer_path()).collect()}
    for i, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((t or "").encode()), n > 2048), (i, t)


def test_driver_loads_no_vocabulary(spark, library, monkeypatch):
    """Each load took the driver's memory; workers, which have their own copy of the module, load it."""

    def refused(*_):
        raise AssertionError("loaded in the driver")

    monkeypatch.setattr(tokens, "whole_tokens", refused)
    monkeypatch.setattr(tokens, "Coder", refused)
    wanted = [len(library.encode(t or "", add_special_tokens=False).ids) for t in TOKEN_TEXTS]
    counted = tokens.token_counts(docs(spark, TOKEN_TEXTS), queries.tokenizer_path()).collect()
    assert [n for _, n in sorted((r["doc_id"], r["n_tokens"]) for r in counted)] == wanted
    packed = packing.pack_documents(docs(spark, TOKEN_TEXTS), queries.tokenizer_path()).groupBy("doc_id").sum("length").collect()
    assert [n for _, n in sorted(map(tuple, packed))] == [n + 1 for n in wanted]


def test_plain_words_go_to_the_merges_alone(library, monkeypatch):
    """New words are neither normalised nor split by the library again, however small the memories are."""
    with open(queries.tokenizer_path(), encoding="utf-8") as f:
        content = f.read()
    whole = tokens.whole_tokens(content)
    own = tokens.Coder(content, whole)
    draw = random.Random(8)
    alphabet = ["the", "thh", "ea", "nt", "É", "ü", "X", ",", "'s", "'", "7", " ", " ", "\n", "\x1c", "\xa0", "w" * 70]
    texts = ["".join(draw.choice(alphabet) for _ in range(draw.randint(1, 60))) for _ in range(300)]
    wanted = [list(library.encode(t, add_special_tokens=False).ids) for t in texts]

    class Unused:
        def encode_batch_fast(self, strings, **_):
            assert not strings
            return []

    monkeypatch.setattr(own, "_tok", Unused())
    for entries in (500_000, 30):
        monkeypatch.setattr(tokens, "CHUNK_ENTRIES", entries)
        monkeypatch.setattr(tokens, "MEMO_ENTRIES", len(whole) + entries)
        assert [own.pack(t) for t in texts] == [tokens.pack_ids(ids) for ids in wanted]
        assert [own.count(t) for t in texts] == list(map(len, wanted))


def test_packing_keeps_every_id(spark, library):
    texts = TOKEN_TEXTS + ["word " * k for k in (1, 5, 2047, 2048, 2049, 5000)] + ["the cat sat"] * 40
    got = packing.pack_documents(docs(spark, texts), queries.tokenizer_path(), bins_per_group=2).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for i, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        own = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and [r["start"] for r in own] == [2048 * k for k in range(len(own))]
        for r in own:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert len(part) == r["length"] and zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)) == r["ids_crc32"]
        assert sum(r["length"] for r in own) == len(ids)
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048


def test_packing_holds_every_capacity(spark):
    cut = spark.createDataFrame([(i, 0, 0, 1 + i * 37 % 400, i) for i in range(300)], "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")
    for rule in ("norm", "dot"):
        rows = packing.pack(cut, 1000, max_documents=3, max_attention=200_000, rule=rule).groupBy("sequence_id").agg(F.sum("length").alias("t"), F.count("*").alias("n"), F.sum(F.col("length") * F.col("length")).alias("a")).collect()
        assert all(r["t"] <= 1000 and r["n"] <= 3 and r["a"] <= 200_000 for r in rows) and sum(r["n"] for r in rows) == 300


def brute_counts(text):
    text = text or ""
    split = lambda s: [w for w in re.split(r"[\x20\x09-\x0D]+", s) if w]
    ws = split(text)
    lines = [x for x in text.split("\n") if split(x)]
    grams = Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
    inside = set()
    for i in range(len(ws) - 2):
        if grams[tuple(ws[i : i + 3])] > 1:
            inside |= {i, i + 1, i + 2}
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def test_quality_counts_are_those_of_brute_force(spark):
    draw = random.Random(2)
    texts = [None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", "x y z\x0bw\x0cq", "l\nl\n\nl\r\nl", "a " * 300, LONG, *["".join(draw.choice(["a", "b", "c", " ", " ", "\n", "#", "é", "\t"]) for _ in range(draw.randint(1, 200))) for _ in range(300)]]
    for r in quality.judge(docs(spark, texts)).collect():
        n = brute_counts(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == n, r["doc_id"]
        assert r["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0]) and (not r["base_failed"] or not r["kept"])


def test_quality_keeps_clean_and_drops_junk(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    judged = {r["doc_id"]: r["kept"] for r in quality.judge(d).collect()}
    kept = quality.keep(d)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == {i for i, k in judged.items() if k}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    long = {r["doc_id"] for r in d.where(F.size(F.split("text", " ")) >= 60).collect()}
    good = [judged[i] for i, q in labels.items() if q == 1 and i in long]
    assert sum(good) >= 0.9 * len(good)


def js(a, b):
    half = lambda x, y: x * math.log2(2 * x / (x + y)) if x else 0.0
    p, q = [x / sum(a) for x in a], [x / sum(b) for x in b]
    return math.sqrt(max(sum(half(x, y) + half(y, x) for x, y in zip(p, q)) / 2, 0))


def brute_histograms(text):
    letters, upper, digits, spaces = (sum(f(c) for c in text) for f in (str.isalpha, str.isupper, str.isdigit, str.isspace))
    punctuation = sum(c in textstats.PUNCTUATION for c in text)
    chars = [letters - upper, upper, digits, spaces, punctuation, len(text) - letters - digits - spaces - punctuation]
    bare = [w.strip(textstats.PUNCTUATION).lower() for w in text.split() if len(w) <= textstats.LONGEST + 2]
    return chars, Counter(w for w in bare if w in textstats.ALL_COMMON)


def brute_judged(rows):
    """(kept, char distance, word distance) of (text, lang), references and all, by loops over all bins."""
    key = lambda lang: lang if lang in textstats.COMMON_WORDS else "*"
    counts = [brute_counts(t) for t, _ in rows]
    failed = [c[0] < 50 or 100 * c[4] > 50 * c[0] for c in counts]
    own = [brute_histograms(t or "") for t, _ in rows]
    refs = {}
    for k in [*textstats.COMMON_WORDS, "*"]:
        listed = textstats.COMMON_WORDS.get(k, [])
        weight = [1 / (rank + 2) for rank in range(len(listed))]
        chars, words, n = list(map(float, quality.PRIOR_CHARS)), {w: 600.0 * x / sum(weight) for w, x in zip(listed, weight)}, 2000.0
        for (text, lang), (cs, ws), c, bad in zip(rows, own, counts, failed):
            if key(lang) == k and not bad:
                chars, n = [a + b for a, b in zip(chars, cs)], n + c[0]
                for w, m in ws.items():
                    words[w] = words.get(w, 0.0) + m
        refs[k] = chars, words, n
    out = []
    for (text, lang), (cs, ws), c, bad in zip(rows, own, counts, failed):
        k = key(lang)
        by_char = by_word = None
        if c[1] >= 200:
            by_char = js(cs, refs[k][0]) if k != "*" else min(js(cs, r[0]) for r in refs.values())
        if c[0] >= 80 and k != "*":
            _, words, n = refs[k]
            mine, theirs = [ws[w] for w in textstats.ALL_COMMON], [words.get(w, 0.0) for w in textstats.ALL_COMMON]
            by_word = js([*mine, c[0] - sum(mine)], [*theirs, n - sum(theirs)])
            share, ours = sum(words.get(w, 0.0) for w in textstats.COMMON_WORDS[k]) / n, sum(ws[w] for w in textstats.COMMON_WORDS[k])
            if c[0] * share >= 8:
                by_word = max(by_word, js([ours, c[0] - ours], [share, 1 - share]) / js([0, 1], [share, 1 - share]))
        out.append((not bad and (by_char or 0) <= 0.2 and (by_word or 0) <= 0.45, by_char, by_word))
    return out


def test_quality_kept_is_that_of_brute_force_and_drops_texts_without_common_words(spark):
    draw = random.Random(8)
    word = lambda: "".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randint(6, 9)))

    def text(n, share, lang):
        return " ".join(draw.choice(textstats.COMMON_WORDS[lang]) if draw.random() < share else word() for _ in range(n))

    rows = [(text(draw.randint(60, 400), 0.22, lang), lang) for lang in textstats.COMMON_WORDS for _ in range(40)]
    good = len(rows)
    rows += [(text(draw.randint(80, 400), 0, lang), lang) for lang in textstats.COMMON_WORDS for _ in range(8)]
    rows += [(" | ".join(text(3, 0, "en") for _ in range(40)), "en"), (text(200, 0.22, "fr"), "en"), (text(200, 0.04, "de"), "de"), (text(60, 0, "es"), "es")]
    rows += [(text(150, 0, "en"), "xx") for _ in range(4)]
    df = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(rows)], "doc_id bigint, text string, lang string")
    judged = quality.judge(df).orderBy("doc_id").collect()
    got = [r["kept"] for r in judged]
    said = brute_judged(rows)
    assert got == [k for k, _, _ in said]
    for r, (_, by_char, by_word) in zip(judged, said):
        assert r["char_distance"] == pytest.approx(by_char, abs=1e-9) and r["word_distance"] == pytest.approx(by_word, abs=1e-9), rows[r["doc_id"]]
    assert sum(got[:good]) >= 0.97 * good
    assert not any(got[good : good + 35]) and all(got[good + 35 :])


def test_mixing_meets_targets_and_its_sql(spark):
    import duckdb

    report, mixed = mixing.mix(spark.read.parquet(f"{SF}/documents.parquet"), rows_per_bucket=16)
    rows = report.collect()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    said = {r[0]: r[1:] for r in con.sql(queries.ORACLE_SQL["op6_mixing"]).fetchall()}
    assert {r["doc_id"]: (r["size"], r["source_size"], r["target"], r["taken"]) for r in rows} == said
    sources = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    taken, target = Counter(), {}
    for r in rows:
        taken[sources[r["doc_id"]]] += r["taken"]
        target[sources[r["doc_id"]]] = r["target"]
        assert r["taken"] <= 3 * r["size"]
    assert abs(sum(taken.values()) - sum(target.values())) <= max(r["size"] for r in rows)
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({r["doc_id"]: r["passes"] for r in rows if r["passes"]})


def test_quality_of_a_language_with_one_document_and_of_none(spark):
    draw = random.Random(3)
    prose = lambda n, lang: " ".join(draw.choice(textstats.COMMON_WORDS[lang]) if draw.random() < 0.3 else "".join(draw.choice("abcdefghiklmnoprst") for _ in range(draw.randint(3, 9))) for _ in range(n))
    rows = [(0, "|| <> ## " * 90 + prose(60, "de"), "de"), (1, prose(200, "fr") + ".", "fr"), (2, prose(300, "es"), None), (3, "The, of. and! " + prose(120, "en"), "en")]
    got = {r["doc_id"]: r["kept"] for r in quality.judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert got == {0: False, 1: True, 2: True, 3: True}


def test_repeated_words_of_a_million_words_are_exact(spark):
    draw = random.Random(9)
    words = [f"w{draw.randrange(3000)}" for _ in range(1_000_000)]
    rows = [(0, " ".join(words), "en"), (1, " ".join(map(str, range(1_000_000))), "en"), (2, "a " * 200_000, "en")]
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)).collect()}
    assert got[0]["n_repeat_words"] == brute_counts(rows[0][1])[4] and got[1]["n_repeat_words"] == 0 and got[2]["n_repeat_words"] == 200_000


BIG = 2**53


def test_packing_keeps_ids_beside_a_null(spark):
    rows = [(BIG + 1, "one"), (None, "two words"), (BIG + 3, "three"), (BIG + 3, "three"), (None, None), (-5, "")]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), queries.tokenizer_path()).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows) and len({(r["sequence_id"], r["offset"]) for r in got}) == len(rows)
    named = packing.pack_documents(spark.createDataFrame([("x", "one"), (None, "two")], "doc_id string, text string"), queries.tokenizer_path()).collect()
    assert {r["doc_id"] for r in named} == {"x", None}


def brute_mix(rows, repeats=3):
    """Taken words of (doc_id, text, source), as a multiset, by one queue of all copies."""
    import hashlib as h

    md5 = lambda s: h.md5(s.encode()).hexdigest()
    sized = [(s, len((t or "").split()), md5(f"0:{'' if i is None else i}:{md5(t or '')}"), i) for i, t, s in rows]
    names = sorted({s for s, *_ in sized}, key=lambda s: (s is None, s or ""))
    size = {s: sum(n for q, n, *_ in sized if q == s) for s in names}
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    target, left, open_ = {}, sum(size.values()), list(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > repeats * size[s]]
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in over:
            target[s] = repeats * size[s]
            left -= target[s]
            open_.remove(s)
    queue = []
    for k, s in enumerate(names):
        upto = 0
        for j, (_, n, order, i) in enumerate(sorted((x for x in sized if x[0] == s), key=lambda x: x[2])):
            upto += n
            queue += [((p * size[s] + upto) / target[s], k, p, order, j, n, i) for p in range(repeats) if n]
    taken, spent = Counter(), 0
    for finish, k, p, order, j, n, i in sorted(queue, key=lambda x: x[:5]):
        spent += n
        if spent > sum(size.values()):
            break
        taken[k, order, j, i, n] += n
    every = [(k, order, j, i, n) for k, s in enumerate(names) for j, (_, n, order, i) in enumerate(sorted((x for x in sized if x[0] == s), key=lambda x: x[2]))]
    return Counter((i, n, taken[k, order, j, i, n]) for k, order, j, i, n in every), {s: (size[s], target[s]) for s in names}


@pytest.mark.parametrize("rows_per_bucket", [1, 4096])
def test_mixing_of_copies_and_null_ids_keeps_to_the_targets(spark, rows_per_bucket):
    draw = random.Random(7)
    rows = [(None, "hot copy here", "a")] * 150 + [(None, f"{'w ' * draw.randint(1, 9)}x{i}", draw.choice("ab")) for i in range(120)] + [(BIG + 1, "x y", "b")] * 7
    rows += [(i, "z " * draw.randint(0, 30), draw.choice(["a", "b", "c", None])) for i in range(80)] + [(8, None, "c"), (9, "", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)
    report, mixed = mixing.mix(df, rows_per_bucket=rows_per_bucket)
    got = report.collect()
    said, sums = brute_mix(rows)
    assert Counter((r["doc_id"], r["size"], r["taken"]) for r in got) == said
    taken = Counter()
    for (i, t, s), n in Counter((r["doc_id"], r["text"], r["source"]) for r in mixed.collect()).items():
        taken[s] += n * len((t or "").split())
    longest = max(len((t or "").split()) for _, t, _ in rows)
    assert all(abs(taken[s] - target) <= 3 * longest for s, (_, target) in sums.items()) and sum(taken.values()) <= sum(n for n, _ in sums.values())


def test_columns_of_any_name_and_repeated_rows(spark):
    """Names with dots, names that differ in case only, and the operators' own working names are carried along or left alone."""
    extra = ["meta.url", "TEXT", "Doc_ID", "ws", "key", "chars", "size", "order", "s", "x", "id", "y", "g", "roomy", "n_words", "row", "c0", "clean", "pass", "h", "node", "label"]
    good = "the and of to in is that for it as " + " ".join(f"word{chr(97 + i % 20)}{chr(97 + i // 20)}" for i in range(60)) + " mail a@b.cd"
    rows = [(i, t, "en", s, *["e"] * len(extra)) for i, t, s in [(1, good, "a"), (1, good, "a"), (None, good + " x", None), (2, None, "a"), (3, "", "b"), (4, "short text", "b")]]
    names = ["doc_id", "text", "lang", "source", *extra]
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` {'bigint' if n == 'doc_id' else 'string'}" for n in names))
    path = queries.tokenizer_path()
    for got in (tokens.token_counts(df, path), pii.find_spans(df), quality.judge(df), mixing.mix(df)[0], packing.pack_documents(df, path), ranking.features(df)):
        assert Counter(r["doc_id"] for r in got.collect()) == Counter(r[0] for r in rows)
    for got, n in ((pii.redact(df), 6), (quality.keep(df), 3), (mixing.mix(df)[1], None)):
        assert got.columns == names and (n is None or got.count() == n) and all(r[4] == "e" for r in got.collect())
    pages = spark.createDataFrame([(1, "http://x.net/a", "e", "e")], "page_id bigint, url string, `URL` string, `a.b` string")
    assert urls.judge_urls(pages, pages.select("page_id").selectExpr("'http://q.com' AS u"), queries.URL_RULES).first()["verdict"] == "block"


def test_pii_secrets_and_scores(spark):
    key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    rows = {r["doc_id"]: r["spans"] for r in pii.find_spans(docs(spark, [f'token = "{key}"', f"commit {key}", f"checksum key {key}", "ip 1.2.3.4 then version 1.2.3.4"])).collect()}
    assert [(s["kind"], s["text"]) for s in rows[0]] == [("secret", key)] and rows[1] == [] and [s["kind"] for s in rows[2]] == []
    assert [s["score"] for s in rows[3]] == [0.9, 0.4]


def test_unknown_tokenizer_goes_to_the_library():
    from tokenizers import Tokenizer, models, pre_tokenizers

    own = Tokenizer(models.WordLevel({"a": 0, "b": 1, "?": 2}, unk_token="?"))
    own.pre_tokenizer = pre_tokenizers.Whitespace()
    made = own.to_str()
    assert not tokens.covered(made) and tokens.covered(open(queries.tokenizer_path()).read())
    coder = tokens.Coder(made, tokens.whole_tokens(made))
    assert coder.count("a b zz") == 3 and coder.pack("b a") == bytes([1, 0, 0, 0, 0, 0, 0, 0])


def test_url_filter_beyond_the_broadcast_bound(spark, monkeypatch):
    rows = spark.createDataFrame([(i, f"http://h{i % 50}.com/p?utm_source=1" if i % 3 == 0 else f"http://h{i % 50}.com/p{i % 2}") for i in range(300)] + [(900 + i, None) for i in range(20)], "page_id bigint, url string")
    key = lambda: Counter((r["page_id"], r["verdict"], r["listed"]) for r in urls.judge_urls(rows, queries.campaign_urls(rows), queries.URL_RULES).collect())
    near = key()
    monkeypatch.setattr(urls, "MAX_BROADCAST_BLOCKS", 0)
    assert key() == near and sum(n for (_, v, _), n in near.items() if v == "block") == 100


def test_mixing_without_broadcast_sources(spark, monkeypatch):
    df = docs(spark, ["a b c"] * 5 + ["d e"] * 9)
    key = lambda: Counter(tuple(r) for r in mixing.mix(df)[0].collect())
    near = key()
    monkeypatch.setattr(mixing, "MAX_BROADCAST_SOURCES", 0)
    assert key() == near


def test_ranking_fits_the_pairs_likelihood():
    """The fitted weights are where the penalised likelihood of the very pairs is greatest: no step in any direction makes it better."""
    import numpy as np

    r = np.random.default_rng(2)
    x = r.normal(size=(300, 3))
    y = (x @ np.array([2.0, -1.0, 0.0]) + r.logistic(size=300) > 0).astype(int)
    model = ranking.fit(x, y, max_pairs=4000)
    draw = np.random.default_rng(7)
    good, bad = x[y == 1], x[y == 0]
    diff = (good[draw.integers(len(good), size=4000)] - bad[draw.integers(len(bad), size=4000)]) / x.std(axis=0)
    loss = lambda w: np.log1p(np.exp(-diff @ w)).mean() + 0.0005 * (w @ w)
    best = np.array(model.weights)
    for k in range(3):
        for step in (0.01, -0.01):
            assert loss(best + step * np.eye(3)[k]) > loss(best)
    score = (x - x.mean(axis=0)) / x.std(axis=0) @ best
    assert ((score >= model.threshold) == (np.argsort(np.argsort(score)) >= round((y == 0).mean() * 300))).all()


def test_ranking_learns_from_all_rows_and_all_pairs(spark):
    """The weights are those of Newton's method on every pair of every labelled row, and classify() hands all 22,000 rows to it."""
    import numpy as np

    r = np.random.default_rng(5)
    width = len(ranking.feature_columns())
    x = np.round(r.normal(size=(600, width)), 1) * 3
    y = (x[:, 0] - x[:, 1] / 2 + 2 * r.logistic(size=600) > 2).astype(int)
    table = spark.createDataFrame([(a.tolist(), int(b)) for a, b in zip(x, y)], "x array<double>, y int")
    model = ranking.train(table.repartition(3))
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    diff = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, width)
    w = np.array(model.weights)
    p = 1 / (1 + np.exp(-diff @ w))
    assert len(diff) > 50_000 and np.abs(diff.T @ (p - 1) / len(diff) + 1e-3 * w).max() < 1e-9
    loss, slope, curve = ranking.whole_loss(ranking.moments(table, x.mean(axis=0), x.std(axis=0), w * 2).collect(), width)
    p = 1 / (1 + np.exp(-diff @ w * 2))
    assert abs(loss / -np.log(p).mean() - 1) < 1e-10 and np.abs(slope - diff.T @ (p - 1) / len(diff)).max() < 1e-10
    assert np.abs(curve - (diff * (p * (1 - p))[:, None]).T @ diff / len(diff)).max() < 1e-10
    score = np.sort(z @ w)
    at = int((y == 0).sum())
    assert abs(model.threshold - (score[at - 1] + score[at]) / 2) < 1e-9 and abs(model.spread - score.std() / 2) < 1e-9

    ids = [i for i in range(66_000) if zlib.crc32(str(i).encode()) % 3 != 1][:22_000]
    texts = ["a b c d", "Of and the, of 12 " * 4, "the # x", None]
    many = spark.createDataFrame([(i, texts[i % 4]) for i in ids], "doc_id bigint, text string")
    marks = spark.createDataFrame([(i, int(i % 7 < 3 + i % 4)) for i in ids], "doc_id bigint, quality int")
    seen = {}
    train, ranking.train = ranking.train, lambda rows: seen.update(n=rows.count(), ones=rows.where("y = 1").count()) or train(rows)
    try:
        assert ranking.classify(many, marks).count() == 22_000
    finally:
        ranking.train = train
    assert seen == {"n": 22_000, "ones": sum(i % 7 < 3 + i % 4 for i in ids)}


def test_ranking_selects_by_rank(spark):
    draw = random.Random(3)
    values = [draw.choice([0.0, -1e300, 1e300, 1.0, 1.0 + 2**-52, draw.random()]) for _ in range(3000)]
    table = spark.createDataFrame([(v,) for v in values], "s double")
    for rank in (0, 1, 600, 1499, 1800, 2998, 2999):
        assert ranking.ranked(table, rank) == sorted(values)[rank]


def test_mixing_of_odd_tables(spark):
    report, mixed = mixing.mix(docs(spark, [None, "", "one two", "three", " "]))
    assert report.count() == 5 and all(r["taken"] == 0 for r in report.collect() if r["size"] == 0) and set(mixed.columns) == set(docs(spark, [None]).columns)
    report, mixed = mixing.mix(docs(spark, ["x"]).limit(0))
    assert report.collect() == [] and mixed.collect() == []


def test_ranking_predicts_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = ranking.classify(spark.read.parquet(f"{sf}/documents.parquet"), labels)
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 50 and sum(r["predicted"] == r["quality"] for r in rows) >= 0.85 * len(rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_ranking_without_labels_or_texts(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    rows = ranking.classify(docs(spark, [None, "", "a b"]), none).collect()
    assert [r["score"] for r in rows] == [0.5] * 3
    assert ranking.classify(docs(spark, ["x"]).limit(0), none).collect() == []


def test_urls(spark):
    cases = {
        "http://A.Example.NET/en/1": ("a.example.net", "/en/1", "example.net/en/", "allow"), "https://x.net/q?b#c": ("x.net", "/q", "net/", "block"), "http://net": ("net", "", None, "allow"), "http://example.com/de/x": ("example.com", "/de/x", "example.com/de/", "block"),
        "ftp://w.org/fr/": ("w.org", "/fr/", "org/fr/", "allow"), "no scheme": ("", "", None, "allow"), "http://y.com/p/?utm_source=1": ("y.com", "/p/", None, "block"), "https://www.y.com:443/p#z": ("www.y.com:443", "/p", None, "block"), "http://y.com/P": ("y.com", "/P", None, "allow"), "://": ("", "", None, "allow"), "http://notnet/x": ("notnet", "/x", None, "allow"), None: ("", "", None, "allow"),
    }
    rows = spark.createDataFrame(list(enumerate(cases)), "page_id bigint, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge_urls(rows, queries.campaign_urls(rows), queries.URL_RULES).collect()}
    assert got == dict(enumerate(cases.values()))
    assert urls.judge_urls(rows.limit(0), rows.select("url").limit(0), queries.URL_RULES).collect() == []


def test_bloom_filter_has_no_false_negative_and_few_false_positives(spark):
    listed = spark.range(2000).select(F.concat(F.lit("u"), "id").alias("key"))
    rows = spark.range(12000).select(F.concat(F.lit("u"), "id").alias("k"))
    hits = {r["k"] for r in urls.possible_hits(rows, "k", listed).collect()}
    assert {f"u{i}" for i in range(2000)} <= hits and len(hits) < 2300


def test_empty_tables(spark):
    none = docs(spark, ["x"]).limit(0)
    path = queries.tokenizer_path()
    for df in (pii.find_spans(none), pii.redact(none), tokens.token_counts(none, path), packing.pack_documents(none, path), quality.judge(none), quality.keep(none)):
        assert df.collect() == []


def test_digest_is_stable():
    assert hashlib.sha256(brute_base("a@b.cd")[0].encode()).hexdigest() == hashlib.sha256(b"email:0:6").hexdigest()
