"""The Merkle manifest and the streaming exact deduplication against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loopwright.llm import manifest as M
from loopwright.llm import streamdedup as S

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, Doc_ID_ string, `a.b` int, tree int, n int, row string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def said(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def brute_tree(nodes):
    """Levels of a tree, and the digest it ends in."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def brute(rows):
    trees = defaultdict(list)
    for doc_id, source, lang, n_chars, text in rows:
        lower = re.sub("[A-Z]", lambda m: m.group().lower(), text) if text is not None else None
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
        leaf = lambda t: H(said(doc_id), said(source), said(lang), said(n_chars), said(t))
        trees[source].append(((doc_id is not None, doc_id or 0, leaf(text)), doc_id, leaf(text), leaf(lower) if hit else leaf(text)))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    levels = {s: brute_tree([x[2] for x in sorted(trees[s])]) for s in order}
    top = brute_tree([levels[s][-1][0] for s in order])
    found = []
    for place, s in enumerate(order):
        for at, (_, doc_id, leaf, changed) in enumerate(sorted(trees[s])):
            siblings, folded = [], changed
            for tree, i in ((levels[s], at), (top, place)):
                for nodes in tree[:-1]:
                    run = nodes[i // 16 * 16 : i // 16 * 16 + 16]
                    siblings += run[: i % 16] + run[i % 16 + 1 :]
                    folded = H(*run[: i % 16], folded, *run[i % 16 + 1 :])
                    i //= 16
            found.append((str(doc_id), leaf, levels[s][-1][0], top[-1][0], H(*siblings), folded, folded == top[-1][0]))
    return sorted(found)


def documents(draw, sizes):
    rows = []
    for source, n in sizes.items():
        for _ in range(n):
            rows.append((draw.choice([None, draw.randint(-50, 10**6), draw.randint(0, 40)]), source, draw.choice([None, "en", "é"]), draw.choice([None, 3]), draw.choice([None, "", "Abc", "xyz", "ÄB ä", "Z" * 40])))
    draw.shuffle(rows)
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3, "q") for r in rows], SCHEMA)


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 16, None: 17}, {f"s{i:02d}": 1 + i % 3 for i in range(40)} | {"B": 300, None: 257, "é": 33, "": 1}])
def test_proofs_are_those_of_brute_force(spark, sizes):
    draw = random.Random(1)
    rows = documents(draw, sizes)
    rows += rows[: len(rows) // 3]
    found = M.manifest(table(spark, rows).repartition(3)).collect()
    got = sorted((str(r["doc_id"]), *[r[c] for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")]) for r in found)
    assert got == brute(rows)
    assert {r["verified"] for r in found} == {True, False} or len(rows) < 20


def test_manifest_of_an_empty_table_and_one_hot_source(spark, monkeypatch):
    assert M.manifest(table(spark, []).limit(0)).collect() == []
    monkeypatch.setattr(M, "MAX_BROADCAST_SOURCES", 0)
    rows = [(7, "a", "en", 1, "T")] * 700 + [(i, "a", "en", 1, "T") for i in range(3600)]
    got = sorted((str(r["doc_id"]), *[r[c] for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")]) for r in M.manifest(table(spark, rows)).collect())
    assert got == brute(rows)


def brute_groups(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    found = []
    for body, own in groups.items():
        best = min(own)
        for k, (_, _, _, doc_id) in enumerate(sorted(own)):
            found.append((str(doc_id), str(best[3]), len(own), k == 0, hashlib.sha256(body.encode()).hexdigest()))
    return sorted(found)


def texts(draw, n):
    base = ["", " ", None, "a b", "ab", "a\tb\n", "é x", "éx", "x" * 3000, "\x1c1", "1", " 1", "same text here"]
    return [(draw.choice([None, i, draw.randint(0, 30)]), draw.choice(base) if draw.random() < 0.6 else f"text {draw.randint(0, n)}") for i in range(n)]


def as_docs(spark, rows):
    return spark.createDataFrame([(i, "s", "en", 1, t, "x", 1, 2, 3, "q") for i, t in rows], SCHEMA)


def told(df):
    return sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"], r["text_sha256"]) for r in df.collect())


@pytest.mark.parametrize("files,digest_chars", [(None, 64), (1, 64), (2, 1)])
def test_groups_are_those_of_brute_force(spark, files, digest_chars):
    """One digest character: sixteen digests for all texts, so that only the bytes tell them apart."""
    rows = texts(random.Random(3), 400)
    df = as_docs(spark, rows).repartition(5)
    assert told(S.deduplicate(df, files_per_batch=files, digest_chars=digest_chars)) == brute_groups(rows)


def test_hot_group_is_compared_in_slots(spark, monkeypatch):
    monkeypatch.setattr(S, "SLOT", 4)
    rows = [(i, "hot  text" if i % 3 else f"t{i // 7}") for i in range(600)] + [(5, "hot text")] * 40
    assert told(S.deduplicate(as_docs(spark, rows))) == brute_groups(rows)
    assert told(S.deduplicate(as_docs(spark, rows), digest_chars=1)) == brute_groups(rows)


def test_state_goes_on_where_it_ended(spark, tmp_path):
    """A second run over a store that got more files reads these alone, against the state of the first."""
    first, more = texts(random.Random(4), 60), [(i + 1000, t) for i, t in texts(random.Random(5), 60) if i is not None]
    store, checkpoint = f"file://{tmp_path}/store", f"file://{tmp_path}/state"
    take = lambda rows: S.content_store(as_docs(spark, rows).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).write.mode("append").parquet(store)
    take(first)
    S.absorb(spark, store, checkpoint)
    take(more)
    S.absorb(spark, store, checkpoint, 1)
    got = sorted((r["copies"], str(r["head_id"])) for r in S.entries(spark, checkpoint).collect())
    assert got == sorted((size, keep) for _, keep, size, kept, _ in brute_groups(first + more) if kept)


def test_keep_leaves_one_of_each_group_and_all_columns(spark):
    rows = texts(random.Random(6), 200) + [(None, "twice")] * 2
    df = as_docs(spark, rows)
    left = S.keep(df)
    assert left.columns == df.columns and left.count() == sum(kept for *_, kept, _ in brute_groups(rows))
    assert S.keep(df.limit(0)).collect() == [] and S.deduplicate(df.limit(0)).collect() == []
