"""Fingerprints, near duplicates and repeated windows against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loopwright.llm import fingerprints, linking, minhash, suffixes

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, source string, h string, label string"


def corpus(n=60, seed=3):
    """Clusters of near copies, exact copies, shared passages, short, empty and null texts."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdeé") for _ in range(draw.randint(1, 6)))
    texts = []
    passage = " ".join(word() for _ in range(70))
    for k in range(n):
        base = [word() for _ in range(draw.randint(1, 200))]
        texts.append(" ".join(base))
        if k % 3 == 0:
            for _ in range(draw.randint(1, 4)):
                near = list(base)
                for _ in range(draw.randint(0, max(1, len(near) // 25))):
                    near[draw.randrange(len(near))] = word()
                texts.append(" ".join(near))
        if k % 5 == 0:
            texts.append(texts[-1])
        if k % 7 == 0:
            texts.append(" ".join(word() for _ in range(20)) + passage + " ".join(word() for _ in range(9)))
    texts += [None, "", " ", "one", "one", "two words", "x" * 900, "x" * 300, "ab" * 400]
    order = list(range(len(texts)))
    draw.shuffle(order)
    return [(i, texts[j], "s", None, "q") for i, j in enumerate(order)]


def bag(text):
    ws = (text or "").encode().split()
    n = min(5, len(ws))
    return Counter(tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)) if ws else Counter()


def brute_classes(rows):
    parent = {r[0]: r[0] for r in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    bags = [(r[0], bag(r[1])) for r in rows]
    for i, (a, x) in enumerate(bags):
        for b, y in bags[:i]:
            both, either = sum((x & y).values()), sum((x | y).values())
            if (either == 0 or both >= 0.8 * either) and root(a) != root(b):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {r[0]: root(r[0]) for r in rows}


def test_near_classes_are_those_of_brute_force(spark):
    rows = corpus()
    found = {r["doc_id"]: r["class_id"] for r in minhash.near_classes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == brute_classes(rows)


def test_keep_leaves_one_of_each_class_and_all_columns(spark):
    rows = corpus(25, 5)
    rows += [rows[0], (None, "a null id", "s", None, "q"), (None, "a null id", "s", None, "q")]
    kept = minhash.keep(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "source", "h", "label"]
    ids = sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect())
    expected = sorted({(False, c) for c in brute_classes([r for r in rows if r[0] is not None]).values()} | {(True, None)})
    assert ids == expected


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert minhash.near_classes(none).collect() == []
    assert minhash.keep(none).collect() == []
    assert suffixes.removed(none).collect() == []
    assert fingerprints.edited(none).collect() == []
    assert fingerprints.near_classes(none).collect() == []


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)]
    found = {r["node"]: r["label"] for r in linking.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}


@pytest.mark.parametrize("small, block_bytes", [(100, 1 << 20), (2, 1 << 20), (2, 700)])
def test_linking_finds_every_link_of_a_bucket(spark, small, block_bytes):
    """Points on a line, all in one bucket, linked within a distance: the head reaches few of them. By pairs, one block, many blocks."""
    import numpy as np

    draw = random.Random(2)
    at = sorted(draw.random() for _ in range(80))
    members = spark.createDataFrame([(1, i) for i in range(80)], "bucket bigint, node bigint")
    place = spark.createDataFrame(list(enumerate(at)), "i bigint, x double")

    def verify(pairs):
        met = pairs.join(place.withColumnRenamed("i", "a").withColumnRenamed("x", "u"), "a").join(place.withColumnRenamed("i", "b").withColumnRenamed("x", "v"), "b")
        return met.withColumn("sim", 1.0 - F.abs(F.col("u") - F.col("v")))

    def similar(data):
        x = np.array([float(d) for d in data])
        return lambda i: 1.0 - np.abs(x - x[i])

    payload = lambda nodes: place.select(F.col("i").alias("node"), F.col("x").cast("string").alias("data")).join(nodes, "node", "left_semi")
    labels, links = linking.classes(members, verify, 0.98, payload, similar, small, block_bytes)
    found = {r["node"]: r["label"] for r in labels.collect()}
    assert all(r["sim"] >= 0.98 and abs(r["sim"] - (1 - abs(at[r["a"]] - at[r["b"]]))) < 1e-9 for r in links.collect())
    expected, label = {}, 0
    for i in range(80):
        label = i if i and at[i] - at[i - 1] > 0.02 else label
        expected[i] = label
    assert {i: found.get(i, i) for i in range(80)} == expected


def test_overlaps_of_a_block_are_those_of_pairs():
    draw = random.Random(4)
    import numpy as np

    bags = [np.unique(np.array([draw.randrange(40) for _ in range(draw.randint(1, 30))], np.uint64)).tobytes() for _ in range(30)]
    similar = minhash.overlaps(bags)
    assert all(abs(similar(i)[j] - minhash.overlap(bags[i], bags[j])) < 1e-12 for i in range(30) for j in range(30))


def test_weighted_signatures_estimate_weighted_jaccard():
    import numpy as np

    errors = []
    for trial in range(80):
        r = np.random.default_rng(trial)
        element, a, b = r.integers(0, 2**63, 50).astype(np.uint64), r.integers(0, 20, 50), r.integers(0, 20, 50)
        owner, both = np.repeat([0, 1], 50), np.r_[a, b]
        s = minhash.signatures(owner[both > 0], np.r_[element, element][both > 0], both[both > 0], 2)
        errors.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.06


def brute_removed(rows, length=200):
    where = defaultdict(int)
    raw = [(r[0], (r[1] or "").encode()) for r in rows]
    for _, t in raw:
        for s in range(len(t) - length + 1):
            where[t[s : s + length]] += 1
    out = {}
    for i, t in raw:
        gone = bytearray(len(t))
        for s in range(len(t) - length + 1):
            if where[t[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("piece", [1 << 18, 700])
def test_removed_bytes_are_those_of_brute_force(spark, monkeypatch, piece):
    import numpy as np

    if piece < 1 << 18:  # the cut of long texts, in this process
        monkeypatch.setattr(suffixes, "PIECE", piece)
        import pyarrow as pa

        text = " ".join(str(i * i) for i in range(2000))
        of, start, n, _, _, _ = suffixes.runs(*suffixes._texts(pa.array([text])))
        covered = np.zeros(len(text), int)
        for s, k in zip(start, n):
            covered[s : s + k] += 1
        assert (covered[: len(text) - 199] == 1).all() and covered[len(text) - 199 :].sum() == 0
        return
    rows = corpus(40, 9)
    got = suffixes.removed(spark.createDataFrame(rows, SCHEMA)).collect()
    found = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got}
    assert len(got) == len(rows) and found == brute_removed(rows)
    assert sum(v[1] > 0 for v in found.values()) > 20


def test_removed_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.removed(docs).collect()}
    assert got == brute_removed(rows)


@pytest.mark.parametrize("range_bytes", [1 << 25, 4000])
def test_fingerprints_meet_the_next_document(spark, range_bytes):
    rows = corpus(30, 4)
    got = {r["doc_id"]: r for r in fingerprints.edited(spark.createDataFrame(rows, SCHEMA), range_bytes=range_bytes).collect()}
    order = sorted(rows, reverse=True)
    assert len(got) == len(rows)
    for (i, text, *_), (_, following, *_) in zip(order, order[1:] + order[:1]):
        text, following = text or "", following or ""
        n = len(text)
        changed = text[: n - n // 3] + following[: n // 3]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (n, hashlib.sha256(changed.encode()).hexdigest())
        assert r["fingerprint"] == fingerprints.fingerprint(text) and r["edited_fingerprint"] == fingerprints.fingerprint(changed)
        of = lambda a, b: float(fingerprints.likeness(fingerprints.read_print(a), fingerprints.read_print(b)))
        assert r["near_edited"] == of(r["fingerprint"], r["edited_fingerprint"])
        assert r["near_next"] == of(r["fingerprint"], fingerprints.fingerprint(following))


def test_fingerprints_tell_edited_from_other_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = [r for r in fingerprints.edited(docs).collect() if r["n_chars"] > 100]
    assert sorted(r["near_edited"] for r in got)[len(got) // 50] > 0.5
    assert sorted(r["near_next"] for r in got)[len(got) * 8 // 10] < 0.3


def test_fingerprint_classes_hold_light_edits_together(spark):
    """Recall against brute force (all edited texts) of at least 0.9, at several lengths and numbers of edits; unrelated texts stay apart."""
    draw = random.Random(8)
    word = lambda: "".join(draw.choice("abcdefghijklmno") for _ in range(draw.randint(2, 9)))

    def edit(text, edits):
        t = list(text)
        for _ in range(edits):
            at, kind = draw.randrange(len(t)), draw.choice("ids")
            t[at : at + (kind != "i")] = [] if kind == "d" else [draw.choice("abcdef ")]
        return "".join(t)

    rows, pairs = [], []
    for length, edits in ((200, 2), (600, 6), (3000, 10), (20000, 15)):
        for _ in range(25):
            text = " ".join(word() for _ in range(length // 6))
            i = len(rows)
            rows += [(i, text, "s", None, ""), (i + 1, text, "s", None, ""), (i + 2, edit(text, edits), "s", None, "")]
            pairs.append((i, i + 2))
    rows += [(9000, None, "s", None, ""), (9001, "", "s", None, "")]
    got = {r["doc_id"]: r for r in fingerprints.near_classes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i]["class_id"] == got[i + 1]["class_id"] == i and got[i]["copies"] >= 2 for i, _ in pairs) and got[9001]["class_id"] == 9000
    assert all(r["class_id"] in (i, i // 3 * 3) for i, r in got.items() if i < 9000)
    assert sum(got[j]["class_id"] == i for i, j in pairs) >= 0.9 * len(pairs)
    assert all(got[j]["copies"] > 2 or (got[j]["links"] > 0 and got[j]["likest"] >= 0.6) for i, j in pairs if got[j]["class_id"] == i)


def brute_print(text):
    """The fingerprint by its definition: each walk step by step, then the last sampled step of each slot."""
    out = ""
    for walk in fingerprints.walks():
        stood, j = [], 0
        for c in text:
            stay = int(walk.advance[(ord(c) * 2654435761 >> 9) % fingerprints.CLASSES][j % fingerprints.PERIOD])
            stood += [c] * stay
            j += stay
        for slot in range(fingerprints.SLOTS // fingerprints.WALKS):
            steps = [int(s) for s in walk._last[:, slot] if 0 <= s < len(stood)]
            if not steps:
                out += "0"
                continue
            step, mask = max(steps), (1 << 64) - 1

            def mix(x):
                x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & mask
                x = (x ^ (x >> 27)) * 0x94D049BB133111EB & mask
                return x ^ (x >> 31)

            out += f"{mix((ord(stood[step]) * 0x9E3779B97F4A7C15 & mask) ^ mix((step + 0x9E3779B97F4A7C15) & mask)) & 15:x}"
    return out


@pytest.mark.parametrize("together", [1, 4, 1000])
def test_fingerprints_are_those_of_the_definition(monkeypatch, together):
    monkeypatch.setattr(fingerprints, "TOGETHER", together)
    draw = random.Random(3)
    texts = ["", "a", "日本", *["".join(draw.choice("abcdé fgh") for _ in range(draw.randint(1, 500))) for _ in range(12)]]
    assert fingerprints.shown(fingerprints.prints(texts)) == [brute_print(t) for t in texts]
    cuts, tails = [len(t) - len(t) // 3 for t in texts], [texts[k - 1][: len(t) // 3] for k, t in enumerate(texts)]
    own, other = fingerprints.edited_prints(texts, cuts, tails)
    assert fingerprints.shown(own) == [brute_print(t) for t in texts] and fingerprints.shown(other) == [brute_print(t[:c] + tail) for t, c, tail in zip(texts, cuts, tails)]


def test_minhash_tells_links_and_overlaps(spark):
    rows = corpus(25, 6)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: r for r in minhash.near_classes(df).collect()}
    bags, words = {r[0]: bag(r[1]) for r in rows}, {r[0]: tuple((r[1] or "").split()) for r in rows}
    like = lambda a, b: sum((bags[a] & bags[b]).values()) / sum((bags[a] | bags[b]).values())
    assert all(r["copies"] == sum(w == words[i] for w in words.values()) for i, r in got.items())
    links = [(r["a"], r["b"], r["overlap"]) for r in minhash.near_links(df).collect()]
    assert links and all(o == pytest.approx(like(a, b)) and o >= 0.8 for a, b, o in links)
    assert all((r["links"] > 0) == (r["overlap"] is not None) for r in got.values())
    assert {i for i, r in got.items() if r["links"]} == {i for i in words for a, b, _ in links if words[i] in (words[a], words[b])}


def test_keep_with_null_ids_and_names_that_clash(spark):
    names = ["doc_id", "text", "meta.url", "TEXT", "h", "node", "row", "n", "c0"]
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(i, t, *["e"] * 7) for i, t in [(None, "a b c d e f"), (None, "g h i j k l"), (None, "a b c d e f"), (2**53 + 1, long), (2**53 + 3, long + " x"), (2**53 + 1, long), (5, None), (6, "")]]
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` {'bigint' if n == 'doc_id' else 'string'}" for n in names))
    kept = minhash.keep(df)
    assert kept.columns == names and Counter((r[0], r[1]) for r in kept.collect()) == Counter({(None, "a b c d e f"): 1, (None, "g h i j k l"): 1, (2**53 + 1, long): 1, (5, None): 1})
    assert fingerprints.edited(df).count() == len(rows) and suffixes.removed(df).count() == len(rows) and minhash.near_classes(df).count() == len(rows)


def test_removed_of_hot_documents_and_one_long_text(spark):
    draw = random.Random(1)
    passage = "".join(draw.choice("abcdefgh ") for _ in range(420))
    rows = [(None, passage + "tail", "s", None, "")] * 1500 + [(i, "".join(draw.choice("abcdefgh ") for _ in range(300)) + passage, "s", None, "") for i in range(4)]
    rows += [(77, "".join(draw.choice("abcdefgh ") for _ in range(400_000)) + passage[:250], "s", None, "")]
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffixes.removed(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == Counter({(None, 424, 424, 1): 1500, (77, 400_250, 250, 1): 1} | {(i, 720, 420, 1): 1 for i in range(4)})


def test_members_know_the_size_of_their_bucket(spark):
    """So that linking doesn't count and join the buckets once more."""
    banded = spark.createDataFrame([(1, [10, 20]), (2, [10, 30]), (3, [10, 20])], "node bigint, bands array<bigint>")
    wanted = [(10, 1, 3), (10, 2, 3), (10, 3, 3), (20, 1, 2), (20, 3, 2)]
    for rows, once in ((banded, True), (banded.unionByName(banded), False)):
        assert sorted(tuple(r) for r in linking.members_of(rows, once).select("bucket", "node", "n").collect()) == wanted


def _line(spark, n, seed=2):
    """Points on a line, linked within a distance of 0.02: classes() of them, but for its buckets, and the label that each point has to get."""
    import numpy as np

    draw = random.Random(seed)
    at = sorted(draw.random() for _ in range(n))
    place = spark.createDataFrame(list(enumerate(at)), "i bigint, x double")

    def verify(pairs):
        met = pairs.join(place.withColumnRenamed("i", "a").withColumnRenamed("x", "u"), "a").join(place.withColumnRenamed("i", "b").withColumnRenamed("x", "v"), "b")
        return met.withColumn("sim", 1.0 - F.abs(F.col("u") - F.col("v"))).drop("u", "v")

    def similar(data):
        x = np.array([float(d) for d in data])
        return lambda i: 1.0 - np.abs(x - x[i])

    payload = lambda nodes: place.select(F.col("i").alias("node"), F.col("x").cast("string").alias("data")).join(nodes, "node", "left_semi")
    expected = [0]
    for i in range(1, n):
        expected.append(i if at[i] - at[i - 1] > 0.02 else expected[-1])
    return lambda members, **sizes: linking.classes(members, verify, 0.98, payload, similar, **sizes), expected


def test_linking_by_chains_takes_few_stages(spark):
    """Neighbours share buckets, so heads hang on heads; two long buckets go to the blocks. The shuffles that this takes don't become more."""
    find, expected = _line(spark, 80)
    rows = [(i, j) for i in range(79) for j in (i, i + 1)] + [(1000 + i % 2, i) for i in range(80)]
    members = spark.createDataFrame(rows, "bucket bigint, node bigint")
    context, tracker = spark.sparkContext, spark.sparkContext.statusTracker()
    context.setJobGroup("linking", "")
    try:
        labels, _ = find(members, small=4)
        found = {r["node"]: r["label"] for r in labels.collect()}
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert [found.get(i, i) for i in range(80)] == expected
    stages = {s for j in tracker.getJobIdsForGroup("linking") for s in tracker.getJobInfo(j).stageIds}
    ran = [s for s in stages if (known := tracker.getStageInfo(s)) and known.numCompletedTasks]
    assert len(ran) < 142  # 130; 154 with the components of all links after each step


def test_linking_in_many_slices(spark, monkeypatch):
    """Buckets and classes of more bytes than a slice are cut into slices by place, and lose no link."""
    monkeypatch.setattr(linking, "SLICE_BLOCKS", 1)
    find, expected = _line(spark, 80)
    labels, _ = find(spark.createDataFrame([(1, i) for i in range(80)], "bucket bigint, node bigint"), small=2, block_bytes=400)
    found = {r["node"]: r["label"] for r in labels.collect()}
    assert [found.get(i, i) for i in range(80)] == expected


def test_labels_of_deep_trees(spark):
    """Each node hangs on the next one; the root is the greatest."""
    tree = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(i, 100) for i in range(101, 140)], "node bigint, up bigint")
    found = {r["node"]: r["label"] for r in linking._trees(tree).collect()}
    assert found == {i: 0 for i in range(1, 21)} | {i: 100 for i in range(101, 140)}
