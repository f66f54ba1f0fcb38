"""Merkle manifest of a dataset, with proofs by looked-up coordinates.

Leaf: digest of a row's columns. Per source, leaves stand by doc_id; every GROUP consecutive nodes become one of the next level, until one is left, the
subroot. The subroots, by source, go on likewise in a tree of their own, up to the root. Nodes are a materialised table: tree, level, place, digest.

Proofs: the place of a leaf and the size of its tree tell, without looking at any other row, which coordinates (tree, level, place) its proof needs: those of the
others in its run, then in its parent's run, and so on through the subroot's tree. The leaves of one run share all coordinates above them, so each run of
leaves explodes those once; they are joined to the node table, ordered and concatenated; each leaf then folds its own run and these, first its own digest, then
that of what it may have been tampered into.

Scale: a text is read once, and only digests move. Leaves are placed by a range sort on (source, doc_id), counted a range and offset, so a source with a third of all rows
lies in many ranges; levels group at most GROUP rows. Nodes near the root are asked for by very many runs: fewer than HOT of them are broadcast (common.meet), and all others
are merged. The number of jobs is that of the levels, a logarithm. Windows without a partition hold one row a range.

Defined results: a null in any column is `-`; null sources are a source, the first, null doc_ids come first; rows of equal doc_id stand by their leaf, and copies of a row
are leaves side by side; an empty table gives no rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loopwright.llm.common import chosen, drop, materialise, meet
from loopwright.operators.numbering import placed

#: Nodes that become one.
GROUP = 16
#: The columns of a leaf, in order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree of the subroots among the trees of the sources, which are numbered from 0.
TOP = -1
#: The table of subroots is broadcast if it has at most so many rows.
MAX_BROADCAST_SOURCES = 10_000
_PROOF = "array<struct<step:int,own:int,others:array<string>>>"
_RESULT = f"doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, proof {_PROOF}"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def encoded(value: Column) -> Column:
    """Byte count, a colon and the value; `-` for null."""
    said = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaves(rows: DataFrame, every: int = 5) -> DataFrame:
    """doc_id, source, leaf, tampered (the leaf of the lower-cased text where `every` divides the id's CRC-32, else null)."""
    leaf = lambda text: digest(*[encoded(text if c == "text" else F.col(c)) for c in COLUMNS])
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % every == 0, F.lit(False))
    return rows.select("doc_id", "source", leaf(F.col("text")).alias("leaf"), F.when(hit, leaf(F.translate("text", _UPPER, _LOWER))).alias("tampered"))


def _height(n: Column) -> Column:
    """Levels above the leaves of a tree of n leaves; n is below GROUP ** 13, so that places are exact as doubles."""
    return sum((F.when(n > GROUP**k, 1).otherwise(0) for k in range(13)), F.lit(0))


def _joined(nodes: str, field: str) -> Column:
    return F.sha2(F.array_join(F.transform(nodes, lambda x: x[field]), ""), 256)


def _ascended(first: DataFrame, level: int, most: int) -> list[DataFrame]:
    """Tables of nodes (tree, n, at, digest), a level each, from `first`, which is of `level`, to that where the largest tree, of `most` leaves, has one."""
    levels = [first]
    while GROUP**level < most:
        runs = levels[-1].where(F.col("n") > GROUP**level).groupBy("tree", "n", F.floor(F.col("at") / GROUP).alias("at")).agg(F.sort_array(F.collect_list(F.struct("at", "digest"))).alias("nodes"))
        levels.append(materialise(runs.select("tree", "n", "at", _joined("nodes", "digest").alias("digest"))))
        level += 1
    return levels


def _coordinates(tree: Column, place: Column, n: Column, from_level: int, step: Column) -> Column:
    """The coordinates of all siblings above `from_level` of what stands at `place` on it in a tree of n leaves, and the own place in each run.

    One struct a level: step (counts levels up to the root), tree, level, first (of the run), own (place in it), size (nodes in it).
    """
    levels = F.when(_height(n) > from_level, F.sequence(F.lit(from_level), _height(n) - 1)).otherwise(F.array().cast("array<int>"))

    def one(k: Column) -> Column:
        up = F.pow(F.lit(float(GROUP)), k - from_level).cast("bigint")
        own = F.floor(place / up)
        first = own - F.pmod(own, F.lit(GROUP))
        nodes = F.ceil(n / F.pow(F.lit(float(GROUP)), k).cast("bigint"))
        return F.struct((step + k - from_level).cast("int").alias("step"), tree.cast("bigint").alias("tree"), k.cast("int").alias("level"), first.cast("bigint").alias("first"), (own - first).cast("int").alias("own"), F.least(F.lit(GROUP), nodes - first).cast("int").alias("size"))

    return F.transform(levels, one)


def _others(coordinate: Column) -> Column:
    """Places of a run without the own one."""
    every = F.sequence(coordinate["first"], coordinate["first"] + coordinate["size"] - 1)
    return F.filter(every, lambda p: p != coordinate["first"] + coordinate["own"])


def manifest(docs: DataFrame, every: int = 5, **columns: str) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, and proof: a struct(step, own, others) a level. `columns` renames those of COLUMNS."""
    rows = materialise(leaves(chosen(docs, **{c: columns.get(c, c) for c in COLUMNS}), every))
    sorted_ = placed(rows, ["source", "doc_id", "leaf"])
    sources = materialise(sorted_.groupBy("source").agg(F.min("at").alias("start"), F.count("*").alias("n")))
    total, most, n_runs = sources.agg(F.count("*"), F.max("n"), F.sum(F.ceil(F.col("n") / GROUP))).first()
    if not total:
        return docs.sparkSession.createDataFrame([], _RESULT)
    trees = placed(sources, ["source"]).select("source", F.col("at").alias("tree"), "start", "n", F.col("n").alias("leaves"))
    own = meet(sorted_, trees, ["source"], "n").select("tree", F.col("leaves").alias("n"), (F.col("at") - F.col("start")).alias("at"), "doc_id", "leaf", "tampered")
    # runs of leaves: what shares all coordinates above
    leaf = F.struct(F.pmod("at", F.lit(GROUP)).cast("int").alias("own"), "leaf", "tampered", "doc_id")
    runs = materialise(own.groupBy("tree", "n", F.floor(F.col("at") / GROUP).alias("at")).agg(F.sort_array(F.collect_list(leaf)).alias("leaves")))
    # nodes above the leaves; the one leaf of a tree is its subroot
    first = runs.select("tree", "n", "at", F.when(F.col("n") > 1, _joined("leaves", "leaf")).otherwise(F.element_at("leaves", 1)["leaf"]).alias("digest"))
    levels = _ascended(materialise(first), 1, most)
    last = [nodes.where(F.greatest(_height(F.col("n")), F.lit(1)) == level) for level, nodes in enumerate(levels, 1)]
    subroots = materialise(reduce(DataFrame.unionByName, last).select("tree", "digest"))
    tops = _ascended(subroots.select(F.lit(TOP).cast("bigint").alias("tree"), F.lit(total).alias("n"), F.col("tree").alias("at"), "digest"), 0, total)
    root = tops[-1].first()["digest"]
    # the node table, with about how many runs ask for each node
    times = lambda height: F.lit(min(n_runs, (GROUP - 1) * GROUP**height) + 1).cast("bigint").alias("times")
    parts = [nodes.select("tree", F.lit(level).alias("level"), "at", "digest", times(level - 1)) for level, nodes in enumerate(levels, 1)]
    parts += [nodes.select("tree", F.lit(level).alias("level"), "at", "digest", times(len(levels) + level)) for level, nodes in enumerate(tops)]
    nodes = materialise(reduce(DataFrame.unionByName, parts))
    drop(rows, sources, *levels, *tops)
    # lookups: the coordinates of each run of leaves through both trees
    height = _height(F.col("n"))
    inner = _coordinates(F.col("tree"), F.col("at"), F.col("n"), 1, F.lit(1))
    outer = _coordinates(F.lit(TOP), F.col("tree"), F.lit(total), 0, height)
    wanted = runs.select(F.col("tree").alias("of_tree"), F.col("at").alias("of_run"), F.explode(F.concat(inner, outer)).alias("c"))
    asking = wanted.select("of_tree", "of_run", F.col("c.step").alias("step"), F.col("c.own").alias("own"), F.col("c.tree").alias("tree"), F.col("c.level").alias("level"), F.explode(F.when(F.col("c.size") > 1, _others(F.col("c")))).alias("at"))
    met = meet(asking, nodes, ["tree", "level", "at"], "times")
    looked = met.groupBy("of_tree", "of_run").agg(F.sort_array(F.collect_list(F.struct("step", "at", "digest"))).alias("found"))
    steps = F.concat(inner, outer)
    heads = subroots.select(F.col("tree").alias("t"), F.col("digest").alias("subroot"))
    together = runs.join(looked, (F.col("tree") == F.col("of_tree")) & (F.col("at") == F.col("of_run")), "left").join(F.broadcast(heads) if total <= MAX_BROADCAST_SOURCES else heads, F.col("tree") == F.col("t"))
    own_steps = F.transform(steps, lambda c: F.struct(c["step"].alias("step"), c["own"].alias("own"), F.transform(F.filter(F.coalesce("found", F.array().cast(looked.schema["found"].dataType)), lambda f: f["step"] == c["step"]), lambda f: f["digest"]).alias("others")))
    shared = together.select("n", "subroot", "leaves", own_steps.alias("above")).select("n", "subroot", "leaves", "above", F.posexplode("leaves").alias("pos", "own"))
    beside = F.transform(F.filter("leaves", lambda x: x["own"] != F.col("own.own")), lambda x: x["leaf"])
    step0 = F.when(F.col("n") > 1, F.array(F.struct(F.lit(0).alias("step"), F.col("own.own").alias("own"), beside.alias("others")))).otherwise(F.array().cast(_PROOF))
    proved = shared.select("own.doc_id", "own.leaf", "own.tampered", "subroot", F.concat(step0, "above").alias("proof"))
    whole = F.array_join(F.flatten(F.transform("proof", lambda s: s["others"])), "")
    fold = F.aggregate(
        "proof",
        F.coalesce("tampered", "leaf"),
        lambda acc, s: F.sha2(F.concat(F.array_join(F.slice(s["others"], F.lit(1), s["own"]), ""), acc, F.array_join(F.slice(s["others"], s["own"] + 1, F.lit(GROUP)), "")), 256),
    )
    folded = proved.select("doc_id", "leaf", "subroot", F.lit(root).alias("root"), F.sha2(whole, 256).alias("proof_sha256"), fold.alias("folded_root"), "proof")
    return folded.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), "proof")


__all__ = ["COLUMNS", "GROUP", "digest", "encoded", "leaves", "manifest"]
