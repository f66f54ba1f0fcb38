"""Classes of linked items, from buckets of items that may be alike, without pairing off any bucket.

Each bucket has a head, the member that shares most buckets with others. First every node is verified against one head, the greatest of its
buckets; copies of one text, light edits included, are thus one class after one pass that is linear in the nodes. Then members of other
classes than their bucket's head are verified against it. Buckets that still hold several
classes are worked through whole, so that no link is lost: small ones as pairs of members of different classes (at
most SMALL - 1 for a member), larger ones in blocks of bounded size. A task meets two blocks; it gives a link for each two
classes that it joins, never its pairs. Blocks are cut along classes, and two blocks of one and the same class don't meet. That is
quadratic in the blocks of a large bucket of many classes: the price of losing no link.

Everything is a DataFrame; steps are tables in the shared folder, and go when all that reads them is written. Steps are kept short: the driver plans
a query anew after each of its shuffles, and holds all its stages meanwhile. Rows of a hot bucket
stay where they are (common.meet), and blocks are cut by sizes alone, in slices of a bounded size, before the payload comes.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loopwright.llm.common import components, drop, materialise, meet, stars

#: Buckets of at most so many members are paired off.
SMALL = 16
#: Bytes of payload in a block.
BLOCK_BYTES = 2 << 20


#: Blocks of a slice, about; a slice is what a window numbers.
SLICE_BLOCKS = 64


def _blocks(rows: DataFrame, block_bytes: int) -> DataFrame:
    """bucket, node, label, block of rows (bucket, node, label, bytes), as a table: labels lie together, as far as they fit a slice."""
    slice_bytes = SLICE_BLOCKS * block_bytes
    sized, slice_ = rows, F.lit(0)
    # few: each has a slice's bytes at least
    large = materialise(rows.groupBy("bucket").agg(F.sum("bytes").alias("all")).where(F.col("all") >= slice_bytes))
    if not large.isEmpty():
        wide = rows.groupBy("bucket", "label").agg(F.sum("bytes").alias("own")).where(F.col("own") >= slice_bytes)
        sized = rows.join(F.broadcast(large), "bucket", "left").join(F.broadcast(wide), ["bucket", "label"], "left")
        piece = F.pmod(F.xxhash64("node"), F.floor(F.coalesce("own", F.lit(0)) / slice_bytes) + 1)
        slice_ = F.pmod(F.xxhash64("label", piece), F.floor(F.coalesce("all", F.lit(0)) / slice_bytes) + 1)
    sliced = sized.withColumn("slice", slice_)
    rank = Window.partitionBy("bucket", "slice").orderBy("label", "node").rowsBetween(Window.unboundedPreceding, 0)
    cut = materialise(sliced.select("bucket", "node", "label", F.concat_ws(":", F.col("slice").cast("string"), F.floor(F.sum("bytes").over(rank) / block_bytes).cast("string")).alias("block")))
    drop(large)
    return cut


def _block_links(open_: DataFrame, payload: DataFrame, similar: Callable, threshold: float, block_bytes: int) -> DataFrame:
    """a, b, sim, x, y: links that join classes, found in the buckets' blocks, and the labels of their ends. `open_` has bucket, node, label."""
    sizes = payload.select("node", (F.octet_length(F.col("data").cast("binary")) + 64).alias("bytes"))
    rows = materialise(open_.select("bucket", "node", "label").join(sizes, "node"))
    cut = _blocks(rows, block_bytes)
    drop(rows)
    blocks = cut.groupBy("bucket", "block").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    left, right = (blocks.select("bucket", F.col("block").alias(x), F.col("low").alias(f"low_{x}"), F.col("high").alias(f"high_{x}")) for x in ("i", "j"))
    met = left.join(right, "bucket").where((F.col("i") <= F.col("j")) & ((F.col("low_i") < F.col("high_j")) | (F.col("low_j") < F.col("high_i"))))
    sides = materialise(met.select("bucket", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block")))
    dealt = sides.join(cut, ["bucket", "block"]).join(payload.select("node", F.col("data").cast("binary").alias("data")), "node")
    kind = open_.schema["node"].dataType.simpleString()

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        own = group.reset_index(drop=True)
        _, label = np.unique(own["label"].map(bytes if own["label"].dtype == object and not isinstance(own["label"].iloc[0], str) else (lambda x: x)), return_inverse=True)
        alike, block = similar(list(own["data"])), own["block"].to_numpy()
        apart = own["i"].iloc[0] != own["j"].iloc[0]
        main = np.bincount(label).argmax()
        found = []
        for at in np.flatnonzero(label != main):
            sims = alike(at)
            near = (sims >= threshold) & (label != label[at])
            if apart:
                near &= block != block[at]
            for other in np.flatnonzero(near):
                if label[other] != label[at]:
                    found.append((own["node"][at], own["node"][other], float(sims[other]), own["label"][at], own["label"][other]))
                    label[label == label[at]] = label[other]
        return pd.DataFrame(found, columns=["a", "b", "sim", "x", "y"])

    return dealt.groupBy("bucket", "i", "j").applyInPandas(joined, f"a {kind}, b {kind}, sim double, x {kind}, y {kind}")


def members_of(banded: DataFrame, once: bool = False) -> DataFrame:
    """bucket, node, each once, and n, the bucket's nodes, of the buckets that several nodes share.

    `banded` has node, bands (array of bucket numbers); `once` says that each node is in one row, which names no bucket twice.
    """
    each = (lambda rows: rows) if once else DataFrame.distinct
    bands = banded.select(F.explode("bands").alias("bucket"), "node")
    shared = materialise(each(bands).groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
    members = materialise(each(meet(bands, shared.withColumn("rows", F.col("n")), ["bucket"], "rows", merged=True)))
    drop(shared)
    return members


def classes(members: DataFrame, verify: Callable[[DataFrame], DataFrame], threshold: float, payload: Callable[[DataFrame], DataFrame], similar: Callable, small: int = SMALL, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """(node, label) of the nodes, and the links (a, b, sim) that were verified, which hold the classes together.

    A label is the least node of a class; this node itself and nodes without a link have no row.
    `members` has distinct rows of bucket, node, and n, the nodes of the bucket, where known as by members_of(). verify() adds sim to pairs (a, b), whose other columns stay. payload(nodes) has node, data (any bytes) of those nodes; similar(list of
    data) gives a function that tells the similarities of its item number i to all items.
    """
    crowded = members
    if "n" not in members.columns:
        sizes = materialise(members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
        crowded = materialise(meet(members, sizes.withColumn("rows", F.col("n")), ["bucket"], "rows"))
        drop(sizes)
    weight = crowded.groupBy("node").agg(F.sum("n").alias("w"))
    heads = materialise(crowded.join(weight, "node").groupBy("bucket").agg(F.min(F.struct((-F.col("w")).alias("w"), "node")).alias("first"), F.count("*").alias("rows")).select("bucket", "rows", F.col("first.node").alias("head"), F.col("first.w").alias("w")))
    headed = materialise(meet(crowded, heads, ["bucket"], "rows"))
    if crowded is not members:
        drop(crowded)
    # the greatest head of a node, and its others; a node has no more heads than bands
    led = headed.where("node <> head").groupBy("node").agg(F.min(F.struct("w", "head"))["head"].alias("a"), F.collect_set("head").alias("heads"))
    led = materialise(led.select(F.col("node").alias("b"), "a", F.filter("heads", lambda h: h != F.col("a")).alias("others")))
    first = materialise(verify(led.select("a", "b")).select("a", "b", "sim"))
    labels = _trees(first.where(F.col("sim") >= threshold).select(F.col("b").alias("node"), F.col("a").alias("up")))
    # heads of other classes
    others = _labelled(led.where(F.size("others") > 0).select(F.col("b").alias("node"), "others"), labels)
    pairs = _labelled(others.select(F.col("node").alias("b"), F.col("label").alias("y"), F.explode("others").alias("node")), labels)
    apart = materialise(pairs.where("label <> y").select(F.col("node").alias("a"), "b", F.col("label").alias("x"), "y"))
    second = materialise(verify(apart).where(F.col("sim") >= threshold))
    drop(led, apart)
    links = first.where(F.col("sim") >= threshold).unionByName(second.select("a", "b", "sim"))
    if not second.isEmpty():
        labels = materialise(_merged(labels, second))
    # buckets that hold several classes
    named = materialise(_labelled(headed.where("n > 2"), labels))
    several = materialise(named.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("rows")).where("x < y").select("bucket", "rows"))
    open_ = materialise(meet(named, several, ["bucket"], "rows").select("bucket", "node", "label", "head", "n"))
    drop(headed, heads, named, several)
    few = open_.where(F.col("n") <= small).select("bucket", "node", "label", "head")
    other = few.select("bucket", F.col("node").alias("b"), F.col("label").alias("other"))
    # members of another class than the head have been judged against it
    left = few.where("node <> head").join(other, "bucket").where((F.col("node") < F.col("b")) & (F.col("label") != F.col("other")) & (F.col("b") != F.col("head")))
    more = materialise(verify(left.select(F.col("node").alias("a"), "b", F.col("label").alias("x"), F.col("other").alias("y")).distinct()).where(F.col("sim") >= threshold).select("a", "b", "sim", "x", "y"))
    many = open_.where(F.col("n") > small)
    if many.limit(1).count():
        more = more.unionByName(materialise(_block_links(many, payload(many.select("node").distinct()), similar, threshold, block_bytes)))
    drop(open_)
    return labels if more.isEmpty() else _merged(labels, more), links.unionByName(more.select("a", "b", "sim"))


def verified_schema(pairs: DataFrame) -> str:
    return ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema], "sim double"])


def _trees(tree: DataFrame) -> DataFrame:
    """node, label as classes() gives them, of trees: each node in one row, with the one that it hangs on. Each round halves the depth."""
    while True:
        above = tree.select(F.col("node").alias("up"), F.col("up").alias("top"))
        new = materialise(tree.select("node", "up").join(above, "up", "left").select("node", F.coalesce("top", "up").alias("up"), "top"))
        drop(tree)
        tree = new
        if tree.where("top is not null").isEmpty():
            break
    roots = materialise(tree.groupBy("up").agg(F.least(F.min("node"), "up").alias("label"), F.count("*").alias("n")))
    hung = meet(tree, roots, ["up"], "n").select("node", "label").unionByName(roots.select(F.col("up").alias("node"), "label"))
    labels = materialise(hung.where("node <> label"))
    drop(tree, roots)
    return labels


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels once links between them (x, y) have joined classes."""
    moved = stars(links.select(F.col("x").alias("a"), F.col("y").alias("b")))
    return labels.join(moved.select(F.col("node").alias("label"), F.col("label").alias("least")), "label", "left").select("node", F.coalesce("least", "label").alias("label")).unionByName(moved)


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds label to rows with a node."""
    return rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def linked(labels: DataFrame, links: DataFrame) -> DataFrame:
    """node, label, links, likest: of each node with a link its class, the number of its verified links and the greatest of their similarities."""
    both = links.select(F.col("a").alias("node"), "sim").unionByName(links.select(F.col("b").alias("node"), "sim"))
    each = both.groupBy("node").agg(F.count("*").alias("links"), F.max("sim").alias("likest"))
    return _labelled(each, labels)
