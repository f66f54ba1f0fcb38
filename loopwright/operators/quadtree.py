"""Cells that adapt to where points are, and the k nearest neighbours found through them.

Tree: each area's square is cut into 16, again and again, where it holds more than a leaf's places; the counts of all depths come from one grouped sum. Points at one
place are one place with its k + 1 least identifiers, for no other of them can be among the k nearest of anybody.

Search: boxes of one depth meet boxes of the same depth, from the square down. A box's reach is a distance within which it surely has k others, told by the counts
and farthest corners of the boxes it meets; boxes beyond the reach are dropped, the others are cut. A leaf that still meets boxes that can be cut falls into its
places, so that a place beside a town meets the town's near edge alone, and not all that some corner of a wide leaf may reach. Places of other leaves drop boxes by their own
reach at the end.

Scale: every join has the key of a box, which bounds its rows; no area, and no spot of it, is one task. Rounds are half the tree's depth, at most DEPTH / 2.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loopwright.checkpoints import drop, written
from loopwright.operators.joins import meet

#: Halvings of the square; a box at this depth isn't cut.
DEPTH = 26
STEP = 2
#: Rounds whose plans are put together before a table is written.
TOGETHER = 3


def _box_id(level: Column, cx: Column, cy: Column) -> Column:
    return F.shiftleft(level.cast("bigint"), 2 * DEPTH).bitwiseOR(F.shiftleft(cx, DEPTH)).bitwiseOR(cy)


def _squares(points: DataFrame) -> DataFrame:
    """area, x0, y0, span, n: the square of each area's points, and their number."""
    ends = points.groupBy("area").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.count("*").alias("n"))
    span = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    return ends.select("area", "x0", "y0", (span * 1.0000001 + F.greatest(F.abs("x0"), F.abs("y0")) * 1e-12 + 1e-12).alias("span"), "n")


def _places(points: DataFrame, others: DataFrame, k: int) -> DataFrame:
    """A row a place: area, x, y, the cell at full depth, the square, asked (somebody asks from here), ids (the k + 1 least of the others here)."""
    asked = points.select("area", "x", "y").distinct().select("area", "x", "y", F.lit(True).alias("asked"), F.lit(None).cast(f"array<{others.schema['h'].dataType.simpleString()}>").alias("ids"))
    turn = F.row_number().over(Window.partitionBy("area", "x", "y").orderBy("h"))
    least = others.select("area", "x", "y", "h").withColumn("turn", turn).where(F.col("turn") <= k + 1)
    held = least.groupBy("area", "x", "y").agg(F.sort_array(F.collect_list("h")).alias("ids")).select("area", "x", "y", F.lit(False).alias("asked"), "ids")
    both = asked.unionByName(held).where(F.col("x").isNotNull() & F.col("y").isNotNull()).groupBy("area", "x", "y").agg(F.bool_or("asked").alias("asked"), F.max("ids").alias("ids"))
    squares = written(_squares(points.select("area", "x", "y").unionByName(others.select("area", "x", "y")).where(F.col("x").isNotNull() & F.col("y").isNotNull())))
    cell = lambda c, low: F.least(F.floor((F.col(c) - F.col(low)) / F.col("span") * float(1 << DEPTH)), F.lit((1 << DEPTH) - 1)).cast("bigint")
    met = meet(both, squares, ["area"], "n")
    return met.select("area", "x", "y", "asked", F.coalesce(F.size("ids"), F.lit(0)).alias("m"), "ids", cell("x", "x0").alias("cx"), cell("y", "y0").alias("cy"), "x0", "y0", "span")


def _at(level: int) -> Column:
    down = DEPTH - level
    return F.struct(F.lit(level).alias("level"), F.shiftright("cx", down).alias("cx"), F.shiftright("cy", down).alias("cy"))


def _tree(places: DataFrame, leaf: int) -> DataFrame:
    """Boxes: area, id, up (the box it was cut from), level, is_leaf, n (others in it, at most k + 1 a place), asks, x, y (low corner), w."""
    each = places.select("area", "m", "asked", "x0", "y0", "span", F.explode(F.array(*[_at(level) for level in range(0, DEPTH + 1, STEP)])).alias("b")).select("area", "m", "asked", "x0", "y0", "span", "b.*")
    boxes = each.groupBy("area", "level", "cx", "cy").agg(F.count("*").alias("here"), F.sum("m").cast("bigint").alias("n"), F.bool_or("asked").alias("asks"), F.first("x0").alias("x0"), F.first("y0").alias("y0"), F.first("span").alias("span"))
    width = F.col("span") / F.pow(F.lit(2.0), F.col("level"))
    up = F.when(F.col("level") > 0, _box_id(F.col("level") - STEP, F.shiftright("cx", STEP), F.shiftright("cy", STEP)))
    error = F.col("span") * 1e-14 + (F.abs("x0") + F.abs("y0") + F.col("span")) * 1e-15
    boxes = boxes.select("area", error.alias("e"), _box_id(F.col("level"), F.col("cx"), F.col("cy")).alias("id"), up.alias("up"), "level", "here", "n", "asks", (F.col("x0") + F.col("cx") * width).alias("x"), (F.col("y0") + F.col("cy") * width).alias("y"), width.alias("w"))
    cut = boxes.where((F.col("here") > leaf) & (F.col("level") < DEPTH)).select(F.col("area").alias("a"), F.col("id").alias("i"))
    alive = boxes.join(cut, (F.col("area") == F.col("a")) & (F.col("up") == F.col("i")), "left_semi").unionByName(boxes.where("level = 0"))
    tree = written(alive.withColumn("is_leaf", (F.col("here") <= leaf) | (F.col("level") == DEPTH)).drop("here"))
    return tree


def _dealt(places: DataFrame, tree: DataFrame, depth: int) -> DataFrame:
    """area, x, y, asked, ids, leaf: each place with its leaf."""
    leaves = tree.where("is_leaf").select(F.col("area").alias("la"), F.col("id").alias("li"))
    at = F.array(*[_box_id(*[_at(level)[c] for c in ("level", "cx", "cy")]) for level in range(0, depth + 1, STEP)])
    each = places.withColumn("leaf", F.explode(at))
    return each.join(leaves, (F.col("area") == F.col("la")) & (F.col("leaf") == F.col("li")), "left_semi").select("area", "x", "y", "asked", "ids", "leaf")


def _gap(p: str, q: str, c: str) -> Column:
    """Least distance between two boxes along an axis."""
    return F.greatest(F.col(f"{p}{c}") - F.col(f"{q}{c}") - F.col(f"{q}w"), F.col(f"{q}{c}") - F.col(f"{p}{c}") - F.col(f"{p}w"), F.lit(0.0))


def _stretch(p: str, q: str, c: str) -> Column:
    return F.greatest(F.col(f"{p}{c}") + F.col(f"{p}w") - F.col(f"{q}{c}"), F.col(f"{q}{c}") + F.col(f"{q}w") - F.col(f"{p}{c}"))


def _length(a: Column, b: Column) -> Column:
    return F.sqrt(a * a + b * b)


def _slack(reach: Column) -> Column:
    """Cells come from divisions: corners may be off by a hair."""
    return reach * (1 + 1e-9) + F.col("p_e")


def _reached(pairs: DataFrame, k: int) -> DataFrame:
    """The pairs within the reach of their p, and `open`: whether p meets boxes that can be cut."""
    far = _length(_stretch("p_", "q_", "x"), _stretch("p_", "q_", "y"))
    near = _length(_gap("p_", "q_", "x"), _gap("p_", "q_", "y"))
    own = Window.partitionBy("p_area", "p_id", "p_x", "p_y")
    kept = [c for c in pairs.columns if c not in ("open", "reach")]
    met = pairs.select(*kept, "reach", near.alias("near"), far.alias("far")).where("near <= reach")
    summed = met.select("*", F.sum("q_n").over(own.orderBy("far", "q_id")).alias("sure"))
    sure = F.min(F.when(F.col("sure") > k, F.col("far"))).over(own)
    judged = summed.select(*kept, "near", F.least("reach", _slack(F.coalesce(sure, F.lit(float("inf"))))).alias("reach")).where("near <= reach")
    return judged.select(*kept, "reach", F.max(~F.col("q_is_leaf")).over(own).alias("open"))


_PARTS = "array<struct<id:bigint,is_leaf:boolean,n:bigint,x:double,y:double,w:double>>"
_SIDE = ("area", "id", "is_leaf", "x", "y", "w")


def _parts(tree: DataFrame, own: Column) -> DataFrame:
    """area, up, parts: what each box is cut into, at most 16 boxes."""
    return tree.where(own & F.col("up").isNotNull()).groupBy(F.col("area").alias("a"), F.col("up").alias("u")).agg(F.collect_list(F.struct("id", "is_leaf", "n", "x", "y", "w")).alias("parts"))


def _pairs(tree: DataFrame, dealt: DataFrame, depth: int, k: int) -> DataFrame:
    """p_*, q_*: leaves with somebody who asks, or single places of them (p_w is 0), and the leaves that may hold some of the k nearest."""
    # the first boxes, at most 16 an area, all meet
    first = tree.where((F.col("level") == STEP) | ((F.col("level") == 0) & F.col("is_leaf")))
    named = lambda p: [F.col(c).alias(f"{p}{c}") for c in _SIDE]
    pairs = first.where("asks").select(*named("p_"), F.col("e").alias("p_e")).join(first.where("n > 0").select(*named("q_"), F.col("n").alias("q_n")), F.col("p_area") == F.col("q_area"))
    pairs = _reached(pairs.select("*", F.lit(float("inf")).alias("reach"), F.lit(True).alias("open")), k)
    place = F.struct(F.col("leaf").alias("id"), F.lit(True).alias("is_leaf"), F.lit(0).cast("bigint").alias("n"), "x", "y", F.lit(0.0).alias("w"))
    before = None

    def fallen(rows: DataFrame, parts: DataFrame, p: str, which: Column) -> DataFrame:
        """Rows whose box of the side p falls into parts, one a part; the others stay."""
        own = F.struct(*[F.col(f"{p}{c}").alias(c) if c != "n" or p == "q_" else F.lit(0).cast("bigint").alias("n") for c in ("id", "is_leaf", "n", "x", "y", "w")])
        met = rows.join(parts, which & (F.col(f"{p}area") == F.col("a")) & (F.col(f"{p}id") == F.col("u")), "left").select(*rows.columns, F.explode(F.when(which, F.coalesce("parts", F.array().cast(_PARTS))).otherwise(F.array(own))).alias("part"))
        new = {f"{p}{c}": F.col(f"part.{c}") for c in ("id", "is_leaf", "x", "y", "w")} | ({"q_n": F.col("part.n")} if p == "q_" else {})
        return met.select(*[new.get(c, F.col(c)).alias(c) for c in rows.columns])

    for level in range(STEP, depth, STEP):
        # wide leaves beside boxes that can be cut fall into their places: leaves of this depth, for those before have fallen; then boxes are cut
        single = dealt.where(F.col("asked") & (F.shiftright("leaf", 2 * DEPTH) == level)).groupBy(F.col("area").alias("a"), F.col("leaf").alias("u")).agg(F.collect_list(place).alias("parts"))
        below = tree.where(F.col("level") == level + STEP)
        pairs = fallen(pairs, single, "p_", F.col("p_is_leaf") & F.col("open") & (F.col("p_w") > 0))
        pairs = fallen(pairs, _parts(below, F.col("asks")), "p_", ~F.col("p_is_leaf"))
        pairs = _reached(fallen(pairs, _parts(below, F.col("n") > 0), "q_", ~F.col("q_is_leaf")), k)
        if (level // STEP) % TOGETHER == TOGETHER - 1:
            pairs = written(pairs)
            if before is not None:
                drop(before)
            before = pairs
    return pairs


def nearest(points: DataFrame, k: int, others: DataFrame | None = None) -> DataFrame:
    """area, h, j, d, rank: the k nearest others (area, h, x, y; else the points themselves) of each point, by distance, then by j.

    A point is never its own neighbour. Points and others without coordinates have and are none; points that share an identifier and a place count once as others.
    """
    others = points if others is None else others
    places = written(_places(points, others.select("area", "h", "x", "y").distinct(), k))
    tree = _tree(places, 2 * (k + 1))
    depth = tree.agg(F.max("level")).first()[0] or 0
    dealt = written(_dealt(places, tree, depth))
    pairs = _pairs(tree, dealt, depth, k)
    box = F.struct(F.col("q_id").alias("id"), F.col("q_n").alias("n"), F.col("q_x").alias("x"), F.col("q_y").alias("y"), F.col("q_w").alias("w"))
    around = pairs.groupBy("p_area", "p_id", "p_x", "p_y").agg(F.collect_list(box).alias("boxes"), F.first("p_w").alias("p_w"), F.first("p_e").alias("p_e"))
    asking = dealt.where("asked").select("area", "x", "y", "leaf").join(around, (F.col("area") == F.col("p_area")) & (F.col("leaf") == F.col("p_id"))).where("p_w > 0 or (x = p_x and y = p_y)")
    axis = lambda b, c: (F.greatest(b[c] - F.col(c), F.col(c) - b[c] - b["w"], F.lit(0.0)), F.greatest(F.col(c) - b[c], b[c] + b["w"] - F.col(c)))
    judged = F.transform("boxes", lambda b: F.struct(_length(axis(b, "x")[1], axis(b, "y")[1]).alias("far"), _length(axis(b, "x")[0], axis(b, "y")[0]).alias("near"), b["n"].alias("n"), b["id"].alias("id")))
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(float("inf")).alias("reach"))
    reach = F.aggregate(F.array_sort("boxes"), start, lambda s, b: F.struct((s["n"] + b["n"]).alias("n"), F.when((s["n"] <= k) & (s["n"] + b["n"] > k), b["far"]).otherwise(s["reach"]).alias("reach")))["reach"]
    wanted = asking.withColumn("boxes", judged).withColumn("reach", _slack(reach)).select("area", "x", "y", F.explode(F.transform(F.filter("boxes", lambda b: b["near"] <= F.col("reach")), lambda b: b["id"])).alias("box"))
    there = dealt.where("ids is not null").select(F.col("area").alias("oa"), F.col("x").alias("ox"), F.col("y").alias("oy"), "ids", F.col("leaf").alias("oleaf"))
    dx, dy = F.col("x") - F.col("ox"), F.col("y") - F.col("oy")
    met = wanted.join(there, (F.col("area") == F.col("oa")) & (F.col("box") == F.col("oleaf"))).select("area", "x", "y", _length(dx, dy).alias("d"), F.explode("ids").alias("j"))
    turn = F.row_number().over(Window.partitionBy("area", "x", "y").orderBy("d", "j"))
    # of each place k + 1: who asks may be among them
    lists = met.withColumn("turn", turn).where(F.col("turn") <= k + 1).groupBy("area", "x", "y").agg(F.sort_array(F.collect_list(F.struct("d", "j"))).alias("list"))
    own = points.select("area", "h", "x", "y").join(lists.select(F.col("area").alias("la"), F.col("x").alias("lx"), F.col("y").alias("ly"), "list"), (F.col("area") == F.col("la")) & (F.col("x") == F.col("lx")) & (F.col("y") == F.col("ly")))
    rest = F.slice(F.filter("list", lambda e: e["j"] != F.col("h")), 1, k)
    return own.select("area", "h", F.posexplode(rest).alias("pos", "e")).select("area", "h", "e.j", "e.d", (F.col("pos") + 1).alias("rank"))
