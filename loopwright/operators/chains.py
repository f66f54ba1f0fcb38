"""Order along chains: list ranking by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopwright.checkpoints import drop, written
from loopwright.operators.graph import ends_of


def ranked(items: DataFrame) -> DataFrame:
    """item, last, after, metres: of a forest of lists (item, next or null, metres): the list's last item, how many items follow, and the metres from here to the end, the own ones included.

    Each round every item looks as far ahead as all before together: a list of n items takes log2(n) joins, and no list is gathered.
    """
    state = written(items.select("item", F.coalesce("next", "item").alias("to"), F.when(F.col("next").isNull(), 0).otherwise(1).cast("bigint").alias("after"), F.when(F.col("next").isNull(), F.lit(0.0)).otherwise(F.col("metres")).alias("ahead"), F.col("next").isNull().alias("done")))
    while not state.where("not done").isEmpty():
        far = state.select(F.col("item").alias("f"), F.col("to").alias("f_to"), F.col("after").alias("f_after"), F.col("ahead").alias("f_ahead"), F.col("done").alias("f_done"))
        # lists that have ended stay out of the join
        open_ = state.where("not done").join(far, F.col("to") == F.col("f"))
        moved = open_.select("item", F.col("f_to").alias("to"), (F.col("after") + F.col("f_after")).alias("after"), (F.col("ahead") + F.col("f_ahead")).alias("ahead"), F.col("f_done").alias("done"))
        new = written(state.where("done").unionByName(moved))
        drop(state)
        state = new
    tail = items.select(F.col("item").alias("t"), F.col("metres").alias("tail"))
    return state.join(tail, F.col("to") == F.col("t")).select("item", F.col("to").alias("last"), "after", (F.col("ahead") + F.col("tail")).alias("metres"))


def along(edge_table: DataFrame, segment_table: DataFrame) -> DataFrame:
    """area, edge, segment, place, start_m, a_first: where each edge lies in its chain of edges (graph.segments).

    Places count from 0 and metres from the chain's start, its lesser end node; in a closed chain its least node, from which it goes along the lesser of the edges there.
    a_first: whether the edge is walked from a to b. A chain whose both ends are one node, or an edge that leads to itself, starts with the lesser edge there.
    """
    own = written(edge_table.join(segment_table.select("area", "edge", "segment"), ["area", "edge"]).select("area", "edge", "a", "b", "length", "segment"))
    ends = ends_of(own.withColumn("street", F.lit(None).cast("string"))).select("area", "node", "other", "edge", "length").join(own.select("area", "edge", "segment"), ["area", "edge"])
    met = ends.groupBy("area", "segment", "node").agg(F.count("*").alias("n"), F.min("edge").alias("x"), F.max("edge").alias("y"))
    tips = met.groupBy("area", "segment").agg(F.min(F.when(F.col("n") != 2, F.col("node"))).alias("tip"), F.min("node").alias("least"))
    cut = tips.select("area", "segment", F.coalesce("tip", "least").alias("start"), F.col("tip").isNull().alias("closed"))
    joints = met.where("n = 2 and x <> y").join(cut, ["area", "segment"]).where("not closed or node <> start").select("area", F.col("node").alias("joint"), "segment", "x", "y")
    # an edge has two ways through it; each leads to the way that leaves the joint by the other edge
    way = lambda edge, to: F.struct(F.col("area").alias("area"), F.col(edge).alias("edge"), F.col(to).alias("to"))
    out = ends.select("area", "edge", F.col("node").alias("from"), F.col("other").alias("to"), "length", "segment")
    across = out.join(joints.select(F.col("area").alias("ja"), F.col("joint").alias("j"), F.col("segment").alias("js"), "x", "y"), (F.col("area") == F.col("ja")) & (F.col("to") == F.col("j")) & (F.col("segment") == F.col("js")), "left")
    beyond = F.when(F.col("edge") == F.col("x"), F.col("y")).otherwise(F.col("x"))
    stepped = across.select("area", "edge", "from", "to", "length", "segment", F.when(F.col("j").isNotNull(), beyond).alias("next_edge"))
    leave = ends.select(F.col("area").alias("la"), F.col("edge").alias("le"), F.col("node").alias("lf"), F.col("other").alias("lt"))
    linked = stepped.join(leave, (F.col("area") == F.col("la")) & (F.col("next_edge") == F.col("le")) & (F.col("to") == F.col("lf")), "left")
    items = written(linked.select(way("edge", "to").alias("item"), F.when(F.col("le").isNotNull(), F.struct(F.col("area").alias("area"), F.col("le").alias("edge"), F.col("lt").alias("to"))).alias("next"), F.col("length").alias("metres"), "segment"))
    found = ranked(items)
    # walked towards the start: what is ahead is what lies before
    back = found.select(F.col("item.area").alias("area"), F.col("item.edge").alias("edge"), F.col("item.to").alias("toward"), F.col("last.to").alias("end"), F.col("last.edge").alias("first_edge"), "after", "metres")
    of = back.join(own, ["area", "edge"]).join(cut, ["area", "segment"]).where(F.col("end") == F.col("start"))
    # both directions of a closed chain end at its start: the one that ends with the lesser edge there is meant
    rank = F.struct("first_edge", F.col("toward"))
    best = of.groupBy("area", "edge", "segment").agg(F.min(F.struct(rank.alias("r"), "after", "metres", "toward", "a", "length")).alias("m"))
    return best.select("area", "edge", "segment", F.col("m.after").alias("place"), (F.col("m.metres") - F.col("m.length")).alias("start_m"), (F.col("m.toward") == F.col("m.a")).alias("a_first"))
