"""Mixing sources to target weights by weighted fair queueing.

Every document gets a virtual finish time: the tokens of its source up to and with it, in a shuffled order, over
the source's target. A document comes round again after its whole source has passed, up to the repeat limit. All
passes together are sorted by finish time and cut where the budget is spent: near virtual time 1, at which
each source has given just its target.

Targets: each source gets its weight's share of the budget; what exceeds the repeat limit times its size goes to
the others by weight, until none is above (water-filling, in closed form over the sources in order of limit by weight).

Scale: neither sort meets in one task. The shuffled order is a hash of seed, doc_id and text; rows that agree in it are copies and are
counted, not listed, so that copies of one row are one place in the queue however many they are. Running sums are taken over the digits of
the hash, three at a time: a window never has more than 4,096 rows of sums, or the few rows of a finest bucket. The global cut is found in slots of
finish time, 4,096 and then 4,096 inside the one that the budget ends in; only the copies inside the last slot are sorted row by row. A place
tells how many of its copies fall into a slot by division, without listing them. A source with a third of all
rows is thus spread over all tasks. Only DataFrame functions are used. Windows without a partition hold one row a source, or one a slot.

Defined results: null texts and texts without words have size 0 and are taken never; a null source is a source,
last in order; repeated rows, and rows of a null doc_id with equal texts, are copies of one place: the cut may fall between them, and which of them are
taken then is arbitrary; an empty table gives no rows; ties of finish time are broken by source, pass and hash; extra columns,
whatever their names, are ignored by the report and kept in the mix. Reruns agree: the order comes from doc_id, text and the seed alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loopwright.llm.common import SPACE_CHARS, chosen, drop, materialise, text_or_empty, unpacked, with_row

#: Rows that a bucket of a running sum holds on average.
ROWS_PER_BUCKET = 4096
#: Slots that finish time is cut into, twice.
SLOTS = 4096
#: Hexadecimal digits of the order that one window goes over: 4,096 values.
DIGITS = 3
#: The table of sources is broadcast if it has at most so many rows.
MAX_BROADCAST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    """Number of words, without building them."""
    spaced = F.translate(text, SPACE_CHARS, " " * len(SPACE_CHARS))
    # a word starts where a character other than space stands first or after a space
    return F.regexp_count(spaced, F.lit("[^ ]+")).cast("bigint")


def source_targets(sums: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), share: float = 1.0, repeats: int = 3) -> DataFrame:
    """source, rank, source_size, weight, target: one row a source, of rows (source, source_size)."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sums.withColumn("rank", F.row_number().over(by_name))
    weighed = ranked.withColumn("weight", F.element_at(cycle, F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1))
    limit = F.col("source_size") * float(repeats)
    everything = Window.partitionBy()
    # sources reach their limits in the order of limit over weight
    rising = Window.orderBy((limit / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) * share - F.coalesce(F.sum(limit).over(before), F.lit(0.0))) / F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing))
    open_level = F.when(level * F.col("weight") < limit, level)
    # the level that holds is that of the first source that stays under its limit
    first_open = F.first(open_level, ignorenulls=True).over(rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    leveled = weighed.withColumn("level", first_open)
    target = F.when(F.col("level").isNull(), limit).otherwise(F.least(limit, F.col("level") * F.col("weight")))
    return leveled.select("source", "rank", "source_size", "weight", target.alias("target"))


def _order(seed: int) -> Column:
    """The place of a row (doc_id, text): equal for copies only."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.col("text"))))


def _starts(sums: DataFrame, digits: int) -> DataFrame:
    """rank, bucket, start: what the buckets before it hold, of rows (rank, bucket, n) with `digits` digits each."""
    if digits <= DIGITS:
        before = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        return sums.select("rank", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    parent = F.substring("bucket", 1, digits - DIGITS)
    above = _starts(sums.groupBy("rank", parent.alias("bucket")).agg(F.sum("n").alias("n")), digits - DIGITS).withColumnRenamed("bucket", "parent").withColumnRenamed("start", "base")
    before = Window.partitionBy("rank", "parent").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    own = sums.withColumn("parent", parent).withColumn("within", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return own.join(above, ["rank", "parent"]).select("rank", "bucket", (F.col("base") + F.col("within")).alias("start"))


def _finish(copy: Column) -> Column:
    """Virtual finish time of a place's copy (from 1)."""
    return (F.col("base") + copy * F.col("size")) / F.col("target")


def _copies_until(time: Column | float) -> Column:
    """How many copies of a place finish at or before a time. The quotient may be off by one, which is mended by the times themselves."""
    at = F.lit(time) if isinstance(time, float) else time
    k = F.greatest(F.lit(0).cast("bigint"), F.least(F.col("copies"), F.floor((at * F.col("target") - F.col("base")) / F.col("size"))))
    up = F.when((k < F.col("copies")) & (_finish(k + 1) <= at), k + 1).otherwise(k)
    return F.when((k > 0) & (_finish(k) > at), k - 1).otherwise(up)


def queue(slim: DataFrame, targets: DataFrame, repeats: int, digits: int) -> DataFrame:
    """rank, pass, order, size, copies, base, target: the places of the queue. `base` is what the source has given before the place."""
    ranks = targets.where("target > 0").select(F.col("source").alias("s"), "rank", "source_size", "target")
    places = slim.where("size > 0").join(_broadcast(ranks), F.col("source").eqNullSafe(F.col("s")), "inner").groupBy("rank", "source_size", "target", "order", "size").agg(F.count("*").alias("copies"))
    places = materialise(places.withColumn("bucket", F.substring("order", 1, digits)))
    n = F.col("size") * F.col("copies")
    starts = _starts(places.groupBy("rank", "bucket").agg(F.sum(n).alias("n")), digits)
    inside = Window.partitionBy("rank", "bucket").orderBy("order", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = places.withColumn("within", F.coalesce(F.sum(n).over(inside), F.lit(0))).join(starts, ["rank", "bucket"])
    passed = placed.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    whole = materialise(passed.select("rank", "pass", "order", "size", "copies", (F.col("pass") * F.col("source_size") + F.col("start") + F.col("within")).alias("base"), "target"))
    drop(places)
    return whole


def _slots(places: DataFrame, low: float, high: float) -> DataFrame:
    """slot, n: tokens of the copies that finish in each of SLOTS stretches of the time (low, high]."""
    width = (high - low) / SLOTS
    edge = lambda q: F.when(q >= SLOTS, F.lit(high)).otherwise(F.lit(low) + q * F.lit(width))
    slot = lambda t: F.greatest(F.lit(0), F.least(F.lit(SLOTS - 1), F.floor((t - F.lit(low)) / F.lit(width)))).cast("int")
    here = places.withColumn("from", _copies_until(low)).withColumn("to", _copies_until(high)).where(F.col("to") > F.col("from"))
    # one slot to both sides, for a time on an edge may be taken to either
    first, last = F.greatest(slot(_finish(F.col("from") + 1)) - 1, F.lit(0)), F.least(slot(_finish(F.col("to"))) + 1, F.lit(SLOTS - 1))
    spread = here.withColumn("slot", F.explode(F.sequence(first, last)))
    until = lambda q: F.greatest(F.col("from"), F.least(F.col("to"), _copies_until(edge(q))))
    given = spread.withColumn("k", until(F.col("slot") + 1) - until(F.col("slot"))).where("k > 0")
    return given.groupBy("slot").agg(F.sum(F.col("k") * F.col("size")).alias("n"))


def cut(places: DataFrame, budget: int) -> dict | None:
    """finish, rank, pass, order, copy of the last copy such that all up to it fit the budget; None if all fit."""
    end = places.agg(F.max(_finish(F.col("copies"))), F.sum(F.col("copies") * F.col("size"))).first()
    if end[0] is None or end[1] <= budget:
        return None
    low, high, left = 0.0, end[0], budget
    for _ in range(2):
        slots = _slots(places, low, high)
        running = slots.select("slot", "n", F.sum("n").over(Window.orderBy("slot")).alias("upto"))
        ended = running.where(F.col("upto") > left).orderBy("slot").first()
        if ended is None:  # the budget ends with the stretch
            break
        left, width = left - (ended["upto"] - ended["n"]), (high - low) / SLOTS
        low, high = low + ended["slot"] * width, high if ended["slot"] + 1 >= SLOTS else low + (ended["slot"] + 1) * width
    inside = places.withColumn("from", _copies_until(low)).withColumn("to", _copies_until(high)).where(F.col("to") > F.col("from"))
    listed = inside.withColumn("copy", F.explode(F.sequence(F.col("from") + 1, F.col("to"))))
    place = listed.select("size", F.struct(_finish(F.col("copy")).alias("finish"), "rank", "pass", "order", "copy").alias("place"))
    summed = place.withColumn("upto", F.sum("size").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)))
    last = summed.where(F.col("upto") <= left).agg(F.max("place").alias("p")).first()["p"]
    return last.asDict() if last else {"finish": low, "rank": 1 << 30, "pass": 0, "order": "", "copy": 0}


def _taken(last: dict | None) -> Column:
    """How many copies of a place are up to the last one."""
    if last is None:
        return F.col("copies")
    until = _copies_until(float(last["finish"]))
    before = F.when((until > 0) & (_finish(until) == F.lit(last["finish"])), until - 1).otherwise(until)
    own, other = F.struct("rank", "pass", "order"), F.struct(F.lit(last["rank"]).cast("int").alias("rank"), F.lit(last["pass"]).cast("int").alias("pass"), F.lit(last["order"]).alias("order"))
    return F.when(own == other, F.lit(last["copy"]).cast("bigint")).when(own < other, until).otherwise(before)


def _broadcast(sources: DataFrame) -> DataFrame:
    return F.broadcast(sources) if sources.count() <= MAX_BROADCAST_SOURCES else sources


def shares(slim: DataFrame, weights=(1.0, 2.0, 3.0), share: float = 1.0, repeats: int = 3, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """source, source_size, target, ends: for each pass the last place that the queue takes of the source, and its copies: taken and all.

    `slim` has source, size, order. Inside a source the queue follows the shuffled order, so these ends
    say all: a row is taken once for each pass whose end it doesn't exceed.
    """
    rows, budget = slim.agg(F.count("*"), F.sum("size")).first()
    budget = int((budget or 0) * share)
    digits = 1
    while 16**digits * rows_per_bucket < rows:
        digits += 1
    targets = materialise(source_targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, repeats))
    places = queue(slim, targets, repeats, digits)
    taken = places.withColumn("taken", _taken(cut(places, budget)) if budget > 0 else F.lit(0).cast("bigint")).where("taken > 0")
    ends = taken.groupBy("rank", "pass").agg(F.max(F.struct("order", "taken", "copies")).alias("end")).groupBy("rank").agg(F.collect_list("end").alias("ends"))
    none = F.array().cast("array<struct<order:string,taken:bigint,copies:bigint>>")
    found = materialise(targets.join(ends, "rank", "left").select("source", "source_size", "target", F.coalesce("ends", none).alias("ends")))
    drop(targets, places)
    return found


def _passes(rows: DataFrame, by_source: DataFrame) -> DataFrame:
    """Rows (source, size, order, slice, ...) with source_size, target and passes.

    Where the cut falls between the copies of a place, they are numbered: inside the slices of the table, from the sums of the slices before.
    """
    met = rows.join(_broadcast(by_source.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    parted = F.filter("ends", lambda e: (e["order"] == F.col("order")) & (e["taken"] < e["copies"]))
    shared = (F.col("size") > 0) & (F.size(parted) > 0)
    counted = lambda number: F.when(F.col("size") > 0, F.size(F.filter("ends", lambda e: (F.col("order") < e["order"]) | ((F.col("order") == e["order"]) & (number <= e["taken"]))))).otherwise(F.lit(0))
    plain = met.where(~shared).withColumn("passes", counted(F.lit(0)))
    copies = materialise(met.where(shared))
    sums = copies.groupBy("order", "slice").agg(F.count("*").alias("n"))
    before = Window.partitionBy("order").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("order", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    number = F.row_number().over(Window.partitionBy("order", "slice").orderBy(F.lit(1))) + F.col("start")
    numbered = copies.join(starts, ["order", "slice"]).withColumn("number", number).withColumn("passes", counted(F.col("number")))
    return plain.unionByName(numbered.select(plain.columns))


def _keyed(rows: DataFrame, seed: int, *more: str) -> DataFrame:
    """source, size, order, slice of rows; a slice is what one task reads: a fixed share of a table's rows."""
    texts = rows.select(*more, "doc_id", "source", text_or_empty().alias("text"))
    return texts.select(*more, "doc_id", "source", word_count(F.col("text")).alias("size"), _order(seed).alias("order"), F.spark_partition_id().alias("slice"))


def _report(slim: DataFrame, by_source: DataFrame) -> DataFrame:
    return _passes(slim, by_source).select("doc_id", "size", "source_size", "target", "passes", (F.col("passes") * F.col("size")).alias("taken"))


def report(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), share: float = 1.0, repeats: int = 3, seed: int = 0, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """doc_id, size, source_size, target, passes, taken of each document. Texts are read once."""
    slim = materialise(_keyed(chosen(docs, doc_id="doc_id", source="source", text="text"), seed))
    return _report(slim, shares(slim, weights, share, repeats, rows_per_bucket))


def mix(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), share: float = 1.0, repeats: int = 3, seed: int = 0, rows_per_bucket: int = ROWS_PER_BUCKET) -> tuple[DataFrame, DataFrame]:
    """The report, and the mix itself: each document as often as it is taken, with the columns of `docs`."""
    slim = materialise(_keyed(chosen(docs, doc_id="doc_id", source="source", text="text"), seed))
    by_source = shares(slim, weights, share, repeats, rows_per_bucket)
    mixed = _passes(_keyed(with_row(docs, doc_id="doc_id", source="source", text="text"), seed, "row"), by_source).where("passes > 0")
    return _report(slim, by_source), unpacked(mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("passes")))), docs)
