"""Edits as keyed overlays on relations, and their history as an append-only log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loopwright.operators import history
from loopwright.schema import UNASSIGNED


def visible(houses: DataFrame, removed: DataFrame) -> DataFrame:
    return houses.join(removed.select("area", "house_id"), ["area", "house_id"], "left_anti")


def in_bounds(houses: DataFrame, removed: DataFrame, south: float, west: float, north: float, east: float) -> DataFrame:
    """Visible houses of a box, its edges included. The box is filtered first, at the scan."""
    boxed = houses.where(F.col("lat").between(south, north) & F.col("lon").between(west, east))
    return visible(boxed, removed)


def select_area(selection: DataFrame, found: DataFrame, additive: bool) -> DataFrame:
    """A new selection: what a rectangle found, with what was selected before if additive."""
    new = found.select("area", "house_id")
    return selection.select("area", "house_id").unionByName(new).distinct() if additive else new.distinct()


def locked_flags(houses: DataFrame, locked_segments: DataFrame, locked_houses: DataFrame) -> DataFrame:
    """Adds `locked` to houses (area, house_id, segment_key): by its segment's lock or its own."""
    by_segment = locked_segments.select("area", "segment_key").distinct().withColumn("s", F.lit(True))
    own = locked_houses.select("area", "house_id").distinct().withColumn("o", F.lit(True))
    met = houses.join(by_segment, ["area", "segment_key"], "left").join(own, ["area", "house_id"], "left")
    return met.withColumn("locked", F.coalesce("s", "o", F.lit(False))).drop("s", "o")


def assigned(houses: DataFrame, assignment: DataFrame) -> DataFrame:
    """Adds g; -1 where nothing is assigned."""
    return houses.join(assignment.select("area", "house_id", "g"), ["area", "house_id"], "left").fillna({"g": UNASSIGNED})


def move(assignment: DataFrame, updates: DataFrame) -> DataFrame:
    """The assignment with updates (area, house_id, g) in it: changed where known, added where not."""
    new = updates.select("area", "house_id", F.col("g").alias("to"))
    return assignment.join(new, ["area", "house_id"], "full_outer").select("area", "house_id", F.coalesce("to", "g").alias("g"))


def move_segment(assignment: DataFrame, houses: DataFrame, segment_key: str, group: int) -> DataFrame:
    """Moves every house of a segment to a group."""
    return move(assignment, houses.where(F.col("segment_key") == segment_key).select("area", "house_id", F.lit(group).alias("g")))


def merge_fetched(fetched: DataFrame, old: DataFrame) -> DataFrame:
    """Fresh houses and those added by hand. Removed ids stay removed, so they aren't touched here."""
    return fetched.unionByName(old.where("manual"))


def toggle_locks(locked: DataFrame, chosen: DataFrame) -> DataFrame:
    """If all chosen houses of an area are locked they are unlocked, else all become locked."""
    have = locked.select("area", "house_id").distinct().withColumn("was", F.lit(True))
    pick = chosen.select("area", "house_id").distinct().withColumn("picked", F.lit(True))
    all_on = pick.join(have, ["area", "house_id"], "left").groupBy("area").agg(F.bool_and(F.coalesce("was", F.lit(False))).alias("off"))
    met = have.join(pick, ["area", "house_id"], "full_outer").join(all_on, "area", "left")
    return met.where(~(F.coalesce("picked", F.lit(False)) & F.coalesce("off", F.lit(False)))).select("area", "house_id")


def undone(log: DataFrame) -> DataFrame:
    """The edits of a log (area, seq, kind, ...) that hold after its undo and redo rows.

    kind 'edit' is an edit; 'undo' takes the last one that holds away, 'redo' brings the last undone one back; a new edit
    clears what could be redone; at most 100 edits can be undone. See history for how a long log is worked through.
    """
    return log.join(history.held_edits(log), ["area", "seq"])


def state_at(edits: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The latest value of each key among edits that hold (area, seq, keys, value); null values are deletions."""
    last = Window.partitionBy("area", *keys).orderBy(F.col("seq").desc())
    latest = edits.withColumn("turn", F.row_number().over(last)).where("turn = 1")
    return latest.where(F.col(value).isNotNull()).select("area", *keys, value)


def is_stale(before: DataFrame, now: DataFrame) -> DataFrame:
    """area, stale: whether any fingerprint (state, groups, model_key, osm, inputs) of an area changed since a solve began."""
    columns = ["state", "groups", "model_key", "osm", "inputs"]
    after = now.select("area", *[F.col(c).alias(f"n_{c}") for c in columns])
    same = [F.col(c).eqNullSafe(F.col(f"n_{c}")) for c in columns]
    met = before.join(after, "area", "left")
    changed = ~same[0]
    for s in same[1:]:
        changed = changed | ~s
    return met.select("area", changed.alias("stale"))


def fetch_replaces(assignment: DataFrame, overwrite: bool) -> None:
    """A fetch wipes assignments; it needs overwrite=True where there are any."""
    if not overwrite and not assignment.isEmpty():
        raise ValueError("fetching replaces all group assignments; pass overwrite=True to go on")
