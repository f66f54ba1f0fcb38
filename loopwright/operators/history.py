"""Undo and redo over logs of any length.

A log's state is small when it is told by distances: how far the history stands below its top (`down`), and how far it may go down at all (`room`, at most
MAX_HISTORY). An edit makes a new top, an undo goes down one, a redo up one; only the top's depth is unbounded, and it only adds up. So a block of rows is a map from the states it
may be entered with to those it is left with, and the maps of an area's blocks compose: blocks are worked through apart, twice, once for all states and once from the right one.
What holds in the end is, of each depth up to the last one, the last edit that reached it: an edit at a depth replaces all that stood there and above.

Scale: areas of at most BLOCK rows are dealt by area and walked through once, many in a batch. The rows of the others are placed by a range sort and dealt by block, so an area with any
share of the rows is spread over tasks; the maps of an area's blocks, 16 kB each, meet in one task, a map for every BLOCK rows of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopwright.checkpoints import drop, written
from loopwright.operators.numbering import placed
from loopwright.schema import MAX_HISTORY

#: Rows of a log that are worked through together.
BLOCK = 4096
_EDIT, _UNDO, _REDO = 0, 1, 2


def _walk(kinds: np.ndarray, room: np.ndarray, down: np.ndarray, top: np.ndarray) -> None:
    """Moves all states (arrays, changed in place) through the rows of a block."""
    for kind in kinds:
        if kind == _UNDO:
            np.minimum(down + 1, room, out=down)
        elif kind == _REDO:
            np.maximum(down - 1, 0, out=down)
        else:
            top += 1 - down
            np.minimum(room - down + 1, MAX_HISTORY, out=room)
            down[:] = 0


def _states() -> tuple[np.ndarray, np.ndarray]:
    """Every (room, down) that a block may be entered with."""
    room = np.repeat(np.arange(MAX_HISTORY + 1), np.arange(1, MAX_HISTORY + 2))
    down = np.concatenate([np.arange(r + 1) for r in range(MAX_HISTORY + 1)])
    return room, down


def _place(room: int, down: int) -> int:
    return room * (room + 1) // 2 + down


def _map(kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a block: the state it is left with, by that it is entered with, and how much the top rises."""
    room, down = (x.copy() for x in _states())
    top = np.zeros(len(room), np.int64)
    _walk(kinds, room, down, top)
    return room * (room + 1) // 2 + down, top


def _blocks(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[str, int, pd.DataFrame]]:
    """Rows of each block, of frames that are sorted by area and block; a block may span frames."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        own = frame.groupby(["area", "block"], sort=False, dropna=False)
        for key, part in own:
            if held and (held[0]["area"].iloc[0], held[0]["block"].iloc[0]) != key:
                yield held[0]["area"].iloc[0], held[0]["block"].iloc[0], pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(part)
    if held:
        yield held[0]["area"].iloc[0], held[0]["block"].iloc[0], pd.concat(held) if len(held) > 1 else held[0]


def _maps(rows: DataFrame) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for area, block, part in _blocks(frames):
            left, top = _map(part["kind"].to_numpy())
            yield pd.DataFrame({"area": [area], "block": [block], "left": [left.astype("<i2").tobytes()], "top": [top.astype("<i4").tobytes()]})

    dealt = rows.select("area", "block", "at", "kind").repartition("area", "block").sortWithinPartitions("area", "block", "at")
    return dealt.mapInPandas(run, "area string, block bigint, left binary, top binary")


def _entries(maps: DataFrame) -> DataFrame:
    """area, block, room, down, top: the state that each block is entered with."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("block")
        rooms, downs = _states()
        at, top, found = _place(0, 0), 0, []
        for left, rise in zip(part["left"], part["top"]):
            found.append((rooms[at], downs[at], top))
            at, top = int(np.frombuffer(left, "<i2")[at]), top + int(np.frombuffer(rise, "<i4")[at])
        room, down, tops = zip(*found)
        return pd.DataFrame({"area": part["area"], "block": part["block"], "room": room, "down": down, "top": tops})

    return maps.groupBy("area").applyInPandas(run, "area string, block bigint, room int, down int, top bigint")


def _depths(rows: DataFrame) -> DataFrame:
    """area, at, seq, depth of each edit, and depth of the last row of each block with a null seq; rows have the state their block is entered with."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for area, _, part in _blocks(frames):
            room, down, top = (int(part[c].iloc[0]) for c in ("room", "down", "top"))
            depths = np.zeros(len(part), np.int64)
            for i, kind in enumerate(part["kind"].to_numpy()):
                if kind == _UNDO:
                    down = min(down + 1, room)
                elif kind == _REDO:
                    down = max(down - 1, 0)
                else:
                    top += 1 - down
                    room = min(room - down + 1, MAX_HISTORY)
                    down = 0
                depths[i] = top - down
            edit = part["kind"].to_numpy() == _EDIT
            yield pd.DataFrame({"area": area, "at": part["at"].to_numpy()[edit], "seq": part["seq"].to_numpy()[edit], "depth": depths[edit], "last": False})
            yield pd.DataFrame({"area": [area], "at": [int(part["at"].iloc[-1])], "seq": [0], "depth": [depths[-1]], "last": [True]})

    return rows.select("area", "block", "at", "seq", "kind", "room", "down", "top").repartition("area", "block").sortWithinPartitions("area", "block", "at").mapInPandas(run, "area string, at bigint, seq bigint, depth bigint, last boolean")


def _short(rows: DataFrame) -> DataFrame:
    """area, seq of the edits that hold, of areas whose rows (area, seq, kind) one walk takes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        area, done, gone, fixed = None, [], [], 0
        for batch in batches:
            areas, seqs = [], []
            for own, seq, kind in zip(*(c.to_pylist() for c in batch.columns)):
                if own != area:
                    areas += [area] * len(done)
                    seqs += done
                    area, done, gone, fixed = own, [], [], 0
                if kind == _UNDO:
                    if len(done) > fixed:
                        gone.append(done.pop())
                elif kind == _REDO:
                    if gone:
                        done.append(gone.pop())
                else:
                    done.append(seq)
                    gone, fixed = [], max(fixed, len(done) - MAX_HISTORY)
            yield pa.RecordBatch.from_arrays([pa.array(areas, pa.string()), pa.array(seqs, pa.int64())], names=["area", "seq"])
        yield pa.RecordBatch.from_arrays([pa.array([area] * len(done), pa.string()), pa.array(done, pa.int64())], names=["area", "seq"])

    return rows.select("area", "seq", "kind").repartition("area").sortWithinPartitions("area", "seq").mapInArrow(run, "area string, seq bigint")


def held_edits(log: DataFrame, block: int = BLOCK) -> DataFrame:
    """area, seq of the edits of a log (area, seq, kind) that hold after its undo and redo rows; kinds are 'edit', 'undo' and 'redo'."""
    kind = F.when(F.col("kind") == "undo", _UNDO).when(F.col("kind") == "redo", _REDO).otherwise(_EDIT).cast("int")
    rows = written(log.select(F.col("area").cast("string").alias("area"), F.col("seq").cast("bigint").alias("seq"), kind.alias("kind")).where("area is not null"))
    long = written(rows.groupBy("area").agg(F.count("*").alias("n")).where(F.col("n") > block).select(F.col("area").alias("a")))
    if long.isEmpty():
        return _short(rows)
    some = F.col("area") == F.col("a")
    return _short(rows.join(long, some, "left_anti")).unionByName(_long(written(rows.join(long, some, "left_semi")), block))


def _long(log: DataFrame, block: int) -> DataFrame:
    """As held_edits(), of a table whose kinds are numbers, by maps of blocks."""
    rows = placed(log, ["area", "seq"])
    first = rows.groupBy("area").agg(F.min("at").alias("first"))
    own = written(rows.join(first.withColumnRenamed("area", "a"), F.col("area") == F.col("a")).select("area", "seq", "kind", "at", F.floor((F.col("at") - F.col("first")) / block).alias("block")))
    entries = _entries(_maps(own))
    met = own.join(entries.select(F.col("area").alias("a"), F.col("block").alias("b"), "room", "down", "top"), (F.col("area") == F.col("a")) & (F.col("block") == F.col("b"))).drop("a", "b")
    depths = written(_depths(met))
    drop(own)
    ends = depths.where("last").groupBy("area").agg(F.max_by("depth", "at").alias("end"))
    lasts = depths.where("not last").groupBy("area", "depth").agg(F.max_by("seq", "at").alias("seq"))
    return lasts.join(ends, "area").where("depth <= end").select("area", "seq")
