"""The edit log as a stream: what holds after undo and redo, and what a solve is stale against, kept up to date by area.

Edits may come late by the watermark's delay: they wait in state, under a timer of their time, until no earlier one can come, and are then applied in the order of (at, seq). State is bounded by
what waits and what can be undone: MAX_HISTORY edits, and as many to redo. Results are changes; the last version of a key is its state, which current() picks.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from loopwright.schema import MAX_HISTORY

HELD = "area string, seq bigint, held boolean, version bigint"
STALE = "area string, stale boolean, version bigint"
#: transformWithState keeps its state in RocksDB.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _InOrder(StatefulProcessor):
    """Rows (area, seq, at, kind, value) wait until the watermark has passed them, then go to apply() one by one."""

    columns: list[str] = []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at bigint, seq bigint", "kind string, value string")
        self.version = handle.getValueState("version", "n bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for seq, at, kind, value in zip(frame["seq"], frame["at"], frame["kind"], frame["value"]):
                ms = pd.Timestamp(at).value // 1_000_000
                self.waiting.updateValue((ms, int(seq)), (kind, value))
                self.handle.registerTimer(ms)
        yield from ()  # nothing is told before its time

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs()
        due = sorted((k[0], k[1], v[0], v[1]) for k, v in self.waiting.iterator() if k[0] <= until)
        n = self.version.get()[0] if self.version.exists() else 0
        found = []
        for ms, seq, kind, value in due:
            n += 1
            found += [(key[0], *row, n) for row in self.apply(seq, kind, value)]
            self.waiting.removeKey((ms, seq))
        if due:
            self.version.update((n,))
        if found:
            yield pd.DataFrame(found, columns=self.columns)

    def apply(self, seq: int, kind: str, value: str | None) -> list[tuple]:
        raise NotImplementedError

    def close(self) -> None:
        pass


class _History(_InOrder):
    columns = ["area", "seq", "held", "version"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.stacks = handle.getValueState("stacks", "done array<bigint>, gone array<bigint>")

    def apply(self, seq: int, kind: str, value: str | None) -> list[tuple]:
        done, gone = ([*x] for x in self.stacks.get()) if self.stacks.exists() else ([], [])
        told = []
        if kind == "undo":
            if done:
                gone.append(done.pop())
                told = [(gone[-1], False)]
        elif kind == "redo":
            if gone:
                done.append(gone.pop())
                told = [(done[-1], True)]
        else:
            done, gone, told = [*done, seq][-MAX_HISTORY:], [], [(seq, True)]
        self.stacks.update((done, gone))
        return told


class _Staleness(_InOrder):
    """kind 'solve' takes the fingerprint that a solve begins with, any other is the area's present one."""

    columns = ["area", "stale", "version"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.begun = handle.getValueState("begun", "value string")

    def apply(self, seq: int, kind: str, value: str | None) -> list[tuple]:
        if kind == "solve":
            self.begun.update((value,))
            return [(False,)]
        return [(self.begun.get()[0] != value,)] if self.begun.exists() else []


def _stream(edits: DataFrame, processor: StatefulProcessor, schema: str, delay: str) -> DataFrame:
    rows = edits.select("area", "seq", "at", "kind", (F.col("value") if "value" in edits.columns else F.lit(None)).cast("string").alias("value"))
    return rows.withWatermark("at", delay).groupBy("area").transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")


def held_changes(edits: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """area, seq, held, version of a stream of edits (area, seq, at, kind): whether an edit holds, each time that changes."""
    return _stream(edits, _History(), HELD, delay)


def stale_changes(states: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """area, stale, version of a stream of fingerprints (area, seq, at, kind, value): whether the area has changed since its solve began."""
    return _stream(states, _Staleness(), STALE, delay)


def current(changes: DataFrame, *keys: str) -> DataFrame:
    """The last version of each key."""
    rest = [c for c in changes.columns if c not in keys]
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), "version").alias("last")).select(*keys, "last.*").drop("version")


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set(*PROVIDER)
