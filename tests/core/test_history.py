"""Undo and redo over blocks of a log against one walk through it."""

import random

import pytest
from pyspark.sql import functions as F

from loopwright.operators import edits, history


def brute(rows):
    done, gone, fixed = [], [], 0
    for seq, kind in sorted(rows):
        if kind == "undo":
            if len(done) > fixed:
                gone.append(done.pop())
        elif kind == "redo":
            if gone:
                done.append(gone.pop())
        else:
            done.append(seq)
            gone, fixed = [], max(fixed, len(done) - 100)
    return done


@pytest.mark.parametrize("block", [1, 7, 64, 4096])
def test_held_edits_are_those_of_one_walk(spark, block):
    draw = random.Random(block)
    logs = {}
    for area, n, weights in (("a", 900, (5, 3, 2)), ("b", 700, (3, 5, 3)), ("c", 500, (1, 6, 6)), ("d", 400, (20, 1, 1)), ("e", 3, (1, 1, 1)), ("f", 1, (0, 1, 0))):
        kinds = draw.choices(["edit", "undo", "redo"], weights, k=n)
        if area == "d":
            kinds[150:290] = ["undo"] * 140
        logs[area] = list(zip(draw.sample(range(10 * n), n), kinds))
    df = spark.createDataFrame([(a, s, k, "x") for a, rows in logs.items() for s, k in rows], "area string, seq bigint, kind string, more string")
    got = {}
    for r in history.held_edits(df, block).collect():
        got.setdefault(r["area"], []).append(r["seq"])
    assert {a: sorted(x) for a, x in got.items()} == {a: sorted(brute(rows)) for a, rows in logs.items() if brute(rows)}


def test_a_log_of_many_rows_in_one_area(spark):
    kind = F.when(F.col("id") % 7 == 3, "undo").when(F.col("id") % 11 == 5, "redo").otherwise("edit")
    n = 150_000
    df = spark.range(n).select(F.lit("one").alias("area"), F.col("id").alias("seq"), kind.alias("kind"))
    rows = [(i, "undo" if i % 7 == 3 else "redo" if i % 11 == 5 else "edit") for i in range(n)]
    assert sorted(r["seq"] for r in edits.undone(df).collect()) == sorted(brute(rows))
    assert edits.undone(df.limit(0)).collect() == []


def test_very_many_short_logs_take_one_walk(spark, monkeypatch):
    """Areas that one walk takes are neither placed nor cut into blocks, beside one that isn't short; nulls in no area hold nothing."""
    asked = []
    monkeypatch.setattr(history, "placed", lambda rows, by, f=history.placed: asked.append(rows.select("area").distinct().count()) or f(rows, by))
    kind = F.when(F.col("id") % 5 == 3, "undo").when(F.col("id") % 9 == 5, "redo").otherwise("edit")
    short = spark.range(30_000).select((F.col("id") % 4000).cast("string").alias("area"), F.col("id").alias("seq"), kind.alias("kind"))
    assert history.held_edits(short).count() and asked == []
    long = spark.range(5000).select(F.lit("long").alias("area"), F.col("id").alias("seq"), kind.alias("kind"))
    none = spark.range(3).select(F.lit(None).cast("string").alias("area"), F.col("id").alias("seq"), F.lit("edit").alias("kind"))
    got = {}
    for r in history.held_edits(short.unionByName(long).unionByName(none)).collect():
        got.setdefault(r["area"], []).append(r["seq"])
    logs = {}
    for r in short.unionByName(long).collect():
        logs.setdefault(r["area"], []).append((r["seq"], r["kind"]))
    assert asked == [1] and {a: sorted(x) for a, x in got.items()} == {a: sorted(brute(rows)) for a, rows in logs.items() if brute(rows)}
