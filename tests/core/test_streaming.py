"""The edit stream against the edit log, with batches that come in another order."""

import datetime
import random

from pyspark.sql import functions as F

from loopwright.operators import edits as log_edits
from loopwright.streaming import edits as stream

ROWS = "area string, seq bigint, at timestamp, kind string, value string"
BEGIN = datetime.datetime(2024, 1, 1)


def run(spark, tmp_path, rows, changes, shuffle_s=300, files=4):
    """The changes of rows that arrive in `files` batches, out of order by up to shuffle_s seconds."""
    draw = random.Random(1)
    late = sorted(rows, key=lambda r: r[2].timestamp() + draw.random() * shuffle_s)
    late.append(("flush", 0, BEGIN + datetime.timedelta(days=9), "edit", "x"))
    step = -(-len(late) // files)
    for k in range(files):
        spark.createDataFrame(late[k * step : (k + 1) * step], ROWS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    before = spark.conf.get(stream.PROVIDER[0], None)
    stream.use_rocksdb(spark)
    try:
        source = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        query = changes(source).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").option("path", f"{tmp_path}/out").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        assert len({p["batchId"] for p in query.recentProgress}) > 1
    finally:
        spark.conf.unset(stream.PROVIDER[0]) if before is None else spark.conf.set(stream.PROVIDER[0], before)
    return spark.read.parquet(f"{tmp_path}/out").where("area <> 'flush'")


def at(seq):
    return BEGIN + datetime.timedelta(seconds=7 * seq)


def test_the_streams_last_state_is_that_of_the_log(spark, tmp_path):
    draw = random.Random(2)
    rows = [(area, s, at(s), draw.choices(["edit", "undo", "redo"], w)[0], None) for area, n, w in (("a", 260, (9, 2, 1)), ("b", 90, (3, 4, 2)), ("c", 1, (0, 1, 0))) for s in range(n)]
    rows += [("d", s, at(s), "edit" if s < 130 else "undo", None) for s in range(240)]
    found = run(spark, tmp_path, rows, stream.held_changes)
    got = {(r["area"], r["seq"]) for r in stream.current(found, "area", "seq").where("held").collect()}
    log = spark.createDataFrame([r[:2] + r[3:4] for r in rows], "area string, seq bigint, kind string")
    assert got == {(r["area"], r["seq"]) for r in log_edits.undone(log).collect()} and len(got) > 100


def test_the_streams_last_staleness_is_that_of_the_fingerprints(spark, tmp_path):
    draw = random.Random(3)
    rows, want = [], {}
    for k in range(12):
        area, begun = f"a{k}", None
        for s in range(draw.randint(1, 30)):
            kind, value = draw.choice(["solve", "now", "now"]), draw.choice(["x", "y", None])
            rows.append((area, s, at(s), kind, value))
            if kind == "solve":
                begun, want[area] = (value,), False
            elif begun:
                want[area] = begun[0] != value
    found = run(spark, tmp_path, rows, stream.stale_changes, files=2)
    assert {r["area"]: r["stale"] for r in stream.current(found, "area").collect()} == want
