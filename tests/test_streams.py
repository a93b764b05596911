"""Stateful streams: killed and restarted, late events, expiry, against the batch."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from chronoply.operators import sequences
from chronoply.spec import LogSpec
from chronoply.streaming import logs

SPEC = LogSpec("c", "e", "t", "i")
SCHEMA = "c string, e string, s long, i long"


def write(spark, path, parts):
    """A file for each part, in order."""
    for k, part in enumerate(parts):
        df = spark.createDataFrame(part, SCHEMA).withColumn("t", F.timestamp_seconds("s")).coalesce(1)
        df.write.mode("append").parquet(f"{path}/{k:03}")


def stream(spark, path):
    schema = spark.createDataFrame([], SCHEMA).withColumn("t", F.timestamp_seconds("s")).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{path}/*")


def run(df, out, point, until=None):
    """Runs all there is; ``until``: fails in the batch of that number, as a killed job does."""

    def sink(batch, number):
        if until is not None and number >= until:
            raise RuntimeError("killed")
        batch.write.mode("overwrite").parquet(f"{out}/{number}")

    query = df.writeStream.foreachBatch(sink).option("checkpointLocation", str(point)).outputMode("append").trigger(availableNow=True).start()
    if until is None:
        query.awaitTermination(200)
    else:
        with pytest.raises(Exception, match="killed"):
            query.awaitTermination(200)


def told(spark, out):
    return sorted((r.case, r.tie, round(r.gap_s, 6)) for r in spark.read.option("recursiveFileLookup", "true").parquet(str(out)).collect())


def batch(spark, rows):
    df = sequences.time_gaps(spark.createDataFrame(rows, SCHEMA).withColumn("t", F.timestamp_seconds("s")), SPEC)
    return sorted((r.c, r.i, round(r.gap_s, 6)) for r in df.where("gap_s IS NOT NULL").collect())


@pytest.fixture
def small(spark):
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, "2")
    yield
    spark.conf.set(key, before)


@pytest.mark.parametrize("ordered", [False, True])
def test_restarted_stream_gives_the_batchs_gaps(spark, small, tmp_path, ordered):
    rng = random.Random(3)
    rows = [(f"c{rng.randrange(4)}", "e", 1_000_000 + 5 * k, k) for k in range(60)]
    parts = [rows[k : k + 12] for k in range(0, 60, 12)]
    if ordered:  # events of neighbouring parts change places, so some come after their successors
        for k in range(4):
            parts[k][-3:], parts[k + 1][:3] = parts[k + 1][:3], parts[k][-3:]
    close = [("z", "e", 2_000_000, 999)]  # moves the watermark past all of them
    write(spark, tmp_path / "in", [*parts, close])
    df = logs.gaps(stream(spark, tmp_path / "in"), SPEC, late="2 minutes", idle_ms=10_000_000, ordered=ordered)
    run(df, tmp_path / "out", tmp_path / "point", until=2)
    run(df, tmp_path / "out", tmp_path / "point")
    assert told(spark, tmp_path / "out") == batch(spark, rows)


def test_state_expires_and_late_events_count_as_zero(spark, small, tmp_path):
    parts = [[("a", "e", 1000, 1)], [("a", "e", 1010, 2), ("a", "e", 1005, 3)], [("a", "e", 1008, 4)], [("b", "e", 50_000, 5)], [("b", "e", 50_001, 6)], [("a", "e", 60_000, 7)], [("a", "e", 60_002, 8)]]
    write(spark, tmp_path / "in", parts)
    df = logs.gaps(stream(spark, tmp_path / "in"), SPEC, late="1 minute", idle_ms=100_000)
    run(df, tmp_path / "out", tmp_path / "point")
    assert told(spark, tmp_path / "out") == [("a", 2, 5.0), ("a", 3, 5.0), ("a", 4, 0.0), ("a", 8, 2.0), ("b", 6, 1.0)]


def test_early_stops(spark, small, tmp_path):
    rng = random.Random(9)
    history = [(r, k, round(rng.random(), 3)) for k in range(20) for r in ("x", "y")]
    for k in range(4):
        spark.createDataFrame(history[k * 10 : k * 10 + 10], "r string, k long, l double").coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    source = spark.readStream.schema("r string, k long, l double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    df = logs.early_stops(source, "r", "k", "l", 3, 0.05)
    run(df, tmp_path / "out", tmp_path / "point", until=1)
    run(df, tmp_path / "out", tmp_path / "point")
    got = {(r.run, r.epoch): (r.stale, r.stop) for r in spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "out")).collect()}
    want = sequences.early_stop(spark.createDataFrame(history, "r string, k long, l double"), "r", "k", "l", 3, 0.05).collect()
    assert got == {(r.r, r.k): (r.stale, r.stop) for r in want}
