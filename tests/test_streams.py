"""Streams over several micro-batches equal their batch twins."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import history, links
from palimpsest.streaming import streams

SCHEMA = "id bigint, k bigint, ts timestamp, kind string"


@pytest.fixture(params=["in order", "ties and disorder"])
def split_log(spark, tmp_path, request):
    """A log written as five files, read one file per micro-batch. With ties many rows share their time with
    rows of other files; with disorder rows come up to half the allowance late."""
    rng = random.Random(11)
    at = (lambda i: i * 97) if request.param == "in order" else (lambda i: max(0, i * 97 // 600 * 600 - rng.choice([0, 0, 600, 1200])))
    rows = [(i, 0 if rng.random() < 0.6 else rng.randrange(1, 4), at(i), rng.choice(["failed", "completed", "processing", "critical"])) for i in range(300)]
    df = spark.createDataFrame(rows, "id bigint, k bigint, s int, kind string").withColumn("ts", F.expr("timestampadd(SECOND, s, timestamp'2024-01-01')")).select("id", "k", "ts", "kind")
    folder = str(tmp_path / "log")
    for b in range(5):
        df.filter((F.col("id") >= b * 60) & (F.col("id") < b * 60 + 60)).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    return stream, df


def same(a, b, *cols):
    take = lambda d: sorted((tuple(r) for r in d.select(*cols).collect()), key=str)
    assert take(a) == take(b) and take(a)


def test_changed_content(split_log):
    shape = lambda d: d.select(F.col("id").alias("observation_id"), F.col("k").alias("resource_id"), F.col("ts").alias("checked_at"), F.col("kind").alias("content_sha256"))
    stream, batch = split_log
    same(streams.changed_content(shape(stream)), history.with_changes(shape(batch)), "observation_id", "previous_observation_id", "content_changed")


def test_failure_streaks(split_log):
    shape = lambda d: d.select(F.col("id").alias("run_id"), F.col("k").alias("endpoint_id"), F.col("ts").alias("finished_at"),
                               F.when(F.col("kind") == "completed", "completed").otherwise("failed").alias("status"))
    stream, batch = split_log
    same(streams.failure_streaks(shape(stream)), history.failure_streaks(shape(batch)), "run_id", "consecutive_failures", "health_state")


def test_status_signals(split_log):
    shape = lambda d: d.select(F.col("id").alias("assessment_id"), F.col("k").alias("endpoint_id"), F.col("ts").alias("assessed_at"),
                               F.when(F.col("kind") == "completed", "healthy").when(F.col("kind") == "failed", "warning").otherwise(F.col("kind")).alias("status"))
    stream, batch = split_log
    same(streams.status_signals(shape(stream)), history.status_signals(shape(batch)), "assessment_id", "signal")


def test_link_states(split_log):
    def shape(d):
        out = d.select(F.col("k").alias("resource_id"), F.col("id").alias("observation_id"), F.col("ts").alias("checked_at"),
                       F.explode(F.array("kind", F.concat(F.lit("x"), (F.col("id") % 3).cast("string")))).alias("target_url"))
        return out.withColumn("row_id", F.concat_ws("|", F.col("observation_id").cast("string"), "target_url"))

    stream, batch = split_log
    b = shape(batch)
    same(streams.link_states(shape(stream)), links.snapshot_states(b.select("observation_id", "target_url"), b), "observation_id", "target_url", "state")


def test_retry_table_keeps_latest_attempt(split_log):
    shape = lambda d: d.select(F.col("k").alias("event_id"), F.lit("failed").alias("status"), (F.col("id") % 9).cast("int").alias("attempts"), F.col("ts").alias("available_at"))
    stream, batch = split_log
    got = {r.event_id: r.attempts for r in streams.retry_updates(shape(stream), "2024-02-01 00:00:00").collect()}
    assert got == {r.event_id: r.m for r in shape(batch).groupBy("event_id").agg(F.max("attempts").alias("m")).collect()}


def test_ingest_once_over_batches(spark, split_log, tmp_path):
    stream, batch = split_log
    keyed = lambda d: d.select((F.col("id") % 50).alias("key"), "ts", "id")
    streams.ingest_once(keyed(stream), "key", "ts", str(tmp_path / "once"))
    got = spark.read.parquet(str(tmp_path / "once"))
    assert got.count() == 50 == got.select("key").distinct().count()


def test_a_restart_goes_on_and_late_rows_are_kept(spark, tmp_path):
    rows = [(i, i % 2, i * 600, "critical" if i % 3 else "completed") for i in range(60)]
    log, folder = str(tmp_path / "log"), str(tmp_path / "stream")
    frame = lambda part: spark.createDataFrame(part, "id bigint, k bigint, s int, kind string").withColumn("ts", F.expr("timestampadd(SECOND, s, timestamp'2024-01-01')")).select("id", "k", "ts", "kind")
    shape = lambda d: d.select(F.col("id").alias("observation_id"), F.col("k").alias("resource_id"), F.col("ts").alias("checked_at"), F.col("kind").alias("content_sha256"))
    run = lambda: streams.changed_content(shape(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(log)), folder)
    cols = ("observation_id", "previous_observation_id", "content_changed")
    early, rest = rows[:28] + [rows[31]], rows[28:31] + rows[32:]
    for part, known in ((early, early), (rest, rows)):
        frame(part).coalesce(1).write.mode("append").parquet(log)
        same(run(), history.with_changes(shape(frame(known))), *cols)
    frame([(99, 0, 5, "late")]).coalesce(1).write.mode("append").parquet(log)
    same(run(), history.with_changes(shape(frame(rows))), *cols)
    late = spark.read.parquet(f"{folder}/late").select("observation_id").collect()
    commits = spark.read.parquet(f"{folder}/commits").agg(F.sum("n_late")).first()[0]
    assert [r[0] for r in late] == [99] and commits == 1


def test_sessions_and_silence(split_log):
    stream, batch = split_log
    sessions = streams.reader_sessions(stream, "k", "ts", "10 minutes")
    assert sessions.count() > 0 and sessions.agg(F.sum("n")).first()[0] <= batch.count()
    silent = streams.silent_keys(stream.filter("id < 60 or k = 0"), "k", "ts").collect()
    assert {r.k for r in silent} >= {1, 2, 3}
