"""Stream forms of the stateful operators; each equals its batch twin on the same rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from palimpsest.operators import history, links, workflow
from palimpsest.streaming.state import Tables, new_folder, replay, run_append, run_batches

DELAY = "1 hour"


def _prefixed(operator, prefix, row_id: str):
    """A step whose state is the rows that later rows depend on."""

    def step(before: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        both = before.unionByName(rows)
        return operator(both).join(before.select(row_id), row_id, "left_anti"), prefix(both)

    return step


def changed_content(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """Content changes per resource; only the last row per key is carried over."""
    last = lambda df: history.latest(df, ["resource_id"], ["checked_at", "observation_id"])
    step = _prefixed(history.with_changes, last, "observation_id")
    return replay(stream, step, stream.schema, "changed-content", "checked_at", folder)


def status_signals(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """Alert and recovery signals; a key carries its last row and its last row that was not
    processing."""

    def prefix(df: DataFrame) -> DataFrame:
        order = ["assessed_at", "assessment_id"]
        last = history.latest(df, ["endpoint_id"], order)
        signal = history.latest(df.filter("status <> 'processing'"), ["endpoint_id"], order)
        return last.unionByName(signal).dropDuplicates(["assessment_id"])

    step = _prefixed(history.status_signals, prefix, "assessment_id")
    return replay(stream, step, stream.schema, "status-signals", "assessed_at", folder)


def failure_streaks(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """Failure streaks and health states; a key carries its streak."""

    def step(before: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        ok = F.when(F.col("status") != "failed", 1).otherwise(0).cast("bigint")
        h = history.History(history.failure_streaks(rows), ["endpoint_id"], ["finished_at", "run_id"],
                            history.hour_chunk("finished_at")).running("_ok", ok).result()
        # Until a run of this batch succeeds, the streak continues the one carried over.
        carried = F.when(F.col("_ok") == 0, F.coalesce("streak", F.lit(0))).otherwise(0)
        out = h.join(before, "endpoint_id", "left").withColumn("consecutive_failures", F.col("consecutive_failures") + carried)
        health = F.when(F.col("consecutive_failures") == 0, "healthy").when(F.col("consecutive_failures") >= 3, "unhealthy").otherwise("degraded")
        out = out.withColumn("health_state", health).select("run_id", "endpoint_id", "finished_at", "consecutive_failures", "health_state")
        now = out.groupBy("endpoint_id").agg(F.max_by("consecutive_failures", F.struct("finished_at", "run_id")).alias("streak"))
        kept = before.join(now.select("endpoint_id"), "endpoint_id", "left_anti")
        return out, kept.unionByName(now)

    kind = stream.schema["endpoint_id"].dataType.simpleString()
    return replay(stream, step, f"endpoint_id {kind}, streak bigint", "failure-streaks", "finished_at", folder)


def link_states(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """Link states per observation, against the resource's observation before. stream: row_id,
    resource_id, observation_id, checked_at, target_url (one row per link)."""

    def operator(df: DataFrame) -> DataFrame:
        states = links.snapshot_states(df.select("observation_id", "target_url"), df, "resource_id", "checked_at", "observation_id", "target_url")
        return states.withColumn("row_id", F.concat_ws("|", F.col("observation_id").cast("string"), "target_url"))

    def prefix(df: DataFrame) -> DataFrame:
        last = history.latest(df.select("resource_id", "checked_at", "observation_id"), ["resource_id"], ["checked_at", "observation_id"])
        return df.join(last.select("resource_id", "observation_id"), ["resource_id", "observation_id"], "left_semi").select(df.columns)

    def step(before: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        both = before.unionByName(rows)
        return operator(both).join(before.select("observation_id").distinct(), "observation_id", "left_anti"), prefix(both)

    return replay(stream, step, stream.schema, "link-states", "checked_at", folder).drop("row_id")


def ingest_once(stream: DataFrame, key: str, at: str, path: str, folder: str | None = None) -> None:
    """Append each idempotency key once, however late its copies come: the first row of a key in a batch (by
    time) is written unless an earlier batch holds the key. A batch is written under its id, so one that is
    repeated overwrites itself."""
    schema = stream.schema

    def each(batch: DataFrame, batch_id: int) -> None:
        once = history.first(batch, [key], [at])
        for earlier in range(0, batch_id, 1000):  # path lists of bounded length
            ids = range(earlier, min(batch_id, earlier + 1000))
            written = batch.sparkSession.read.schema(schema).parquet(*[f"{path}/batch={i}" for i in ids])
            once = once.join(written.select(key), key, "left_anti")
        once.select(batch.columns).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    run_batches(stream, each, folder or new_folder(stream.sparkSession, "ingest-once"))


def rolling_counts(stream: DataFrame, at: str, state: str, length: str = "24 hours", slide: str = "1 hour") -> DataFrame:
    """Counts per state in sliding windows, emitted when a window is closed by the watermark."""
    agg = stream.withWatermark(at, DELAY).groupBy(F.window(at, length, slide), state).agg(F.count(F.lit(1)).alias("n"))
    flat = agg.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), state, "n")
    return run_append(flat, new_folder(stream.sparkSession, "rolling-counts"))


def hourly_starts(stream: DataFrame, at: str) -> DataFrame:
    """Rows per tumbling hour."""
    agg = stream.withWatermark(at, DELAY).groupBy(F.window(at, "1 hour")).agg(F.count(F.lit(1)).alias("n"))
    flat = agg.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "n")
    return run_append(flat, new_folder(stream.sparkSession, "hourly-starts"))


def reader_sessions(stream: DataFrame, user: str, at: str, gap: str = "30 minutes") -> DataFrame:
    """Sessions of each user: events with gaps below ``gap``."""
    agg = stream.withWatermark(at, DELAY).groupBy(F.session_window(at, gap), user).agg(F.count(F.lit(1)).alias("n"))
    flat = agg.select(user, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")
    return run_append(flat, new_folder(stream.sparkSession, "reader-sessions"))


def silent_keys(stream: DataFrame, key: str, at: str, minutes: int = 30) -> DataFrame:
    """Keys without an event for ``minutes``, by event time. The state is one time per key and a
    micro-batch only contributes its maximum, read chunk by chunk."""

    def track(k, frames, state: GroupState):
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({key: [k[0]], "last_event_us": [last]})
            return
        last = state.get[0] if state.exists else 0
        for pdf in frames:
            last = max(last, int(pdf["_us"].max()))
        state.update((last,))
        # A deadline the watermark has already passed fires as soon as allowed.
        state.setTimeoutTimestamp(max(last // 1000 + 1 + minutes * 60_000, state.getCurrentWatermarkMs() + 1))

    kind = stream.schema[key].dataType.simpleString()
    rows = stream.withWatermark(at, DELAY).select(key, at, F.unix_micros(at).alias("_us"))
    out = rows.groupBy(key).applyInPandasWithState(track, f"{key} {kind}, last_event_us bigint", "last bigint", "append",
                                                   GroupStateTimeout.EventTimeTimeout)
    return run_append(out, new_folder(stream.sparkSession, "silent-keys"))


def retry_updates(stream: DataFrame, as_of: str, folder: str | None = None) -> DataFrame:
    """Current retry table after all delivery attempts of the stream: the latest attempt per event
    decides, in whatever order they come. stream: event_id, status, attempts, available_at."""
    spark, schema = stream.sparkSession, stream.schema
    folder = folder or new_folder(spark, "retry-table")

    def each(batch: DataFrame, batch_id: int) -> None:
        own = Tables(batch.sparkSession, folder, {"state": schema})
        last = own.last(batch_id)
        both = own.read("state", last.batch_id if last else None).unionByName(batch)
        own.write("state", history.latest(both, ["event_id"], ["attempts", "available_at"]), batch_id)
        own.commit(batch_id, None, None, 0)

    run_batches(stream, each, folder)
    tables = Tables(spark, folder, {"state": schema})
    last = tables.last()
    current = tables.read("state", last.batch_id if last else None).withColumn("available_at", F.col("available_at").cast("timestamp_ntz"))
    return workflow.retry_table(current, as_of)
