"""Registered streams over the event log; each runs until its input is used up."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.plans.registry import query
from palimpsest.session import shared_folder
from palimpsest.streaming import streams
from palimpsest.streaming.state import events as event_stream
from palimpsest.streaming.state import new_folder


def source(t):
    shared_folder(t.spark)
    return event_stream(t.spark, t.sf_dir, "events.parquet", t.events.schema)


def _us(c):
    return F.unix_micros(c)


@query("stream_changed_content", "R1", """
SELECT observation_id, lag(observation_id) OVER w AS previous_observation_id, lag(observation_id) OVER w IS NULL OR content_sha256 IS DISTINCT FROM lag(content_sha256) OVER w AS content_changed
FROM observation WINDOW w AS (PARTITION BY resource_id ORDER BY checked_at, observation_id)""")
def stream_changed_content(t):
    k = F.get_json_object("props", "$.k")
    rows = source(t).select(F.col("event_id").alias("observation_id"), F.col("user_id").alias("resource_id"), F.col("ts").alias("checked_at"),
                            F.when(F.col("event_type") != "click", F.sha2(F.substring(k, 1, 1), 256)).alias("content_sha256"))
    return streams.changed_content(rows).select("observation_id", "previous_observation_id", "content_changed")


@query("stream_failure_streaks", "R2", "SELECT run_id, endpoint_id, consecutive_failures, health_state FROM streak")
def stream_failure_streaks(t):
    failed = F.col("event_type").isin("error", "click", "view") & (F.col("value") > 15)
    rows = source(t).select(F.col("event_id").alias("run_id"), F.col("user_id").alias("endpoint_id"), F.col("ts").alias("finished_at"),
                            F.when(failed, "failed").otherwise("completed").alias("status"))
    return streams.failure_streaks(rows).select("run_id", "endpoint_id", "consecutive_failures", "health_state")


@query("stream_status_signals", "R3", "SELECT assessment_id, endpoint_id, signal FROM signal")
def stream_status_signals(t):
    kind = F.col("event_type")
    status = F.when(kind == "error", "critical").when(kind == "purchase", "warning").when(kind == "click", "processing").otherwise("healthy")
    rows = source(t).select(F.col("event_id").alias("assessment_id"), F.col("user_id").alias("endpoint_id"), F.col("ts").alias("assessed_at"), status.alias("status"))
    return streams.status_signals(rows).select("assessment_id", "endpoint_id", "signal")


@query("stream_ingest_once", "R4 K1", "SELECT user_id || '/' || json_extract_string(props, '$.k') AS idempotency_key, count(DISTINCT 1) AS n, epoch_us(min(ts)) AS first_us FROM events GROUP BY 1")
def stream_ingest_once(t):
    key = F.concat_ws("/", F.col("user_id").cast("string"), F.get_json_object("props", "$.k"))
    rows = source(t).select(key.alias("idempotency_key"), "ts", "event_id")
    path = new_folder(t.spark, "ingested")
    streams.ingest_once(rows, "idempotency_key", "ts", path)
    return t.spark.read.parquet(path).groupBy("idempotency_key").agg(F.count(F.lit(1)).alias("n"), F.min(_us("ts")).alias("first_us"))


_CLOSED = "(SELECT epoch_us(max(ts)) - 3600000000 FROM events)"


@query("stream_rolling_counts", "R5 A25", f"""
SELECT epoch_us(time_bucket(INTERVAL '1 hour', ts) - to_hours(k)) AS window_start_us, event_type, count(*) AS n FROM events, range(24) AS r(k)
WHERE epoch_us(time_bucket(INTERVAL '1 hour', ts) - to_hours(k)) + 86400000000 <= {_CLOSED} GROUP BY ALL""")
def stream_rolling_counts(t):
    out = streams.rolling_counts(source(t), "ts", "event_type")
    return out.select(_us("window_start").alias("window_start_us"), "event_type", "n")


@query("stream_hourly_starts", "R6", f"""
SELECT epoch_us(date_trunc('hour', ts)) AS window_start_us, count(*) AS n FROM events GROUP BY 1 HAVING epoch_us(date_trunc('hour', ts)) + 3600000000 <= {_CLOSED}""")
def stream_hourly_starts(t):
    return streams.hourly_starts(source(t), "ts").select(_us("window_start").alias("window_start_us"), "n")


@query("stream_silent_keys", "R7", """
SELECT user_id, epoch_us(max(ts)) AS last_event_us FROM events GROUP BY 1 HAVING max(ts) + to_minutes(30) < (SELECT max(ts) FROM events) - to_hours(1)""")
def stream_silent_keys(t):
    return streams.silent_keys(source(t), "user_id", "ts")


@query("stream_reader_sessions", "R8", f"""
SELECT user_id, epoch_us(min(ts)) AS session_start_us, count(*) AS n FROM (
  SELECT *, count(*) FILTER (WHERE fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *, coalesce(ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + to_minutes(30), true) AS fresh FROM events))
GROUP BY user_id, g HAVING epoch_us(max(ts)) + 1800000000 <= {_CLOSED}""")
def stream_reader_sessions(t):
    out = streams.reader_sessions(source(t), "user_id", "ts")
    return out.select("user_id", _us("session_start").alias("session_start_us"), "n")


@query("stream_link_states", "R9", """
WITH o AS (SELECT user_id, ts, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, json_extract_string(props, '$.k') AS k FROM events),
 l AS (SELECT user_id, n, unnest([event_type, 'k' || substr(k, 1, 1)]) AS target_url FROM o)
SELECT o.event_id AS observation_id, target_url, state FROM (SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.n, b.n + 1) AS n, coalesce(a.target_url, b.target_url) AS target_url,
  CASE WHEN b.n IS NULL THEN 'added' WHEN a.n IS NULL THEN 'removed' ELSE 'retained' END AS state FROM l a FULL OUTER JOIN l b ON a.user_id = b.user_id AND a.target_url = b.target_url AND a.n = b.n + 1) JOIN o USING (user_id, n)""")
def stream_link_states(t):
    found = F.array("event_type", F.concat(F.lit("k"), F.substring(F.get_json_object("props", "$.k"), 1, 1)))
    rows = source(t).select(F.col("user_id").alias("resource_id"), F.col("event_id").alias("observation_id"), F.col("ts").alias("checked_at"), F.explode(found).alias("target_url"))
    rows = rows.withColumn("row_id", F.concat_ws("|", F.col("observation_id").cast("string"), "target_url"))
    return streams.link_states(rows).select("observation_id", "target_url", "state")


@query("stream_retry_table", "R10 W21", """
SELECT event_id, attempts, CASE WHEN attempts >= 8 THEN 'terminal' WHEN last_at <= timestamp '2024-01-29 00:00:00' THEN 'eligible' ELSE 'waiting' END AS delivery_state, CASE WHEN attempts < 8 THEN cast(least(60, pow(2, greatest(0, attempts - 1))) AS int) END AS retry_minutes
FROM (SELECT event_id, max(attempts) AS attempts, arg_max(last_at, attempts) AS last_at FROM (SELECT cast(json_extract_string(props, '$.k') AS bigint) AS event_id, user_id AS attempts, max(ts) AS last_at FROM events GROUP BY ALL) GROUP BY 1)""")
def stream_retry_table(t):
    rows = source(t).select(F.get_json_object("props", "$.k").cast("bigint").alias("event_id"), F.lit("failed").alias("status"),
                            F.col("user_id").cast("int").alias("attempts"), F.col("ts").alias("available_at"))
    return streams.retry_updates(rows, "2024-01-29 00:00:00").select("event_id", "attempts", "delivery_state", "retry_minutes")
