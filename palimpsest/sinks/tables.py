"""Idempotent appends and the rows that sinks emit."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from palimpsest.functions.keys import canonical_json, content_key, fingerprint


def new_rows(rows: DataFrame, existing: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """Rows whose natural key is not in the table yet, one per key."""
    fresh = rows.dropDuplicates(list(keys))
    return fresh if existing is None else fresh.join(existing.select(*keys), list(keys), "left_anti")


def append_new(rows: DataFrame, path: str, keys: Sequence[str], partition_by: Sequence[str] = ()) -> None:
    """Append only rows with new keys to a parquet table; running twice adds nothing. One writer
    per table is assumed."""
    spark = rows.sparkSession
    try:
        existing = spark.read.schema(rows.schema).parquet(path)
    except AnalysisException:
        existing = None
    out = new_rows(rows, existing, keys).write.mode("append")
    (out.partitionBy(*partition_by) if partition_by else out).parquet(path)


def content_addressed(blobs: DataFrame, content: str, namespace: str = "") -> DataFrame:
    """Content rows with sha256, byte size and storage key, one per hash."""
    rows = blobs.withColumn("sha256", F.sha2(F.col(content), 256)).withColumn("byte_size", F.octet_length(content))
    return rows.withColumn("storage_key", content_key(F.col("sha256"), namespace)).dropDuplicates(["sha256"])


def put_blobs(blobs: DataFrame, content: str, path: str, namespace: str = "") -> None:
    """Put-if-absent of content-addressed rows, partitioned by the first hash byte."""
    rows = content_addressed(blobs, content, namespace).withColumn("prefix", F.substring("sha256", 1, 2))
    append_new(rows, path, ["prefix", "sha256"], ["prefix"])


def pipeline_events(rows: DataFrame, event_type: str, aggregate_type: str, aggregate_id: Column, occurred_at: Column,
                    payload: Mapping[str, Column]) -> DataFrame:
    """Event rows with canonical JSON payload; write once for the event table, and projected by
    :func:`outbox_rows` for the outbox."""
    body = canonical_json(**payload)
    return rows.select(fingerprint(F.lit(event_type), aggregate_id, body).alias("event_id"), F.lit(event_type).alias("event_type"),
                       F.lit(aggregate_type).alias("aggregate_type"), aggregate_id.cast("string").alias("aggregate_id"),
                       occurred_at.alias("occurred_at"), body.alias("payload"))


def outbox_rows(events: DataFrame) -> DataFrame:
    return events.select("event_id", F.col("event_type").alias("topic"), F.lit("pending").alias("status"),
                         F.lit(0).alias("attempts"), F.col("occurred_at").alias("available_at"), "payload")


def audit_events(rows: DataFrame, action: Column, target_type: str, target_id: Column, actor_id: Column,
                 occurred_at: Column, details: Mapping[str, Column]) -> DataFrame:
    body = canonical_json(**details)
    return rows.select(fingerprint(action, target_id, actor_id, body).alias("event_id"), action.alias("action"),
                       F.lit(target_type).alias("target_type"), target_id.cast("string").alias("target_id"),
                       F.substring(actor_id.cast("string"), 1, 255).alias("actor_id"), occurred_at.alias("occurred_at"), body.alias("details"))


def inventory(artifacts: DataFrame) -> DataFrame:
    """Artifact list in hash order. A total order over many files, not one sorted file."""
    return artifacts.select("sha256", "byte_size", "storage_key").orderBy("sha256")


def inventory_totals(artifacts: DataFrame) -> DataFrame:
    return artifacts.agg(F.count(F.lit(1)).alias("artifact_count"), F.sum("byte_size").alias("byte_total"))


def write_inventory(artifacts: DataFrame, path: str) -> None:
    """Inventory as JSON lines, range-partitioned and sorted by hash."""
    inventory(artifacts).write.mode("overwrite").json(path)
