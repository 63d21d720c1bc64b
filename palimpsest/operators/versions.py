"""Identity and version resolution of extracted observations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.keys import fingerprint
from palimpsest.operators.history import first


def resolve(observations: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Evidence rows: each observation with its identity (by collection and URL, aliases followed
    one hop) and its version (by identity and content hash).

    observations: observation_id, artifact_id, collection_id, identity_url, content_sha256, title,
    retrieved_at; aliases: identity_id, superseded_by."""
    keyed = observations.withColumn("identity_id", fingerprint(F.col("collection_id"), F.col("identity_url")))
    if aliases is not None:
        keyed = keyed.join(aliases.filter("superseded_by is not null").select("identity_id", "superseded_by"), "identity_id", "left").withColumn(
            "identity_id", F.coalesce("superseded_by", "identity_id")).drop("superseded_by")
    version = fingerprint(F.col("identity_id"), F.col("content_sha256"))
    out = keyed.withColumn("version_id", version)
    return out.withColumn("evidence_id", fingerprint(F.col("version_id"), F.col("observation_id")))


def identities(evidence: DataFrame) -> DataFrame:
    """One row per identity, titled by its first observation."""
    rows = evidence.select("identity_id", "collection_id", "identity_url", "title", "retrieved_at", "observation_id")
    return first(rows, ["identity_id"], ["retrieved_at", "observation_id"])


def versions(evidence: DataFrame) -> DataFrame:
    """One row per (identity, content), created when first observed."""
    rows = evidence.select("version_id", "identity_id", "content_sha256", "title", "retrieved_at", "observation_id")
    seen = evidence.groupBy("version_id").agg(F.count(F.lit(1)).alias("observation_count"))
    return first(rows, ["version_id"], ["retrieved_at", "observation_id"]).withColumnRenamed("retrieved_at", "created_at").join(seen, "version_id")
