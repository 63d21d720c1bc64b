"""Evidence graph: node and edge tables projected from the document tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.keys import fingerprint


def _node(df: DataFrame, kind: str, source: Column, key: Column, label: Column) -> DataFrame:
    return df.select(F.concat_ws(":", F.lit(kind), source.cast("string")).alias("node_id"), F.lit(kind).alias("node_type"),
                     source.cast("string").alias("source_id"), key.alias("canonical_key"), label.alias("label"))


def nodes(authorities: DataFrame, collections: DataFrame, identities: DataFrame, versions: DataFrame,
          sections: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Six node projections, one row per (type, source)."""
    c, s = F.col, lambda *x: F.concat_ws(":", *x)
    parts = [
        _node(authorities, "authority", c("authority_id"), s(F.lit("authority"), c("authority_id")), c("authority_id")),
        _node(collections, "collection", c("collection_id"), s(F.lit("collection"), c("authority_id"), c("collection_id")), c("collection_id")),
        _node(identities, "document", c("identity_id"), s(F.lit("document"), c("identity_id")), F.coalesce("title", "identity_id")),
        _node(versions, "version", c("version_id"), s(F.lit("version"), c("identity_id"), c("content_sha256")), F.coalesce("title", "identity_id")),
        _node(sections, "section", c("section_id"), s(F.lit("section"), c("section_id")), F.substring("text", 1, 160)),
        _node(artifacts, "artifact", c("artifact_id"), s(F.lit("artifact:sha256"), c("artifact_id")),
              F.concat(F.lit("SHA-256 "), F.substring("artifact_id", 1, 16), F.lit("…"))),
    ]
    # Only artifacts can repeat across versions; dropping on the id keeps one row each.
    return reduce(DataFrame.unionByName, parts).groupBy("node_id").agg(*[
        F.min(x).alias(x) for x in ("node_type", "source_id", "canonical_key", "label")])


def _edge(df: DataFrame, subject: tuple[str, str], predicate: str, obj: tuple[str, str], source_type: str, source: str) -> DataFrame:
    node = lambda kind, col: F.concat_ws(":", F.lit(kind), F.col(col).cast("string"))
    a, b = node(*subject), node(*obj)
    return df.select(fingerprint(a, F.lit(predicate), b, F.lit(source_type), F.col(source)).alias("edge_id"), a.alias("subject_id"),
                     F.lit(predicate).alias("predicate"), b.alias("object_id"), F.lit(source_type).alias("source_type"))


def edges(collections: DataFrame, identities: DataFrame, versions: DataFrame, sections: DataFrame, evidence: DataFrame) -> DataFrame:
    """Six edge projections, unique by fingerprint. sections carry artifact_id; evidence:
    evidence_id, version_id, artifact_id."""
    parts = [
        _edge(collections, ("authority", "authority_id"), "has_collection", ("collection", "collection_id"), "publication_collection", "collection_id"),
        _edge(identities, ("collection", "collection_id"), "has_document", ("document", "identity_id"), "document_identity", "identity_id"),
        _edge(versions, ("document", "identity_id"), "has_version", ("version", "version_id"), "document_version", "version_id"),
        _edge(sections, ("version", "version_id"), "has_section", ("section", "section_id"), "normalized_section", "section_id"),
        _edge(sections, ("section", "section_id"), "derived_from", ("artifact", "artifact_id"), "normalized_section", "section_id"),
        _edge(evidence, ("version", "version_id"), "derived_from", ("artifact", "artifact_id"), "version_evidence", "evidence_id"),
    ]
    return reduce(DataFrame.unionByName, parts).dropDuplicates(["edge_id"])


def neighbours(edge_table: DataFrame, wanted: DataFrame) -> DataFrame:
    """Outgoing and incoming edges of the wanted nodes (node_id)."""
    w = wanted.select("node_id").distinct()
    out = edge_table.join(w, F.col("subject_id") == F.col("node_id")).select("node_id", F.lit("outgoing").alias("direction"), "predicate", F.col("object_id").alias("neighbour_id"), "edge_id")
    inc = edge_table.join(w, F.col("object_id") == F.col("node_id")).select("node_id", F.lit("incoming").alias("direction"), "predicate", F.col("subject_id").alias("neighbour_id"), "edge_id")
    return out.unionByName(inc)
