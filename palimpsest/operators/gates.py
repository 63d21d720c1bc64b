"""Named boolean gates in long form, and the admission and acceptance reports built from them.

Gate names are fixed values, listed in the order in which gates are reported.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import urls
from palimpsest.operators.history import first, top_n
from palimpsest.operators.reliability import of_ids, recent_runs


def to_gates(df: DataFrame, key: str, gates: Mapping[str, Column]) -> DataFrame:
    """One row per gate: key, gate, passed (null tests count as failed)."""
    rows = F.array(*[F.struct(F.lit(name).alias("gate"), F.coalesce(test, F.lit(False)).alias("passed"))
                     for name, test in gates.items()])
    return df.select(key, F.inline(rows))


def gate_rollup(gates: DataFrame, key: str) -> DataFrame:
    return gates.groupBy(key).agg(F.count(F.lit(1)).alias("gate_count"), F.count_if("passed").alias("passed_count"),
                                  F.bool_and("passed").alias("ready"))


def _precision(runs: DataFrame, candidate_obs: DataFrame, domains: Sequence[str], prefixes: Sequence[str],
               extensions: Sequence[str], maximum: int, required: int) -> DataFrame:
    """Per endpoint over its last runs: all candidate counts within bounds, all URLs qualifying."""
    allowed = F.array(*[F.lit(d) for d in domains])
    last = recent_runs(runs, required).select("endpoint_id", "run_id")
    rows = of_ids(candidate_obs, last, "run_id").select("run_id", "canonical_url").distinct()
    good = F.coalesce(urls.document_url(F.col("canonical_url"), allowed, prefixes, extensions), F.lit(False))
    per_run = rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("_n"), F.bool_and(good).alias("_good"))
    j = last.join(per_run, "run_id", "left")
    n = F.coalesce("_n", F.lit(0))
    return j.groupBy("endpoint_id").agg(
        F.bool_and((n > 0) & (n <= maximum)).alias("bounded"), F.bool_and(F.coalesce("_good", F.lit(False))).alias("precise"))


def static_admission(assessed: DataFrame, runs: DataFrame, candidate_obs: DataFrame, repeat: DataFrame,
                     observations: DataFrame, approved_content: DataFrame, setup: DataFrame, *, domains: Sequence[str],
                     prefixes: Sequence[str] = (), extensions: Sequence[str] = urls.DOCUMENT_EXTENSIONS,
                     max_candidates: int = 20, required: int = 2) -> DataFrame:
    """The fifteen admission gates of every listing source.

    assessed: output of ``reliability.assess``; repeat: output of ``reliability.repeatability``;
    observations: run_id, response_status, final_url; approved_content: endpoint_id,
    content_ready (candidates of the latest run with an approved content type); setup: endpoint_id,
    promoted, has_snapshot, config_version, run-level config_version in ``runs``."""
    allowed = F.array(*[F.lit(d) for d in domains])
    last = recent_runs(runs, required)
    status_ok = F.col("response_status").between(200, 299) | (F.col("response_status") == 304)
    ok = F.coalesce(status_ok & urls.host_allowed(urls.host(F.col("final_url")), allowed), F.lit(False))
    per_run = of_ids(observations, last, "run_id").groupBy("run_id").agg(F.bool_or(ok).alias("_seen"))
    evidence = (last.join(per_run, "run_id", "left").join(setup.select("endpoint_id", F.col("config_version").alias("_want")), "endpoint_id", "left")
                .groupBy("endpoint_id").agg(F.bool_and(F.coalesce("_seen", F.lit(False))).alias("_evidence"),
                                            F.bool_and(F.col("config_version").eqNullSafe(F.col("_want"))).alias("_config")))
    j = (assessed.join(repeat.withColumnRenamed("repeatable", "_repeatable"), "endpoint_id", "left")
         .join(evidence, "endpoint_id", "left").join(approved_content, "endpoint_id", "left").join(setup, "endpoint_id", "left")
         .join(_precision(runs, candidate_obs, domains, prefixes, extensions, max_candidates, required), "endpoint_id", "left"))
    n, s, enough = F.col("candidate_count"), F.col("section_count"), F.coalesce("enough_runs", F.lit(False))
    full = lambda c: (n > 0) & (F.col(c) == n)
    return to_gates(j, "endpoint_id", {
        "controlled_activation": (~F.col("is_enabled") & F.col("next_poll_at").isNull()) | F.col("promoted"),
        "source_pack_snapshot": F.col("has_snapshot"),
        "completed_run_count": enough,
        "connector_evidence": enough & F.col("config_version").isNotNull() & F.col("_config"),
        "immutable_endpoint_evidence": enough & F.col("_evidence"),
        "bounded_candidates": enough & F.col("bounded"),
        "candidate_precision": enough & F.col("precise"),
        "repeatability": F.col("_repeatable"),
        "no_unexplained_disappearance": enough & (F.col("disappeared") == 0),
        "artifact_preservation": full("artifact_ready"),
        "document_content_types": (n > 0) & (F.col("content_ready") == n),
        "extraction_coverage": full("extraction_ready"),
        "knowledge_graph_coverage": full("graph_ready") & (F.col("version_count") >= n) & (s > 0),
        "local_embedding_coverage": (s > 0) & (F.col("local_embedding_ready") == s),
        "configured_embedding_coverage": (s > 0) & (F.col("configured_embedding_ready") == s),
    })


def browser_admission(endpoints: DataFrame, captures: DataFrame, *, required: int = 2) -> DataFrame:
    """The nine admission gates of every browser source from its last captures.

    captures, one row each: endpoint_id, capture_id, finished_at, immutable_evidence, bounded,
    raw_count (qualifying links without the browser), rendered_count, precise, set_sha256,
    lineage_ready, lineage_total; endpoints: endpoint_id, is_enabled, next_poll_at, promoted,
    has_snapshot."""
    last = top_n(captures, ["endpoint_id"], [F.desc("finished_at"), F.desc("capture_id")], required, "recency")
    newest = F.col("recency") == 1
    agg = last.groupBy("endpoint_id").agg(
        F.count(F.lit(1)).alias("_n"), F.bool_and("immutable_evidence").alias("_immutable"), F.bool_and("bounded").alias("_bounded"),
        F.bool_and((F.col("raw_count") >= 0) & (F.col("rendered_count") > F.col("raw_count"))).alias("_lift"),
        F.bool_and("precise").alias("_precise"), (F.min("set_sha256") == F.max("set_sha256")).alias("_same"),
        F.max(F.when(newest, F.col("lineage_ready"))).alias("_ready"), F.max(F.when(newest, F.col("lineage_total"))).alias("_total"))
    j = endpoints.join(agg, "endpoint_id", "left")
    enough = F.coalesce(F.col("_n") == required, F.lit(False))
    return to_gates(j, "endpoint_id", {
        "controlled_activation": (~F.col("is_enabled") & F.col("next_poll_at").isNull()) | F.col("promoted"),
        "source_pack_snapshot": F.col("has_snapshot"),
        "repeat_capture_count": enough,
        "immutable_evidence": enough & F.col("_immutable"),
        "bounded_network": enough & F.col("_bounded"),
        "browser_only_lift": enough & F.col("_lift"),
        "candidate_precision": enough & F.col("_precise"),
        "repeatability": enough & F.col("_same"),
        "downstream_lineage": (F.col("_total") > 0) & (F.col("_ready") == F.col("_total")),
    })


def cycle_acceptance(sources: DataFrame, runs: DataFrame, run_facts: DataFrame, as_of: str, *,
                     freshness_grace: int = 60, pipeline_grace: int = 30) -> DataFrame:
    """Whether each admitted source's first scheduled run after its baseline was sound.

    sources: endpoint_id, baseline_at, first_due_at, next_poll_at; run_facts per run: run_id,
    observed_count, artifact_count, failed_fetches, reliability_status. Output: endpoint_id,
    run_id, status (passed, pending, failed), failed_gates."""
    now = F.expr(f"timestamp_ntz'{as_of}'")
    after = (runs.filter("trigger = 'scheduled'").join(sources.select("endpoint_id", "baseline_at"), "endpoint_id")
             .filter("created_at >= baseline_at").drop("baseline_at"))
    run = first(after.select("endpoint_id", "run_id", "status", "created_at", "started_at", "finished_at", "discovered_count"),
                ["endpoint_id"], ["created_at", "run_id"])
    j = sources.join(run, "endpoint_id", "left").join(run_facts, "run_id", "left")
    gates = {
        "candidate_observation_coverage": (F.col("observed_count") == F.col("discovered_count")) & (F.col("observed_count") > 0),
        "artifact_observation_coverage": F.col("artifact_count") == F.col("observed_count"),
        "bounded_fetches_succeeded": F.coalesce("failed_fetches", F.lit(0)) == 0,
        "next_poll_advanced": F.col("next_poll_at") > F.col("started_at"),
        "pipeline_reliability_healthy": F.col("reliability_status") == "healthy",
    }
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in gates.items()]))
    j = j.withColumn("_failed", F.when(F.col("status") == "completed", failed).when(
        F.col("status").isin("pending", "running") | F.col("run_id").isNull(), F.array().cast("array<string>")).otherwise(
        F.array(F.lit("scheduled_run_completed"))))
    overdue = now > F.col("first_due_at") + F.make_interval(mins=F.lit(freshness_grace))
    in_grace = F.coalesce(now <= F.col("finished_at") + F.make_interval(mins=F.lit(pipeline_grace)), F.lit(False))
    only_reliability = F.col("_failed") == F.array(F.lit("pipeline_reliability_healthy"))
    status = (
        F.when(F.col("run_id").isNull() & F.col("first_due_at").isNull(), "failed")
        .when(F.col("run_id").isNull(), F.when(overdue, "failed").otherwise("pending"))
        .when(F.col("status").isin("pending", "running"), "pending")
        .when(F.size("_failed") == 0, "passed").when(only_reliability & in_grace, "pending").otherwise("failed"))
    return j.select("endpoint_id", "run_id", status.alias("status"), F.array_join("_failed", ",").alias("failed_gates"))


def acceptance_tally(acceptance: DataFrame) -> DataFrame:
    """One row: counts by status and the overall verdict."""
    count = lambda s: F.count_if(F.col("status") == s)
    overall = (F.when(F.count(F.lit(1)) == 0, "not_applicable").when(count("passed") == F.count(F.lit(1)), "passed")
               .when(count("failed") > 0, "failed").otherwise("pending"))
    return acceptance.agg(F.count(F.lit(1)).alias("source_count"), count("passed").alias("passed_count"),
                          count("pending").alias("pending_count"), count("failed").alias("failed_count"), overall.alias("status"))
