"""Source coverage, freshness, status, confidence and repair plans.

Tables: endpoint(endpoint_id, is_enabled, requires_javascript, health_state, next_poll_at,
polling_interval_minutes), run(run_id, endpoint_id, status, trigger, created_at, finished_at),
candidate_obs(run_id, candidate_id, canonical_url), artifact_obs(observation_id, run_id,
candidate_id, artifact_id, retrieved_at), derivative(source_artifact_id, derived_artifact_id),
extraction(artifact_id, status, created_at), graph_artifact(artifact_id), version_evidence(
version_id, artifact_id), version_section(section_id, version_id, local_ready, configured_ready).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.keys import set_digest
from palimpsest.functions.scalars import safe_ratio
from palimpsest.operators.history import latest, top_n
from palimpsest.session import stage

FRESHNESS_GRACE_MINUTES = 60
PIPELINE_GRACE_MINUTES = 30

# Stage names, in pipeline order; they also begin the coverage finding codes.
STAGES = ("artifact", "extraction", "graph", "local_embedding", "configured_embedding")


def recent_runs(runs: DataFrame, n: int = 2) -> DataFrame:
    """The last ``n`` completed runs of each endpoint, newest first as ``recency`` 1."""
    return top_n(runs.filter("status = 'completed'"), ["endpoint_id"],
                 [F.desc("finished_at"), F.desc("created_at"), F.desc("run_id")], n, "recency")


def of_ids(log: DataFrame, ids: DataFrame, *keys: str) -> DataFrame:
    """The log's rows of the given ids only: histories are cut to what is asked before they are grouped."""
    return log.join(ids.select(*keys).distinct(), list(keys), "left_semi")


def run_sets(candidate_obs: DataFrame) -> DataFrame:
    """Size and digest of every run's URL set; the set itself is never gathered."""
    urls = candidate_obs.select("run_id", "canonical_url").distinct()
    return urls.groupBy("run_id").agg(F.count(F.lit(1)).alias("candidate_count"),
                                      set_digest(F.col("canonical_url")).alias("set_sha256"))


def set_changes(runs: DataFrame, candidate_obs: DataFrame) -> DataFrame:
    """Latest run per endpoint with its set digest, the digest of the run before, and whether the
    two non-empty sets differ."""
    recent = recent_runs(runs, 2)
    two = recent.join(run_sets(of_ids(candidate_obs, recent, "run_id")), "run_id", "left")
    at = lambda r, c: F.max(F.when(F.col("recency") == r, F.col(c)))
    out = two.groupBy("endpoint_id").agg(
        at(1, "run_id").alias("run_id"), at(1, "candidate_count").alias("candidate_count"),
        at(1, "set_sha256").alias("set_sha256"), at(2, "set_sha256").alias("previous_set_sha256"))
    changed = F.coalesce(F.col("set_sha256") != F.col("previous_set_sha256"), F.lit(False))
    return out.withColumn("candidate_count", F.coalesce("candidate_count", F.lit(0))).withColumn("set_changed", changed)


def repeatability(runs: DataFrame, candidate_obs: DataFrame, required: int = 2) -> DataFrame:
    """Over the last ``required`` runs of each endpoint: enough of them, equal URL sets, and how
    many URLs disappeared between neighbours.

    Disappearances are counted on (run, URL) rows: a URL of one run without a row in the next."""
    last = recent_runs(runs, required).select("endpoint_id", "run_id", "recency")
    rows = last.join(candidate_obs.select("run_id", "canonical_url").distinct(), "run_id")
    newer = rows.select("endpoint_id", "canonical_url", (F.col("recency") + 1).alias("recency"), F.lit(True).alias("_kept"))
    gone = (rows.filter("recency > 1").join(newer, ["endpoint_id", "canonical_url", "recency"], "left")
            .groupBy("endpoint_id").agg(F.count_if(F.col("_kept").isNull()).alias("disappeared")))
    sets = last.join(run_sets(of_ids(candidate_obs, last, "run_id")), "run_id", "left").groupBy("endpoint_id").agg(
        F.count(F.lit(1)).alias("run_count"), F.min(F.coalesce("set_sha256", F.lit(""))).alias("_lo"),
        F.max(F.coalesce("set_sha256", F.lit(""))).alias("_hi"))
    out = sets.join(gone, "endpoint_id", "left")
    return out.select("endpoint_id", "run_count", (F.col("run_count") == required).alias("enough_runs"),
                      ((F.col("run_count") == required) & (F.col("_lo") == F.col("_hi"))).alias("repeatable"),
                      F.coalesce("disappeared", F.lit(0)).alias("disappeared"))


def expanded_artifacts(artifact_obs: DataFrame, derivative: DataFrame) -> DataFrame:
    """(run_id, candidate_id, artifact_id): each candidate's artifacts with what was derived from
    them."""
    own = artifact_obs.select("run_id", "candidate_id", "artifact_id").distinct()
    derived = (own.join(derivative.select(F.col("source_artifact_id").alias("artifact_id"), "derived_artifact_id"), "artifact_id")
               .select("run_id", "candidate_id", F.col("derived_artifact_id").alias("artifact_id")))
    return own.unionByName(derived).distinct()


def coverage(latest_runs: DataFrame, candidate_obs: DataFrame, artifact_obs: DataFrame, derivative: DataFrame,
             extraction: DataFrame, graph_artifact: DataFrame, version_evidence: DataFrame,
             version_section: DataFrame) -> DataFrame:
    """Stage coverage of each endpoint's latest run: how many candidates have artifacts,
    extractions and graph nodes, and how many sections of their versions are embedded.

    latest_runs: endpoint_id, run_id."""
    last = latest_runs.select("endpoint_id", "run_id")
    found = last.join(candidate_obs.select("run_id", "candidate_id").distinct(), "run_id")
    totals = found.groupBy("endpoint_id").agg(F.count(F.lit(1)).alias("candidate_count"))
    # Artifacts count whether or not their candidate was listed. Read by three steps, so the union and distinct are done once.
    arts = stage(expanded_artifacts(of_ids(artifact_obs, last, "run_id"), derivative).join(last, "run_id"), "covered-artifacts")
    done = extraction.filter("status = 'succeeded'").select("artifact_id", F.lit(True).alias("_x")).distinct()
    graph = graph_artifact.select("artifact_id", F.lit(True).alias("_g")).distinct()
    flagged = arts.join(done, "artifact_id", "left").join(graph, "artifact_id", "left")
    per = flagged.groupBy("endpoint_id", "candidate_id").agg(
        F.bool_or(F.coalesce("_x", F.lit(False))).alias("_x"), F.bool_or(F.coalesce("_g", F.lit(False))).alias("_g"))
    ready = per.groupBy("endpoint_id").agg(
        F.count(F.lit(1)).alias("artifact_ready"), F.count_if("_x").alias("extraction_ready"), F.count_if("_g").alias("graph_ready"))
    versions = (arts.select("endpoint_id", "artifact_id").distinct()
                .join(version_evidence.select("artifact_id", "version_id"), "artifact_id")
                .select("endpoint_id", "version_id").distinct())
    per_version = of_ids(version_section, versions, "version_id").groupBy("version_id").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if("local_ready").alias("_l"), F.count_if("configured_ready").alias("_c"))
    text = versions.join(per_version, "version_id", "left").groupBy("endpoint_id").agg(
        F.count(F.lit(1)).alias("version_count"), F.sum(F.coalesce("_n", F.lit(0))).alias("section_count"),
        F.sum(F.coalesce("_l", F.lit(0))).alias("local_embedding_ready"),
        F.sum(F.coalesce("_c", F.lit(0))).alias("configured_embedding_ready"))
    out = last.join(totals, "endpoint_id", "left").join(ready, "endpoint_id", "left").join(text, "endpoint_id", "left")
    return out.fillna(0, ["candidate_count", "artifact_ready", "extraction_ready", "graph_ready", "version_count",
                          "section_count", "local_embedding_ready", "configured_embedding_ready"])


def _total(stage: str) -> Column:
    return F.col("section_count" if stage.endswith("embedding") else "candidate_count")


def assess(endpoints: DataFrame, runs: DataFrame, covered: DataFrame, changes: DataFrame, as_of: str,
           captures: DataFrame | None = None) -> DataFrame:
    """Status and findings of every endpoint at ``as_of``.

    covered: output of :func:`coverage`; changes: output of :func:`set_changes`; captures, for
    endpoints that need a browser: run_id, bounded. Findings are an array of struct(code,
    severity) in rule order."""
    now = F.expr(f"timestamp_ntz'{as_of}'")
    last = recent_runs(runs, 1).select("endpoint_id", F.col("run_id").alias("_run"), F.coalesce("finished_at", "created_at").alias("_finished"))
    cov = covered.drop("run_id")
    ch = changes.select("endpoint_id", "set_changed")
    j = endpoints.join(last, "endpoint_id", "left").join(cov, "endpoint_id", "left").join(ch, "endpoint_id", "left")
    if captures is not None:
        j = j.join(captures.select(F.col("run_id").alias("_run"), F.lit(True).alias("_captured"), F.col("bounded").alias("_bounded")), "_run", "left")
    else:
        j = j.withColumn("_captured", F.lit(None).cast("boolean")).withColumn("_bounded", F.lit(None).cast("boolean"))
    minutes = lambda n: F.make_interval(mins=n)
    expected = F.coalesce("next_poll_at", F.col("_finished") + minutes(F.col("polling_interval_minutes")))
    deadline = expected + minutes(F.lit(FRESHNESS_GRACE_MINUTES))
    in_grace = now <= F.col("_finished") + minutes(F.lit(PIPELINE_GRACE_MINUTES))
    count = F.coalesce("candidate_count", F.lit(0))
    js = F.col("requires_javascript")
    # Finding codes and severities, in rule order.
    rules = [
        ("endpoint_unhealthy", "critical", F.col("health_state") == "unhealthy"),
        ("endpoint_degraded", "warning", F.col("health_state") == "degraded"),
        ("source_stale", "critical", now > deadline),
        ("no_candidates", "critical", count == 0),
        ("browser_capture_missing", "critical", js & ~F.coalesce("_captured", F.lit(False))),
        ("browser_network_unverified", "critical", js & ~F.coalesce("_bounded", F.lit(False))),
    ]
    found = [F.when(test, F.struct(F.lit(code).alias("code"), F.lit(sev).alias("severity"))) for code, sev, test in rules]
    for name in STAGES:
        ready, total = F.coalesce(f"{name}_ready", F.lit(0)), F.coalesce(_total(name), F.lit(0))
        # Zero of zero still counts as incomplete unless the run found nothing at all.
        incomplete = ~((ready == total) & ((total > 0) | (count == 0)))
        found.append(F.when(incomplete, F.struct(F.lit(f"{name}_coverage").alias("code"),
                                                 F.when(in_grace, "info").otherwise("warning").alias("severity"))))
    found.append(F.when(F.coalesce("set_changed", F.lit(False)), F.struct(
        F.lit("candidate_set_changed").alias("code"), F.lit("info").alias("severity"))))
    none = F.array(F.struct(F.lit("no_completed_run").alias("code"), F.lit("warning").alias("severity")))
    empty = F.array().cast("array<struct<code:string,severity:string>>")
    findings = (F.when(~F.col("is_enabled"), empty).when(F.col("_run").isNull(), none)
                .otherwise(F.array_compact(F.array(*found))))
    j = j.withColumn("findings", findings)
    has = lambda sev: F.exists("findings", lambda f: f["severity"] == sev)
    processing = F.exists("findings", lambda f: (f["severity"] == "info") & f["code"].endswith("_coverage"))
    status = (F.when(~F.col("is_enabled"), "disabled").when(has("critical"), "critical").when(has("warning"), "warning")
              .when(processing, "processing").otherwise("healthy"))
    return j.select(*endpoints.columns, F.col("_run").alias("run_id"), status.alias("status"), "findings",
                    deadline.alias("freshness_deadline"), F.coalesce("set_changed", F.lit(False)).alias("set_changed"),
                    *[F.coalesce(c, F.lit(0)).alias(c) for c in ("candidate_count", "version_count", "section_count", *[f"{s}_ready" for s in STAGES])])


def coverage_percent() -> Column:
    """Mean of the five stage ratios in percent, rounded; an empty total counts as zero."""
    ratios = [F.coalesce(safe_ratio(F.col(f"{s}_ready"), _total(s)), F.lit(0.0)) for s in STAGES]
    return F.bround(sum(ratios[1:], ratios[0]) / len(ratios) * 100, 0).cast("int")


def confidence(assessed: DataFrame, runs: DataFrame, admission_ready: DataFrame) -> DataFrame:
    """Confidence state and coverage percent of each endpoint. admission_ready: endpoint_id of
    sources whose latest admission assessment is ready."""
    completed = runs.filter("status = 'completed'").groupBy("endpoint_id").agg(F.count(F.lit(1)).alias("completed_runs"))
    ready = admission_ready.select("endpoint_id", F.lit(True).alias("_ready")).distinct()
    j = assessed.join(completed, "endpoint_id", "left").join(ready, "endpoint_id", "left")
    state = (F.when(F.col("status") == "healthy", "operational").when(F.col("status") == "processing", "processing")
             .when(F.col("is_enabled"), "attention").when(F.col("_ready"), "admission_ready")
             .when(F.col("completed_runs") > 0, "pilot_evidence").otherwise("registered"))
    return j.select("endpoint_id", "is_enabled", "status", state.alias("state"), coverage_percent().alias("coverage_percent"),
                    F.coalesce("completed_runs", F.lit(0)).alias("completed_runs"))


def repair_plan(runs: DataFrame, candidate_obs: DataFrame, artifact_obs: DataFrame, fetches: DataFrame,
                derivative: DataFrame, extraction: DataFrame, ocr_runs: DataFrame, version_evidence: DataFrame,
                version_section: DataFrame, graph_version: DataFrame) -> DataFrame:
    """Missing stages of each endpoint's latest run as actions (endpoint_id, kind, object_id), one
    per kind and object.

    fetches: run_id, candidate_id, status; ocr_runs: artifact_id, status, created_at, run_id;
    graph_version: version_id."""
    last = recent_runs(runs, 1).select("endpoint_id", "run_id")
    todo = stage(last.join(candidate_obs.select("run_id", "candidate_id").distinct(), "run_id"), "repair-todo")
    # Without nulls both uses of it are one plan, so it is made once.
    own = of_ids(artifact_obs.filter("artifact_id is not null"), todo, "candidate_id").select("candidate_id", "artifact_id").distinct()
    every = stage(own.unionByName(own.join(derivative.select(F.col("source_artifact_id").alias("artifact_id"), "derived_artifact_id"), "artifact_id")
                                  .select("candidate_id", F.col("derived_artifact_id").alias("artifact_id"))), "repair-artifacts")
    # A candidate with a succeeded or active extraction needs neither fetch, OCR nor extraction. Mostly few are left,
    # and only their histories are ordered.
    settled = every.join(extraction.filter(F.col("status").isin("succeeded", "pending", "running")), "artifact_id", "left_semi")
    open_ = stage(todo.join(settled.select("candidate_id").distinct(), "candidate_id", "left_anti"), "repair-open")
    seen = stage(of_ids(artifact_obs, open_, "candidate_id").select("candidate_id", "artifact_id", "retrieved_at", "observation_id"), "repair-seen")
    newest = latest(seen, ["candidate_id"], ["retrieved_at", "observation_id"]).select("candidate_id", F.col("artifact_id").alias("_newest"))
    ended = (of_ids(fetches.filter(F.col("status").isin("succeeded", "not_modified")), open_, "run_id", "candidate_id")
             .select("run_id", "candidate_id", F.lit(True).alias("_ended")).distinct())
    asked = extraction.filter("status = 'ocr_required'").select("artifact_id", "created_at")
    needs_ocr = stage(seen.select("candidate_id", "artifact_id").distinct().join(asked, "artifact_id").groupBy("candidate_id")
                      .agg(F.max_by("artifact_id", F.struct("created_at", "artifact_id")).alias("_ocr_artifact")), "repair-ocr")
    picked = needs_ocr.select(F.col("_ocr_artifact").alias("artifact_id"))
    ocr = (of_ids(ocr_runs, picked, "artifact_id").groupBy(F.col("artifact_id").alias("_ocr_artifact"))
           .agg(F.max_by("status", F.struct("created_at", "run_id")).alias("_ocr_status")))
    derived = (of_ids(derivative, picked.withColumnRenamed("artifact_id", "source_artifact_id"), "source_artifact_id")
               .groupBy(F.col("source_artifact_id").alias("_ocr_artifact")).agg(F.max("derived_artifact_id").alias("_derived")))
    j = (open_.join(newest, "candidate_id", "left").join(ended, ["run_id", "candidate_id"], "left").join(needs_ocr, "candidate_id", "left")
         .join(ocr, "_ocr_artifact", "left").join(derived, "_ocr_artifact", "left"))
    no_artifact = F.col("_newest").isNull()
    kind = (F.when(no_artifact & F.coalesce("_ended", F.lit(False)), "manual_review").when(no_artifact, "fetch_candidate")
            .when(F.col("_ocr_artifact").isNull(), "extract_artifact")
            .when(F.col("_ocr_status") == "running", None).when(F.col("_ocr_status") == "permanent_failure", "manual_review")
            .when(F.col("_ocr_status") == "succeeded", "extract_artifact").otherwise("ocr_artifact"))
    target = (F.when(no_artifact, F.col("candidate_id").cast("string")).when(F.col("_ocr_artifact").isNull(), F.col("_newest"))
              .when(F.col("_ocr_status") == "succeeded", F.coalesce("_derived", "_ocr_artifact")).otherwise(F.col("_ocr_artifact")))
    first = j.select("endpoint_id", kind.alias("kind"), target.alias("object_id")).filter("kind is not null").distinct()
    # Versions are judged once each, before they are dealt out to the endpoints whose candidates they stem from.
    sections = version_section.select("version_id", F.lit(True).alias("_section"), F.lit(False).alias("_graph"),
                                      F.coalesce(F.col("local_ready") & F.col("configured_ready"), F.lit(False)).alias("_ready"))
    graph = graph_version.select("version_id", F.lit(False).alias("_section"), F.lit(True).alias("_graph"), F.lit(True).alias("_ready"))
    complete = (sections.unionByName(graph).groupBy("version_id").agg(*[F.bool_or(c).alias(c) for c in ("_section", "_graph")], F.bool_and("_ready").alias("_ready"))
                .filter("_section and _graph and _ready").select("version_id"))
    lacking = (every.join(version_evidence.select("artifact_id", "version_id"), "artifact_id").select("candidate_id", "version_id")
               .join(complete, "version_id", "left_anti"))
    second = (lacking.select("candidate_id", "version_id").join(todo.select("endpoint_id", "candidate_id"), "candidate_id")
              .select("endpoint_id", F.lit("project_knowledge").alias("kind"), F.col("version_id").cast("string").alias("object_id")).distinct())
    return first.unionByName(second)
