"""Workflow tables: stage attempts, status from stage outcomes, recovery and backfill plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.history import History, latest


def due_rows(rows: DataFrame, active: DataFrame, key: str, as_of: str) -> DataFrame:
    """Enabled rows that are due at ``as_of`` (or never polled) and have no open run."""
    now = F.expr(f"timestamp_ntz'{as_of}'")
    due = rows.filter(F.col("is_enabled") & (F.col("next_poll_at").isNull() | (F.col("next_poll_at") <= now)))
    return due.join(active.select(key).distinct(), key, "left_anti")


def resolved_changes(evidence: DataFrame, chunk: Column | None = None) -> DataFrame:
    """Each observation's version with the identity's version observed before it, and whether the
    content changed. evidence: identity_id, version_id, observation_id, retrieved_at.

    Observations at the same instant do not precede each other."""
    out = _strictly_before(evidence, chunk)
    changed = F.col("previous_version_id").isNull() | (F.col("previous_version_id") != F.col("version_id"))
    return out.withColumn("content_changed", changed)


def _strictly_before(evidence: DataFrame, chunk: Column | None) -> DataFrame:
    # One row per (identity, instant): the version seen last at that instant.
    instants = evidence.groupBy("identity_id", "retrieved_at").agg(F.max_by("version_id", "observation_id").alias("_v"))
    before = History(instants, ["identity_id"], ["retrieved_at"], chunk).previous(previous_version_id="_v").result().drop("_v")
    return evidence.join(before, ["identity_id", "retrieved_at"], "left")


# Stages a change passes, in order, and its statuses.
STAGES = ("artifact", "extraction", "version", "quality", "knowledge", "lineage", "comparison", "review", "summary", "completed")
STATUSES = ("pending", "queued", "running", "waiting_ocr", "no_content_change", "quality_review_required", "lineage_rejected",
            "review_required", "summary_pending", "summary_failed", "completed", "failed")

# What a stage's latest outcome leads to: (stage, outcome, status, next stage, whether that stage is looked at).
# An outcome of None is a stage that has not run.
TRANSITIONS: tuple[tuple[str, str | None, str, str, bool], ...] = (
    ("artifact", None, "pending", "artifact", False),
    ("review", None, "review_required", "review", False),
    ("summary", None, "summary_pending", "summary", False),
    ("summary", "failed", "summary_failed", "summary", False),
    ("extraction", "waiting", "waiting_ocr", "extraction", False),
    ("version", "unchanged", "no_content_change", "completed", False),
    ("quality", "held", "quality_review_required", "quality", False),
    ("lineage", "quarantined", "lineage_rejected", "lineage", False),
    ("comparison", "baseline", "completed", "completed", False),
    ("comparison", "completed", "completed", "completed", False),
    ("comparison", "material", "review_required", "review", True),
    ("review", "confirmed", "summary_pending", "summary", True),
    ("review", "completed", "completed", "completed", False),
    ("summary", "completed", "completed", "completed", False),
    *((stage, "completed", "running", then, True) for stage, then in zip(STAGES[:6], STAGES[1:7])),
    *((stage, None, "running", stage, False) for stage in STAGES[1:7]),
    *((stage, outcome, outcome, stage, False) for stage in STAGES[:8] for outcome in ("pending", "queued", "running", "failed")),
    *(("summary", outcome, "summary_pending", "summary", False) for outcome in ("pending", "queued", "running")),
)


def workflow_states(workflows: DataFrame, attempts: DataFrame, transitions=TRANSITIONS, stages=STAGES) -> DataFrame:
    """Status, current stage and number of stages passed of each workflow, by folding a table of transitions over
    its stages in order.

    workflows: workflow_id; attempts: workflow_id, stage, attempt_number, outcome. The latest attempt of a stage
    counts (ties: larger outcome); it is found by an aggregate that combines before the shuffle, so a workflow has
    at most one row a stage when they are gathered, however often it was retried. Attempts at stages beyond the
    one that stops do not count, nor do unknown stages. A known stage's null or unknown outcome is ``failed``."""
    names = F.array(*[F.lit(s) for s in stages])
    last = (attempts.where(F.col("stage").isin(*stages)).groupBy("workflow_id", "stage")
            .agg(F.max(F.struct("attempt_number", F.coalesce("outcome", F.lit("?")).alias("outcome")))["outcome"].alias("outcome")))
    gathered = last.groupBy("workflow_id").agg(F.map_from_entries(F.collect_list(F.struct("stage", "outcome"))).alias("_outcomes"))
    key = lambda stage, outcome: F.concat_ws("|", stage, F.coalesce(outcome, F.lit("")))
    cell = lambda status, stage, go, passed: F.struct(status.alias("status"), stage.alias("stage"), go.alias("go"), passed.alias("passed"))
    table = F.create_map(*[x for stage, outcome, status, then, go in transitions
                           for x in (F.lit(f"{stage}|{outcome or ''}"), F.struct(F.lit(status).alias("status"), F.lit(then).alias("stage"), F.lit(go).alias("go")))])

    def step(state, stage):
        then = F.try_element_at(table, key(stage, F.try_element_at(F.col("_outcomes"), stage)))
        moved = cell(F.coalesce(then["status"], F.lit("failed")), F.coalesce(then["stage"], stage), F.coalesce(then["go"], F.lit(False)),
                     state["passed"] + (F.coalesce(then["stage"], stage) != stage).cast("int"))
        return F.when(state["go"] & (state["stage"] == stage), moved).otherwise(state)

    end = F.aggregate(names, cell(F.lit("pending"), F.lit(stages[0]), F.lit(True), F.lit(0)), step)
    j = workflows.select("workflow_id").join(gathered, "workflow_id", "left").withColumn(
        "_outcomes", F.coalesce("_outcomes", F.create_map().cast("map<string,string>")))
    return j.select("workflow_id", end.alias("_end")).select("workflow_id", "_end.status", "_end.stage", "_end.passed")


def workflow_status(stages: DataFrame) -> DataFrame:
    """Status and current stage of each change from its stage results; the first stop decides.

    stages: workflow_id, stored_ok, extraction_status, content_changed, quality_outcome,
    provenance_status, has_pair, material_changes (nulls where a stage has not run)."""
    rules = [
        (~F.col("stored_ok"), "retryable_failure", "artifact"),
        (F.col("stored_ok").isNull(), "pending", "artifact"),
        (F.col("extraction_status").isNull(), "running", "extraction"),
        (F.col("extraction_status") == "ocr_required", "waiting_ocr", "extraction"),
        (F.col("extraction_status") == "retryable_failure", "retryable_failure", "extraction"),
        (F.col("extraction_status") != "succeeded", "failed", "extraction"),
        (F.col("content_changed").isNull(), "running", "version"),
        (~F.col("content_changed"), "no_content_change", "completed"),
        (F.col("quality_outcome").isNull(), "running", "quality"),
        (F.col("quality_outcome") == "review_required", "quality_review_required", "quality"),
        (F.col("provenance_status").isNull(), "running", "lineage"),
        (F.col("provenance_status") == "quarantined", "lineage_rejected", "lineage"),
        (F.col("has_pair").isNull(), "running", "comparison"),
        (~F.col("has_pair"), "completed", "completed"),
        (F.col("material_changes") > 0, "review_required", "review"),
    ]
    status, stage = F.lit("completed"), F.lit("completed")
    for test, s, g in reversed(rules):
        status, stage = F.when(test, s).otherwise(status), F.when(test, g).otherwise(stage)
    return stages.select("workflow_id", status.alias("status"), stage.alias("stage"))


def recoverable(workflows: DataFrame, as_of: str, limit: int, stale_minutes: int = 30) -> DataFrame:
    """Up to ``limit`` workflows to pick up: pending first, then OCR-ready, then stale ones, oldest
    first within each class. workflows: workflow_id, status, created_at, updated_at,
    heartbeat_at, has_evidence."""
    stale = F.col("heartbeat_at") < F.expr(f"timestamp_ntz'{as_of}'") - F.make_interval(mins=F.lit(stale_minutes))
    kind = (F.when(F.col("status") == "pending", 1).when((F.col("status") == "waiting_ocr") & F.col("has_evidence"), 2)
            .when(F.col("status").isin("queued", "running") & stale, 3))
    since = F.when(kind == 1, F.col("created_at")).when(kind == 2, F.col("updated_at")).otherwise(F.col("heartbeat_at"))
    return (workflows.select("workflow_id", kind.alias("priority"), since.alias("since")).filter("priority is not null")
            .orderBy("priority", "since", "workflow_id").limit(limit))


def missing_workflows(observations: DataFrame, workflows: DataFrame) -> DataFrame:
    """Changed observations without a workflow."""
    return observations.filter("content_changed").join(workflows.select("observation_id"), "observation_id", "left_anti")


def backfill_plan(observations: DataFrame, workflows: DataFrame, limit: int) -> DataFrame:
    return missing_workflows(observations, workflows).orderBy("retrieved_at", "observation_id").limit(limit)


def workflow_audit(observations: DataFrame, workflows: DataFrame, as_of: str, stale_minutes: int = 30) -> DataFrame:
    """Totals as rows (measure, value): changed observations, workflows, missing, stale running and
    one row per status."""
    now = F.expr(f"timestamp_ntz'{as_of}'")
    stale = F.col("status").isin("queued", "running") & (F.col("heartbeat_at") < now - F.make_interval(mins=F.lit(stale_minutes)))
    one = lambda df, name, agg: df.agg(agg.alias("value")).select(F.lit(name).alias("measure"), F.col("value").cast("bigint").alias("value"))
    rows = one(observations, "changed_observations", F.count_if("content_changed"))
    rows = rows.unionByName(one(workflows, "workflows", F.count(F.lit(1))))
    rows = rows.unionByName(one(missing_workflows(observations, workflows), "missing_workflows", F.count(F.lit(1))))
    rows = rows.unionByName(one(workflows, "stale_running", F.count_if(stale)))
    per = workflows.groupBy("status").agg(F.count(F.lit(1)).alias("value"))
    return rows.unionByName(per.select(F.concat(F.lit("status:"), "status").alias("measure"), "value"))


def retry_table(outbox: DataFrame, as_of: str, max_attempts: int = 8, stale_minutes: int = 10) -> DataFrame:
    """Delivery order and next attempt of undelivered events: eligible events are those due with
    attempts left; a failed attempt waits 1, 2, 4, ... minutes, at most 60.

    The order is the pair (available_at, event_id), so it needs no global numbering."""
    now = F.expr(f"timestamp_ntz'{as_of}'")
    open_ = outbox.filter(F.col("status") != "published")
    wait = F.least(F.lit(60), F.pow(F.lit(2), F.greatest(F.lit(0), F.least(F.lit(10), F.col("attempts") - 1)))).cast("int")
    terminal = F.col("attempts") >= max_attempts
    state = F.when(terminal, "terminal").when(F.col("available_at") <= now, "eligible").otherwise("waiting")
    return open_.select("event_id", "attempts", "available_at", state.alias("delivery_state"),
                        F.when(~terminal, wait).alias("retry_minutes"))


def duplicate_identities(identities: DataFrame, versions: DataFrame) -> DataFrame:
    """Identities of one collection whose current versions have equal content, each paired with the
    oldest such identity (not with every other one), and the reason a pair cannot be merged.

    identities: identity_id, collection_id, superseded_by; versions: identity_id, version_id,
    content_sha256, created_at, has_evidence."""
    current = latest(versions.select("identity_id", "version_id", "content_sha256", "created_at", "has_evidence"),
                     ["identity_id"], ["created_at", "version_id"])
    j = identities.join(current, "identity_id")
    keeper = (j.filter("superseded_by is null").groupBy("collection_id", "content_sha256")
              .agg(F.min(F.struct("created_at", "identity_id", "has_evidence")).alias("_k"))
              .select("collection_id", "content_sha256", F.col("_k.identity_id").alias("target_id"), F.col("_k.has_evidence").alias("_target_evidence")))
    aliased = identities.filter("superseded_by is not null").select(F.col("superseded_by").alias("identity_id"), F.lit(True).alias("_has_aliases")).distinct()
    pairs = j.join(keeper, ["collection_id", "content_sha256"]).filter("identity_id <> target_id").join(aliased, "identity_id", "left")
    reason = (F.when(F.col("superseded_by").isNotNull() & (F.col("superseded_by") != F.col("target_id")), "already_superseded")
              .when(F.col("superseded_by").isNotNull(), "already_resolved")
              .when(F.col("_has_aliases"), "source_has_aliases")
              .when(~F.col("has_evidence") | ~F.col("_target_evidence"), "evidence_missing"))
    return pairs.select(F.col("identity_id").alias("source_id"), "target_id", "content_sha256", reason.alias("reason"))


def resolve_alias(identities: DataFrame) -> DataFrame:
    """Each identity with the one that stands for it (one hop)."""
    return identities.select("identity_id", F.coalesce("superseded_by", "identity_id").alias("resolved_id"))


def ocr_plan(extraction: DataFrame, derivative: DataFrame) -> DataFrame:
    """Artifacts flagged for OCR that have no derivative yet, with their latest flag time."""
    flagged = extraction.filter("status = 'ocr_required'").groupBy("artifact_id").agg(F.max("created_at").alias("flagged_at"))
    return flagged.join(derivative.select(F.col("source_artifact_id").alias("artifact_id")).distinct(), "artifact_id", "left_anti")


def integrity(artifacts: DataFrame) -> DataFrame:
    """Artifacts whose stored bytes differ from the record. artifacts: artifact_id, content,
    byte_size, sha256."""
    size, digest = F.octet_length("content"), F.sha2("content", 256)
    reason = F.when(size != F.col("byte_size"), "size_mismatch").when(digest != F.col("sha256"), "hash_mismatch")
    return artifacts.select("artifact_id", reason.alias("reason")).filter("reason is not null")
