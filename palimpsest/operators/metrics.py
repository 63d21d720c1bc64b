"""Operational metrics as a long table (name, labels, value), its text form, alerts and panels.

``as_of`` is always a parameter, never the clock, so a metric run can be repeated.
Metric and label names are fixed values.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.scalars import age_seconds, safe_ratio
from palimpsest.operators.history import latest
from palimpsest.operators.impacts import with_latest_review
from palimpsest.operators.selection import quantiles

LABELS = "map<string,string>"


def _now(as_of: str) -> Column:
    return F.expr(f"timestamp_ntz'{as_of}'")


def _labels(**labels) -> Column:
    if not labels:
        return F.create_map().cast(LABELS)
    pairs = [x for k, v in labels.items() for x in (F.lit(k), v if isinstance(v, Column) else F.lit(v))]
    return F.create_map(*pairs).cast(LABELS)


def rows(df: DataFrame, name: str, value: Column, **labels) -> DataFrame:
    return df.select(F.lit(name).alias("name"), _labels(**labels).alias("labels"), value.cast("double").alias("value"))


def sample(name: str, value: Column, **labels) -> Column:
    """One metric row as a struct, so that many metrics of a row come from one pass over it."""
    return F.struct(F.lit(name).alias("name"), _labels(**labels).alias("labels"), value.cast("double").alias("value"))


def union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def grouped_counts(df: DataFrame, column: str, expected: Sequence[str]) -> DataFrame:
    """Count per value with a zero row for every expected value that does not occur."""
    names = df.sparkSession.createDataFrame([(v,) for v in expected], f"{column} string")
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    return names.join(counts, column, "full_outer").select(column, F.coalesce("count", F.lit(0)).alias("count"))


def recent(df: DataFrame, column: str, as_of: str, hours: int) -> DataFrame:
    return df.filter(F.col(column) >= _now(as_of) - F.make_interval(hours=F.lit(hours)))


def window_counts(runs: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """Counts per (endpoint, status) and per status in one pass over the window; endpoint_id is
    null in the totals."""
    out = recent(runs, "created_at", as_of, hours).select("endpoint_id", "status")
    sets = out.groupingSets([[F.col("endpoint_id"), F.col("status")], [F.col("status")]], F.col("endpoint_id"), F.col("status"))
    return sets.agg(F.count(F.lit(1)).alias("run_count"))


def approximate_quantiles(df: DataFrame, value: str, groups: Sequence[str] = (), qs: Sequence[float] = (0.5, 0.95),
                          accuracy: int = 10000) -> DataFrame:
    """Quantiles whose rank is off by at most n / accuracy, in one pass (see :func:`selection.quantiles`
    for exact ones)."""
    aggs = [F.percentile_approx(value, q, accuracy).alias(f"q{round(q * 100)}") for q in qs]
    return df.groupBy(*groups).agg(F.count(value).alias("n"), *aggs)


def success_ratio(runs: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Completed over completed plus failed; null when neither occurs."""
    ok, bad = F.count_if(F.col("status") == "completed"), F.count_if(F.col("status") == "failed")
    return runs.groupBy(*groups).agg(safe_ratio(ok, ok + bad).alias("success_ratio"))


def latest_coverage(assessments: DataFrame, order: Sequence[str] = ("assessed_at", "assessment_id")) -> DataFrame:
    """Coverage ratio per stage summed over the latest assessment of every endpoint."""
    cols = ["endpoint_id", *order, "candidate_count", "artifact_ready", "extraction_ready", "graph_ready", "section_count",
            "configured_embedding_ready"]
    last = latest(assessments.select(*cols), ["endpoint_id"], list(order))
    pairs = {"artifact": ("artifact_ready", "candidate_count"), "extraction": ("extraction_ready", "candidate_count"),
             "graph": ("graph_ready", "candidate_count"), "embedding": ("configured_embedding_ready", "section_count")}
    sums = last.agg(*[F.sum(c).alias(c) for c in {c for p in pairs.values() for c in p}])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(stage).alias("stage"), safe_ratio(F.col(a), F.col(b)).alias("ratio"))
                                          for stage, (a, b) in pairs.items()])))


def oldest_active_age(tables: Sequence[tuple[DataFrame, str, Sequence[str]]], as_of: str) -> DataFrame:
    """Age of the oldest active row over several (table, time column, active statuses); 0 if none."""
    mins = [df.filter(F.col("status").isin(*active)).agg(F.min(at).alias("_t")) for df, at, active in tables]
    out = union(mins).agg(F.min("_t").alias("_t"))
    return out.select(age_seconds(as_of, "_t").alias("oldest_active_age_seconds"))


def attempts_by_state(outbox: DataFrame, expected: Sequence[str]) -> DataFrame:
    names = outbox.sparkSession.createDataFrame([(v,) for v in expected], "status string")
    sums = outbox.groupBy("status").agg(F.sum("attempts").alias("attempts"))
    return names.join(sums, "status", "full_outer").select("status", F.coalesce("attempts", F.lit(0)).alias("attempts"))


def review_backlog(items: DataFrame, reviews: DataFrame, key: str) -> DataFrame:
    """Number of items without any review."""
    return items.select(key).join(reviews.select(key).distinct(), key, "left_anti").agg(F.count(F.lit(1)).alias("backlog"))


def child_counts(parents: DataFrame, key: str, children: Mapping[str, tuple[DataFrame, Column | None]]) -> DataFrame:
    """Conditional distinct counts per parent; each child table is counted before it is joined, so
    no two children multiply."""
    out = parents.select(key)
    for name, (df, test) in children.items():
        counted = df.groupBy(key).agg(F.count_distinct(F.when(test, F.col("child_id")) if test is not None else F.col("child_id")).alias(name))
        out = out.join(counted, key, "left")
    return out.fillna(0, list(children))


def dashboard(endpoints: DataFrame, assessments: DataFrame, workflows: DataFrame) -> DataFrame:
    """One row: enabled and healthy endpoints, alerting endpoints, active and failed workflows."""
    last = latest(assessments.select("endpoint_id", "assessed_at", "assessment_id", "status"), ["endpoint_id"], ["assessed_at", "assessment_id"])
    a = endpoints.agg(F.count_if("is_enabled").alias("enabled"), F.count_if(F.col("is_enabled") & (F.col("health_state") == "healthy")).alias("healthy"))
    b = last.agg(F.count_if(F.col("status").isin("warning", "critical")).alias("alerting"))
    c = workflows.agg(F.count_if(F.col("status").isin("pending", "queued", "running", "waiting_ocr")).alias("active"),
                      F.count_if(F.col("status").isin("failed", "retryable_failure", "quality_review_required")).alias("failed"))
    return side_by_side([a, b, c])


def side_by_side(parts: Sequence[DataFrame]) -> DataFrame:
    """One-row tables as one row, by stacking and aggregating (no join)."""
    fields = [f for p in parts for f in p.schema.fields]
    stacked = union([p.select(*[(F.col(f.name) if f.name in p.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]) for p in parts])
    return stacked.agg(*[F.max(f.name).alias(f.name) for f in fields])


RUN_STATES = ("pending", "running", "completed", "failed", "cancelled")


def source_metrics(endpoints: DataFrame, assessed: DataFrame, runs: DataFrame, streaks: DataFrame, as_of: str) -> DataFrame:
    """Metric family of every enabled endpoint.

    endpoints: endpoint_id, source, is_enabled, health_state, next_poll_at; assessed: output of
    ``reliability.assess``; streaks: endpoint_id, consecutive_failures."""
    e = endpoints.filter("is_enabled").select("endpoint_id", "source", "health_state", "next_poll_at")
    ok = runs.filter("status = 'completed'").groupBy("endpoint_id").agg(F.max("finished_at").alias("last_success_at"))
    facts = assessed.select("endpoint_id", "status", "freshness_deadline", "candidate_count", "section_count", "findings",
                            "artifact_ready", "extraction_ready", "graph_ready", "local_embedding_ready", "configured_embedding_ready")
    j = (e.join(ok, "endpoint_id", "left").join(facts, "endpoint_id", "left").join(streaks, "endpoint_id", "left"))
    window = recent(runs.filter("trigger = 'scheduled'"), "created_at", as_of, 24 * 7)
    counted = window.groupBy("endpoint_id").agg(*[F.count_if(F.col("status") == x).alias(f"_n_{x}") for x in RUN_STATES])
    j = j.join(counted, "endpoint_id", "left")
    lab = dict(source=F.col("source"), endpoint=F.col("endpoint_id").cast("string"))
    head = F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'{as_of}', freshness_deadline)") / 1e6
    samples = [
        sample("source_reliability_info", F.lit(1), **lab, status=F.coalesce("status", F.lit("unknown"))),
        sample("source_http_health_info", F.lit(1), **lab, health_state=F.col("health_state")),
        sample("source_last_success_age_seconds", age_seconds(as_of, "last_success_at", float("inf")), **lab),
        sample("source_freshness_headroom_seconds", head, **lab),
        sample("source_poll_overdue_seconds", age_seconds(as_of, "next_poll_at", float("inf")), **lab),
        sample("source_consecutive_failures", F.coalesce("consecutive_failures", F.lit(0)), **lab),
        sample("source_candidate_count", F.coalesce("candidate_count", F.lit(0)), **lab),
    ]
    for stage, total in (("artifact", "candidate_count"), ("extraction", "candidate_count"), ("graph", "candidate_count"),
                         ("local_embedding", "section_count"), ("configured_embedding", "section_count")):
        samples.append(sample("source_coverage_ratio", safe_ratio(F.col(f"{stage}_ready"), F.col(total)), **lab, stage=stage))
    for x in RUN_STATES:
        samples.append(sample("source_scheduled_runs_window", F.coalesce(f"_n_{x}", F.lit(0)), **lab, status=x))
    # A finding occurs once per code and severity in an assessment.
    found = F.transform(F.coalesce("findings", F.array().cast("array<struct<code:string,severity:string>>")),
                        lambda f: sample("source_reliability_findings", F.lit(1), **lab, code=f["code"], severity=f["severity"]))
    return j.select(F.inline(F.concat(F.array(*samples), found)))


def release_metrics(items: DataFrame, reviews: DataFrame, publications: DataFrame, impact_states: DataFrame,
                    impact_reviews: DataFrame, impact_publications: DataFrame, outbox: DataFrame, as_of: str,
                    window_hours: int = 24 * 7) -> DataFrame:
    """Queue, readiness, blocked, published and delivered counts with their ages.

    publications: review_id, reviewed_at, published_at; impact_states: output of
    ``impacts.impact_readiness``; impact_publications: the same columns; outbox: event_id, status,
    attempts, available_at, published_at."""
    age = lambda c, empty=0.0: age_seconds(as_of, c, empty)
    least = lambda test, c: F.min(F.when(test, c))
    state, decision = F.col("state"), F.col("decision")

    done = publications.select("review_id", F.lit(True).alias("_done")).distinct()
    changed = with_latest_review(items.filter("change_type <> 'unchanged'"), reviews).join(done, "review_id", "left")
    waiting = decision.isNull() | (decision == "needs_context")
    ready = (decision == "confirmed") & F.col("_done").isNull()
    change = changed.agg(F.count_if(waiting).alias("q"), least(waiting, F.coalesce("reviewed_at", "created_at")).alias("qt"),
                         F.count_if(ready).alias("r"), least(ready, F.col("reviewed_at")).alias("rt"), F.lit(None).cast("bigint").alias("b"))
    i_wait, i_ready = state.isin("unreviewed", "needs_context"), state == "ready"
    impact = impact_states.agg(F.count_if(i_wait).alias("q"), least(i_wait, F.col("reviewed_at")).alias("qt"),
                               F.count_if(i_ready).alias("r"), least(i_ready, F.col("reviewed_at")).alias("rt"),
                               F.count_if(state == "blocked").alias("b"))
    queue = lambda kind: [
        sample("review_queue", F.col("q"), kind=kind), sample("review_oldest_age_seconds", age("qt"), kind=kind),
        sample("publication_ready", F.col("r"), kind=kind), sample("publication_ready_oldest_age_seconds", age("rt"), kind=kind)]
    blocked = sample("publication_blocked", F.col("b"), kind="impact", reason="stale_source_review")
    parts = [change.select(F.inline(F.array(*queue("change")))), impact.select(F.inline(F.array(*queue("impact"), blocked)))]

    for kind, df, expected in (("change", reviews, ("confirmed", "rejected", "needs_context")),
                               ("impact", impact_reviews, ("approved", "amended", "rejected", "needs_context"))):
        inside = recent(df, "created_at", as_of, window_hours).agg(*[F.count_if(F.col("decision") == d).alias(d) for d in expected])
        parts.append(inside.select(F.inline(F.array(*[
            sample("review_decisions_window", F.col(d), kind=kind, decision=d) for d in expected]))))

    for kind, df in (("change", publications), ("impact", impact_publications)):
        seconds = F.greatest(F.lit(0.0), F.expr("timestampdiff(MICROSECOND, reviewed_at, published_at)") / 1e6)
        inside = F.col("published_at") >= _now(as_of) - F.make_interval(hours=F.lit(window_hours))
        rows_ = df.select("published_at", F.when(inside, seconds).alias("_s"))
        known = rows_.agg(F.count("_s").alias("n"), F.max("published_at").alias("t"))
        agg = known.unionByName(quantiles(rows_, "_s").drop("n"), allowMissingColumns=True).agg(*[F.max(c).alias(c) for c in ("n", "t", "q50", "q95")])
        parts.append(agg.select(F.inline(F.array(
            sample("publications_window", F.col("n"), kind=kind),
            sample("publication_duration_quantile_seconds", F.col("q50"), kind=kind, quantile="0.50"),
            sample("publication_duration_quantile_seconds", F.col("q95"), kind=kind, quantile="0.95"),
            sample("last_publication_age_seconds", age("t", float("inf")), kind=kind)))))

    states = ("pending", "publishing", "published", "failed")
    recent_row = F.col("available_at") >= _now(as_of) - F.make_interval(hours=F.lit(window_hours))
    is_ = lambda x: F.col("status") == x
    sent = outbox.agg(
        *[F.count_if(is_(x)).alias(f"n_{x}") for x in states], *[F.count_if(is_(x) & recent_row).alias(f"w_{x}") for x in states],
        *[F.coalesce(F.sum(F.when(is_(x), F.col("attempts"))), F.lit(0)).alias(f"a_{x}") for x in states],
        least(F.col("status").isin("pending", "publishing"), F.col("available_at")).alias("oldest"),
        F.max(F.when(is_("published"), F.col("published_at"))).alias("newest"))
    parts.append(sent.select(F.inline(F.array(
        *[sample(name, F.col(f"{p}_{x}"), status=x) for p, name in (("n", "impact_delivery_events"), ("w", "impact_delivery_events_window"),
                                                                  ("a", "impact_delivery_attempts")) for x in states],
        sample("impact_delivery_oldest_pending_age_seconds", age("oldest")),
        sample("impact_delivery_last_success_age_seconds", age("newest", float("inf")))))))
    return union(parts)


def exposition(metrics: DataFrame) -> DataFrame:
    """Text form of each metric row: ``name{label="value",...} number`` with escapes."""
    esc = lambda v: F.replace(F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit('"'), F.lit('\\"'))
    pairs = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), esc(e["value"]), F.lit('"')))
    v = F.col("value")
    number = (F.when(v.isNull() | F.isnan(v), "NaN").when(v == float("inf"), "+Inf").when(v == float("-inf"), "-Inf")
              .otherwise(F.regexp_replace(F.regexp_replace(F.format_string("%.6f", v), r"0+$", ""), r"\.$", "")))
    body = F.when(F.size("labels") > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise(F.lit(""))
    return metrics.select("name", F.concat("name", body, F.lit(" "), number).alias("line"))


# Alert name, metric, label filter (name, allowed values), comparison, threshold,
# severity.
ALERTS = (
    ("MetricsUnavailable", "up", None, "==", 0.0, "critical"),
    ("SchedulerWorkerHeartbeatMissing", "scheduler_worker_heartbeat_age_seconds", None, ">", 180.0, "critical"),
    ("OutboxDeliveryFailed", "impact_delivery_events", ("status", ("failed",)), ">", 0.0, "warning"),
    ("ReviewQueueStale", "review_oldest_age_seconds", None, ">", 259200.0, "warning"),
    ("PublicationReadyStale", "publication_ready_oldest_age_seconds", None, ">", 86400.0, "warning"),
    ("OutboxDeliveryPending", "impact_delivery_oldest_pending_age_seconds", None, ">", 900.0, "warning"),
    ("SourceEndpointUnhealthy", "source_endpoints", ("health_state", ("unhealthy",)), ">", 0.0, "warning"),
    ("SourceReliabilityNeedsAttention", "source_reliability_info", ("status", ("warning", "critical")), "==", 1.0, "warning"),
    ("SourceFreshnessExpired", "source_freshness_headroom_seconds", None, "<", 0.0, "critical"),
    ("SourcePollOverdue", "source_poll_overdue_seconds", None, ">", 900.0, "warning"),
    ("SourceCoverageIncomplete", "source_coverage_ratio", None, "<", 1.0, "warning"),
    ("SourceRunSuccessRateLow", "source_run_success_ratio", None, "<", 0.95, "warning"),
    ("PipelineWorkStalled", "pipeline_oldest_active_age_seconds", None, ">", 1800.0, "warning"),
)


def firing_alerts(metrics: DataFrame, alerts=ALERTS) -> DataFrame:
    """Every (alert, metric row) that fires. The rules are a fixed short list, so they are column
    expressions, not a join."""
    tests = []
    for name, metric, label, op, threshold, severity in alerts:
        v = F.col("value")
        hit = {"==": v == threshold, ">": v > threshold, "<": v < threshold}[op] & (F.col("name") == metric)
        if label:
            hit = hit & F.element_at("labels", F.lit(label[0])).isin(*label[1])
        tests.append(F.when(hit, F.struct(F.lit(name).alias("alert"), F.lit(severity).alias("severity"))))
    return metrics.select("name", "labels", "value", F.inline(F.array_compact(F.array(*tests))))


def panel(metrics: DataFrame, name: str, label: str) -> DataFrame:
    """Dashboard panel: min, max and sum of one metric per value of a label."""
    return metrics.filter(F.col("name") == name).groupBy(F.element_at("labels", F.lit(label)).alias(label)).agg(
        F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.sum("value").alias("sum_value"))
