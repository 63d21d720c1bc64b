"""Reader usage, chat histories and the product status that is read from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.keys import pseudonym
from palimpsest.operators.metrics import side_by_side

SEARCH, VIEW, DOWNLOAD, FEEDBACK = "search", "view", "download", "feedback"


def usage_events(raw: DataFrame) -> DataFrame:
    """Usage log rows without raw values: pseudonymous user, query hash and length. raw: event_id,
    user_id, query, occurred_at."""
    return raw.select("event_id", pseudonym(F.col("user_id")).alias("user_hash"), pseudonym(F.col("query")).alias("query_hash"),
                      F.length(F.trim("query")).alias("query_length"), "occurred_at")


def usage_totals(events: DataFrame) -> DataFrame:
    """One row of usage counts. events: actor_id, action, result_count."""
    is_ = lambda a: F.col("action") == a
    return events.agg(
        F.count_if(is_(SEARCH)).alias("searches"), F.count_if(is_(SEARCH) & (F.col("result_count") > 0)).alias("successful_searches"),
        F.count_if(is_(VIEW)).alias("views"), F.count_if(is_(DOWNLOAD)).alias("downloads"), F.count_if(is_(FEEDBACK)).alias("feedback"),
        F.count_distinct(F.when(is_(FEEDBACK), F.col("actor_id"))).alias("feedback_users"))


def ratings(events: DataFrame) -> DataFrame:
    """Average rating per feedback category. events: action, category, rating."""
    rated = events.filter((F.col("action") == FEEDBACK) & F.col("rating").isNotNull())
    return rated.groupBy(F.coalesce("category", F.lit("unknown")).alias("category")).agg(
        F.count(F.lit(1)).alias("ratings"), F.round(F.avg("rating"), 2).alias("average_rating"))


def engaged_users(events: DataFrame, owners: DataFrame) -> DataFrame:
    """Profile owners who searched or viewed with a profile, downloaded and gave feedback.
    events: actor_id, action, profile_id; owners: user_id."""
    per = events.groupBy("actor_id").agg(
        F.bool_or(F.col("action").isin(SEARCH, VIEW) & F.col("profile_id").isNotNull()).alias("_used"),
        F.bool_or(F.col("action") == DOWNLOAD).alias("_down"), F.bool_or(F.col("action") == FEEDBACK).alias("_back"))
    all_of = per.filter(F.col("_used") & F.col("_down") & F.col("_back")).select(F.col("actor_id").alias("user_id"))
    return all_of.join(owners.select("user_id").distinct(), "user_id", "left_semi")


def completed_journeys(publications: DataFrame, outbox: DataFrame, matches: DataFrame) -> DataFrame:
    """Publications whose event was delivered and whose impact matched a profile. publications:
    publication_id, event_id, impact_id."""
    sent = outbox.filter("status = 'published'").select("event_id")
    hit = matches.filter("outcome = 'matched'").select("impact_id").distinct()
    return publications.join(sent, "event_id", "left_semi").join(hit, "impact_id", "left_semi")


def product_criteria(confidence: DataFrame, workflows: DataFrame, journeys: DataFrame, events: DataFrame,
                     engaged: DataFrame, milestones: DataFrame) -> DataFrame:
    """One row of five criteria. confidence: is_enabled, state, status, coverage_percent;
    milestones: rows of selected next milestones."""
    good = (F.col("state") == "operational") & (F.col("status") == "healthy") & (F.col("coverage_percent") == 100)
    base = confidence.filter("is_enabled").agg(F.count(F.lit(1)).alias("_enabled"), F.count_if(good).alias("_good"))
    held = workflows.agg(F.count_if(F.col("status") == "quality_review_required").alias("_held"))
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    j = side_by_side([base, held, n(journeys, "_journeys"), usage_totals(events), n(engaged, "_engaged"), n(milestones, "_milestones")])
    return j.select(
        ((F.col("_enabled") > 0) & (F.col("_good") == F.col("_enabled")) & (F.col("_held") == 0)).alias("production_baseline"),
        (F.col("_journeys") > 0).alias("complete_change_journey"), (F.col("_engaged") >= 3).alias("three_engaged_users"),
        ((F.col("feedback_users") >= 3) & (F.col("searches") > 0) & (F.col("downloads") > 0)).alias("findings_and_metrics"),
        (F.col("_milestones") > 0).alias("next_milestone_selected"))


def thread_listing(threads: DataFrame, messages: DataFrame, limit: int = 50) -> DataFrame:
    """Newest threads of every scope with their message counts, at most ``limit`` each. threads:
    thread_id, scope, updated_at."""
    counts = messages.groupBy("thread_id").agg(F.count(F.lit(1)).alias("message_count"))
    w = W.partitionBy("scope").orderBy(F.desc("updated_at"), F.desc("thread_id"))
    top = threads.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= limit)
    return top.join(counts, "thread_id", "left").fillna(0, ["message_count"])


def bounded_history(messages: DataFrame, maximum: int = 16, budget: int = 12000) -> DataFrame:
    """The last messages of each thread inside a character budget, oldest first as ``position``.

    The newest ``maximum`` messages are taken first (pruned before the shuffle), so the running
    sums work on short lists; the message that crosses the budget is cut. messages: thread_id,
    message_id, created_order, role, content."""
    newest = W.partitionBy("thread_id").orderBy(F.desc("created_order"), F.desc("message_id"))
    last = messages.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= maximum)
    text = last.withColumn("content", F.btrim("content", F.lit(" \n\r\t"))).filter("content <> ''")
    w = W.partitionBy("thread_id").orderBy("_n")
    before = F.coalesce(F.sum(F.length("content")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    kept = text.withColumn("_left", F.lit(budget) - before).filter("_left > 0")
    cut = kept.withColumn("content", F.substr("content", F.lit(1), F.col("_left").cast("int")))
    back = W.partitionBy("thread_id").orderBy(F.desc("_n"))
    return cut.withColumn("position", F.row_number().over(back)).select("thread_id", "message_id", "position", "role", "content")
