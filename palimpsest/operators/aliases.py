"""Superseded identities: alias rows with their basis, chains and cycles resolved by pointer jumping, and the
workflow updates that follow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.keys import canonical_json
from palimpsest.session import scratch, stage

# Bounds of a stated reason, name of the strategy.
REASON_LENGTH = (20, 2000)
STRATEGY = "reviewed_duplicate_content_v1"


def alias_rows(requests: DataFrame) -> DataFrame:
    """Each request as a row with ``rejection`` (null if it holds) and, if it holds, its ``basis`` as JSON.

    requests: source_id, target_id, reason, actor_type, actor_id, content_sha256, recorded_at. Texts are
    trimmed. Of the valid requests for one source the earliest holds (ties: smaller target); later ones are
    ``already_superseded``, or ``already_resolved`` where they name the same target. A null id, an identity
    that names itself, a reason outside 20 to 2,000 characters or a missing actor is a rejection too."""
    trimmed = {c: F.trim(F.coalesce(c, F.lit(""))) for c in ("reason", "actor_type", "actor_id")}
    rows = requests.withColumns(trimmed)
    low, high = REASON_LENGTH
    fault = (F.when(F.col("source_id").isNull() | F.col("target_id").isNull(), "identity_missing")
             .when(F.col("source_id") == F.col("target_id"), "same_identity")
             .when(~F.length("reason").between(low, high), "reason_length")
             .when((F.col("actor_type") == "") | (F.col("actor_id") == ""), "actor_missing"))
    rows = rows.withColumn("_fault", fault)
    first = (rows.where("_fault is null").groupBy("source_id")
             .agg(F.min(F.struct(F.col("recorded_at").isNull().alias("late"), "recorded_at", "target_id")).alias("_first")))
    rows = rows.join(first, "source_id", "left")
    same = F.col("target_id") == F.col("_first.target_id")
    holds = same & F.col("recorded_at").eqNullSafe(F.col("_first.recorded_at"))
    rejection = F.coalesce("_fault", F.when(holds, F.lit(None)).when(same, F.lit("already_resolved")).otherwise(F.lit("already_superseded")))
    basis = canonical_json(strategy=F.lit(STRATEGY), reason=F.col("reason"), actor_type=F.col("actor_type"), actor_identifier=F.col("actor_id"),
                           normalized_content_sha256=F.col("content_sha256"), target_identity_id=F.col("target_id").cast("string"))
    out = rows.withColumn("rejection", rejection)
    return out.select("source_id", "target_id", "recorded_at", "rejection", F.when(F.col("rejection").isNull(), basis).alias("basis")).distinct()


def resolve(aliases: DataFrame) -> DataFrame:
    """Each alias with the identity that stands for it in the end: source_id, target_id, resolved_id, cyclic.

    aliases: source_id (one row each), target_id. A chain ends at the identity without an alias. Where it runs
    into a cycle, the smallest identity of that cycle stands for all that lead there, itself included.
    Every round doubles the reach of a pointer and sets aside what has reached its end, so a chain of n aliases
    takes log2(n) rounds, and what is left when a round sets nothing aside leads to cycles. Rounds are
    written to the shared folder. A target of very many aliases is one key of the looked-up side only, so
    adaptive execution can split the other side."""
    spark = aliases.sparkSession
    with scratch(spark):
        start = stage(aliases.select("source_id", "target_id").where("source_id is not null and target_id is not null and source_id <> target_id"), "aliases")
        ends = start.select(F.col("target_id").alias("end")).distinct().join(start.select(F.col("source_id").alias("end")), "end", "left_anti")
        ends = stage(ends, "alias-ends")
        settled, left = [], start.select("source_id", F.col("target_id").alias("at"), F.col("target_id").alias("least"))
        open_rows = None
        while True:
            at_end = ends.select(F.col("end").alias("at"))
            settled.append(stage(left.join(at_end, "at", "left_semi").select("source_id", F.col("at").alias("resolved_id"), F.lit(False).alias("cyclic")), "alias-settled"))
            left = stage(left.join(at_end, "at", "left_anti"), "alias-left")
            n = left.count()
            if n == 0 or n == open_rows:
                break
            open_rows = n
            left = _jump(left, _reach(left, settled))
        if n:
            settled.append(_cycles(left))
        done = settled[0]
        for part in settled[1:]:
            done = done.unionByName(part)
        return stage(start.join(done, "source_id"), "alias-resolved", keep=True)


def _reach(left: DataFrame, settled: list[DataFrame]) -> DataFrame:
    """What every aliased identity reaches so far: (via, to, low), the ends of settled ones and the places of others."""
    reach = left.select(F.col("source_id").alias("via"), F.col("at").alias("to"), F.col("least").alias("low"))
    for part in settled:
        reach = reach.unionByName(part.select(F.col("source_id").alias("via"), F.col("resolved_id").alias("to"), F.col("resolved_id").alias("low")))
    return reach


def _jump(left: DataFrame, reach: DataFrame) -> DataFrame:
    return left.join(reach, F.col("at") == F.col("via")).select("source_id", F.col("to").alias("at"), F.least("least", "low").alias("least"))


def _cycles(left: DataFrame) -> DataFrame:
    """Rows all of which lead to cycles. Pointers are doubled until the places they reach stay the same in
    number (all are then on cycles) and the least identities seen on the way from them do too (each has then
    seen its whole cycle)."""
    before = None
    while True:
        places = left.select(F.col("at").alias("source_id")).distinct()
        on = stage(left.join(places, "source_id"), "alias-cycle")
        row = on.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("source_id", "least").cast("decimal(38,0)")).alias("s")).first()
        now = (row["n"], row["s"])
        if now == before:
            break
        before = now
        left = stage(_jump(left, _reach(left, [])), "alias-left")
    low = on.select(F.col("source_id").alias("at"), F.col("least").alias("resolved_id"))
    return stage(left.join(low, "at").select("source_id", "resolved_id", F.lit(True).alias("cyclic")), "alias-settled")


def workflow_updates(resolved: DataFrame, workflows: DataFrame) -> DataFrame:
    """Changes to workflows held for quality, from resolved aliases: those of an identity that gave way
    complete, those of the one that stands for it start again with one retry more. Of a cycle the smallest
    identity stays.

    workflows: workflow_id, identity_id, status, retry_count."""
    gone = resolved.where("source_id <> resolved_id").select(F.col("source_id").alias("identity_id"), F.lit("completed").alias("new_status"))
    kept = resolved.select(F.col("resolved_id").alias("identity_id")).distinct().withColumn("new_status", F.lit("pending"))
    held = workflows.where("status = 'quality_review_required'")
    back = F.col("new_status") == "pending"
    return held.join(gone.unionByName(kept), "identity_id").select(
        "workflow_id", "identity_id", "new_status", F.when(~back, F.lit("completed")).otherwise(F.lit("artifact")).alias("new_stage"),
        (~back).alias("finished"), (F.col("retry_count") + back.cast("int")).alias("retry_count"))
