"""Impact rules, applicability targets, profile matching, review checks and publication rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import bounded_text, citation_numbers, verified_quote
from palimpsest.operators.history import latest

# Impact rules in priority order (pattern, impact type), matched regardless of case.
IMPACT_RULES = (
    (r"\b(shall|must|required to|is required)\b", "obligation"),
    (r"\b(report|notify|notification)\b", "reporting"),
    (r"\b(register|registration|licen[cs]e)\b", "registration"),
    (r"\b(within \d+|no later than|by \d{1,2} [A-Za-z]+)\b", "deadline"),
    (r"\b(must not|shall not|prohibited|forbidden)\b", "prohibition"),
    (r"\b(penalty|fine|offence|liable)\b", "penalty"),
    (r"\b(exempt|exemption)\b", "exemption"),
    (r"\bmay\b", "permission"),
    (r"\b(record|retain|retention)\b", "record_keeping"),
    (r"\b(board|officer|policy|governance)\b", "governance"),
)
MAX_IMPACTS = 5

# Targets every impact has, targets by keyword, and the sector used when no keyword
# names one.
DEFAULT_TARGETS = (("jurisdiction", "malaysia"), ("size", "any-size"))
KEYWORD_TARGETS = (
    (r"\bpersonal data\b", "activity", "process-personal-data"),
    (r"\b(data user|data controller|controller)\b", "regulated_role", "data-user"),
    (r"\b(data processor|processor)\b", "regulated_role", "data-processor"),
    (r"\bemployer\b", "regulated_role", "employer"),
    (r"\b(direct marketing|marketing)\b", "activity", "direct-marketing"),
    (r"\b(cross-border|outside malaysia|overseas transfer)\b", "activity", "cross-border-transfer"),
    (r"\b(digital service|online platform|software)\b", "sector", "digital-services"),
    (r"\b(bank|banking|insurance|financial)\b", "sector", "financial-services"),
)
FALLBACK_TARGET = ("sector", "cross-sector")

# Terms that satisfy their dimension for everyone; dimensions with one value each.
WILDCARDS = (("sector", "cross-sector"), ("size", "any-size"))
SINGLE_VALUED = ("jurisdiction", "organization_type", "size")


def impact_types(text: Column, rules: Sequence[tuple[str, str]] = IMPACT_RULES,
                 maximum: int = MAX_IMPACTS) -> Column:
    """Impact types whose pattern occurs in the text, in rule order, the first ``maximum``."""
    hits = [F.when(text.rlike(f"(?iU){p}"), F.lit(kind)) for p, kind in rules]
    return F.slice(F.array_compact(F.array(*hits)), 1, maximum)


def target_terms(text: Column, defaults: Sequence[tuple[str, str]] = DEFAULT_TARGETS,
                 keywords: Sequence[tuple[str, str, str]] = KEYWORD_TARGETS,
                 fallback: tuple[str, str] = FALLBACK_TARGET) -> Column:
    """Distinct ``struct(dimension, code)`` targets named by the text, defaults first; the
    fallback joins them when no keyword names a term of its dimension."""
    term = lambda d, c: F.struct(F.lit(d).alias("dimension"), F.lit(c).alias("code"))
    found = [F.when(text.rlike(f"(?iU){p}"), term(d, c)) for p, d, c in keywords]
    named = F.lit(False)
    for p, d, _ in keywords:
        if d == fallback[0]:
            named = named | text.rlike(f"(?iU){p}")
    return F.array_distinct(F.array_compact(F.array(
        *[term(d, c) for d, c in defaults], *found, F.when(~named, term(*fallback)))))


def generate_candidates(confirmed: DataFrame, terms: DataFrame, rules=IMPACT_RULES,
                        defaults=DEFAULT_TARGETS, keywords=KEYWORD_TARGETS, fallback=FALLBACK_TARGET) -> DataFrame:
    """Impact candidates of confirmed changes: one row per (item, impact type, target).

    The changed text is the after side, else the before side. confirmed: item_id, change_type,
    before_text, after_text; terms: dimension, code. Items without a matching rule give no rows;
    targets outside the taxonomy are dropped."""
    text = F.coalesce("after_text", "before_text", F.lit(""))
    rows = confirmed.select("item_id", "change_type", impact_types(text, rules).alias("_types"),
                            target_terms(text, defaults, keywords, fallback).alias("_targets"))
    rows = rows.select("item_id", "change_type", F.posexplode("_types").alias("rule_order", "impact_type"), "_targets")
    out = rows.select("item_id", "change_type", (F.col("rule_order") + 1).alias("rule_order"), "impact_type",
                      F.inline("_targets"))
    return out.join(terms.select("dimension", "code").distinct(), ["dimension", "code"], "left_semi")


def evidence_sides(confirmed: DataFrame, maximum: int = 4000) -> DataFrame:
    """Before and after evidence of each item as rows (item_id, side, text, truncated)."""
    side = lambda name: F.struct(F.lit(name).alias("side"), F.col(f"{name}_text").alias("_text"))
    rows = confirmed.select("item_id", F.inline(F.array(side("before"), side("after")))).filter("_text is not null")
    cut = bounded_text(F.col("_text"), maximum)
    return rows.select("item_id", "side", cut["text"].alias("text"), cut["truncated"].alias("truncated"),
                       F.sha2("_text", 256).alias("text_sha256"))


# --- profiles ------------------------------------------------------------------------------------


def match_profiles(pairs: DataFrame, profile_terms: DataFrame, targets: DataFrame,
                   wildcards: Sequence[tuple[str, str]] = WILDCARDS) -> DataFrame:
    """Outcome of each requested (profile, impact) pair.

    A reviewed exclusion the profile has decides first; then an impact without included targets
    or with a dimension the profile does not state is insufficient context; then any dimension
    without a common code is a miss. A wildcard target settles its dimension. Terms are gathered
    per profile and per impact, both bounded by the taxonomy's size (at most 500 terms).

    pairs: profile_id, impact_id; profile_terms: profile_id, dimension, code; targets: impact_id,
    dimension, code, disposition. Output adds outcome, matched, unmet, unresolved.
    """
    key = F.concat_ws(":", "dimension", "code")
    prof = profile_terms.groupBy("profile_id").agg(
        F.collect_set(key).alias("_has"), F.collect_set("dimension").alias("_dims"))
    wild = F.lit(False)
    for d, c in wildcards:
        wild = wild | ((F.col("dimension") == d) & (F.col("code") == c))
    included = F.col("disposition") == "included"
    goal = targets.groupBy("impact_id").agg(
        F.collect_set(F.when(~included, key)).alias("_excluded"),
        F.collect_set(F.when(included, F.struct("dimension", "code", key.alias("key")))).alias("_included"),
        F.collect_set(F.when(included, F.col("dimension"))).alias("_goal_dims"),
        F.collect_set(F.when(included & wild, F.col("dimension"))).alias("_wild"))
    empty = F.array().cast("array<string>")
    j = pairs.join(prof, "profile_id", "left").join(goal, "impact_id", "left")
    j = j.withColumns({c: F.coalesce(c, empty) for c in ("_has", "_dims", "_excluded", "_goal_dims", "_wild")})
    hits = F.filter(F.coalesce("_included", F.array().cast("array<struct<dimension:string,code:string,key:string>>")),
                    lambda t: F.array_contains("_has", t["key"]) | F.array_contains("_wild", t["dimension"]))
    # In a wildcard dimension only the wildcard itself counts as matched.
    wild_keys = F.array(*[F.lit(f"{d}:{c}") for d, c in wildcards]).cast("array<string>")
    matched = F.filter(hits, lambda t: ~F.array_contains("_wild", t["dimension"]) | F.array_contains(wild_keys, t["key"]))
    open_dims = F.array_except("_goal_dims", "_wild")
    unresolved = F.array_sort(F.array_except(open_dims, "_dims"))
    hit_dims = F.transform(hits, lambda t: t["dimension"])
    unmet = F.array_sort(F.array_except(F.array_intersect(open_dims, "_dims"), hit_dims))
    j = j.withColumns({
        "matched": F.array_sort(F.transform(matched, lambda t: t["key"])), "unmet": unmet,
        "_unresolved": unresolved, "_hit_excluded": F.size(F.array_intersect("_excluded", "_has")) > 0})
    none = F.size("_goal_dims") == 0
    outcome = (F.when(F.col("_hit_excluded"), "not_matched")
               .when(none | (F.size("_unresolved") > 0), "insufficient_context")
               .when(F.size("unmet") > 0, "not_matched").otherwise("matched"))
    shown = F.when(~F.col("_hit_excluded") & none, F.array(F.lit("included_target"))).otherwise(F.col("_unresolved"))
    return j.select(*pairs.columns, outcome.alias("outcome"), "matched", "unmet", shown.alias("unresolved"))


def profile_tally(evaluated: DataFrame) -> DataFrame:
    """Counts per profile; rows with a null outcome were skipped."""
    kinds = ("matched", "not_matched", "insufficient_context")
    return evaluated.groupBy("profile_id").agg(
        F.count("outcome").alias("evaluated"), *[F.count_if(F.col("outcome") == k).alias(k) for k in kinds],
        F.count_if(F.col("outcome").isNull()).alias("skipped"))


def profile_term_violations(profile_terms: DataFrame, profiles: DataFrame) -> DataFrame:
    """Profiles that break a term rule: no terms, duplicates, several taxonomies, several values in
    a single-valued dimension. profile_terms: profile_id, taxonomy_id, dimension, code."""
    per_term = profile_terms.groupBy("profile_id", "taxonomy_id", "dimension", "code").agg(F.count(F.lit(1)).alias("_n"))
    per_dim = per_term.groupBy("profile_id", "dimension").agg(
        F.max("_n").alias("_dup"), F.count(F.lit(1)).alias("_values"),
        F.min("taxonomy_id").alias("_lo"), F.max("taxonomy_id").alias("_hi"))
    per_profile = per_dim.groupBy("profile_id").agg(
        (F.max("_dup") > 1).alias("_dup"), (F.min("_lo") != F.max("_hi")).alias("_mixed"),
        F.bool_or(F.col("dimension").isin(*SINGLE_VALUED) & (F.col("_values") > 1)).alias("_many"))
    j = profiles.select("profile_id").join(per_profile, "profile_id", "left")
    reasons = F.array_compact(F.array(
        F.when(F.col("_dup").isNull(), F.lit("no_terms")), F.when(F.col("_dup"), F.lit("duplicate_term")),
        F.when(F.col("_mixed"), F.lit("mixed_taxonomies")), F.when(F.col("_many"), F.lit("single_valued_dimension"))))
    return j.select("profile_id", F.explode(reasons).alias("violation"))


# --- reviews and publication ---------------------------------------------------------------------


def with_latest_review(items: DataFrame, reviews: DataFrame, item: str = "item_id") -> DataFrame:
    """Items with their latest review (by time, then id), null where there is none."""
    last = latest(reviews.select(item, "created_at", "review_id", "decision", "reviewer_id"), [item], ["created_at", "review_id"])
    last = last.withColumnRenamed("created_at", "reviewed_at")
    return items.join(last, item, "left")


def review_progress(items: DataFrame, reviews: DataFrame) -> DataFrame:
    """Per comparison: changed items, reviewed, confirmed, and whether review is complete."""
    j = with_latest_review(items.filter("change_type <> 'unchanged'"), reviews)
    return j.groupBy("comparison_id").agg(
        F.count(F.lit(1)).alias("item_count"), F.count("decision").alias("reviewed_count"),
        F.count_if(F.col("decision") == "confirmed").alias("confirmed_count"),
        (F.count("decision") == F.count(F.lit(1))).alias("complete"))


def publishable_changes(items: DataFrame, reviews: DataFrame, publications: DataFrame, publisher: int | None = None) -> DataFrame:
    """Changed items whose latest review confirms them and is not yet published. With a publisher,
    items that person reviewed are held back for someone else (two-person rule)."""
    j = with_latest_review(items.filter("change_type <> 'unchanged'"), reviews).filter("decision = 'confirmed'")
    out = j.join(publications.select("review_id").distinct(), "review_id", "left_anti")
    two = F.lit(True) if publisher is None else F.col("reviewer_id") != publisher
    return out.withColumn("disposition", F.when(two, "publish").otherwise("needs_other_publisher"))


def impact_readiness(impacts: DataFrame, impact_reviews: DataFrame, source_reviews: DataFrame,
                     published: DataFrame) -> DataFrame:
    """State of every impact on its way to release: unreviewed, needs_context, rejected, published,
    blocked (its source confirmation is no longer the latest review) or ready.

    impacts: impact_id, item_id, confirmation_review_id; both review tables: review_id, decision,
    created_at and their key; published: review_id."""
    mine = latest(impact_reviews.select("impact_id", "created_at", "review_id", "decision", "reviewer_id"), ["impact_id"], ["created_at", "review_id"])
    source = latest(source_reviews.select("item_id", "created_at", "review_id", "decision"), ["item_id"], ["created_at", "review_id"])
    source = source.select("item_id", F.col("review_id").alias("_source"), F.col("decision").alias("_source_decision"))
    done = published.select("review_id", F.lit(True).alias("_published")).distinct()
    j = (impacts.join(mine.withColumnRenamed("created_at", "reviewed_at"), "impact_id", "left")
         .join(source, "item_id", "left").join(done, "review_id", "left"))
    current = F.col("confirmation_review_id").eqNullSafe(F.col("_source")) & (F.col("_source_decision") == "confirmed")
    state = (F.when(F.col("decision").isNull(), "unreviewed")
             .when(F.col("decision").isin("needs_context", "rejected"), F.col("decision"))
             .when(F.col("_published"), "published").when(F.coalesce(current, F.lit(False)), "ready")
             .otherwise("blocked"))
    return j.select("impact_id", "item_id", "review_id", "decision", "reviewer_id", "reviewed_at", state.alias("state"))


def publish_impacts(ready: DataFrame, targets: DataFrame, publisher: int | None = None) -> DataFrame:
    """Publication rows of ready impacts with their targets nested (bounded by the taxonomy); an
    included target is required, and the reviewer may not publish."""
    nested = targets.groupBy("impact_id").agg(
        F.array_sort(F.collect_list(F.struct("dimension", "code", "disposition"))).alias("targets"))
    j = ready.filter("state = 'ready'").join(nested, "impact_id", "left")
    included = F.exists("targets", lambda t: t["disposition"] == "included")
    reason = (F.when(~F.coalesce(included, F.lit(False)), "included_target_missing")
              .when(F.col("reviewer_id") == publisher if publisher is not None else F.lit(False), "needs_other_publisher")
              .otherwise("publish"))
    return j.select("impact_id", "review_id", reason.alias("disposition"), F.to_json(F.struct(
        "impact_id", "review_id", "targets")).alias("payload"))


def review_rejection(proposals: DataFrame, impacts: DataFrame, source_reviews: DataFrame) -> DataFrame:
    """Why a proposed impact review is not acceptable (null when it is).

    proposals: proposal_id, impact_id, taxonomy_id, decision, targets
    array<struct<dimension,code,taxonomy_id,rationale>>; impacts: impact_id, item_id,
    confirmation_review_id."""
    source = latest(source_reviews.select("item_id", "created_at", "review_id", "decision"), ["item_id"], ["created_at", "review_id"])
    source = source.select("item_id", F.col("review_id").alias("_source"), F.col("decision").alias("_confirmed"))
    j = (proposals.join(impacts.select("impact_id", "item_id", "confirmation_review_id"), "impact_id", "left")
         .join(source, "item_id", "left"))
    keys = F.transform("targets", lambda t: F.concat_ws(":", t["dimension"], t["code"]))
    stale = ~(F.col("confirmation_review_id").eqNullSafe(F.col("_source")) & F.coalesce(F.col("_confirmed") == "confirmed", F.lit(False)))
    reason = (
        F.when(stale, "source_confirmation_stale")
        .when(~F.col("decision").isin("approved", "amended", "rejected", "needs_context"), "unsupported_decision")
        .when(F.size(F.array_distinct(keys)) < F.size("targets"), "duplicate_target")
        .when(F.exists("targets", lambda t: t["taxonomy_id"] != F.col("taxonomy_id")), "other_taxonomy")
        .when(F.exists("targets", lambda t: F.trim(F.coalesce(t["rationale"], F.lit(""))) == ""), "rationale_missing")
        .when(F.col("decision").isin("approved", "amended") & (F.size("targets") == 0), "approved_without_target"))
    return j.select("proposal_id", "impact_id", reason.alias("reason"))


# --- model inputs and outputs --------------------------------------------------------------------


def summary_inputs(items: DataFrame, reviews: DataFrame, maximum_items: int = 50, maximum_chars: int = 4000) -> DataFrame:
    """Bounded model input per comparison: confirmed items only, as canonical JSON with its hash.

    A comparison above the item maximum is refused (``eligible`` false, no payload), not cut; only
    rows within the maximum are ever gathered.
    items: comparison_id, item_id, change_type, created_at, before_text, after_text."""
    j = with_latest_review(items.filter("change_type <> 'unchanged'"), reviews).filter("decision = 'confirmed'")
    counts = j.groupBy("comparison_id").agg(F.count(F.lit(1)).alias("item_count"))
    fits = counts.filter(F.col("item_count") <= maximum_items)
    part = lambda c: F.when(F.col(c).isNotNull(), bounded_text(F.col(c), maximum_chars))
    row = F.struct(F.col("created_at").alias("_at"), F.col("item_id"), F.struct(
        part("after_text").alias("after"), part("before_text").alias("before"), "change_type",
        F.col("review_id").alias("confirmation_review_id"), "item_id").alias("item"))
    gathered = (j.join(fits.select("comparison_id"), "comparison_id", "left_semi").groupBy("comparison_id")
                .agg(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["item"]).alias("items")))
    payload = F.to_json(F.struct("comparison_id", "items"))
    out = counts.join(gathered, "comparison_id", "left").withColumn("payload", F.when(F.col("items").isNotNull(), payload))
    return out.select("comparison_id", "item_count", (F.col("item_count") <= maximum_items).alias("eligible"),
                      "payload", F.sha2("payload", 256).alias("input_sha256"))


def summary_output_rejection(outputs: DataFrame, expected: DataFrame) -> DataFrame:
    """Check generated summaries row by row against their input items.

    outputs: comparison_id, item_id, change_type; expected: the same columns. One row per
    comparison of ``expected`` with the first failing rule."""
    mine = outputs.groupBy("comparison_id", "item_id").agg(
        F.count(F.lit(1)).alias("_n"), F.min("change_type").alias("_type"), F.max("change_type").alias("_type2"))
    j = expected.select("comparison_id", "item_id", F.col("change_type").alias("_want")).join(
        mine, ["comparison_id", "item_id"], "full_outer")
    g = j.groupBy("comparison_id").agg(
        F.bool_or(F.coalesce(F.col("_n") != 1, F.lit(True)) | F.col("_want").isNull()).alias("_bad_ids"),
        F.bool_or((F.col("_type") != F.col("_want")) | (F.col("_type2") != F.col("_want"))).alias("_bad_type"))
    return g.select("comparison_id", F.when(F.col("_bad_ids"), "items_not_cited_once").when(
        F.col("_bad_type"), "change_type_altered").alias("reason"))


def impact_output_rejection(candidates: DataFrame, terms: DataFrame) -> DataFrame:
    """Why a generated impact candidate is rejected (null when it is not).

    candidates: candidate_id, expected_item_id, item_id, expected_anchor_ids, citation_ids,
    targets array<struct<dimension,code>>; terms: the controlled terms (bounded)."""
    # The terms are one value of a subquery, so every candidate is judged in its row and none is shuffled.
    known = terms.where("dimension is not null and code is not null").agg(F.collect_set(F.struct("dimension", "code"))).scalar()
    pairs = F.transform("targets", lambda t: F.struct(t["dimension"].alias("dimension"), t["code"].alias("code")))
    unknown = F.size(F.array_except(pairs, known)) > 0
    keys = F.transform("targets", lambda t: F.concat_ws(":", t["dimension"], t["code"]))
    cited = F.array_sort(F.col("citation_ids")) == F.array_sort(F.array_distinct("expected_anchor_ids"))
    reason = (F.when(~F.col("item_id").eqNullSafe(F.col("expected_item_id")), "item_id_altered")
              .when(~cited, "citations_not_exact")
              .when(F.size(F.array_distinct(keys)) < F.size("targets"), "duplicate_target")
              .when(unknown, "unknown_term"))
    return candidates.select("candidate_id", reason.alias("reason"))


def answer_citations(answers: DataFrame, citations: DataFrame, sources: DataFrame) -> DataFrame:
    """Verified citations of each answer and the reason an answer is refused.

    A citation counts when its source exists, its quote occurs in the source text and its source
    section was not cited before. Every marker of the answer needs one; unused ones are dropped.
    answers: answer_id, answer; citations: answer_id, position, source_number, quote; sources:
    answer_id, source_number, section_id, text. Output: answer_id, reason, source_numbers."""
    j = citations.join(sources, ["answer_id", "source_number"])
    ok = j.withColumn("_quote", verified_quote(F.col("text"), F.col("quote"))).filter("_quote is not null")
    once = ok.groupBy("answer_id", "section_id").agg(F.min_by("source_number", "position").alias("source_number"))
    # The sources of one answer are a short list by construction (top k).
    good = once.groupBy("answer_id").agg(F.array_sort(F.collect_set("source_number")).alias("_good"))
    a = answers.select("answer_id", citation_numbers(F.col("answer")).alias("_markers")).join(good, "answer_id", "left")
    have = F.coalesce("_good", F.array().cast("array<int>"))
    missing = F.size(F.array_except("_markers", have)) > 0
    reason = F.when(F.size("_markers") == 0, "missing_answer_markers").when(missing, "unverified_answer_markers")
    used = F.when(reason.isNull(), F.array_intersect("_markers", have)).otherwise(F.array().cast("array<int>"))
    return a.select("answer_id", reason.alias("reason"), used.alias("source_numbers"))
