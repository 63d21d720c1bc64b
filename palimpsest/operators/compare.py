"""Version pairing and structural comparison of two versions' anchors.

Anchor tables carry comparison_id, anchor_id, ordinal, anchor_type, canonical_key, text and
text_sha256. Work inside one comparison is bounded by its two documents.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.similarity import ratio, ratio_udf, stable_keys_udf, word_delta_udf
from palimpsest.functions.text import normalize_inline
from palimpsest.operators.history import History, first
from palimpsest.session import spread, stage

SIMILARITY_THRESHOLD = 0.72
AMBIGUITY_MARGIN = 0.03
CHANGE_TYPES = ("unchanged", "added", "removed", "modified", "moved", "format_only", "ambiguous")

ITEM = ("comparison_id string, before_id string, after_id string, before_ordinal int, "
        "after_ordinal int, change_type string, match_strategy string, similarity_score double, "
        "candidate_after_ids array<string>")


def lineage_audit(versions: DataFrame, sections: DataFrame, evidence: DataFrame) -> DataFrame:
    """Provenance of each version: verified with direct evidence, reconstructable from a single
    (artifact, extraction) pair, else quarantined; unknown representations are quarantined.

    versions: version_id, representation_kind; sections: version_id, artifact_id, extraction_id;
    evidence: version_id.
    """
    per_section = sections.groupBy("version_id").agg(
        F.count(F.lit(1)).alias("section_count"),
        F.min("artifact_id").eqNullSafe(F.max("artifact_id")).alias("_one_artifact"),
        F.min("extraction_id").eqNullSafe(F.max("extraction_id")).alias("_one_extraction"))
    per_evidence = evidence.groupBy("version_id").agg(F.count(F.lit(1)).alias("evidence_count"))
    out = versions.join(per_section, "version_id", "left").join(per_evidence, "version_id", "left")
    n, e = F.coalesce("section_count", F.lit(0)), F.coalesce("evidence_count", F.lit(0))
    single = F.coalesce(F.col("_one_artifact") & F.col("_one_extraction"), F.lit(False))
    reason = (F.when(n == 0, "version_has_no_normalized_sections")
              .when(e > 0, "direct_version_evidence_present")
              .when(single, "single_section_artifact_and_extraction_lineage")
              .otherwise("missing_unambiguous_version_evidence"))
    unknown = F.col("representation_kind") == "unknown"
    status = (F.when((n == 0) | unknown, "quarantined").when(e > 0, "verified")
              .when(single, "reconstructable").otherwise("quarantined"))
    reasons = F.concat_ws(",", reason, F.when(unknown, F.lit("unknown_representation_kind")))
    return out.select(*versions.columns, n.alias("section_count"), e.alias("evidence_count"),
                      status.alias("provenance_status"), reasons.alias("reasons"))


def eligible_pairs(lineage: DataFrame, chunk: Column) -> DataFrame:
    """Consecutive comparable versions of each (identity, track): one representative per source
    artifact (verified first, then oldest), paired in time order.

    lineage: identity_id, track, artifact_id, version_id, provenance_status, created_at.
    ``chunk`` cuts each track's history so that no track is windowed as a whole.
    """
    usable = lineage.filter(F.col("provenance_status").isin("verified", "reconstructable"))
    ranked = usable.withColumn("_worse", (F.col("provenance_status") != "verified").cast("int"))
    reps = first(ranked, ["identity_id", "track", "artifact_id"],
                 ["_worse", "created_at", "version_id"]).drop("_worse")
    paired = History(reps, ["identity_id", "track"], ["created_at", "version_id"], chunk).previous(
        before_version_id="version_id").result()
    return paired.filter(F.col("before_version_id").isNotNull()).select(
        "identity_id", "track", "before_version_id", F.col("version_id").alias("after_version_id"))


def pair_rejection(pairs: DataFrame, lineage: DataFrame) -> DataFrame:
    """Why a requested pair cannot be compared (null when it can).

    pairs: first_id, second_id; lineage as in :func:`eligible_pairs`."""
    cols = ["version_id", "identity_id", "track", "artifact_id", "provenance_status"]
    side = lambda p: lineage.select(*[F.col(c).alias(f"{p}_{c}") for c in cols])
    j = (pairs.join(side("a"), F.col("first_id") == F.col("a_version_id"), "left")
         .join(side("b"), F.col("second_id") == F.col("b_version_id"), "left"))
    reason = (
        F.when(F.col("a_identity_id").isNull() | F.col("b_identity_id").isNull(), "unknown_version")
        .when(F.col("a_identity_id") != F.col("b_identity_id"), "different_identity")
        .when(F.col("first_id") == F.col("second_id"), "same_version")
        .when((F.col("a_provenance_status") == "quarantined")
              | (F.col("b_provenance_status") == "quarantined"), "quarantined")
        .when(F.col("a_track") != F.col("b_track"), "cross_representation")
        .when(F.col("a_artifact_id") == F.col("b_artifact_id"), "same_artifact"))
    return j.select(*pairs.columns, reason.alias("reason"))


def _sided(anchors: DataFrame, side: str) -> DataFrame:
    keep = ("anchor_id", "ordinal", "anchor_type", "text", "text_sha256")
    return anchors.select("comparison_id", "canonical_key",
                          *[F.col(c).alias(f"{side}_{c}") for c in keep])


def align_by_key(before: DataFrame, after: DataFrame) -> DataFrame:
    """Anchors present on both sides under the same key."""
    return _sided(before, "before").join(_sided(after, "after"), ["comparison_id", "canonical_key"])


def stable_keys(before: DataFrame, after: DataFrame) -> DataFrame:
    """(comparison_id, canonical_key) of keys that keep their place in the key sequence."""
    ordered = lambda df, name: df.groupBy("comparison_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("ordinal", "canonical_key"))),
        lambda s: s["canonical_key"]).alias(name))
    both = spread(ordered(before, "_b").join(ordered(after, "_a"), "comparison_id"), "comparison_id")
    return both.select("comparison_id", F.explode(stable_keys_udf("_b", "_a")).alias("canonical_key")).withColumn(
        "stable", F.lit(True))


def classify_key_pairs(pairs: DataFrame, stable: DataFrame) -> DataFrame:
    """Change type, strategy and score of key-aligned pairs; the ratio is computed for changed
    text only."""
    j = pairs.join(stable, ["comparison_id", "canonical_key"], "left")
    same = F.col("before_text_sha256") == F.col("after_text_sha256")
    nb, na = normalize_inline(F.col("before_text")), normalize_inline(F.col("after_text"))
    change = (F.when(same & F.coalesce("stable", F.lit(False)), "unchanged").when(same, "moved")
              .when(nb == na, "format_only").otherwise("modified"))
    strategy = (F.when(same, "canonical_key_exact_text").when(nb == na, "canonical_key_normalized_text")
                .otherwise("canonical_key"))
    changed = ~same & (nb != na)
    # Equal texts become nulls: they are neither moved nor compared.
    slim = spread(j.select(
        "comparison_id", "before_anchor_id", "after_anchor_id", "before_ordinal", "after_ordinal",
        change.alias("change_type"), strategy.alias("match_strategy"),
        F.when(changed, nb).alias("_b"), F.when(changed, na).alias("_a")), "comparison_id", "before_anchor_id")
    return slim.withColumn("similarity_score", F.coalesce(ratio_udf("_b", "_a"), F.lit(1.0))).drop("_b", "_a")


def align_by_hash(before: DataFrame, after: DataFrame) -> DataFrame:
    """Same text under different keys, when the text occurs once on each side: moved."""
    once = lambda df, p: (
        df.groupBy("comparison_id", "text_sha256")
        .agg(F.count(F.lit(1)).alias(f"_{p}n"), F.min("anchor_id").alias(f"{p}_anchor_id"),
             F.min("ordinal").alias(f"{p}_ordinal")).filter(F.col(f"_{p}n") == 1))
    j = once(before, "before").join(once(after, "after"), ["comparison_id", "text_sha256"])
    return j.select("comparison_id", "before_anchor_id", "after_anchor_id", "before_ordinal",
                    "after_ordinal", F.lit("moved").alias("change_type"),
                    F.lit("exact_text_hash").alias("match_strategy"),
                    F.lit(1.0).alias("similarity_score"))


def _may_reach(x: str, y: str, cx: Counter, cy: Counter, threshold: float) -> bool:
    """Two upper bounds on the ratio: by length, then by shared characters."""
    total = len(x) + len(y)
    if not total:
        return True
    if 2.0 * min(len(x), len(y)) / total < threshold:
        return False
    small, big = (cx, cy) if len(cx) <= len(cy) else (cy, cx)
    return 2.0 * sum(min(n, big[ch]) for ch, n in small.items()) / total >= threshold


def _resolve(comparison, before, after, threshold, margin, with_rest):
    """Item rows of one comparison's leftovers; both lists are in reading order."""
    rows, used, taken, pool = [], set(), set(), {}
    for t in after:
        pool.setdefault(t["anchor_type"], []).append((t, Counter(t["norm"])))
    for s in before:
        counts, hits = Counter(s["norm"]), []
        for t, other in pool.get(s["anchor_type"], ()):
            if t["anchor_id"] in used or not _may_reach(s["norm"], t["norm"], counts, other, threshold):
                continue
            score = ratio(s["norm"], t["norm"], threshold)
            if score >= threshold:
                hits.append((-score, t["ordinal"], t["anchor_id"]))
        if not hits:
            continue
        hits.sort()
        taken.add(s["anchor_id"])
        score = -hits[0][0]
        if len(hits) > 1 and score + hits[1][0] <= margin:
            rows.append((comparison, s["anchor_id"], None, s["ordinal"], None, "ambiguous",
                         "similarity_ambiguous", score, [h[2] for h in hits[:5]]))
        else:
            used.add(hits[0][2])
            rows.append((comparison, s["anchor_id"], hits[0][2], s["ordinal"], hits[0][1],
                         "modified", "structural_text_similarity", score, []))
    if with_rest:
        rows += [(comparison, s["anchor_id"], None, s["ordinal"], None, "removed", "unmatched_before", 0.0, [])
                 for s in before if s["anchor_id"] not in taken]
        rows += [(comparison, None, t["anchor_id"], None, t["ordinal"], "added", "unmatched_after", 0.0, [])
                 for t in after if t["anchor_id"] not in used]
    return rows


def align_by_similarity(before: DataFrame, after: DataFrame,
                        threshold: float = SIMILARITY_THRESHOLD,
                        margin: float = AMBIGUITY_MARGIN, with_rest: bool = False) -> DataFrame:
    """Greedy one-to-one alignment of leftover anchors of equal type.

    ``before`` anchors are visited in order; the best free ``after`` anchor at or above the
    threshold is taken, unless the runner-up is within the margin: then the anchor is ambiguous
    and consumes nothing. The order dependence makes this a per-comparison step; a comparison's
    leftovers are bounded by its two documents, and texts are compared only when neither exact
    upper bound rules them out. ``with_rest`` adds the anchors left on either side as removed and
    added.
    """
    def gather(df: DataFrame, name: str) -> DataFrame:
        anchor = F.struct("ordinal", "anchor_id", "anchor_type", normalize_inline(F.col("text")).alias("norm"))
        return df.groupBy("comparison_id").agg(F.array_sort(F.collect_list(anchor)).alias(name))

    def resolve(batches):
        names = [c.split()[0] for c in ITEM.split(", ")]
        for pdf in batches:
            rows = []
            for c, b, a in zip(pdf["comparison_id"], pdf["_b"], pdf["_a"]):
                rows += _resolve(c, b if b is not None else (), a if a is not None else (), threshold, margin, with_rest)
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({"before_ordinal": "Int32", "after_ordinal": "Int32"})

    both = gather(before, "_b").join(gather(after, "_a"), "comparison_id", "full_outer")
    return spread(both, "comparison_id").mapInPandas(resolve, ITEM)


def _as_item(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("comparison_id").cast("string").alias("comparison_id"),
        F.col("before_anchor_id").alias("before_id"), F.col("after_anchor_id").alias("after_id"),
        "before_ordinal", "after_ordinal", "change_type", "match_strategy", "similarity_score",
        F.array().cast("array<string>").alias("candidate_after_ids"))


def one_sided(before: DataFrame, after: DataFrame, aligned: DataFrame) -> DataFrame:
    """Removed and added anchors: the anti joins of the alignment (before_id, after_id)."""
    gone = before.join(aligned.select("comparison_id", F.col("before_id").alias("anchor_id"))
                       .filter("anchor_id is not null"), ["comparison_id", "anchor_id"], "left_anti")
    new = after.join(aligned.select("comparison_id", F.col("after_id").alias("anchor_id"))
                     .filter("anchor_id is not null"), ["comparison_id", "anchor_id"], "left_anti")
    nul = lambda t: F.lit(None).cast(t)
    shape = lambda df, b, a, kind, how: df.select(
        F.col("comparison_id").cast("string").alias("comparison_id"),
        (F.col("anchor_id") if b else nul("string")).alias("before_id"),
        (F.col("anchor_id") if a else nul("string")).alias("after_id"),
        (F.col("ordinal") if b else nul("int")).alias("before_ordinal"),
        (F.col("ordinal") if a else nul("int")).alias("after_ordinal"),
        F.lit(kind).alias("change_type"), F.lit(how).alias("match_strategy"),
        F.lit(0.0).alias("similarity_score"), F.array().cast("array<string>").alias("candidate_after_ids"))
    return shape(gone, True, False, "removed", "unmatched_before").unionByName(
        shape(new, False, True, "added", "unmatched_after"))


def marked(before: DataFrame, after: DataFrame) -> DataFrame:
    """The anchors of both sides with ``how`` they are matched: ``key`` where their key is on both sides, ``hash``
    where the keys leave their text over once on each side, else ``rest``.

    Texts that nothing compares (the same under a key, matched by hash) are left out; where all of a key are the same,
    so are their hashes. Three windows over the anchors of a comparison: inputs that are already dealt out by
    comparison_id are not moved."""
    keep = ("comparison_id", "canonical_key", "anchor_id", "ordinal", "anchor_type", "text", "text_sha256")
    side = lambda df, is_before: df.select(*keep, F.lit(is_before).alias("is_before"))
    both = side(before, True).unionByName(side(after, False))
    group = W.partitionBy("comparison_id", "canonical_key")
    seen = lambda test: F.bool_or(test).over(group)
    known = F.col("comparison_id").isNotNull()
    digest = F.col("text_sha256")
    both = both.select("*", (known & F.col("canonical_key").isNotNull() & seen("is_before") & seen(~F.col("is_before"))).alias("_key"),
                       (F.min(digest).over(group).eqNullSafe(F.max(digest).over(group))
                        & (F.count(digest).over(group) == F.count(F.lit(1)).over(group))).alias("_same"))
    left = W.partitionBy("comparison_id", "_key", "text_sha256")
    once = lambda test: F.count_if(test).over(left) == 1
    both = both.withColumn("how", F.when(F.col("_key"), "key").when(
        known & digest.isNotNull() & once("is_before") & once(~F.col("is_before")), "hash").otherwise("rest"))
    same = (F.col("how") == "key") & F.col("_same")
    return both.select("comparison_id", "canonical_key", "anchor_id", "ordinal", "anchor_type", "is_before", "how",
                       F.when(~same & (F.col("how") != "hash"), F.col("text")).alias("text"),
                       F.when(same, "").when(F.col("how") != "rest", digest).alias("text_sha256"))


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """All alignment rows of every comparison: by key, by exact text, by similarity, then the
    one-sided rest.

    Both inputs are read once; what they hold beyond unchanged texts is staged."""
    anchors = stage(marked(before, after), "marked-anchors")
    side = lambda is_before, *how: anchors.where(F.col("how").isin(*how) & (F.col("is_before") == is_before))
    sides = lambda *how: (side(True, *how), side(False, *how))
    keyed = classify_key_pairs(align_by_key(*sides("key")), stable_keys(*sides("key", "hash", "rest")))
    rest = align_by_similarity(*sides("rest"), with_rest=True)
    return _as_item(keyed).unionByName(_as_item(align_by_hash(*sides("hash")))).unionByName(rest)


def with_text_delta(items: DataFrame, before: DataFrame, after: DataFrame, maximum: int = 200) -> DataFrame:
    """Add word-level edit steps of the two anchor texts to each item."""
    text = lambda df, p: df.select(F.col("comparison_id").cast("string").alias("comparison_id"),
                                   F.col("anchor_id").alias(f"{p}_id"), F.col("text").alias(f"_{p}"))
    j = (items.join(text(before, "before"), ["comparison_id", "before_id"], "left")
         .join(text(after, "after"), ["comparison_id", "after_id"], "left"))
    return j.withColumn("text_delta", word_delta_udf(maximum)("_before", "_after")).drop("_before", "_after")


def change_counts(items: DataFrame) -> DataFrame:
    """One row per comparison with a count per change type."""
    return items.groupBy("comparison_id").agg(
        *[F.count_if(F.col("change_type") == t).alias(f"{t}_count") for t in CHANGE_TYPES])


def material_changes(items: DataFrame) -> DataFrame:
    return items.filter(~F.col("change_type").isin("unchanged", "format_only"))


def display_order(items: DataFrame) -> DataFrame:
    """Items numbered in reading order: by after ordinal, missing ones last, then before ordinal."""
    far = F.lit(10 ** 9)
    w = W.partitionBy("comparison_id").orderBy(
        F.coalesce("after_ordinal", far), F.coalesce("before_ordinal", far), "change_type",
        F.coalesce("before_id", F.lit("")))
    return items.withColumn("position", F.row_number().over(w))
