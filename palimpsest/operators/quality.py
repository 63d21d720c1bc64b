"""Corpus-aware document quality: metrics, findings, score and outcome."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.keys import set_digest
from palimpsest.functions.scalars import safe_ratio
from palimpsest.functions.text import non_space_length, token_coverage

# Default thresholds.
DEFAULTS = {
    "short_review": 100,
    "short_warning": 400,
    "sections_warning": 2,
    "title_coverage_warning": 0.5,
    "repeated_minimum": 80,
    "repeated_warning": 0.5,
    "repeated_review": 0.8,
    "pages_warning": 1.0,
    "pages_review": 0.8,
}


def duplicate_groups(versions: DataFrame) -> DataFrame:
    """(content_sha256, duplicate_group_size) for contents held by more than one version; members
    stay rows of ``versions``, so a huge group is never one value."""
    return (versions.groupBy("content_sha256").agg(F.count(F.lit(1)).alias("duplicate_group_size"))
            .filter("duplicate_group_size > 1"))


def shared_sections(sections: DataFrame, minimum: int = DEFAULTS["repeated_minimum"]) -> DataFrame:
    """Hashes of sections that occur in more than one document and are long enough to count."""
    return (
        sections.groupBy("text_sha256")
        .agg(F.min("version_id").alias("_lo"), F.max("version_id").alias("_hi"),
             F.max(non_space_length(F.col("text"))).alias("section_length"))
        .filter((F.col("_lo") != F.col("_hi")) & (F.col("section_length") >= minimum))
        .select("text_sha256", "section_length"))


def repeated_content(sections: DataFrame, minimum: int = DEFAULTS["repeated_minimum"]) -> DataFrame:
    """Characters, section count and share of repeated text per version.

    Hot sections are handled in two steps: (version, hash) sums first, so the join on the hash
    carries one row per pair, and AQE splits a skewed hash."""
    # Equal hashes mean equal texts, so one length per pair is enough.
    per_pair = sections.groupBy("version_id", "text_sha256").agg(
        F.max(non_space_length(F.col("text"))).alias("_len"), F.count(F.lit(1)).alias("_n"))
    per_pair = per_pair.withColumn("_chars", F.col("_len") * F.col("_n"))
    per_hash = (per_pair.groupBy("text_sha256")
                .agg(F.count(F.lit(1)).alias("_docs"), F.max("_len").alias("_l"))
                .filter((F.col("_docs") > 1) & (F.col("_l") >= minimum))
                .select("text_sha256", F.lit(True).alias("_shared")))
    flagged = per_pair.join(per_hash, "text_sha256", "left")
    out = flagged.groupBy("version_id").agg(
        F.sum("_n").alias("section_count"), F.sum("_chars").alias("section_characters"),
        F.coalesce(F.sum(F.when(F.col("_shared"), F.col("_chars"))), F.lit(0)).alias("repeated_characters"))
    return out.withColumn("repeated_content_ratio", F.coalesce(
        safe_ratio(F.col("repeated_characters"), F.col("section_characters")), F.lit(0.0)))


def page_coverage(pages: DataFrame, minimum_per_page: int = 40) -> DataFrame:
    """Per artifact: pages with text over page count, and whether OCR is needed because the text
    is under ``minimum_per_page`` characters a page on average.

    pages: artifact_id, page_number, page_text, page_count."""
    chars = non_space_length(F.coalesce("page_text", F.lit("")))
    return pages.groupBy("artifact_id").agg(
        F.count_distinct(F.when(chars > 0, F.col("page_number"))).alias("extracted_pages"),
        F.max("page_count").alias("page_count"), F.sum(chars).alias("text_characters"),
    ).select(
        "artifact_id", "extracted_pages", "page_count",
        safe_ratio(F.col("extracted_pages"), F.col("page_count")).alias("page_coverage"),
        (F.col("text_characters") < F.col("page_count") * minimum_per_page).alias("requires_ocr"))


def assess(versions: DataFrame, sections: DataFrame, configuration: Mapping | None = None) -> DataFrame:
    """Findings, outcome and score of every version against the whole corpus.

    versions: version_id, title, content, content_sha256 and, when known, identity_title,
    missing_locator_count, pending_link_count, is_pdf, page_count, extracted_pages, requires_ocr.
    Output: version_id, metrics, ``findings`` (array of struct(code, severity) sorted by code),
    warning_count, review_count, outcome, score.
    """
    cfg = {**DEFAULTS, **(configuration or {})}
    opt = lambda name, default: (F.coalesce(F.col(name), default) if name in versions.columns else default)
    base = versions.select(
        "version_id", "content_sha256",
        F.when(F.trim("title") != "", F.col("title")).otherwise(opt("identity_title", F.lit(""))).alias("_title"),
        F.col("content").alias("_content"),
        opt("missing_locator_count", F.lit(0)).alias("missing_locator_count"),
        opt("pending_link_count", F.lit(0)).alias("_pending"),
        opt("is_pdf", F.lit(False)).alias("_pdf"),
        opt("requires_ocr", F.lit(False)).alias("_ocr"),
        (F.col("page_count") if "page_count" in versions.columns else F.lit(None).cast("int")).alias("_pages"),
        opt("extracted_pages", F.lit(0)).alias("_extracted"))
    # Texts are reduced to numbers before any join, so the shuffles carry no document bodies.
    measured = base.select(
        "version_id", "content_sha256", "missing_locator_count", "_pending", "_pdf", "_ocr",
        F.when(F.col("_pages") > 0, F.col("_extracted") / F.col("_pages")).alias("_page_cov"),
        non_space_length(F.col("_content")).alias("non_whitespace_characters"),
        (F.trim("_title") == "").alias("_no_title"),
        token_coverage(F.col("_title"), F.col("_content")).alias("title_token_coverage"))
    joined = (measured.join(repeated_content(sections, cfg["repeated_minimum"]), "version_id", "left")
              .join(duplicate_groups(versions), "content_sha256", "left")
              .fillna({"section_count": 0, "section_characters": 0, "repeated_characters": 0,
                       "repeated_content_ratio": 0.0})
              .withColumn("duplicate_group_size", F.coalesce("duplicate_group_size", F.lit(1))))
    n, cov, rep = (F.col("non_whitespace_characters"), F.col("title_token_coverage"),
                   F.col("repeated_content_ratio"))
    page = F.col("_page_cov")
    pdf_pages = F.col("_pdf") & page.isNotNull()
    # Finding codes and severities, in alphabetical order.
    rules = [
        ("duplicate_normalized_content", "review_required", F.col("duplicate_group_size") > 1),
        ("empty_content", "review_required", n == 0),
        ("high_repeated_content", "review_required", rep >= cfg["repeated_review"]),
        ("incomplete_pdf_page_coverage", "warning",
         pdf_pages & (page < cfg["pages_warning"]) & (page >= cfg["pages_review"])),
        ("linked_document_pending", "review_required", ~F.col("_pdf") & (F.col("_pending") > 0)),
        ("low_pdf_page_coverage", "review_required", pdf_pages & (page < cfg["pages_review"])),
        ("low_section_count", "warning", F.col("section_count") < cfg["sections_warning"]),
        ("low_title_token_coverage", "warning",
         ~F.col("_no_title") & F.coalesce(cov < cfg["title_coverage_warning"], F.lit(False))),
        ("missing_source_locators", "review_required", F.col("missing_locator_count") > 0),
        ("missing_title", "warning", F.col("_no_title")),
        ("pdf_requires_ocr", "review_required", F.col("_pdf") & F.col("_ocr")),
        ("repeated_content", "warning",
         (rep >= cfg["repeated_warning"]) & (rep < cfg["repeated_review"])),
        ("short_content", "warning", (n >= cfg["short_review"]) & (n < cfg["short_warning"])),
        ("very_short_content", "review_required", (n > 0) & (n < cfg["short_review"])),
    ]
    found = F.array_compact(F.array(*[
        F.when(test, F.struct(F.lit(code).alias("code"), F.lit(sev).alias("severity")))
        for code, sev, test in rules]))
    count = lambda sev: F.size(F.filter("findings", lambda f: f["severity"] == sev))
    warn, review = F.col("warning_count"), F.col("review_count")
    return (
        joined.withColumn("findings", found)
        .withColumn("warning_count", count("warning")).withColumn("review_count", count("review_required"))
        .withColumn("outcome", F.when(review > 0, "review_required").when(warn > 0, "warning").otherwise("passed"))
        .withColumn("score", F.greatest(F.lit(0), F.lit(100) - warn * 15 - review * 40))
        .select("version_id", "non_whitespace_characters", "section_count", "section_characters",
                F.round("title_token_coverage", 6).alias("title_token_coverage"),
                "repeated_characters", F.round("repeated_content_ratio", 6).alias("repeated_content_ratio"),
                "duplicate_group_size", "findings", "warning_count", "review_count", "outcome", "score"))


def outcome_tally(assessments: DataFrame) -> DataFrame:
    return assessments.agg(
        F.count(F.lit(1)).alias("assessed"),
        *[F.count_if(F.col("outcome") == o).alias(o) for o in ("passed", "warning", "review_required")],
        F.sum(F.size("findings")).alias("finding_count"))


def finding_counts(assessments: DataFrame) -> DataFrame:
    return (assessments.select(F.inline("findings")).groupBy("code", "severity")
            .agg(F.count(F.lit(1)).alias("finding_count")))


def corpus_fingerprint(versions: DataFrame, sections: DataFrame) -> DataFrame:
    """One digest of a corpus: each document is hashed on its own (its section list is bounded by
    the document), then the document digests are combined without collecting them."""
    per_doc = sections.groupBy("version_id").agg(F.sha2(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("ordinal", "text_sha256"))),
        lambda s: s["text_sha256"]), "\n"), 256).alias("_sections"))
    docs = versions.select("version_id", "content_sha256", "title").join(per_doc, "version_id", "left")
    digest = F.sha2(F.concat_ws("\n", F.col("version_id").cast("string"), "content_sha256", "title",
                                F.coalesce("_sections", F.lit(""))), 256)
    return docs.select(digest.alias("_d")).agg(F.count("_d").alias("documents"),
                                               set_digest(F.col("_d")).alias("corpus_digest"))
