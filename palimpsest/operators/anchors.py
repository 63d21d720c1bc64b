"""Structural anchors: spans of a section that start at a recognized heading line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.scalars import let
from palimpsest.functions.text import SPACE, SPACE_CHARS, strip
from palimpsest.operators.sections import running_starts

# Anchor types in priority order with the line pattern (English and Malay), matched
# case-insensitively at the start of a line; group 1 is the reference.
ANCHOR_LINES = (
    ("part", r"(?:part|bahagian)\s+([ivxlcdm]+|\d+[a-z]?)\b.*"),
    ("division", r"(?:division|penggal)\s+([ivxlcdm]+|\d+[a-z]?)\b.*"),
    ("section", r"(?:section|seksyen)\s+(\d{1,3}[a-z]?(?:\([a-z0-9]+\))*)\b.*"),
    ("regulation", r"(?:regulation|peraturan)\s+(\d{1,3}[a-z]?(?:\([a-z0-9]+\))*)\b.*"),
    ("schedule", r"(?:schedule|jadual)(?:\s+([a-z0-9ivxlcdm]+))?\b.*"),
    ("circular", r"(?:circular|pekeliling).*?(?:no\.?|bil\.?)\s*(\d+(?:\s*/\s*\d{4})?)\b.*"),
    ("order", r"(?:order|perintah)(?:\s+([a-z0-9./()-]+))?\b.*"),
    ("paragraph", r"(?:paragraph|perenggan)\s+(\d{1,3}[a-z]?(?:\([a-z0-9]+\))*)\b.*"),
    ("clause", r"(\d{1,3}[a-z]?(?:\([a-z0-9]+\))*)[.)]?\s+\S.*"),
)


def canonical_reference(value: Column) -> Column:
    """Reference without spaces, lower case, outer punctuation trimmed, ``main`` when empty."""
    bare = F.btrim(F.lower(F.regexp_replace(value, SPACE, "")), F.lit(".-–—:()"))
    return F.when(bare == "", F.lit("main")).otherwise(bare)


def line_anchor(line: Column) -> Column:
    """``struct(anchor_type, reference)`` of a stripped line, null when no pattern matches."""
    out = F.lit(None).cast("struct<anchor_type:string,reference:string>")
    for name, pattern in reversed(ANCHOR_LINES):
        full = rf"(?i)^{pattern}$"
        ref = canonical_reference(F.regexp_extract(line, full, 1))
        out = F.when(line.rlike(full), F.struct(F.lit(name).alias("anchor_type"),
                                                ref.alias("reference"))).otherwise(out)
    return out


def _split_pattern() -> str:
    """Zero-width split point at the start of every line that is an anchor line."""
    in_line = lambda p: p.replace(r"\s", r"[^\S\r\n]")
    any_line = "|".join(f"(?:{in_line(p)})" for _, p in ANCHOR_LINES)
    return rf"(?im)(?=^[^\S\r\n]*(?:{any_line})$)"


def anchor_spans(sections: DataFrame, offsets: bool = True) -> DataFrame:
    """Split each section at its anchor lines.

    Input: section_id, version_id, ordinal, text, optional heading, page_number, char_start.
    The split, the running offsets and the fallback are computed inside the row; no shuffle, linear in its pieces.
    Output per span: section_id, version_id, section_ordinal, span, anchor_type, base_key, label,
    text, relative_start, relative_end, char_start, char_end; the last four, which need a Python process, only with
    ``offsets``.
    """
    have = set(sections.columns)
    heading = F.col("heading") if "heading" in have else F.lit("")
    page = F.col("page_number") if "page_number" in have else F.lit(None).cast("int")
    base = F.col("char_start") if "char_start" in have else F.lit(0)
    sections = sections.select(
        "section_id", "version_id", F.col("ordinal").alias("section_ordinal"),
        F.col("text").alias("_text"), F.coalesce(heading, F.lit("")).alias("_heading"),
        page.alias("_page"), base.cast("bigint").alias("_base"))
    lead = lambda c: F.length(c) - F.length(F.ltrim(c, F.lit(SPACE_CHARS)))
    first_line = lambda c: strip(F.split_part(F.replace(c, F.lit("\r"), F.lit("\n")), F.lit("\n"), F.lit(1)))
    any_line = "|".join(f"(?:{p})" for _, p in ANCHOR_LINES)
    is_anchor = lambda text: first_line(text).rlike(rf"(?i)^(?:{any_line})$")
    # A first piece without an anchor line is the preamble and starts at 0.
    start = lambda p, text, i: F.when(is_anchor(text), F.get("_starts", i) + lead(p) if offsets else i.cast("bigint"))
    pieces = F.transform("_pieces", lambda p, i: let(strip(p), lambda text: F.struct(
        i.alias("i"), text.alias("text"), start(p, text, i).alias("start"))))
    end = lambda spans, s: F.coalesce(F.get(spans, s["i"] + 1)["start"], F.length("_text").cast("bigint"))
    rows = lambda spans: F.filter(F.transform(spans, lambda s: F.struct(
        s["i"].alias("span"), s["text"].alias("text"),
        F.coalesce(s["start"], F.lit(0).cast("bigint")).alias("relative_start"),
        end(spans, s).alias("relative_end"), s["start"].isNotNull().alias("is_anchor"),
        F.size(spans).alias("_n"))),
        lambda r: r["is_anchor"] | (r["text"] != "") | (r["_n"] == 1))
    spans = let(pieces, rows)
    sections = sections.withColumn("_pieces", F.split(F.col("_text"), _split_pattern()))
    if offsets:
        sections = sections.withColumn("_starts", running_starts(F.transform("_pieces", lambda p: F.length(p).cast("bigint"))))
    out = sections.select("section_id", "version_id", "section_ordinal", "_text", "_heading", "_page",
                          "_base", F.inline(spans))
    label_line = first_line(F.col("text"))
    hit = line_anchor(label_line)
    out = out.withColumn("_hit", F.when(F.col("is_anchor"), hit))
    fallback = ~F.col("is_anchor") & (F.col("_n") == 1)
    fallback_type = F.when(F.coalesce(F.col("_page"), F.lit(0)) != 0, "page").otherwise("section")
    fallback_ref = F.when(F.coalesce(F.col("_page"), F.lit(0)) != 0, F.col("_page")).otherwise(
        F.col("section_ordinal")).cast("string")
    kind = (F.when(F.col("is_anchor"), F.col("_hit.anchor_type"))
            .when(fallback, fallback_type).otherwise(F.lit("preamble")))
    reference = (F.when(F.col("is_anchor"), F.col("_hit.reference"))
                 .when(fallback, fallback_ref).otherwise(F.col("section_ordinal").cast("string")))
    headed = F.when(F.col("_heading") != "", F.col("_heading"))
    label = (F.when(F.col("is_anchor"), label_line)
             .when(fallback, F.coalesce(headed, F.concat(F.initcap(kind), F.lit(" "), reference)))
             .otherwise(F.coalesce(headed, F.lit("Preamble"))))
    return out.select(
        "section_id", "version_id", "section_ordinal", "span", kind.alias("anchor_type"),
        F.concat_ws(":", kind, reference).alias("base_key"), label.alias("label"),
        F.when(fallback, F.col("_text")).otherwise(F.col("text")).alias("text"),
        *(("relative_start", "relative_end",
           (F.col("_base") + F.col("relative_start")).alias("char_start"),
           (F.col("_base") + F.col("relative_end")).alias("char_end")) if offsets else ()))


def number_anchors(spans: DataFrame) -> DataFrame:
    """Ordinals per version and ``:occurrence:n`` suffixes for repeated keys.

    A version's spans come from one document, which bounds the group; both windows share one
    shuffle on the version."""
    version = W.partitionBy("version_id")
    by_key = W.partitionBy("version_id", "base_key")
    ordered = version.orderBy("section_ordinal", "section_id", "span")
    numbered = spans.withColumn("ordinal", F.row_number().over(ordered))
    numbered = numbered.withColumn("_total", F.count(F.lit(1)).over(by_key)).withColumn(
        "_nth", F.row_number().over(by_key.orderBy("ordinal")))
    key = F.when(F.col("_total") > 1, F.concat_ws(":", "base_key", F.lit("occurrence"), F.col("_nth").cast("string"))
                 ).otherwise(F.col("base_key"))
    return (numbered.withColumn("canonical_key", key)
            .withColumn("text_sha256", F.sha2("text", 256))
            .withColumn("anchor_id", F.concat_ws("#", F.col("version_id").cast("string"), F.col("ordinal").cast("string")))
            .drop("_total", "_nth"))


def version_anchors(sections: DataFrame, offsets: bool = True) -> DataFrame:
    return number_anchors(anchor_spans(sections, offsets))
