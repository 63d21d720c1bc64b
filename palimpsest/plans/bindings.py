"""Canonical tables as deterministic views of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators.anchors import version_anchors
from palimpsest.operators.sections import line_sections
from palimpsest.plans.registry import SQL_ONLY, shared, spark_binding
from palimpsest.session import stage

# --- documents: versions, sections, anchors ------------------------------------------------------


@shared
def version(d):
    return f"""
    SELECT doc_id AS version_id, {d.sha("concat_ws(chr(10), source, lang)")} AS identity_id,
      source AS collection_id, lang AS language, text AS content, {d.sha("text")} AS content_sha256,
      split_part(text, chr(10), 1) AS title,
      concat('https://', source, '.example.org/', lang, '/', cast(doc_id as string), '.html') AS canonical_url,
      CASE lang WHEN 'fr' THEN 'pdf' WHEN 'de' THEN 'ocr' WHEN 'es' THEN 'plain' ELSE 'html' END AS extractor_name,
      {d.ts("2024-01-01 00:00:00")} + {d.minutes("doc_id")} AS created_at
    FROM documents"""


@shared
def collection(d):
    return """
    SELECT DISTINCT source AS collection_id, source <> 'src3' AS collection_enabled,
      source <> 'src5' AS evidence_eligible FROM documents"""


@shared
def lineage(d):
    return f"""
    SELECT version_id, identity_id, created_at, content_sha256 AS artifact_id,
      CASE language WHEN 'fr' THEN 'official_file' WHEN 'de' THEN 'official_file'
        WHEN 'es' THEN 'unknown' ELSE 'landing_page' END AS track,
      CASE WHEN language = 'es' THEN 'quarantined' WHEN q.quality = 1 THEN 'verified'
        WHEN q.toxic = 1 THEN 'quarantined' ELSE 'reconstructable' END AS provenance_status
    FROM version LEFT JOIN labels q ON q.doc_id = version_id"""


@spark_binding
def section(t):
    return line_sections(t.version)


SQL_ONLY["section"] = r"""
    SELECT version_id || ':' || ordinal AS section_id, version_id, ordinal, text, sha256(text) AS text_sha256,
      char_start, char_start + length(text) AS char_end
    FROM (
      SELECT version_id, text, cast(row_number() OVER w AS int) AS ordinal,
        cast(coalesce(sum(length(text) + 2) OVER (PARTITION BY version_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS char_start
      FROM (SELECT version_id, i, trim(regexp_replace(line, '[\s\x{00a0}]+', ' ', 'g')) AS text
            FROM (SELECT version_id, unnest(string_split(content, chr(10))) AS line,
                    generate_subscripts(string_split(content, chr(10)), 1) AS i FROM version))
      WHERE text <> '' WINDOW w AS (PARTITION BY version_id ORDER BY i))"""


def placeless_section(t):
    """``section`` without offsets, for what reads texts and hashes only: they need a Python process, which no
    optimizer leaves out."""
    return line_sections(t.version, offsets=False)


@spark_binding
def corpus_section(t):
    """Sections with the identity and titles of their version, for search. An identity's title is its
    collection and language; every eighth line heads the seven after it."""
    keep = ("identity_id", "title", "identity_title", "canonical_url", "collection_id", "language", "created_at")
    versions = t.version.withColumn("identity_title", F.concat_ws(" ", "collection_id", "language"))
    return line_sections(versions, keep=keep, heading_every=8, offsets=False)


SQL_ONLY["corpus_section"] = """
    SELECT s.*, v.identity_id, v.title, concat_ws(' ', v.collection_id, v.language) AS identity_title, v.canonical_url, v.collection_id, v.language, v.created_at,
      CASE WHEN (s.ordinal - 1) % 8 = 0 THEN '' ELSE first_value(s.text) OVER (PARTITION BY s.version_id, (s.ordinal - 1) // 8 ORDER BY s.ordinal) END AS heading
    FROM section s JOIN version v USING (version_id)"""

# A document as one section whose lines carry a heading, every seventh from the first left bare, so
# that anchors, preambles and fallbacks all occur.


@spark_binding
def headed_section(t):
    lines = F.split("content", "\n")
    headed = F.transform(lines, lambda l, i: F.when(F.pmod(i, F.lit(7)) == 0, l).otherwise(
        F.concat(F.lit("Section "), (i + 1).cast("string"), F.lit(" "), l)))
    return t.version.select(
        F.col("version_id").cast("string").alias("section_id"), "version_id", F.lit(1).alias("ordinal"),
        F.array_join(headed, "\n").alias("text"), F.lit(0).alias("char_start"))


SQL_ONLY["headed_line"] = """
    SELECT version_id, i, CASE WHEN (i - 1) % 7 = 0 THEN line ELSE 'Section ' || i || ' ' || line END AS line
    FROM (SELECT version_id, unnest(string_split(content, chr(10))) AS line,
            generate_subscripts(string_split(content, chr(10)), 1) AS i FROM version)"""

# The edited version of every document: line 3 dropped, words appended to line 5, lines 8 and 9
# swapped under their headings, line 7 renumbered to 7a with a word added, a space doubled in line 12.


@spark_binding
def edited_section(t):
    lines = F.split("content", "\n")
    headed = F.transform(lines, lambda l, i: F.when(F.pmod(i, F.lit(7)) == 0, l).otherwise(
        F.concat(F.lit("Section "), (i + 1).cast("string"), F.lit(" "), l)))
    n = F.size(lines)
    swapped = F.transform(headed, lambda l, i: F.when((i == 8) & (n > 9), F.get(headed, F.lit(9)))
                          .when((i == 9) & (n > 9), F.get(headed, F.lit(8))).otherwise(l))
    edited = F.transform(swapped, lambda l, i: F.when(i == 2, F.lit(None).cast("string"))
                         .when(i == 4, F.concat(l, F.lit(" as amended from time to time")))
                         .when(i == 6, F.concat(F.regexp_replace(l, "^Section 7 ", "Section 7a "), F.lit(" herein")))
                         .when(i == 11, F.regexp_replace(l, "^(Section \\d+) ", "$1  ")).otherwise(l))
    return t.version.select(
        F.col("version_id").cast("string").alias("section_id"), "version_id", F.lit(1).alias("ordinal"),
        F.array_join(F.array_compact(edited), "\n").alias("text"), F.lit(0).alias("char_start"))


SQL_ONLY["edited_line"] = r"""
    SELECT version_id, i, CASE WHEN i = 5 THEN line || ' as amended from time to time'
        WHEN i = 7 THEN regexp_replace(line, '^Section 7 ', 'Section 7a ') || ' herein'
        WHEN i = 12 THEN regexp_replace(line, '^(Section \d+) ', '\1  ') ELSE line END AS line
    FROM (SELECT a.version_id, a.i, coalesce(b.line, a.line) AS line
          FROM (SELECT *, max(i) OVER (PARTITION BY version_id) AS n FROM headed_line) a
          LEFT JOIN headed_line b ON a.version_id = b.version_id AND a.n > 9
            AND ((a.i = 9 AND b.i = 10) OR (a.i = 10 AND b.i = 9)))
    WHERE i <> 3"""


def _anchor_sql(lines: str) -> str:
    return rf"""
    SELECT version_id, span, anchor_type, base_key, label, text, relative_start, relative_end,
      cast(row_number() OVER (PARTITION BY version_id ORDER BY span) AS int) AS ordinal,
      CASE WHEN count(*) OVER (PARTITION BY version_id, base_key) > 1 THEN base_key || ':occurrence:' ||
        row_number() OVER (PARTITION BY version_id, base_key ORDER BY span) ELSE base_key END AS canonical_key,
      sha256(text) AS text_sha256
    FROM (
      SELECT version_id, span, min(start_) AS relative_start, max(end_) AS relative_end, max(n) AS n,
        CASE WHEN max(hit) = 0 AND max(n) = 0 THEN 'section' WHEN max(hit) = 0 THEN 'preamble' ELSE 'section' END AS anchor_type,
        CASE WHEN max(hit) = 0 AND max(n) = 0 THEN 'section:1' WHEN max(hit) = 0 THEN 'preamble:1'
          ELSE 'section:' || regexp_extract(min_by(line, i), '^Section (\d+[a-z]?) ', 1) END AS base_key,
        CASE WHEN max(hit) = 0 AND max(n) = 0 THEN 'Section 1' WHEN max(hit) = 0 THEN 'Preamble' ELSE trim(min_by(line, i)) END AS label,
        CASE WHEN max(hit) = 0 AND max(n) = 0 THEN string_agg(line, chr(10) ORDER BY i)
          ELSE trim(string_agg(line, chr(10) ORDER BY i)) END AS text
      FROM (
        SELECT *, sum(hit) OVER (PARTITION BY version_id ORDER BY i) AS span, sum(hit) OVER (PARTITION BY version_id) AS n,
          off AS start_, off + length(line) + CASE WHEN i = last_i THEN 0 ELSE 1 END AS end_
        FROM (
          SELECT version_id, i, line, CASE WHEN regexp_matches(line, '^Section \d{{1,3}}[a-z]? ') THEN 1 ELSE 0 END AS hit,
            max(i) OVER (PARTITION BY version_id) AS last_i,
            cast(coalesce(sum(length(line) + 1) OVER (PARTITION BY version_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS off
          FROM {lines}))
      GROUP BY version_id, span)
    WHERE anchor_type = 'section' OR text <> ''"""


SQL_ONLY["anchor"] = _anchor_sql("headed_line")
SQL_ONLY["edited_anchor"] = _anchor_sql("edited_line")


@spark_binding
def anchor(t):
    return version_anchors(t.headed_section)


@spark_binding
def edited_anchor(t):
    return version_anchors(t.edited_section)


@spark_binding
def before_anchor(t):
    return stage(t.anchor.withColumn("comparison_id", F.col("version_id").cast("string")), "before-anchors")


@spark_binding
def after_anchor(t):
    after = (t.edited_anchor.withColumn("comparison_id", F.col("version_id").cast("string"))
             .withColumn("anchor_id", F.concat(F.lit("e"), F.col("anchor_id"))))
    return stage(after, "after-anchors")


# --- retrieval -----------------------------------------------------------------------------------


@shared
def retrieval_query(d):
    return "SELECT item_id AS query_id, text AS query FROM benchmark"


# --- chat ----------------------------------------------------------------------------------------


@shared
def chat_answer(d):
    return """
    SELECT conv_id, turn, role, text, concat(text, ' [', cast(turn as string), ', ', cast(length(text) as string), '] see [',
        cast(conv_id as string), '; 1]') AS answer,
      CASE WHEN role = 'system' THEN concat('not ', text) ELSE concat('  ', replace(split_part(text, chr(10), 1), 'e', 'E'), ' ') END AS quote
    FROM conversations"""
