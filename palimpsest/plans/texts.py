"""Registered queries over documents: text expressions, sections, anchors, quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import keys, text
from palimpsest.functions.scalars import any_locator, valid_vector
from palimpsest.operators import anchors as anchor_ops
from palimpsest.operators import quality
from palimpsest.plans.bindings import placeless_section
from palimpsest.plans.registry import SQL_ONLY, query

SP = r"[\s\x{00a0}]+"
COMPACT = lambda x: rf"trim(regexp_replace({x}, '{SP}', ' ', 'g'))"
NONSPACE = lambda x: rf"length(regexp_replace({x}, '{SP}', '', 'g'))"
WORDS = lambda x: rf"regexp_extract_all(lower({x}), '[\pL\pN_]+')"
TOKSET = lambda x: f"list_distinct(list_filter({WORDS(x)}, lambda w: length(w) >= 3))"


@query("normalize_text", "F1 F2 F3", rf"""
SELECT version_id, {COMPACT("content")} AS inline_text,
  regexp_replace(regexp_replace(array_to_string(list_transform(string_split(content, chr(10)), lambda l: {COMPACT("l")}), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g') AS multiline_text,
  {NONSPACE("content")} AS non_space_length FROM version""")
def normalize_text(t):
    c = F.col("content")
    return t.version.select("version_id", text.normalize_inline(c).alias("inline_text"),
                            text.normalize_multiline(c).alias("multiline_text"),
                            text.non_space_length(c).cast("bigint").alias("non_space_length"))


@query("token_sets", "F4 F5 F32", f"""
SELECT version_id, len({TOKSET("content")}) AS token_count,
  array_to_string(list_sort({TOKSET("title")}), ' ') AS title_tokens,
  CASE WHEN len({TOKSET("title")}) > 0 THEN round(len(list_intersect({TOKSET("title")}, {TOKSET("content")})) / len({TOKSET("title")}), 8) END AS title_coverage
FROM version""")
def token_sets(t):
    c, title = F.col("content"), F.col("title")
    return t.version.select(
        "version_id", F.size(text.token_set(c)).cast("bigint").alias("token_count"),
        F.array_join(F.array_sort(text.token_set(title)), " ").alias("title_tokens"),
        F.round(text.token_coverage(title, c), 8).alias("title_coverage"))


_STOP = "['and','are','does','for','from','how','into','that','the','this','what','when','where','which','who','why','with']"
_QW = lambda x: rf"list_distinct(regexp_extract_all(lower({x}), '[\pL\pN]+'))"
_WANT = lambda x: f"list_filter({_QW(x)}, lambda w: length(w) > 2 AND NOT list_contains({_STOP}, w))"


@query("query_title_overlap", "F6", f"""
SELECT version_id, coalesce(CASE WHEN len({_WANT("content")}) > 0 THEN
  round(len(list_intersect({_WANT("content")}, {_QW("title")})) / len({_WANT("content")}), 8) END, 0.0) AS overlap
FROM version""")
def query_title_overlap(t):
    return t.version.select("version_id", F.round(text.query_title_overlap(
        F.col("content"), F.col("title")), 8).alias("overlap"))


@query("display_titles", "F7", r"""
SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS version_title,
  CASE WHEN base <> '' THEN base ELSE url END AS url_title
FROM (SELECT *, trim(url_decode(list_last(string_split(regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/+$', ''), '/')))) AS base FROM pages)""")
def display_titles(t):
    found = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return t.pages.select(
        "page_id", text.display_title(found, F.lit(""), F.col("url")).alias("version_title"),
        text.display_title(F.lit("  "), F.col("url"), F.col("url")).alias("url_title"))


SQL_ONLY["excerpt_input"] = rf"""
    SELECT version_id, {COMPACT("content")} AS c,
      list_filter(string_split({COMPACT("lower(split_part(content, chr(10), greatest(1, len(string_split(content, chr(10))) // 2)))")}, ' '), lambda w: length(w) > 2) AS words
    FROM version"""


@query("bounded_excerpts", "F8", """
SELECT version_id, length(c) > 620 AS truncated, CASE WHEN length(c) <= 620 THEN c
    WHEN start_ + 620 < length(c) THEN rtrim(head) || '…' ELSE head END AS excerpt
FROM (SELECT *, CASE WHEN start_ > 0 THEN '…' || ltrim(substr(c, start_ + 1, 620)) ELSE substr(c, start_ + 1, 620) END AS head FROM (
  SELECT *, greatest(0, coalesce(list_min(list_filter(list_transform(words, lambda w: instr(lower(c), w) - 1), lambda p: p >= 0)), 0) - 155) AS start_ FROM excerpt_input))""")
def bounded_excerpts(t):
    # The query of each document is its middle line.
    lines = F.split("content", "\n")
    middle = F.element_at(lines, F.greatest(F.lit(1), F.floor(F.size(lines) / 2).cast("int")))
    e = text.bounded_excerpt(F.col("content"), middle)
    return t.version.select("version_id", e.alias("e")).select("version_id", "e.truncated", "e.excerpt")


@query("evidence_truncation", "F35", """
SELECT version_id, substr(content, 1, 2000) AS bounded_text, length(content) > 2000 AS truncated FROM version""")
def evidence_truncation(t):
    b = text.bounded_text(F.col("content"), 2000)
    return t.version.select("version_id", b["text"].alias("bounded_text"), b["truncated"].alias("truncated"))


@query("citation_markers", "F22", r"""
SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(
  array_to_string(regexp_extract_all(answer, '\[((?:\s*\d+\s*)(?:(?:,|;)\s*\d+\s*)*)\]', 1), ' '), '\d+'), lambda x: cast(x as int)))), ',') AS numbers
FROM chat_answer""")
def citation_markers(t):
    return t.chat_answer.select("conv_id", "turn", F.array_join(text.citation_numbers(
        F.col("answer")).cast("array<string>"), ",").alias("numbers"))


@query("verified_quotes", "F23", rf"""
SELECT conv_id, turn, CASE WHEN q <> '' AND contains(lower({COMPACT("text")}), lower(q)) THEN substr(q, 1, 500) END AS quote
FROM (SELECT *, {COMPACT("quote")} AS q FROM chat_answer)""")
def verified_quotes(t):
    return t.chat_answer.select("conv_id", "turn", text.verified_quote(F.col("text"), F.col("quote")).alias("quote"))


@query("thread_titles", "F24", rf"""
SELECT conv_id, turn, CASE WHEN length(c) <= 76 THEN c ELSE
  rtrim(regexp_extract(c, '^(.{{0,75}})\s', 1)) || '…' END AS title
FROM (SELECT conv_id, turn, {COMPACT("text")} AS c FROM conversations)""")
def thread_titles(t):
    return t.conversations.select("conv_id", "turn", text.shorten(F.col("text")).alias("title"))


@query("embedding_inputs", "F33", """
SELECT section_id, CASE WHEN trim(title) <> '' THEN 'Document title: ' || trim(title) || chr(10) ELSE '' END || CASE WHEN trim(heading) <> '' THEN 'Section heading: ' || trim(heading) || chr(10) ELSE '' END || text AS input_text FROM corpus_section""")
def embedding_inputs(t):
    return t.corpus_section.select("section_id", text.embedding_input(
        F.col("title"), F.col("heading"), F.col("text")).alias("input_text"))


@query("vector_checks", "F34", """
SELECT vec_id, len(embedding) = 64 AND len(list_filter(embedding, lambda v: isfinite(v))) = len(embedding) AS valid FROM embeddings""")
def vector_checks(t):
    return t.embeddings.select("vec_id", valid_vector(F.col("embedding"), 64).alias("valid"))


@query("section_offsets", "W20 F15 S8", "SELECT section_id, version_id, ordinal, text_sha256, char_start, char_end FROM section")
def section_offsets(t):
    return t.section.select("section_id", "version_id", "ordinal", "text_sha256", "char_start", "char_end")


@query("anchor_lines", "F17 F18", r"""
SELECT version_id, i, regexp_extract(line, '^Section (\d+) ', 1) AS reference FROM headed_line WHERE regexp_matches(line, '^Section \d{1,3} ')""")
def anchor_lines(t):
    lines = t.headed_section.select("version_id", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    hit = anchor_ops.line_anchor(F.trim("line"))
    return (lines.select("version_id", (F.col("p") + 1).cast("bigint").alias("i"), hit.alias("h"))
            .filter("h is not null").select("version_id", "i", F.col("h.reference").alias("reference")))


@query("structural_anchors", "T13 W4", """
SELECT version_id, ordinal, anchor_type, base_key, canonical_key, label, text_sha256, relative_start, relative_end FROM anchor""")
def structural_anchors(t):
    return t.anchor.select("version_id", "ordinal", "anchor_type", "base_key", "canonical_key", "label",
                           "text_sha256", "relative_start", "relative_end")


# --- quality -------------------------------------------------------------------------------------

SQL_ONLY["pair_chars"] = f"""
    SELECT version_id, text_sha256, sum({NONSPACE("text")}) AS chars, count(*) AS n, max({NONSPACE("text")}) AS len FROM section GROUP BY ALL"""
SQL_ONLY["shared_hash"] = "SELECT text_sha256 FROM pair_chars GROUP BY 1 HAVING count(*) > 1 AND max(len) >= 80"
SQL_ONLY["repeated"] = """
    SELECT p.version_id, sum(n) AS section_count, sum(chars) AS section_characters,
      coalesce(sum(chars) FILTER (WHERE h.text_sha256 IS NOT NULL), 0) AS repeated_characters
    FROM pair_chars p LEFT JOIN shared_hash h USING (text_sha256) GROUP BY 1"""
SQL_ONLY["quality_metrics"] = f"""
    SELECT v.version_id, {NONSPACE("content")} AS chars, trim(title) = '' AS no_title,
      CASE WHEN len({TOKSET("title")}) > 0 THEN len(list_intersect({TOKSET("title")}, {TOKSET("content")})) / len({TOKSET("title")}) END AS cov,
      coalesce(r.section_count, 0) AS section_count, coalesce(section_characters, 0) AS section_characters,
      coalesce(repeated_characters, 0) AS repeated_characters,
      coalesce(repeated_characters / nullif(section_characters, 0), 0.0) AS rep,
      count(*) OVER (PARTITION BY content_sha256) AS dup
    FROM version v LEFT JOIN repeated r USING (version_id)"""
SQL_ONLY["quality_finding"] = """
    SELECT version_id, unnest(list_filter([
      CASE WHEN dup > 1 THEN 'duplicate_normalized_content:review_required' END,
      CASE WHEN chars = 0 THEN 'empty_content:review_required' END,
      CASE WHEN rep >= 0.8 THEN 'high_repeated_content:review_required' END,
      CASE WHEN section_count < 2 THEN 'low_section_count:warning' END,
      CASE WHEN NOT no_title AND cov < 0.5 THEN 'low_title_token_coverage:warning' END,
      CASE WHEN no_title THEN 'missing_title:warning' END,
      CASE WHEN rep >= 0.5 AND rep < 0.8 THEN 'repeated_content:warning' END,
      CASE WHEN chars >= 100 AND chars < 400 THEN 'short_content:warning' END,
      CASE WHEN chars > 0 AND chars < 100 THEN 'very_short_content:review_required' END], lambda x: x IS NOT NULL)) AS finding
    FROM quality_metrics"""
SQL_ONLY["quality_result"] = """
    SELECT m.version_id, chars AS non_whitespace_characters, section_count, section_characters, round(cov, 6) AS title_token_coverage,
      repeated_characters, round(rep, 6) AS repeated_content_ratio, dup AS duplicate_group_size,
      coalesce(f.findings, '') AS findings, coalesce(w, 0) AS warning_count, coalesce(r, 0) AS review_count,
      CASE WHEN coalesce(r, 0) > 0 THEN 'review_required' WHEN coalesce(w, 0) > 0 THEN 'warning' ELSE 'passed' END AS outcome,
      greatest(0, 100 - coalesce(w, 0) * 15 - coalesce(r, 0) * 40) AS score
    FROM quality_metrics m LEFT JOIN (
      SELECT version_id, string_agg(split_part(finding, ':', 1), ',' ORDER BY finding) AS findings,
        count(*) FILTER (WHERE finding LIKE '%:warning') AS w, count(*) FILTER (WHERE finding LIKE '%:review_required') AS r
      FROM quality_finding GROUP BY 1) f USING (version_id)"""


def flat_quality(t):
    out = quality.assess(t.version, placeless_section(t))
    return out.withColumn("findings", F.array_join(F.transform("findings", lambda f: f["code"]), ","))


@query("document_quality", "G1", "SELECT * FROM quality_result")
def document_quality(t):
    return flat_quality(t)


@query("quality_outcomes", "A11", """
SELECT count(*) AS assessed, count(*) FILTER (WHERE outcome = 'passed') AS passed, count(*) FILTER (WHERE outcome = 'warning') AS warning,
  count(*) FILTER (WHERE outcome = 'review_required') AS review_required, sum(warning_count + review_count) AS finding_count FROM quality_result""")
def quality_outcomes(t):
    return quality.outcome_tally(quality.assess(t.version, placeless_section(t)))


@query("quality_finding_counts", "A7", """
SELECT split_part(finding, ':', 1) AS code, split_part(finding, ':', 2) AS severity, count(*) AS finding_count FROM quality_finding GROUP BY ALL""")
def quality_finding_counts(t):
    return quality.finding_counts(quality.assess(t.version, placeless_section(t)))


@query("duplicate_members", "A13", """
SELECT version_id, content_sha256, n AS duplicate_group_size FROM (SELECT *, count(*) OVER (PARTITION BY content_sha256) AS n FROM version) WHERE n > 1""")
def duplicate_members(t):
    return t.version.select("version_id", "content_sha256").join(quality.duplicate_groups(t.version), "content_sha256")


@query("shared_section_hashes", "A14", f"""
SELECT text_sha256, max({NONSPACE("text")}) AS section_length FROM section GROUP BY 1 HAVING count(DISTINCT version_id) > 1 AND max({NONSPACE("text")}) >= 80""")
def shared_section_hashes(t):
    return quality.shared_sections(t.section)


@query("repeated_content_ratio", "A15", """
SELECT version_id, section_count, section_characters, repeated_characters, round(repeated_characters / section_characters, 8) AS ratio FROM repeated""")
def repeated_content_ratio(t):
    return quality.repeated_content(t.section).select(
        "version_id", "section_count", "section_characters", "repeated_characters",
        F.round("repeated_content_ratio", 8).alias("ratio"))


# Pages of an artifact: each document's lines are its pages; lines under 20 characters carry no text.
SQL_ONLY["artifact_page"] = """
    SELECT version_id AS artifact_id, i AS page_number, CASE WHEN length(line) >= 20 THEN line ELSE '' END AS page_text,
      count(*) OVER (PARTITION BY version_id) AS page_count
    FROM (SELECT version_id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS i FROM version)"""


@query("page_coverage", "A16 T12 S8", f"""
SELECT artifact_id, count(DISTINCT page_number) FILTER (WHERE {NONSPACE("page_text")} > 0) AS extracted_pages, max(page_count) AS page_count,
  round(count(DISTINCT page_number) FILTER (WHERE {NONSPACE("page_text")} > 0) / max(page_count), 8) AS page_coverage,
  sum({NONSPACE("page_text")}) < max(page_count) * 40 AS requires_ocr FROM artifact_page GROUP BY 1""")
def page_coverage(t):
    lines = F.split("content", "\n")
    pages = t.version.select(F.col("version_id").alias("artifact_id"), F.size(lines).cast("bigint").alias("page_count"),
                             F.posexplode(lines).alias("p", "line"))
    pages = pages.select("artifact_id", "page_count", (F.col("p") + 1).alias("page_number"),
                         F.when(F.length("line") >= 20, F.col("line")).otherwise("").alias("page_text"))
    return quality.page_coverage(pages).withColumn("page_coverage", F.round("page_coverage", 8))


_PART = lambda x, i: f"sum(('0x' || substr({x}, {i * 15 + 1}, 15))::bigint::hugeint)"


def digest_sql(value: str) -> str:
    """SQL twin of the order-free set digest of a sha-able text expression."""
    h = f"sha256({value})"
    return ("sha256(concat_ws(':', count(" + value + ")::varchar, "
            + ", ".join(f"({_PART(h, i)})::varchar" for i in range(4)) + "))")


@query("corpus_fingerprint", "A12", f"""
SELECT count(*) AS documents, {digest_sql("d")} AS corpus_digest FROM (
  SELECT sha256(concat_ws(chr(10), version_id::varchar, content_sha256, title, coalesce(s.h, ''))) AS d FROM version v LEFT JOIN (
    SELECT version_id, sha256(string_agg(text_sha256, chr(10) ORDER BY ordinal)) AS h FROM section GROUP BY 1) s USING (version_id))""")
def corpus_fingerprint(t):
    return quality.corpus_fingerprint(t.version, t.section)
