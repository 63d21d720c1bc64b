"""Registered queries over reviewed changes: impacts, profiles, reviews, publication."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import impacts
from palimpsest.operators.history import review_chain
from palimpsest.plans.registry import SQL_ONLY, query, shared

# Orders as change items, their lines as reviews (flag A confirms, R rejects, N needs context).


@shared
def change_item(d):
    return """
    SELECT o_orderkey AS item_id, o_custkey AS comparison_id, o_orderdate AS created_at,
      CASE o_orderpriority WHEN '1-URGENT' THEN 'modified' WHEN '2-HIGH' THEN 'added' WHEN '3-MEDIUM' THEN 'removed'
        WHEN '4-NOT SPECIFIED' THEN 'format_only' ELSE 'unchanged' END AS change_type,
      CASE WHEN o_orderpriority <> '2-HIGH' THEN concat('before ', cast(o_custkey as string)) END AS before_text,
      CASE WHEN o_orderpriority <> '3-MEDIUM' THEN concat('after ', o_orderpriority) END AS after_text
    FROM orders"""


@shared
def change_review(d):
    return """
    SELECT concat_ws('-', cast(l_orderkey as string), cast(l_linenumber as string), cast(l_partkey as string), cast(l_suppkey as string)) AS review_id,
      l_orderkey AS item_id, l_suppkey AS reviewer_id, l_shipdate AS created_at,
      CASE l_returnflag WHEN 'A' THEN 'confirmed' WHEN 'R' THEN 'rejected' ELSE 'needs_context' END AS decision, l_tax, l_quantity, l_linestatus
    FROM lineitem"""


@shared
def change_publication(d):
    return f"""
    SELECT review_id, item_id, reviewer_id + 1 AS publisher_id, created_at AS reviewed_at, created_at + {d.days("l_quantity")} AS published_at
    FROM change_review WHERE decision = 'confirmed' AND l_tax >= 0.04"""


@shared
def impact_review(d):
    return """
    SELECT concat_ws('/', cast(l_partkey as string), cast(l_orderkey as string), cast(l_linenumber as string), cast(l_suppkey as string)) AS review_id,
      l_partkey AS impact_id, l_suppkey AS reviewer_id, l_shipdate AS created_at,
      CASE l_returnflag WHEN 'A' THEN 'approved' WHEN 'N' THEN 'amended' ELSE CASE l_linestatus WHEN 'F' THEN 'rejected' ELSE 'needs_context' END END AS decision, l_tax
    FROM lineitem"""


@shared
def impact(d):
    pair = "struct(created_at, review_id)" if d.name == "spark" else "(created_at, review_id)"
    return f"""
    SELECT p_partkey AS impact_id, p_partkey AS item_id, p_brand AS brand, CASE WHEN p_size > 25 THEN last_id ELSE first_id END AS confirmation_review_id
    FROM part LEFT JOIN (SELECT item_id, max_by(review_id, {pair}) AS last_id, min_by(review_id, {pair}) AS first_id FROM change_review GROUP BY item_id) r ON r.item_id = p_partkey"""


@shared
def impact_publication(d):
    return "SELECT review_id, impact_id, created_at AS reviewed_at FROM impact_review WHERE decision IN ('approved', 'amended') AND l_tax < 0.03"


@shared
def profile_term(d):
    return """
    SELECT c_custkey AS profile_id, 'v1' AS taxonomy_id, 'sector' AS dimension, lower(c_mktsegment) AS code FROM customer UNION ALL
    SELECT c_custkey, 'v1', 'jurisdiction', concat('nation-', cast(c_nationkey as string)) FROM customer WHERE c_acctbal < 9000 UNION ALL
    SELECT c_custkey, CASE WHEN c_acctbal < -500 THEN 'v0' ELSE 'v1' END, 'size', CASE WHEN c_acctbal > 0 THEN 'large' ELSE 'small' END FROM customer WHERE c_acctbal < 5000 UNION ALL
    SELECT c_custkey, 'v1', 'size', 'medium' FROM customer WHERE c_acctbal BETWEEN 1000 AND 1500"""


@shared
def impact_target(d):
    return """
    SELECT p_partkey AS impact_id, 'sector' AS dimension, CASE p_type WHEN 'ECONOMY' THEN 'machinery' WHEN 'STANDARD' THEN 'building' WHEN 'LARGE' THEN 'automobile'
      WHEN 'MEDIUM' THEN 'furniture' ELSE 'cross-sector' END AS code, 'included' AS disposition FROM part WHERE p_size > 3 UNION ALL
    SELECT p_partkey, 'sector', 'household', 'included' FROM part WHERE p_size > 20 UNION ALL
    SELECT p_partkey, 'jurisdiction', concat('nation-', substr(p_brand, 7)), CASE WHEN p_size > 40 THEN 'excluded' ELSE 'included' END FROM part WHERE p_retailprice > 950 UNION ALL
    SELECT p_partkey, 'size', CASE WHEN p_size > 30 THEN 'any-size' ELSE 'large' END, 'included' FROM part WHERE p_type <> 'SMALL'"""


@shared
def match_request(d):
    return "SELECT DISTINCT o_custkey AS profile_id, l_partkey AS impact_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey"


SQL_ONLY["match_dim"] = """
    SELECT profile_id, impact_id, t.dimension, bool_or(t.dimension || ':' || t.code IN ('sector:cross-sector', 'size:any-size')) AS wild,
      bool_or(p.code IS NOT NULL) AS hit,
      list(t.dimension || ':' || t.code) FILTER (WHERE p.code IS NOT NULL) AS hit_keys, list(t.dimension || ':' || t.code) FILTER (WHERE t.dimension || ':' || t.code IN ('sector:cross-sector', 'size:any-size')) AS wild_keys,
      bool_or(d.dimension IS NOT NULL) AS stated
    FROM match_request JOIN impact_target t USING (impact_id)
    LEFT JOIN (SELECT DISTINCT profile_id, dimension, code FROM profile_term) p USING (profile_id, dimension, code)
    LEFT JOIN (SELECT DISTINCT profile_id, dimension FROM profile_term) d ON d.profile_id = match_request.profile_id AND d.dimension = t.dimension
    WHERE disposition = 'included' GROUP BY ALL"""
SQL_ONLY["match_result"] = """
    SELECT r.profile_id, r.impact_id, CASE WHEN x.profile_id IS NOT NULL THEN 'not_matched' WHEN dims IS NULL OR len(unresolved) > 0 THEN 'insufficient_context' WHEN len(unmet) > 0 THEN 'not_matched' ELSE 'matched' END AS outcome,
      array_to_string(list_sort(coalesce(matched, [])), ',') AS matched, array_to_string(list_sort(coalesce(unmet, [])), ',') AS unmet,
      CASE WHEN x.profile_id IS NULL AND dims IS NULL THEN 'included_target' ELSE array_to_string(list_sort(coalesce(unresolved, [])), ',') END AS unresolved
    FROM match_request r
    LEFT JOIN (SELECT profile_id, impact_id, count(*) AS dims, coalesce(list(dimension) FILTER (WHERE NOT wild AND NOT stated), []) AS unresolved, coalesce(list(dimension) FILTER (WHERE NOT wild AND stated AND NOT hit), []) AS unmet,
        flatten(list(CASE WHEN wild THEN wild_keys ELSE hit_keys END) FILTER (WHERE wild OR hit)) AS matched FROM match_dim GROUP BY ALL) g USING (profile_id, impact_id)
    LEFT JOIN (SELECT DISTINCT profile_id, impact_id FROM match_request JOIN impact_target USING (impact_id) JOIN profile_term USING (profile_id, dimension, code) WHERE disposition = 'excluded') x USING (profile_id, impact_id)"""


def matched(t):
    return impacts.match_profiles(t.match_request, t.profile_term, t.impact_target)


@query("profile_matching", "J16", "SELECT * FROM match_result")
def profile_matching(t):
    out = matched(t)
    return out.select("profile_id", "impact_id", "outcome", *[F.array_join(c, ",").alias(c) for c in ("matched", "unmet", "unresolved")])


SQL_ONLY["last_impact_review"] = "SELECT * FROM impact_review QUALIFY row_number() OVER (PARTITION BY impact_id ORDER BY created_at DESC, review_id DESC) = 1"
SQL_ONLY["last_change_review"] = "SELECT * FROM change_review QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY created_at DESC, review_id DESC) = 1"


@query("profile_tally", "A27", """
SELECT profile_id, count(outcome) AS evaluated, count(*) FILTER (WHERE outcome = 'matched') AS matched, count(*) FILTER (WHERE outcome = 'not_matched') AS not_matched,
  count(*) FILTER (WHERE outcome = 'insufficient_context') AS insufficient_context, count(*) FILTER (WHERE outcome IS NULL) AS skipped
FROM (SELECT profile_id, CASE WHEN decision IN ('approved', 'amended') THEN outcome END AS outcome FROM match_result LEFT JOIN last_impact_review USING (impact_id)) GROUP BY 1""")
def profile_tally(t):
    last = impacts.with_latest_review(t.part.select(F.col("p_partkey").alias("impact_id")), t.impact_review, "impact_id")
    j = matched(t).join(last, "impact_id", "left")
    usable = F.col("decision").isin("approved", "amended")
    return impacts.profile_tally(j.withColumn("outcome", F.when(usable, F.col("outcome"))))


@query("profile_term_rules", "V8", """
SELECT profile_id, unnest(list_filter([CASE WHEN n IS NULL THEN 'no_terms' END, CASE WHEN dup THEN 'duplicate_term' END, CASE WHEN mixed THEN 'mixed_taxonomies' END, CASE WHEN many THEN 'single_valued_dimension' END], lambda x: x IS NOT NULL)) AS violation
FROM (SELECT c_custkey AS profile_id, n, dup, mixed, many FROM customer LEFT JOIN (
  SELECT profile_id, count(*) AS n, count(*) <> count(DISTINCT (taxonomy_id, dimension, code)) AS dup, count(DISTINCT taxonomy_id) > 1 AS mixed,
    greatest(count(DISTINCT (taxonomy_id, code)) FILTER (WHERE dimension = 'size'), count(DISTINCT (taxonomy_id, code)) FILTER (WHERE dimension = 'jurisdiction')) > 1 AS many FROM profile_term GROUP BY 1) ON profile_id = c_custkey)""")
def profile_term_rules(t):
    return impacts.profile_term_violations(t.profile_term, t.customer.select(F.col("c_custkey").alias("profile_id")))


# Rules bound to words that occur in the sections.
RULES = ((r"\b(the|der)\b", "obligation"), (r"\bwith\b", "reporting"), (r"\bfrom\b", "registration"), (r"\b(for|que)\b", "deadline"),
         (r"\bthat\b", "prohibition"), (r"\bwas\b", "penalty"), (r"\b(les|los)\b", "exemption"))
KEYWORDS = ((r"\bthis\b", "activity", "process"), (r"\b(are|is)\b", "regulated_role", "user"), (r"\bdie\b", "sector", "digital"), (r"\bhere\b", "activity", "unknown-term"))
DEFAULTS = (("jurisdiction", "here"), ("size", "any-size"))


def _bounded(p: str) -> str:
    """The pattern with word boundaries spelled out over Unicode letters, for RE2."""
    head, tail = r"(?:^|[^\pL\pN_])", r"(?:[^\pL\pN_]|$)"
    return "(?i)" + head + p.removeprefix(r"\b").removesuffix(r"\b") + tail


@query("impact_types", "F27", """
SELECT section_id, array_to_string(list_filter([""" + ", ".join(f"CASE WHEN regexp_matches(text, '{_bounded(p)}') THEN '{k}' END" for p, k in RULES) + """], lambda x: x IS NOT NULL)[:5], ',') AS types FROM section""")
def impact_types(t):
    return t.section.select("section_id", F.array_join(impacts.impact_types(F.col("text"), RULES), ",").alias("types"))


_TERMS = [("jurisdiction", "here"), ("size", "any-size"), ("activity", "process"), ("regulated_role", "user"), ("sector", "digital"), ("sector", "cross-sector")]


@query("impact_candidates", "G12 F28", """
SELECT section_id AS item_id, 'modified' AS change_type, rule_order, impact_type, split_part(term, ':', 1) AS dimension, split_part(term, ':', 2) AS code FROM (
  SELECT section_id, terms, generate_subscripts(types, 1) AS rule_order, unnest(types) AS impact_type FROM (
    SELECT section_id, list_filter([""" + ", ".join(f"CASE WHEN regexp_matches(text, '{_bounded(p)}') THEN '{k}' END" for p, k in RULES) + """], lambda x: x IS NOT NULL)[:5] AS types,
      list_filter(['jurisdiction:here', 'size:any-size', """ + ", ".join(f"CASE WHEN regexp_matches(text, '{_bounded(p)}') THEN '{d}:{c}' END" for p, d, c in KEYWORDS[:3]) + """,
        CASE WHEN NOT regexp_matches(text, '""" + _bounded(r"\bdie\b") + """') THEN 'sector:cross-sector' END], lambda x: x IS NOT NULL) AS terms FROM section)), unnest(terms) AS u(term)""")
def impact_candidates(t):
    confirmed = t.section.select(F.col("section_id").alias("item_id"), F.lit("modified").alias("change_type"),
                                 F.lit(None).cast("string").alias("before_text"), F.col("text").alias("after_text"))
    terms = t.spark.createDataFrame(_TERMS, "dimension string, code string")
    return impacts.generate_candidates(confirmed, terms, RULES, DEFAULTS, KEYWORDS)


@query("impact_evidence", "G12 F35", """
SELECT item_id, side, substr(text, 1, 8) AS text, length(text) > 8 AS truncated, sha256(text) AS text_sha256 FROM (
  SELECT item_id, 'before' AS side, before_text AS text FROM change_item UNION ALL SELECT item_id, 'after', after_text FROM change_item) WHERE text IS NOT NULL""")
def impact_evidence(t):
    return impacts.evidence_sides(t.change_item, 8)


@query("latest_reviews", "J8 W1", "SELECT i.item_id, comparison_id, change_type, review_id, decision, reviewer_id FROM change_item i LEFT JOIN last_change_review USING (item_id)")
def latest_reviews(t):
    return impacts.with_latest_review(t.change_item, t.change_review).select("item_id", "comparison_id", "change_type", "review_id", "decision", "reviewer_id")


@query("review_chains", "W15 W14", """
SELECT review_id, lag(review_id) OVER w AS previous_review_id, row_number() OVER w AS review_number FROM change_review WINDOW w AS (PARTITION BY item_id ORDER BY created_at, review_id)""")
def review_chains(t):
    return review_chain(t.change_review).select("review_id", "previous_review_id", "review_number")


@query("review_progress", "A23", """
SELECT comparison_id, count(*) AS item_count, count(decision) AS reviewed_count, count(*) FILTER (WHERE decision = 'confirmed') AS confirmed_count, count(decision) = count(*) AS complete
FROM change_item LEFT JOIN last_change_review USING (item_id) WHERE change_type <> 'unchanged' GROUP BY 1""")
def review_progress(t):
    return impacts.review_progress(t.change_item, t.change_review)


@query("publishable_changes", "G10 J12", """
SELECT item_id, review_id, CASE WHEN reviewer_id <> 7 THEN 'publish' ELSE 'needs_other_publisher' END AS disposition FROM change_item JOIN last_change_review r USING (item_id)
WHERE change_type <> 'unchanged' AND decision = 'confirmed' AND NOT EXISTS (SELECT 1 FROM change_publication p WHERE p.review_id = r.review_id)""")
def publishable_changes(t):
    return impacts.publishable_changes(t.change_item, t.change_review, t.change_publication, publisher=7).select("item_id", "review_id", "disposition")


SQL_ONLY["impact_state"] = """
    SELECT i.impact_id, i.item_id, r.review_id, r.decision, r.reviewer_id, r.created_at AS reviewed_at, CASE WHEN r.decision IS NULL THEN 'unreviewed' WHEN r.decision IN ('needs_context', 'rejected') THEN r.decision
      WHEN p.review_id IS NOT NULL THEN 'published' WHEN s.review_id = i.confirmation_review_id AND s.decision = 'confirmed' THEN 'ready' ELSE 'blocked' END AS state
    FROM impact i LEFT JOIN last_impact_review r ON r.impact_id = i.impact_id LEFT JOIN last_change_review s ON s.item_id = i.item_id LEFT JOIN impact_publication p ON p.review_id = r.review_id"""


def readiness(t):
    return impacts.impact_readiness(t.impact, t.impact_review, t.change_review, t.impact_publication)


@query("impact_readiness", "J13 J12", "SELECT impact_id, review_id, decision, state FROM impact_state")
def impact_readiness(t):
    return readiness(t).select("impact_id", "review_id", "decision", "state")


@query("impact_publications", "G11", """
SELECT impact_id, review_id, CASE WHEN coalesce(inc, false) = false THEN 'included_target_missing' WHEN reviewer_id = 3 THEN 'needs_other_publisher' ELSE 'publish' END AS disposition, coalesce(n, -1) AS targets
FROM impact_state LEFT JOIN (SELECT impact_id, bool_or(disposition = 'included') AS inc, count(*) AS n FROM impact_target GROUP BY 1) USING (impact_id) WHERE state = 'ready'""")
def impact_publications(t):
    out = impacts.publish_impacts(readiness(t), t.impact_target, publisher=3)
    n = F.size(F.from_json("payload", "targets array<struct<code:string>>")["targets"])
    return out.select("impact_id", "review_id", "disposition", F.coalesce(n, F.lit(-1)).alias("targets"))


@query("review_validation", "G26", """
SELECT proposal_id, impact_id, CASE WHEN s.review_id IS DISTINCT FROM confirmation_review_id OR s.decision IS DISTINCT FROM 'confirmed' THEN 'source_confirmation_stale' WHEN p.decision = 'pending' THEN 'unsupported_decision'
  WHEN dup THEN 'duplicate_target' WHEN other THEN 'other_taxonomy' WHEN blank THEN 'rationale_missing' WHEN p.decision IN ('approved', 'amended') AND none THEN 'approved_without_target' END AS reason
FROM (SELECT l_orderkey || '-' || l_linenumber || '-' || l_suppkey AS proposal_id, l_partkey AS impact_id, CASE l_linenumber WHEN 1 THEN 'pending' WHEN 2 THEN 'rejected' WHEN 3 THEN 'amended' ELSE 'approved' END AS decision,
    l_discount > 0.085 AS dup, l_tax > 0.065 AND l_quantity > 5 AS other, l_quantity < 10 AND l_quantity > 5 AS blank, l_quantity <= 5 AND l_discount <= 0.085 AS none FROM lineitem) p
JOIN impact USING (impact_id) LEFT JOIN last_change_review s USING (item_id)""")
def review_validation(t):
    term = lambda d, c, x, r: F.struct(F.lit(d).alias("dimension"), F.lit(c).alias("code"), x.alias("taxonomy_id"), r.alias("rationale"))
    tax = F.when(F.col("l_tax") > 0.065, "v0").otherwise("v1")
    why = F.when(F.col("l_quantity") < 10, " ").otherwise("because")
    sector, size = term("sector", "machinery", tax, why), term("size", "large", F.lit("v1"), F.lit("stated"))
    targets = F.array_compact(F.array(
        F.when(F.col("l_quantity") > 5, sector), F.when(F.col("l_discount") > 0.085, size), F.when(F.col("l_discount") > 0.085, size)))
    n = F.col("l_linenumber")
    proposals = t.lineitem.select(
        F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_suppkey")]).alias("proposal_id"),
        F.col("l_partkey").alias("impact_id"), F.lit("v1").alias("taxonomy_id"),
        F.when(n == 1, "pending").when(n == 2, "rejected").when(n == 3, "amended").otherwise("approved").alias("decision"), targets.alias("targets"))
    return impacts.review_rejection(proposals, t.impact, t.change_review)


@query("summary_inputs", "T18", """
SELECT comparison_id, count(*) AS item_count, count(*) <= 4 AS eligible, CASE WHEN count(*) <= 4 THEN string_agg(item_id::varchar || change_type, ',' ORDER BY i.created_at, item_id) END AS items
FROM change_item i JOIN last_change_review r USING (item_id) WHERE change_type <> 'unchanged' AND decision = 'confirmed' GROUP BY 1""")
def summary_inputs(t):
    out = impacts.summary_inputs(t.change_item, t.change_review, maximum_items=4)
    parsed = F.from_json("payload", "items array<struct<item_id:bigint,change_type:string>>")["items"]
    items = F.array_join(F.transform(parsed, lambda i: F.concat(i["item_id"].cast("string"), i["change_type"])), ",")
    return out.select("comparison_id", "item_count", "eligible", items.alias("items"))


@query("summary_validation", "T17", """
SELECT comparison_id, CASE WHEN bool_or(coalesce(n, 0) <> 1) THEN 'items_not_cited_once' WHEN bool_or(altered) THEN 'change_type_altered' END AS reason FROM (
  SELECT comparison_id, item_id, CASE WHEN o_totalprice > 480000 THEN 0 WHEN o_totalprice < 5000 THEN 2 ELSE 1 END AS n, o_totalprice BETWEEN 5000 AND 30000 AND change_type <> 'added' AS altered
  FROM change_item JOIN orders ON o_orderkey = item_id) GROUP BY 1""")
def summary_validation(t):
    j = t.change_item.join(t.orders.select(F.col("o_orderkey").alias("item_id"), "o_totalprice"), "item_id")
    copies = F.when(F.col("o_totalprice") > 480000, 0).when(F.col("o_totalprice") < 5000, 2).otherwise(1)
    answered = F.when(F.col("o_totalprice").between(5000, 30000), "added").otherwise(F.col("change_type"))
    outputs = j.withColumn("_c", copies).filter("_c > 0").select(
        "comparison_id", "item_id", answered.alias("change_type"), F.explode(F.array_repeat(F.lit(1), F.col("_c"))).alias("_x")).drop("_x")
    return impacts.summary_output_rejection(outputs, t.change_item)


@query("impact_output_validation", "T17", """
SELECT candidate_id, CASE WHEN l_tax > 0.075 THEN 'item_id_altered' WHEN l_quantity < 5 THEN 'citations_not_exact' WHEN l_discount > 0.085 THEN 'duplicate_target' WHEN l_returnflag = 'R' THEN 'unknown_term' END AS reason
FROM (SELECT *, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS candidate_id FROM lineitem)""")
def impact_output_validation(t):
    term = lambda d, c: F.struct(F.lit(d).alias("dimension"), F.lit(c).alias("code"))
    ids = F.array(F.concat(F.lit("b"), F.col("l_orderkey").cast("string")), F.concat(F.lit("a"), F.col("l_orderkey").cast("string")))
    targets = F.array_compact(F.array(term("sector", "digital"), F.when(F.col("l_discount") > 0.085, term("sector", "digital")),
                                      F.when(F.col("l_returnflag") == "R", term("sector", "nowhere"))))
    rows = t.lineitem.select(
        F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).alias("candidate_id"),
        F.col("l_orderkey").alias("expected_item_id"), F.when(F.col("l_tax") > 0.075, -1).otherwise(F.col("l_orderkey")).alias("item_id"),
        ids.alias("expected_anchor_ids"), F.when(F.col("l_quantity") < 5, F.slice(ids, 1, 1)).otherwise(F.reverse(ids)).alias("citation_ids"), targets.alias("targets"))
    return impacts.impact_output_rejection(rows, t.spark.createDataFrame(_TERMS, "dimension string, code string"))


# Answers: each assistant turn marks its own turn and turn 0; its sources are the turns of its
# conversation so far and it quotes their first lines; odd turns quote a changed text.
SQL_ONLY["answer_source"] = """
    SELECT a.conv_id || ':' || a.turn AS answer_id, s.turn AS source_number, s.conv_id || ':' || s.turn AS section_id, s.text,
      CASE WHEN s.turn % 2 = 1 AND length(s.text) % 3 = 0 THEN 'not ' || s.text ELSE split_part(s.text, chr(10), 1) END AS quote
    FROM conversations a JOIN conversations s ON s.conv_id = a.conv_id AND s.turn <= a.turn WHERE a.role = 'assistant'"""


@query("answer_validation", "T16", r"""
WITH good AS (SELECT answer_id, source_number FROM answer_source WHERE trim(regexp_replace(quote, '\s+', ' ', 'g')) <> '' AND contains(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), lower(trim(regexp_replace(quote, '\s+', ' ', 'g'))))),
 mark AS (SELECT DISTINCT conv_id || ':' || turn AS answer_id, unnest([0, turn]) AS n FROM conversations WHERE role = 'assistant' AND length(text) % 5 <> 0),
 ans AS (SELECT conv_id || ':' || turn AS answer_id FROM conversations WHERE role = 'assistant')
SELECT answer_id, CASE WHEN count(n) = 0 THEN 'missing_answer_markers' WHEN count(n) > count(source_number) THEN 'unverified_answer_markers' END AS reason,
  CASE WHEN count(n) = count(source_number) THEN coalesce(string_agg(n::varchar, ',' ORDER BY n), '') ELSE '' END AS source_numbers
FROM ans LEFT JOIN mark USING (answer_id) LEFT JOIN good ON good.answer_id = ans.answer_id AND source_number = n GROUP BY 1""")
def answer_validation(t):
    a = t.conversations.filter("role = 'assistant'").select("conv_id", "turn", "text")
    aid = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    marks = F.concat(F.lit("see [0; "), F.col("turn").cast("string"), F.lit("]"))
    answers = a.select(aid.alias("answer_id"), F.when(F.length("text") % 5 != 0, marks).otherwise("none").alias("answer"))
    s = t.conversations.select("conv_id", F.col("turn").alias("source_number"), F.col("text").alias("body"))
    src = (a.select("conv_id", "turn", aid.alias("answer_id")).join(s, "conv_id").filter("source_number <= turn")
           .select("answer_id", F.col("source_number").cast("int").alias("source_number"),
                   F.concat_ws(":", F.col("conv_id").cast("string"), F.col("source_number").cast("string")).alias("section_id"), F.col("body").alias("text")))
    changed = (F.col("source_number") % 2 == 1) & (F.length("text") % 3 == 0)
    quote = F.when(changed, F.concat(F.lit("not "), F.col("text"))).otherwise(F.split_part("text", F.lit("\n"), F.lit(1)))
    citations = src.select("answer_id", F.col("source_number").alias("position"), "source_number", quote.alias("quote"))
    return impacts.answer_citations(answers, citations, src).select("answer_id", "reason", F.array_join("source_numbers", ",").alias("source_numbers"))
