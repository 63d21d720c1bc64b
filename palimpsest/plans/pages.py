"""Registered queries over pages and links: URL expressions, discovery, feeds, request logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import scalars, urls
from palimpsest.functions.keys import fingerprint, stagger_offset
from palimpsest.operators import links
from palimpsest.plans.registry import SQL_ONLY, query, shared, spark_binding
from palimpsest.sources import feeds, html

DOMAINS = ["example.com", "Example.org."]
EXT = "['.pdf', '.doc', '.docx', '.csv', '.json', '.xml']"

SCHEME = lambda x: f"lower(regexp_extract({x}, '^([a-zA-Z][a-zA-Z0-9+.-]*)://', 1))"
AUTH = lambda x: f"regexp_extract({x}, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)"
HOST = lambda x: rf"lower(regexp_replace(regexp_replace({AUTH(x)}, '^.*@', ''), ':\d*$', ''))"
PATH = lambda x: f"regexp_extract({x}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
QUERY = lambda x: rf"regexp_extract({x}, '^[^?#]*\?([^#]*)', 1)"
EXTN = lambda x: rf"lower(regexp_extract(regexp_replace({x}, '[?#].*$', ''), '[^/](\.[^./]+)$', 1))"
_Q = lambda x, safe: f"array_to_string(list_transform(string_split({x}, ''), lambda c: CASE WHEN regexp_matches(c, '^[{safe}]?$') THEN c ELSE url_encode(c) END), '')"
_PS = "A-Za-z0-9/%:@._~!$&''()*+,;=-"
NORM = lambda x: (f"({SCHEME(x)} || '://' || {HOST(x)} || {_Q('CASE WHEN ' + PATH(x) + chr(61) + chr(39) * 2 + ' THEN ' + chr(39) + '/' + chr(39) + ' ELSE ' + PATH(x) + ' END', _PS)}"
                  f" || CASE WHEN {QUERY(x)} <> '' THEN '?' || {_Q(QUERY(x), _PS + '?')} ELSE '' END)")
ALLOWED = lambda h: f"(({h}) IN ('example.com', 'example.org') OR ends_with({h}, '.example.com') OR ends_with({h}, '.example.org'))"


@query("normalize_urls", "F9 F14 F15", f"""
SELECT page_id, {NORM("url")} AS normalized, {EXTN("url")} AS extension, sha256({NORM("url")}) AS fingerprint FROM pages""")
def normalize_urls(t):
    n = urls.normalize_url(F.col("url"))
    return t.pages.select("page_id", n.alias("normalized"), urls.extension(F.col("url")).alias("extension"),
                          fingerprint(n).alias("fingerprint"))


@spark_binding
def page_link(t):
    """Links of every page; every third link length gets a document suffix."""
    rows = html.links(t.pages, "html", ["page_id", "url"])
    return rows.withColumn("href", F.when(F.length("href") % 3 == 0, F.concat("href", F.lit(".pdf"))).otherwise(F.col("href")))


SQL_ONLY["page_link"] = """
    SELECT page_id, url, position, CASE WHEN length(href) % 3 = 0 THEN href || '.pdf' ELSE href END AS href, title FROM (
      SELECT page_id, url, generate_subscripts(m, 1) AS position, regexp_extract(unnest(m), 'href="([^"]*)"', 1) AS href,
        regexp_extract(unnest(m), '>([^<]*)</a>', 1) AS title
      FROM (SELECT *, regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>') AS m FROM pages))"""
SQL_ONLY["page_target"] = f"""
    SELECT *, {NORM("abs_url")} AS target FROM (
      SELECT *, {SCHEME("url")} || '://' || {AUTH("url")} || href AS abs_url FROM page_link)"""


@query("page_links", "S4", "SELECT page_id, position, href, title FROM page_link")
def page_links(t):
    return t.page_link.select("page_id", "position", "href", "title")


@query("resolve_relative_urls", "F10", "SELECT page_id, position, abs_url FROM page_target")
def resolve_relative_urls(t):
    return t.page_link.select("page_id", "position", urls.resolve(F.col("url"), F.col("href")).alias("abs_url"))


@query("resolve_relative_urls_full", "F10", "SELECT page_id, position, abs_url FROM page_target")
def resolve_relative_urls_full(t):
    return t.page_link.select("page_id", "position", urls.resolve_udf("url", "href").alias("abs_url"))


SQL_ONLY["ranked_listing"] = f"""
    SELECT page_id, candidate_url, title, is_document, cast(rn AS int) AS rank, CASE WHEN rn <= 4 THEN 'accepted' ELSE 'over_cap' END AS disposition FROM (
      SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY is_document DESC, position) AS rn FROM (
        SELECT page_id, target AS candidate_url, min(position) AS position, arg_min(title, position) AS title,
          list_contains({EXT}, {EXTN("target")}) AS is_document
        FROM page_target WHERE {SCHEME("target")} = 'https' AND {ALLOWED(HOST("target"))} AND target <> {NORM("url")}
          AND NOT ends_with({PATH("target")}, '/feed/')
        GROUP BY page_id, target))"""
SQL_ONLY["listing"] = "SELECT page_id, candidate_url, title, is_document, rank FROM ranked_listing WHERE disposition = 'accepted'"


@spark_binding
def ranked_listing(t):
    return links.candidates(t.page_link, "page_id", "url", DOMAINS, cap=4)


@spark_binding
def listing(t):
    return t.ranked_listing.filter("disposition = 'accepted'").drop("disposition")


@query("listing_candidates", "S4 E4 W10", "SELECT * FROM ranked_listing")
def listing_candidates(t):
    return t.ranked_listing


SQL_ONLY["detail_link"] = """
    SELECT DISTINCT candidate_url AS page_url, candidate_url || '/annex-' || n || '.pdf' AS link_url
    FROM listing, (VALUES (1), (2)) AS k(n) WHERE NOT is_document AND length(title) % 2 = 0 AND (n = 1 OR length(title) % 4 = 0)"""


@spark_binding
def detail_link(t):
    n = F.when(F.length("title") % 4 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    pages = t.listing.filter(~F.col("is_document") & (F.length("title") % 2 == 0))
    return pages.select(F.col("candidate_url").alias("page_url"), F.explode(n).alias("n")).select(
        "page_url", F.concat("page_url", F.lit("/annex-"), F.col("n").cast("string"), F.lit(".pdf")).alias("link_url")).distinct()


SQL_ONLY["expanded_listing"] = """
    SELECT page_id, coalesce(link_url, candidate_url) AS candidate_url, title,
      CASE WHEN link_url IS NOT NULL THEN candidate_url END AS source_detail_page
    FROM listing LEFT JOIN detail_link ON page_url = candidate_url AND NOT is_document"""


@query("detail_expansion", "S5", "SELECT * FROM expanded_listing")
def detail_expansion(t):
    return links.expand_details(t.listing, t.detail_link).select("page_id", "candidate_url", "title", "source_detail_page")


@query("listing_reconciliation", "P18", f"""
SELECT page_id, candidate_url, route, CASE route WHEN 'fetch_and_monitor_detail' THEN source_detail_page WHEN 'monitor_page' THEN candidate_url END AS monitored_url
FROM (SELECT *, CASE WHEN source_detail_page IS NOT NULL THEN 'fetch_and_monitor_detail' WHEN list_contains({EXT}, {EXTN("candidate_url")}) THEN 'fetch' ELSE 'monitor_page' END AS route FROM expanded_listing)""")
def listing_reconciliation(t):
    return links.reconcile_listing(links.expand_details(t.listing, t.detail_link)).select(
        "page_id", "candidate_url", "route", "monitored_url")


@query("detail_page_links", "S6", f"""
SELECT page_id, target_url, sha256(target_url) AS fingerprint, title, CASE WHEN reason = '' THEN 'accepted' ELSE 'quarantined' END AS disposition, reason AS quarantine_reason
FROM (SELECT *, CASE WHEN {SCHEME("target_url")} <> 'https' THEN 'non_https_or_missing_hostname' WHEN NOT {ALLOWED(HOST("target_url"))} THEN 'hostname_not_allowlisted' ELSE '' END AS reason
  FROM (SELECT page_id, target AS target_url, arg_min(title, position) AS title FROM page_target WHERE list_contains({EXT}, {EXTN("target")}) GROUP BY ALL))""")
def detail_page_links(t):
    return links.detail_dispositions(t.page_link, "page_id", "url", DOMAINS)


@spark_binding
def feed(t):
    """One RSS document per page whose items are the page's links."""
    esc = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    item = F.concat(F.lit("<item><title>"), esc(F.col("title")), F.lit("</title><link>"), esc(F.col("href")),
                    F.lit("</link><guid>"), F.length("href").cast("string"), F.lit("</guid><pubDate>Mon, 25 Aug 2025 08:"),
                    F.lpad(F.col("position").cast("string"), 2, "0"), F.lit(":41 +0800</pubDate></item>"))
    return (t.page_link.groupBy(F.col("page_id").alias("feed_id"), F.col("url").alias("feed_url"))
            .agg(F.array_sort(F.collect_list(F.struct("position", item.alias("x")))).alias("_i"))
            .select("feed_id", "feed_url", F.concat(F.lit("<rss><channel><title>Links</title>"),
                    F.array_join(F.transform("_i", lambda i: i["x"]), ""), F.lit("</channel></rss>")).alias("content")))


@query("feed_entries", "S7 F19", f"""
SELECT feed_id, target_url, title, external_identifier, CASE WHEN reason = '' THEN 'accepted' ELSE 'quarantined' END AS disposition, reason AS quarantine_reason, published_at
FROM (SELECT *, CASE WHEN count(*) OVER (PARTITION BY feed_id, external_identifier) > 1 THEN 'ambiguous_external_identifier'
    WHEN {SCHEME("target_url")} <> 'https' THEN 'non_https_or_missing_hostname' WHEN NOT {ALLOWED(HOST("target_url"))} THEN 'hostname_not_allowlisted' ELSE '' END AS reason
  FROM (SELECT page_id AS feed_id, target AS target_url, arg_min(trim(title), position) AS title, arg_min(length(href)::varchar, position) AS external_identifier,
      '2025-08-25T00:' || lpad(min(position)::varchar, 2, '0') || ':41+00:00' AS published_at FROM page_target GROUP BY 1, 2))""")
def feed_entries(t):
    return feeds.feed_links(t.feed, DOMAINS).select("feed_id", "target_url", "title", "external_identifier",
                                                    "disposition", "quarantine_reason", "published_at")


@query("feed_scope", "P17", f"""
SELECT page_id, target, CASE WHEN starts_with({PATH("target")}, '/t') OR starts_with({PATH("target")}, '/d') THEN 'approved' ELSE 'pending_review' END AS scope_disposition
FROM (SELECT DISTINCT page_id, target FROM page_target)""")
def feed_scope(t):
    rows = t.page_link.select("page_id", urls.normalize_url(urls.resolve(F.col("url"), F.col("href"))).alias("target")).distinct()
    return links.scope_split(rows, ["/t", "/d"], "target")


@query("page_blocks", "T10")
def page_blocks(t):
    return html.blocks(t.pages, "html", ["page_id"])


@query("page_structure", "T11", """
SELECT page_id, len(tags) AS node_count, sha256(array_to_string(list_transform(tags, lambda g: regexp_extract(g, '^<([a-z0-9]+)', 1) ||
  CASE WHEN contains(g, 'class=') THEN '.' || regexp_extract(g, 'class="([^"]*)"', 1) ELSE '' END), chr(10))) AS structure_sha256
FROM (SELECT page_id, regexp_extract_all(html, '<[a-z][a-z0-9]*( class="[^"]*")?')[:2000] AS tags FROM pages)""")
def page_structure(t):
    return html.structure(t.pages, "html", ["page_id"]).select("page_id", F.col("node_count").cast("bigint").alias("node_count"), "structure_sha256")


@query("structure_incidents", "G14", """
SELECT page_id, sha IS DISTINCT FROM good AND good IS NOT NULL AS structure_changed, good AS last_good_sha256, pause_day FROM (
  SELECT *, last_value(CASE WHEN matched THEN sha END IGNORE NULLS) OVER (PARTITION BY host ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS good FROM (
    SELECT page_id, """ + HOST("url") + """ AS host, length(html) % 3 <> 0 AS matched, sha256(regexp_extract(html, '<html lang="([a-z]+)"', 1)) AS sha,
      CASE WHEN length(url) > 40 THEN 3 ELSE 1 END AS pause_day FROM pages)) WHERE NOT matched""")
def structure_incidents(t):
    # A page is an observation of its host; a length divisible by three plays the selector miss.
    obs = t.pages.select(
        urls.host(F.col("url")).alias("resource_id"), F.col("page_id").alias("observation_id"),
        F.expr("timestamp_ntz'2024-01-01' + make_interval(0,0,0,0,0,cast(page_id as int),0)").alias("checked_at"),
        (F.length("html") % 3 != 0).alias("matched"), F.sha2(F.regexp_extract("html", '<html lang="([a-z]+)"', 1), 256).alias("structure_sha256"),
        F.expr("CASE WHEN length(url) > 40 THEN timestamp_ntz'2024-01-01' + make_interval(0,0,0,3,0,cast(page_id as int),0) END").alias("next_poll_at"))
    out = links.structure_incidents(obs)
    return out.select(F.col("observation_id").alias("page_id"), "structure_changed", "last_good_sha256",
                      F.expr("cast(timestampdiff(DAY, checked_at, paused_until) as int)").alias("pause_day"))


@query("host_allowlist", "P5", f"SELECT page_id, {ALLOWED(HOST('url'))} AS allowed FROM pages")
def host_allowlist(t):
    d = F.array(*[F.lit(x) for x in DOMAINS])
    return t.pages.select("page_id", urls.host_allowed(urls.host(F.col("url")), d).alias("allowed"))


# Every page URL in four disguises: as is, with credentials, with a port, upgraded to https.
SQL_ONLY["disguised"] = """
    SELECT page_id, k, CASE k WHEN 0 THEN url WHEN 1 THEN 'https://user:pw@' || rest WHEN 2 THEN 'https://' || regexp_replace(rest, '^([^/?#]*)', '\\1:8443') ELSE 'https://' || rest END AS url
    FROM (SELECT page_id, url, regexp_replace(url, '^[a-z]+://', '') AS rest FROM pages), (VALUES (0), (1), (2), (3)) AS v(k)"""


@query("url_safety", "P6", rf"""
SELECT page_id, k, CASE WHEN {SCHEME("url")} <> 'https' THEN 'scheme_not_https' WHEN contains({AUTH("url")}, '@') THEN 'credentials_present'
  WHEN regexp_extract({AUTH("url")}, ':(\d+)$', 1) NOT IN ('', '443') THEN 'port_not_allowed' WHEN NOT {ALLOWED(HOST("url"))} THEN 'hostname_not_allowlisted' END AS reason FROM disguised""")
def url_safety(t):
    rest = F.regexp_replace("url", r"^[a-z]+://", "")
    forms = F.array(F.col("url"), F.concat(F.lit("https://user:pw@"), rest),
                    F.concat(F.lit("https://"), F.regexp_replace(rest, r"^([^/?#]*)", "$1:8443")), F.concat(F.lit("https://"), rest))
    rows = t.pages.select("page_id", F.posexplode(forms).alias("k", "url"))
    return rows.select("page_id", "k", urls.url_safety_reason(F.col("url"), F.array(*[F.lit(x) for x in DOMAINS])).alias("reason"))


@query("document_urls", "P7 P19", f"""
SELECT page_id, position, {SCHEME("target")} = 'https' AND {ALLOWED(HOST("target"))} AND starts_with({PATH("target")}, '/t') AND list_contains({EXT}, {EXTN("target")}) AS qualifies,
  {PATH("target")} IN ('/the', '/de') OR starts_with({PATH("target")}, '/the/') OR starts_with({PATH("target")}, '/de/') AS under_prefix FROM page_target""")
def document_urls(t):
    target = urls.normalize_url(urls.resolve(F.col("url"), F.col("href")))
    return t.page_link.withColumn("target", target).select(
        "page_id", "position", urls.document_url(F.col("target"), F.array(*[F.lit(x) for x in DOMAINS]), ["/t"]).alias("qualifies"),
        urls.under_prefix(urls.path(F.col("target")), ["/the", "/de/"]).alias("under_prefix"))


@query("canonical_hosts", "F11", f"""
SELECT page_id, {SCHEME("url")} || '://' || CASE {HOST("url")} WHEN 'thther.example.org' THEN 'www.example.org' WHEN 'blog.tionsh.example.net' THEN 'tionsh.example.net' ELSE {HOST("url")} END
  || {PATH("url")} || CASE WHEN {QUERY("url")} <> '' THEN '?' || {QUERY("url")} ELSE '' END AS canonical_url FROM pages""")
def canonical_hosts(t):
    alias = {"thther.example.org": "www.example.org", "blog.tionsh.example.net": "tionsh.example.net"}
    return t.pages.select("page_id", urls.canonical_host(F.col("url"), alias).alias("canonical_url"))


@query("delimited_values", "F12", """
SELECT page_id, nullif(trim(CASE WHEN contains(html, '<title>') AND contains(rest, '</') THEN split_part(rest, '</', 1) END), '') AS value
FROM (SELECT page_id, html, substr(html, instr(html, '<title>') + 7) AS rest FROM pages)""")
def delimited_values(t):
    return t.pages.select("page_id", urls.delimited_value(F.col("html"), "<title>", "</").alias("value"))


@query("unwrapped_links", "F13", """
SELECT page_id, CASE WHEN length(url) % 5 = 0 THEN url WHEN length(url) % 5 = 1 THEN NULL ELSE url END AS target FROM pages""")
def unwrapped_links(t):
    good = F.concat(F.col("url"), F.lit("|"), F.sha2("url", 256))
    bad = F.concat(F.col("url"), F.lit("|short"))
    wrap = lambda c: F.concat(F.lit("/open?u="), F.url_encode(F.regexp_replace(F.base64(F.encode(c, "UTF-8")), r"\s", "")))
    value = (F.when(F.length("url") % 5 == 0, F.col("url")).when(F.length("url") % 5 == 1, wrap(bad)).otherwise(wrap(good)))
    return t.pages.select("page_id", urls.unwrap_link(value, "/open", "u").alias("target"))


@query("content_types", "P10 P11", """
SELECT page_id, CASE WHEN starts_with(lower(ltrim(html)), '<!doctype html') THEN 'text/html' ELSE '?' END AS sniffed,
  CASE WHEN length(url) % 2 = 0 THEN 'application/pdf' ELSE 'text/html' END AS headed, CASE WHEN regexp_matches(url, '\\.html([?#]|$)') THEN false ELSE length(url) % 2 = 0 END AS as_expected FROM pages""")
def content_types(t):
    header = F.when(F.length("url") % 2 == 0, "application/pdf; charset=x").otherwise("Text/HTML")
    sniffed = scalars.sniff_content_type(F.encode("html", "UTF-8"), header)
    headed = scalars.sniff_content_type(F.encode(F.lit("plain words"), "UTF-8"), header)
    suffix = urls.extension(F.col("url"))
    expected = scalars.expected_types(suffix, ["application/pdf"], {".html": ("text/html+x",), **scalars.DOCUMENT_TYPES})
    return t.pages.select("page_id", sniffed.alias("sniffed"), headed.alias("headed"),
                          F.array_contains(expected, headed).alias("as_expected"))


@query("response_headers", "P16", f"""
SELECT page_id, 'content-type=text/html,etag=' || length(html)::varchar AS kept FROM pages""")
def response_headers(t):
    h = F.create_map(F.lit("ETag"), F.length("html").cast("string"), F.lit("Set-Cookie"), F.col("url"),
                     F.lit("Content-Type"), F.lit("text/html"))
    kept = scalars.whitelist_headers(h)
    pairs = F.transform(F.array_sort(F.map_entries(kept)), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return t.pages.select("page_id", F.array_join(pairs, ",").alias("kept"))


@query("stagger_offsets", "W22", """
SELECT page_id, cast(('0x' || substr(sha256(url), 1, 8))::bigint % 1440 as bigint) AS offset_minutes FROM pages""")
def stagger_offsets(t):
    return t.pages.select("page_id", stagger_offset(F.sha2("url", 256), 1440).alias("offset_minutes"))


@query("detail_backfill", "S11", f"""
SELECT 'https://' || {HOST("url")} || '/' AS detail_url, arg_max(regexp_extract(html, '<title>([^<]*)</title>', 1), page_id) AS title FROM pages GROUP BY 1""")
def detail_backfill(t):
    meta = t.pages.select("page_id", F.concat(F.lit("https://"), urls.host(F.col("url")), F.lit("/")).alias("detail_url"),
                          F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("page_title"))
    return links.backfill_details(meta, "detail_url", "page_title", "page_id")


@query("link_routes", "J21", f"""
SELECT identity_url, target_url, arg_min(title, (version_id, title)) AS title, min(version_id) AS version_id, sha256(identity_url || chr(10) || target_url) AS fingerprint
FROM (SELECT page_id AS version_id, {HOST("url")} AS identity_url, target AS target_url, title FROM page_target WHERE {SCHEME("target")} = 'https' AND {ALLOWED(HOST("target"))} AND ends_with(target, '.pdf')) GROUP BY 1, 2""")
def link_routes(t):
    pdf = t.page_link.withColumn("target", urls.normalize_url(urls.resolve(F.col("url"), F.col("href")))).filter(F.endswith("target", F.lit(".pdf")))
    # A version's link list is bounded by its page.
    versions = pdf.groupBy(F.col("page_id").alias("version_id"), urls.host(F.col("url")).alias("identity_url")).agg(
        F.collect_list(F.struct(F.col("target").alias("url"), "title")).alias("links"))
    return links.route_links(versions, DOMAINS)


# --- request logs --------------------------------------------------------------------------------


@shared
def request_log(d):
    return """
    SELECT user_id AS capture_id, event_id AS request_id, ts AS requested_at,
      CASE event_type WHEN 'click' THEN 'https://app.example.org/api' WHEN 'view' THEN 'https://cdn.example.net/lib'
        WHEN 'error' THEN 'http://app.example.org/x' WHEN 'purchase' THEN 'https://app.example.org/search' ELSE 'https://other.test/x' END AS url,
      CASE event_type WHEN 'purchase' THEN 'POST' ELSE 'GET' END AS method,
      CASE WHEN value < 30 THEN 'script' WHEN value < 90 THEN 'xhr' WHEN value < 160 THEN 'document' ELSE 'image' END AS resource_type,
      CASE WHEN value > 120 THEN 6 ELSE 0 END AS redirect_count, cast(floor(value * 100) as bigint) AS body_bytes
    FROM events"""


SQL_ONLY["request_decision"] = """
    SELECT *, CASE WHEN sequence > 60 THEN 'request_limit_exceeded' WHEN redirect_count > 5 THEN 'redirect_limit_exceeded'
      WHEN resource_type = 'image' THEN 'blocked_resource_type' WHEN url LIKE 'http:%' THEN 'scheme_not_https'
      WHEN url LIKE '%other.test%' THEN 'hostname_not_allowlisted'
      WHEN url LIKE '%cdn.example.net%' AND resource_type <> 'script' THEN 'dependency_resource_type'
      WHEN method = 'POST' AND body_bytes > 5000 THEN 'request_body_limit_exceeded' ELSE '' END AS block_reason
    FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY requested_at, request_id) AS sequence FROM request_log)"""


def decisions(t):
    return links.classify_requests(t.request_log, primary=["app.example.org"], dependencies=["example.net"],
                                   post_paths=["/search"], max_requests=60, max_body=5000)


@query("request_decisions", "P8", "SELECT request_id, sequence, block_reason, CASE WHEN block_reason = '' THEN 'allowed' ELSE 'blocked' END AS disposition FROM request_decision")
def request_decisions(t):
    return decisions(t).select("request_id", "sequence", "block_reason", "disposition")


@query("bounded_captures", "P9", """
SELECT capture_id, count(*) FILTER (WHERE block_reason = '' AND method = 'POST') AS allowed_posts,
  NOT bool_or(block_reason IN ('request_limit_exceeded', 'redirect_limit_exceeded', 'request_body_limit_exceeded')) AND count(*) FILTER (WHERE block_reason = '' AND method = 'POST') > 0 AS bounded
FROM request_decision GROUP BY 1""")
def bounded_captures(t):
    return links.bounded_captures(decisions(t), primary=["app.example.org"], post_paths=["/search"], max_body=5000)
