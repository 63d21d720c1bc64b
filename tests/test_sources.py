"""HTML, feed, URL and definition scenarios with hand-derived expectations."""

import base64
import hashlib
import json

from pyspark.sql import functions as F

from palimpsest.functions import scalars, urls
from palimpsest.operators import links
from palimpsest.sources import feeds, html, registry, taxonomy


def one(df):
    return [tuple(r) for r in df.collect()]


def test_blocks_headings_tables_and_root_choice(spark):
    page = """<html lang="EN"><head><title>Site - Home</title></head><body><nav><p>Menu text that is long enough to count as content, really</p></nav>
      <article><h2>Act&nbsp;One</h2><p>First  line<br>second line</p><ul><li>Item <b>bold</b></li></ul>
      <table><tr><th>A</th><td>1</td></tr><tr><td> </td></tr></table><blockquote><p>inner</p></blockquote></article></body></html>"""
    df = spark.createDataFrame([(1, page)], "page_id bigint, html string")
    got = one(html.blocks(df, "html", ["page_id"]).orderBy("position").select("block_type", "heading_level", "heading", "text", "document_title", "language", "content_selector"))
    assert got == [
        ("heading", 2, "Act One", "Act One", "Act One", "en", "article"), ("paragraph", None, "Act One", "First  line\nsecond line".replace("  ", " "), "Act One", "en", "article"),
        ("list_item", None, "Act One", "Item\nbold", "Act One", "en", "article"), ("table", None, "Act One", "A | 1", "Act One", "en", "article"),
        ("quote", None, "Act One", "inner", "Act One", "en", "article")]


def test_links_use_first_present_selector_and_show_misses(spark):
    df = spark.createDataFrame([(1, '<div class="x"><a href="a.pdf"> A  b </a></div><main><a href="m.pdf">M</a></main>'), (2, "<p>none</p>")], "page_id bigint, html string")
    got = one(html.links(df, "html", ["page_id"], selectors=(".missing", ".x")).orderBy("page_id"))
    assert got == [(1, 1, "a.pdf", "A b", ".x"), (2, None, None, None, None)]


def test_structure_ignores_text(spark):
    a, b, c = '<div class="z a"><p>one</p></div>', '<div class="a z"><p>two words</p></div>', "<div><p>one</p></div>"
    df = spark.createDataFrame([(1, a), (2, b), (3, c)], "page_id bigint, html string")
    got = {r.page_id: (r.structure_sha256, r.sample) for r in html.structure(df, "html", ["page_id"]).collect()}
    assert got[1] == got[2] and got[1][1] == ["div.a.z", "p"] and got[3][0] != got[1][0]


def test_paths_start_at_the_nearest_id():
    page = html.Page('<html><body><nav><p>x</p></nav><div id="m"><p>a</p><p id="k">b</p><ul><li>c</li></ul></div><p>q</p><p>r</p></body></html>')
    page.drop({"nav"})
    paths = [page.path(n, page.nodes[0]) for n in page.nodes if n.tag in ("p", "li")]
    assert paths == ["div#m > p:nth-of-type(1)", "p#k", "div#m > ul:nth-of-type(1) > li:nth-of-type(1)",
                     "html:nth-of-type(1) > body:nth-of-type(1) > p:nth-of-type(1)", "html:nth-of-type(1) > body:nth-of-type(1) > p:nth-of-type(2)"]


def rss(items):
    return "<rss><channel><title>Feed</title>" + "".join(
        f"<item><title>{t}</title><link>{u}</link><guid>{g}</guid><pubDate>{d}</pubDate></item>" for t, u, g, d in items) + "</channel></rss>"


def test_rss_bound_quarantine_and_date(spark):
    xml = rss([("A", "https://gov.example.org/a", "1", "Mon, 25 Aug 2025 08:40:41 +0800"), ("B", "https://evil.test/b", "2", ""), ("C", "https://gov.example.org/c", "3", "")])
    df = spark.createDataFrame([(1, "https://gov.example.org/feed", xml)], "feed_id bigint, feed_url string, content string")
    got = one(feeds.feed_links(df, ["example.org"], max_entries=2).orderBy("position").select("target_url", "disposition", "quarantine_reason", "published_at"))
    assert got == [("https://gov.example.org/a", "accepted", "", "2025-08-25T00:40:41+00:00"), ("https://evil.test/b", "quarantined", "hostname_not_allowlisted", ""),
                   ("https://gov.example.org/c", "quarantined", "over_limit", "")]
    assert [r[2] for r in one(feeds.feed_links(df, ["example.org"]).orderBy("position").select("target_url", "disposition", "quarantine_reason"))] == ["", "hostname_not_allowlisted", ""]
    assert one(feeds.feed_links(df, ["example.org"], max_bytes=10).select("disposition", "quarantine_reason")) == [("error", "feed_too_large")]


def test_atom_and_ambiguous_identifier_and_bad_xml(spark):
    atom = ('<feed xmlns="http://www.w3.org/2005/Atom"><title>T</title><entry><title>X</title><id>same</id><link rel="self" href="/s"/><link href="/x"/><updated>2024-02-01T10:00:00Z</updated></entry>'
            '<entry><title>Y</title><id>same</id><link rel="alternate" href="/y"/></entry></feed>')
    df = spark.createDataFrame([(1, "https://gov.example.org/feed", atom), (2, "https://gov.example.org/f", "<rss><chan"), (3, "https://gov.example.org/g", "<html/>")],
                               "feed_id bigint, feed_url string, content string")
    got = one(feeds.feed_links(df, ["example.org"]).orderBy("position").select("feed_type", "target_url", "quarantine_reason", "updated_at"))
    assert sorted(got, key=str)[2:] == [(None, None, "not_well_formed", ""), (None, None, "unsupported_root", "")]
    assert sorted(got, key=str)[:2] == [("atom", "https://gov.example.org/x", "ambiguous_external_identifier", "2024-02-01T10:00:00+00:00"),
                   ("atom", "https://gov.example.org/y", "ambiguous_external_identifier", "")]
    errors = {r.feed_id: r.error for r in feeds.entries(df).filter("error is not null").collect()}
    assert errors == {2: "not_well_formed", 3: "unsupported_root"}


def test_url_functions(spark):
    sha = hashlib.sha256(b"x").hexdigest()
    wrapped = base64.b64encode(f"https://a.example.org/d.pdf|{sha}".encode()).decode().replace("=", "%3D").replace("+", "%2B")
    df = spark.createDataFrame([("HTTPS://User@Ex.Org:443/a b?q=ü#f", "javascript:open('doc/7');", f"/dl?u={wrapped}")], "u string, js string, w string")
    r = df.select(urls.normalize_url(F.col("u")).alias("n"), urls.delimited_value(F.col("js"), "open('", "')").alias("d"),
                  urls.unwrap_link(F.col("w"), "/dl", "u").alias("w"), urls.unwrap_link(F.lit("https://x.org/dl?u=a&v=b"), "/dl", "u").alias("bad"),
                  urls.resolve_udf(F.lit("https://x.org/a/b/c"), F.lit("../d")).alias("r"), urls.resolve(F.lit("https://x.org/a/b?x#y"), F.lit("c")).alias("r2")).first()
    assert tuple(r) == ("https://ex.org/a%20b?q=%C3%BC", "doc/7", "https://a.example.org/d.pdf", None, "https://x.org/a/d", "https://x.org/a/c")


def test_small_scalars(spark):
    df = spark.createDataFrame([(bytearray(b" <?xml version='1'?><a/>"), bytearray(b"%PDF-1.7"), bytearray(b'  {"a":1}'))], "x binary, p binary, j binary")
    r = df.select(scalars.sniff_content_type(F.col("x"), F.lit("")).alias("x"), scalars.sniff_content_type(F.col("p"), F.lit("text/html")).alias("p"),
                  scalars.sniff_content_type(F.col("j"), F.lit(None)).alias("j"), scalars.feed_date(F.lit("Tue, 5 Mar 2024 01:02:03 GMT")).alias("d"),
                  scalars.feed_date(F.lit("soon")).alias("e")).first()
    assert tuple(r) == ("application/xml", "application/pdf", "application/json", "2024-03-05T01:02:03+00:00", "")
    loc = spark.createDataFrame([({"page": ""}, 1), ({"xpath": "/a"}, 2)], "l map<string,string>, i int")
    assert [tuple(x) for x in loc.select("i", scalars.any_locator(F.col("l")).alias("p")).orderBy("i").collect()] == [(1, False), (2, True)]


def test_link_states_over_observations(spark):
    obs = spark.createDataFrame([("p", 1, "2024-01-01 00:00:00"), ("p", 2, "2024-01-01 05:00:00")], "resource_id string, observation_id bigint, t string").withColumn("checked_at", F.to_timestamp_ntz("t"))
    found = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "c")], "observation_id bigint, target_url string")
    got = sorted((r.observation_id, r.target_url, r.state) for r in links.snapshot_states(found, obs).collect())
    assert got == [(1, "a", "added"), (1, "b", "added"), (2, "a", "retained"), (2, "b", "removed"), (2, "c", "added")]


def test_registry_file_and_rules(spark, tmp_path):
    d = {"schema_version": 1, "slug": "ok-pack", "version": 1, "authority": {"slug": "a", "name": "A", "authority_type": "agency", "official_domains": ["example.org"]},
         "collection": {"slug": "c", "name": "C"}, "endpoint": {"name": "e", "discovery_url": "https://www.example.org/l", "connector_type": "html_listing", "allowed_domains": ["www.example.org"],
         "polling_interval_minutes": 60, "requires_javascript": False, "connector_configuration_version": 1},
         "connector_configurations": [{"version": 1, "is_active": True, "configuration": {"max_candidates": 20}}], "resources": []}
    (tmp_path / "a.json").write_text(json.dumps(d, indent=1))
    bad = {**d, "slug": "bad-pack", "endpoint": {**d["endpoint"], "allowed_domains": ["evil.test"]}}
    (tmp_path / "b.json").write_text(json.dumps(bad))
    defs = registry.read(spark, str(tmp_path))
    got = sorted(one(registry.violations(defs, ["agency"], ["html_listing"])))
    assert got == [("bad-pack", "discovery_url"), ("bad-pack", "domain_not_official")]
    assert registry.configurations(defs).count() == 2 and registry.authorities(defs).count() == 1


def test_taxonomy_file_and_rules(spark, tmp_path):
    term = lambda d, c, p=None: {"dimension": d, "code": c, "label": c, "description": "x", "parent_code": p, "aliases": []}
    doc = {"schema_version": 1, "slug": "t", "version": 2, "name": "n", "terms": [term("sector", "b", "a"), term("sector", "a"), term("sector", "c", "a"), term("sector", "a"), term("size", "Big One")]}
    (tmp_path / "t.json").write_text(json.dumps(doc, indent=2))
    rows = taxonomy.terms(taxonomy.read(spark, str(tmp_path)))
    got = sorted((r.code, r.position, r.rule) for r in taxonomy.violations(rows, ["sector", "size"]).collect())
    assert got == [("Big One", 5, "code"), ("a", 4, "duplicate"), ("b", 1, "parent")]
