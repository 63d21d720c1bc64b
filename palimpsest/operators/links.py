"""Link tables: discovery, expansion, reconciliation, snapshot diffs, request logs, incidents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions import urls
from palimpsest.functions.keys import fingerprint
from palimpsest.functions.scalars import bind_columns
from palimpsest.operators.history import History, first, hour_chunk, latest


def candidates(links: DataFrame, key: str, base_url: str, domains: Sequence[str], *,
               include_prefixes: Sequence[str] = (), exclude_suffixes: Sequence[str] = ("/feed/",),
               upload_prefixes: Sequence[str] = ("/wp-content/uploads/",),
               extensions: Sequence[str] = urls.DOCUMENT_EXTENSIONS, aliases: dict | None = None,
               cap: int | None = None) -> DataFrame:
    """Listing links to candidate documents: resolved, normalized, allowlisted, filtered by path,
    first mention wins, document links first. With a ``cap`` the candidates beyond it are marked
    ``over_cap``. Output: key, candidate_url, title, is_document, rank, disposition."""
    url = urls.normalize_url(urls.resolve(F.col(base_url), F.col("href")))
    if aliases:
        url = urls.canonical_host(url, aliases)
    rows = bind_columns(links.filter(F.col("href").isNotNull()), candidate_url=url,
                        _self=urls.normalize_url(F.col(base_url)))
    c = F.col("candidate_url")
    path, allowed = urls.path(c), F.array(*[F.lit(d) for d in domains])
    is_document = urls.extension(c).isin(*extensions)
    excluded, upload = F.lit(False), F.lit(False)
    for s in exclude_suffixes:
        excluded = excluded | path.endswith(s)
    for p in upload_prefixes:
        upload = upload | path.startswith(p)
    keep = ((urls.scheme(c) == "https") & urls.host_allowed(urls.host(c), allowed)
            & (c != F.col("_self")) & urls.has_prefix(path, include_prefixes)
            & ~excluded & ~(upload & ~is_document))
    name = F.try_url_decode(F.element_at(F.split(path, "/"), -1))
    title = F.when(F.col("title") != "", F.col("title")).otherwise(name)
    kept = rows.filter(keep).select(key, "position", "candidate_url", title.alias("title"),
                                    is_document.alias("is_document"))
    once = first(kept, [key, "candidate_url"], ["position"])
    place = W.partitionBy(key).orderBy(F.desc("is_document"), F.asc("position"))
    ranked = once.withColumn("rank", F.row_number().over(place)).drop("position")
    over = F.lit(False) if cap is None else F.col("rank") > cap
    return ranked.withColumn("disposition", F.when(over, "over_cap").otherwise("accepted"))


def expand_details(listing: DataFrame, detail_links: DataFrame) -> DataFrame:
    """Replace each non-document candidate by the document links of its detail page; keep it when
    the page has none. listing: key columns, candidate_url, is_document; detail_links: page_url,
    link_url."""
    pages = listing.filter(~F.col("is_document"))
    found = pages.join(detail_links.select(F.col("page_url").alias("candidate_url"), "link_url").distinct(),
                       "candidate_url", "left")
    expanded = found.withColumn("source_detail_page", F.when(F.col("link_url").isNotNull(), F.col("candidate_url"))).withColumn(
        "candidate_url", F.coalesce("link_url", "candidate_url")).drop("link_url")
    direct = listing.filter("is_document").withColumn("source_detail_page", F.lit(None).cast("string"))
    return direct.unionByName(expanded)


def detail_dispositions(links: DataFrame, key: str, base_url: str, domains: Sequence[str],
                        extensions: Sequence[str] = urls.DOCUMENT_EXTENSIONS) -> DataFrame:
    """Document links of detail pages, first mention wins, accepted or quarantined with reason."""
    url = urls.normalize_url(urls.resolve(F.col(base_url), F.col("href")))
    rows = bind_columns(links.filter(F.col("href").isNotNull()), target_url=url)
    rows = rows.filter(urls.extension(F.col("target_url")).isin(*extensions))
    allowed = F.array(*[F.lit(d) for d in domains])
    reason = (F.when((urls.scheme(F.col("target_url")) != "https"), "non_https_or_missing_hostname")
              .when(~urls.host_allowed(urls.host(F.col("target_url")), allowed), "hostname_not_allowlisted")
              .otherwise(""))
    once = first(rows.select(key, "target_url", "position", "title"), [key, "target_url"], ["position"])
    return once.withColumn("quarantine_reason", reason).select(
        key, "target_url", fingerprint(F.col("target_url")).alias("fingerprint"), "title",
        F.when(F.col("quarantine_reason") == "", "accepted").otherwise("quarantined").alias("disposition"),
        "quarantine_reason")


def reconcile_listing(candidates: DataFrame, extensions: Sequence[str] = urls.DOCUMENT_EXTENSIONS) -> DataFrame:
    """Route each candidate: fetch it, fetch it and monitor its detail page, or monitor it."""
    detail = F.coalesce("source_detail_page", F.lit("")) != ""
    document = urls.extension(F.col("candidate_url")).isin(*extensions)
    return candidates.withColumn("route", F.when(detail, "fetch_and_monitor_detail").when(
        document, "fetch").otherwise("monitor_page")).withColumn(
        "monitored_url", F.when(detail, F.col("source_detail_page")).when(~document, F.col("candidate_url")))


def scope_split(entries: DataFrame, prefixes: Sequence[str], url: str = "target_url") -> DataFrame:
    """Feed entries inside the configured detail paths are approved, the rest pend review."""
    inside = urls.has_prefix(urls.path(F.col(url)), prefixes)
    return entries.withColumn("scope_disposition", F.when(inside, "approved").otherwise("pending_review"))


def link_diff(current: DataFrame, previous: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Added, retained and removed links between two snapshots."""
    a = current.select(*keys).distinct().withColumn("_now", F.lit(True))
    b = previous.select(*keys).distinct().withColumn("_before", F.lit(True))
    state = (F.when(F.col("_before").isNull(), "added").when(F.col("_now").isNull(), "removed")
             .otherwise("retained"))
    return a.join(b, list(keys), "full_outer").select(*keys, state.alias("state"))


def snapshot_states(links: DataFrame, observations: DataFrame, resource: str = "resource_id",
                    at: str = "checked_at", observation: str = "observation_id",
                    target: str = "target_url") -> DataFrame:
    """State of every link at every observation of its resource, against the observation before.

    observations gives each resource's order; links: observation, target. Removed links are
    reported at the observation that no longer has them."""
    numbered = History(observations.select(resource, observation, at).distinct(), [resource],
                       [at, observation], hour_chunk(at)).numbered("_n").result()
    here = links.join(numbered.select(resource, observation, "_n"), observation).select(
        resource, target, "_n").distinct()
    ahead = here.withColumn("_n", F.col("_n") + 1).withColumn("_before", F.lit(True))
    joined = here.withColumn("_now", F.lit(True)).join(ahead, [resource, target, "_n"], "full_outer")
    state = (F.when(F.col("_before").isNull(), "added").when(F.col("_now").isNull(), "removed")
             .otherwise("retained"))
    out = joined.select(resource, target, "_n", state.alias("state"))
    # The inner join drops links of the last observation carried one step too far.
    return out.join(numbered.select(resource, "_n", observation), [resource, "_n"]).select(
        resource, observation, target, "state")


def reuse_unmodified(runs: DataFrame, found: DataFrame, endpoint: str = "endpoint_id", run: str = "run_id",
                     at: str = "created_at", chunk: Column | None = None) -> DataFrame:
    """Candidates of every run; a not-modified run repeats those of the last run that changed.

    runs: endpoint, run, at, not_modified; found: run, candidate_id."""
    source = F.when(~F.col("not_modified"), F.col(run))
    based = History(runs.select(endpoint, run, at, "not_modified"), [endpoint], [at, run],
                    chunk if chunk is not None else F.date_trunc("month", F.col(at))).carried("source_run_id", source).result()
    return (based.filter("source_run_id is not null")
            .join(found.select(F.col(run).alias("source_run_id"), "candidate_id").distinct(), "source_run_id")
            .select(endpoint, run, "source_run_id", "candidate_id"))


def backfill_details(candidates: DataFrame, url: str, title: str, seen: str) -> DataFrame:
    """Distinct detail URLs found in candidate metadata with the title seen last."""
    rows = candidates.filter(F.col(url).isNotNull() & (F.col(url) != ""))
    return rows.groupBy(url).agg(F.max_by(F.coalesce(title, F.lit("")), seen).alias("title"))


def route_links(versions: DataFrame, domains: Sequence[str]) -> DataFrame:
    """Document links of the latest versions as fetch routes (identity URL, target URL), one per
    fingerprint. versions: version_id, identity_url, links array<struct<url,title>>."""
    rows = versions.select("version_id", "identity_url", F.inline("links"))
    allowed = F.array(*[F.lit(d) for d in domains])
    ok = (urls.scheme(F.col("url")) == "https") & urls.host_allowed(urls.host(F.col("url")), allowed)
    routes = rows.filter(ok).select("identity_url", F.col("url").alias("target_url"), "title", "version_id",
                                    fingerprint(F.col("identity_url"), F.col("url")).alias("fingerprint"))
    return first(routes, ["fingerprint"], ["version_id", "title"])


# What a capture may request.
RESOURCE_TYPES = ("document", "stylesheet", "script", "xhr", "fetch", "other")
SAFE_METHODS = ("GET", "HEAD", "OPTIONS")
FATAL_REASONS = ("request_limit_exceeded", "redirect_limit_exceeded", "request_body_limit_exceeded")


def classify_requests(requests: DataFrame, *, primary: Sequence[str], dependencies: Sequence[str],
                      post_paths: Sequence[str] = (), max_requests: int = 200, max_redirects: int = 5,
                      max_body: int = 16384, capture: str = "capture_id", order: Sequence[str] = ("requested_at", "request_id"),
                      chunk: Column | None = None) -> DataFrame:
    """Number the requests of each capture and mark each allowed or blocked with the first
    failing rule. requests: capture, order columns, url, method, resource_type, redirect_count,
    body_bytes."""
    c = chunk if chunk is not None else hour_chunk(order[0])
    rows = History(requests, [capture], list(order), c).numbered("sequence").result()
    arr = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    u, h = F.col("url"), urls.host(F.col("url"))
    own = urls.host_allowed(h, arr(primary))
    post = ((F.upper("method") == "POST") & own & urls.path(u).isin(*post_paths)
            & (urls.query(u) == "") & ~F.contains(u, F.lit("#")))
    unsafe = ~F.upper("method").isin(*SAFE_METHODS)
    reason = (
        F.when(F.col("sequence") > max_requests, "request_limit_exceeded")
        .when(F.col("redirect_count") > max_redirects, "redirect_limit_exceeded")
        .when(~F.col("resource_type").isin(*RESOURCE_TYPES), "blocked_resource_type")
        .when(urls.url_safety_reason(u, arr([*primary, *dependencies])).isNotNull(),
              urls.url_safety_reason(u, arr([*primary, *dependencies])))
        .when(~own & ~F.col("resource_type").isin("script", "stylesheet"), "dependency_resource_type")
        .when(unsafe & ~post, "unsafe_http_method")
        .when(unsafe & (F.col("body_bytes") > max_body), "request_body_limit_exceeded"))
    return rows.withColumn("block_reason", F.coalesce(reason, F.lit(""))).withColumn(
        "disposition", F.when(F.col("block_reason") == "", "allowed").otherwise("blocked"))


def bounded_captures(requests: DataFrame, *, primary: Sequence[str], post_paths: Sequence[str],
                     max_body: int, capture: str = "capture_id") -> DataFrame:
    """Whether each capture's traffic stayed bounded: no fatal reason, every allowed POST inside
    the approved paths, and at least one of those when any are approved."""
    arr = F.array(*[F.lit(x) for x in primary]).cast("array<string>")
    u = F.col("url")
    is_post = (F.col("disposition") == "allowed") & (F.col("method") == "POST")
    good = (urls.host_allowed(urls.host(u), arr) & urls.path(u).isin(*post_paths)
            & (urls.query(u) == "") & (F.col("body_bytes") <= max_body))
    agg = requests.groupBy(capture).agg(
        F.bool_or(F.col("block_reason").isin(*FATAL_REASONS)).alias("_fatal"),
        F.count_if(is_post).alias("allowed_posts"), F.count_if(is_post & ~good).alias("_bad"))
    enough = (F.col("allowed_posts") > 0) if post_paths else F.lit(True)
    return agg.select(capture, "allowed_posts", (~F.col("_fatal") & (F.col("_bad") == 0) & enough).alias("bounded"))


def structure_incidents(observations: DataFrame, pause_minutes: int = 1440) -> DataFrame:
    """Observations whose selector found nothing: fingerprint before and now, whether the shape
    changed, and the time polling stays paused. observations: resource_id, observation_id,
    checked_at, matched (boolean), structure_sha256, next_poll_at."""
    h = (History(observations, ["resource_id"], ["checked_at", "observation_id"], hour_chunk("checked_at"))
         .carried("last_good_sha256", F.when(F.col("matched"), F.col("structure_sha256")), inclusive=False).result())
    until = F.expr(f"timestampadd(MINUTE, {pause_minutes}, checked_at)")
    return h.filter(~F.col("matched")).withColumn(
        "structure_changed", F.coalesce(F.col("last_good_sha256") != F.col("structure_sha256"), F.lit(False))).withColumn(
        "paused_until", F.greatest(until, F.coalesce("next_poll_at", until)))
