"""URL expressions: parts, normal forms, allowlists, safety rules, link decoding."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.udf import vectorized

# Extensions that mark a fetchable document unless a source says otherwise.
DOCUMENT_EXTENSIONS = (".pdf", ".doc", ".docx", ".csv", ".json", ".xml")

_AUTHORITY = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1))


def authority(url: Column) -> Column:
    return F.regexp_extract(url, _AUTHORITY, 1)


def host(url: Column) -> Column:
    """Lower-case host without credentials or port."""
    return F.lower(F.regexp_replace(F.regexp_replace(authority(url), r"^.*@", ""), r":\d*$", ""))


def port(url: Column) -> Column:
    text = F.regexp_extract(authority(url), r":(\d+)$", 1)
    return F.when(text != "", text.cast("int"))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def extension(url_or_path: Column) -> Column:
    """Lower-case suffix of the last path segment, dot included, or the empty string."""
    bare = F.regexp_replace(url_or_path, r"[?#].*$", "")
    return F.lower(F.regexp_extract(bare, r"[^/](\.[^./]+)$", 1))


# Characters that stay as they are in a path or a query.
PATH_SAFE = r"A-Za-z0-9/%:@._~!$&'()*+,;=-"
QUERY_SAFE = PATH_SAFE + "?"


def quote(text: Column, safe: str) -> Column:
    """Percent-encode every character outside the safe class (UTF-8)."""
    encoded = lambda ch: F.regexp_replace(F.url_encode(ch), r"\+", "%20")
    one_by_one = F.array_join(F.transform(F.split(text, ""), lambda ch: F.when(
        ch.rlike(rf"^[{safe}]?$"), ch).otherwise(encoded(ch))), "")
    return F.when(text.rlike(rf"^[{safe}]*$"), text).otherwise(one_by_one)


def normalize_url(url: Column) -> Column:
    """Lower-case scheme and host, ``/`` for an empty path, query kept, fragment dropped,
    unsafe characters percent-encoded."""
    p = F.when(path(url) == "", F.lit("/")).otherwise(path(url))
    q = query(url)
    return F.concat(scheme(url), F.lit("://"), host(url), quote(p, PATH_SAFE),
                    F.when(q != "", F.concat(F.lit("?"), quote(q, QUERY_SAFE))).otherwise(F.lit("")))


def resolve(base: Column, href: Column) -> Column:
    """Resolve absolute, scheme-relative, root-relative, query-only, fragment and plain relative
    references. Dot segments go through :func:`resolve_udf`."""
    h = F.trim(href)
    origin = F.concat(scheme(base), F.lit("://"), authority(base))
    directory = F.regexp_replace(F.when(path(base) == "", F.lit("/")).otherwise(path(base)),
                                 r"[^/]*$", "")
    no_fragment = F.regexp_replace(base, r"#.*$", "")
    return (
        F.when(h.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), h)
        .when(h.startswith("//"), F.concat(scheme(base), F.lit(":"), h))
        .when(h.startswith("/"), F.concat(origin, h))
        .when(h.startswith("?"), F.concat(origin, path(base), h))
        .when(h.startswith("#") | (h == ""), F.concat(no_fragment, h))
        .otherwise(F.concat(origin, directory, h))
    )


@vectorized("string")
def resolve_udf(base: pd.Series, href: pd.Series) -> pd.Series:
    """Full relative resolution (dot segments included), Arrow-batched."""
    from urllib.parse import urljoin

    return pd.Series([None if b is None or h is None else urljoin(b, h.strip())
                      for b, h in zip(base, href)])


def host_allowed(hostname: Column, domains: Column) -> Column:
    """True when the host equals an allowed domain or is a sub-domain of one."""
    clean = lambda c: F.regexp_replace(F.lower(c), r"\.+$", "")
    h = clean(hostname)
    return (h != "") & F.exists(domains, lambda d: (h == clean(d)) | F.endswith(h, F.concat(F.lit("."), clean(d))))


def url_safety_reason(url: Column, domains: Column) -> Column:
    """First failing safety rule as a reason, or null for a safe URL."""
    return (
        F.when(scheme(url) != "https", F.lit("scheme_not_https"))
        .when(F.contains(authority(url), F.lit("@")), F.lit("credentials_present"))
        .when(host(url) == "", F.lit("hostname_missing"))
        .when(F.coalesce(port(url), F.lit(443)) != 443, F.lit("port_not_allowed"))
        .when(~host_allowed(host(url), domains), F.lit("hostname_not_allowlisted"))
    )


def has_prefix(text: Column, prefixes: Sequence[str]) -> Column:
    """True when the text starts with any prefix; an empty list accepts everything."""
    if not prefixes:
        return F.lit(True)
    return F.exists(F.array(*[F.lit(p) for p in prefixes]), lambda p: F.startswith(text, p))


def document_url(url: Column, domains: Column, prefixes: Sequence[str] = (),
                 extensions: Sequence[str] = DOCUMENT_EXTENSIONS) -> Column:
    """https, allowed host, configured path prefix and document extension."""
    return ((scheme(url) == "https") & host_allowed(host(url), domains)
            & has_prefix(path(url), prefixes) & extension(url).isin(*[e.lower() for e in extensions]))


def under_prefix(text: Column, prefixes: Sequence[str]) -> Column:
    """True when the path equals an approved prefix or lies below it."""
    tests = [(text == p.rstrip("/")) | (text == p) | text.startswith(p.rstrip("/") + "/") for p in prefixes]
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def canonical_host(url: Column, aliases: Mapping[str, str]) -> Column:
    """Replace the host by its configured alias and drop the fragment."""
    h = host(url)
    target = h
    if aliases:
        table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
        target = F.coalesce(table[h], h)
    q = query(url)
    return F.concat(scheme(url), F.lit("://"), target, path(url),
                    F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")))


def delimited_value(value: Column, prefix: str, suffix: str) -> Column:
    """Trimmed text between the first ``prefix`` and the next ``suffix``; null when absent or blank."""
    start = F.instr(value, prefix)
    rest = F.substr(value, start + F.lit(len(prefix)))
    end = F.instr(rest, suffix)
    inner = F.trim(F.substr(rest, F.lit(1), end - 1))
    return F.when((start > 0) & (end > 0) & (inner != ""), inner)


def unwrap_link(value: Column, wrapper_path: str, parameter: str) -> Column:
    """Decode a wrapped link: its only query parameter is base64 of ``target|sha256``.
    Values on another path pass through; a malformed wrapper gives null."""
    bare = F.regexp_replace(value, r"[?#].*$", "")
    value_path = F.concat(F.lit("/"), F.ltrim(F.when(scheme(value) != "", path(value)).otherwise(bare), F.lit("/")))
    q = query(value)
    payload = F.regexp_extract(q, rf"^{parameter}=([^&]+)$", 1)
    decoded = F.try_to_binary(F.try_url_decode(payload), F.lit("base64")).cast("string")
    target = F.regexp_extract(decoded, r"(?s)^(.+)\|[0-9a-fA-F]{64}$", 1)
    return F.when(value_path != wrapper_path, value).when((payload != "") & (target != ""), target)
