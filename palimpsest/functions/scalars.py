"""Time, ratio, content-type and small classification expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MICRO = 1_000_000


def let(value: Column, body) -> Column:
    """Bind ``value`` once for use inside lambdas: Spark re-evaluates a captured expression for
    every array element, a lambda variable only once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def bind_columns(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later filters use by name. A plain projection would be inlined into every
    filter that mentions it and computed again there; a one-element explode is not."""
    for name, value in columns.items():
        df = df.select("*", F.explode(F.array(value)).alias(name))
    return df


def seconds_between(start: str, end: str) -> Column:
    """Seconds from one timestamp column to another, never negative."""
    return F.greatest(F.lit(0.0), F.expr(f"timestampdiff(MICROSECOND, {start}, {end})") / F.lit(float(MICRO)))


def age_seconds(as_of: str, column: str, empty: float | None = 0.0) -> Column:
    """Age of a timestamp at the literal time ``as_of``; ``empty`` for nulls."""
    age = F.greatest(F.lit(0.0), F.expr(
        f"timestampdiff(MICROSECOND, {column}, timestamp_ntz'{as_of}')") / F.lit(float(MICRO)))
    return F.when(F.col(column).isNotNull(), age).otherwise(F.lit(empty))


def epoch_us(column: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {column})")


def safe_ratio(part: Column, whole: Column) -> Column:
    return F.when(whole != 0, part / whole)


def rounded(value: Column, digits: int = 6) -> Column:
    """A double rounded half away from zero after scaling, as DuckDB rounds. ``F.round`` rounds the shortest decimal of the
    number instead: 41/640 is a double just below 0.0640625, so one gives 0.064062 and the other 0.064063."""
    scale = F.lit(float(10 ** digits))
    return F.round(value * scale, 0) / scale


def feed_date(value: Column) -> Column:
    """RFC 2822 or ISO 8601 date text as ``yyyy-MM-ddTHH:mm:ss+00:00`` in UTC, else empty."""
    v = F.trim(value)
    no_day = F.regexp_replace(v, r"^[A-Za-z]{3},\s*", "")
    zone = F.regexp_replace(no_day, r"\s(GMT|UT|UTC|Z)$", " +0000")
    parsed = F.coalesce(
        F.try_to_timestamp(zone, F.lit("d MMM yyyy HH:mm:ss xx")),
        F.try_to_timestamp(zone, F.lit("d MMM yyyy HH:mm xx")),
        F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(v)),
    )
    text = F.date_format(F.to_utc_timestamp(parsed, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(parsed.isNotNull(), F.concat(text, F.lit("+00:00"))).otherwise(F.lit(""))


def representation_kind(extractor: Column, ocr_derived: Column) -> Column:
    """Representation of a version from its extractor and whether OCR produced the text."""
    return (
        F.when(ocr_derived, F.lit("ocr_derived"))
        .when(extractor.startswith("html"), F.lit("landing_html"))
        .when(extractor.startswith("pdf"), F.lit("official_pdf"))
        .otherwise(F.lit("unknown"))
    )


def representation_track(kind: Column) -> Column:
    """Versions may be compared inside one track only; both PDF kinds share a track."""
    return (F.when(kind.isin("official_pdf", "ocr_derived"), F.lit("official_file"))
            .when(kind == "landing_html", F.lit("landing_page")).otherwise(F.lit("unknown")))


def sniff_content_type(content: Column, header: Column) -> Column:
    """Content type from the first bytes, then from the header without parameters."""
    head = F.regexp_replace(
        F.lower(F.decode(F.substring(content, 1, 512), "ISO-8859-1")), r"^\s+", "")
    declared = F.lower(F.trim(F.split_part(F.coalesce(header, F.lit("")), F.lit(";"), F.lit(1))))
    return (
        F.when(head.startswith("%pdf-"), F.lit("application/pdf"))
        .when(head.startswith("<!doctype html") | head.startswith("<html"), F.lit("text/html"))
        .when(head.startswith("<?xml"), F.lit("application/xml"))
        .when(head.startswith("{") | head.startswith("["), F.lit("application/json"))
        .when(declared != "", declared)
        .otherwise(F.lit("application/octet-stream"))
    )


# Content types by document suffix; response headers kept with an observation;
# candidate states that unchanged content leaves as they are.
DOCUMENT_TYPES = {
    ".csv": ("application/csv", "text/csv"),
    ".doc": ("application/msword",),
    ".docx": ("application/vnd.openxmlformats-officedocument.wordprocessingml.document",),
    ".json": ("application/json",),
    ".pdf": ("application/pdf",),
    ".xml": ("application/xml", "text/xml"),
}
KEPT_HEADERS = ("cache-control", "content-length", "content-type", "date", "etag", "expires",
                "last-modified", "retry-after")
STABLE_STATES = ("raw_stored", "extracted", "normalized", "identity_resolved", "versioned", "diffed",
                 "published", "manual_review")


def expected_types(extension: Column, default: Sequence[str],
                   by_suffix: Mapping[str, Sequence[str]] = DOCUMENT_TYPES) -> Column:
    """Content types acceptable for a URL suffix, else the endpoint's own list."""
    out = F.array(*[F.lit(t) for t in default])
    for suffix, types in by_suffix.items():
        out = F.when(extension == suffix, F.array(*[F.lit(t) for t in types])).otherwise(out)
    return out


def whitelist_headers(headers: Column, keep: Sequence[str] = KEPT_HEADERS) -> Column:
    """Header map with lower-case names, limited to the kept names."""
    lowered = F.transform_keys(headers, lambda k, _: F.lower(k))
    return F.map_filter(lowered, lambda k, _: k.isin(*[n.lower() for n in keep]))


def any_locator(locator: Column, keys: Sequence[str] = ("html_path", "css_selector", "xpath",
                                                        "page", "page_number")) -> Column:
    """True when any precise-locator key of a string map is present and non-empty."""
    out = F.lit(False)
    for key in keys:
        out = out | (F.coalesce(locator[key], F.lit("")) != "")
    return out


def valid_vector(vector: Column, dimensions: int) -> Column:
    """Right size, no nulls, NaN or infinities."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v)
                      & (F.abs(v) < F.lit(float("inf"))))
    return (F.size(vector) == dimensions) & finite


def json_field(document: Column, path: str, default: str = "") -> Column:
    return F.coalesce(F.get_json_object(document, path), F.lit(default))


def restore_state(state: Column, stable: Sequence[str] = STABLE_STATES, reset: str = "raw_stored") -> Column:
    """Keep a stable state after unchanged content, reset any other."""
    return F.when(state.isin(*stable), state).otherwise(F.lit(reset))
