"""Work lists, browse listings and nested reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.history import latest, page, top_n


def contains_any(df: DataFrame, text: str, columns: Sequence[str]) -> DataFrame:
    """Rows where any column contains the text, regardless of case."""
    test = F.lit(False)
    for c in columns:
        test = test | F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lower(F.lit(text))), F.lit(False))
    return df.filter(test)


def eligible(sections: DataFrame, collections: DataFrame) -> DataFrame:
    """Sections of enabled, evidence-eligible collections of enabled authorities."""
    ok = collections.filter("collection_enabled and evidence_eligible and authority_enabled").select("collection_id")
    return sections.join(ok, "collection_id", "left_semi")


def between_dates(df: DataFrame, column: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Inclusive date range on a timestamp column; the bounds stay comparable with the raw column,
    so they can be pushed to the scan."""
    if start:
        df = df.filter(F.col(column) >= F.expr(f"timestamp_ntz'{start} 00:00:00'"))
    if end:
        df = df.filter(F.col(column) < F.expr(f"timestamp_ntz'{end} 00:00:00' + interval 1 day"))
    return df


def work_list(items: DataFrame, state: str | None = None, text: str | None = None, columns: Sequence[str] = (),
              order: Sequence[Column] = (), number: int = 1, size: int = 25) -> DataFrame:
    """A page of items, optionally of one state and containing a text."""
    if state is not None:
        items = items.filter(F.col("state") == state)
    if text:
        items = contains_any(items, text, columns)
    return page(items, order, number, size)


def browse_documents(versions: DataFrame, sections: DataFrame, number: int, size: int, *, collections: DataFrame | None = None,
                     authority: Column | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """A page of current versions (latest per identity), newest first, each with its whole first section.

    ``collections`` keeps versions of enabled, evidence-eligible collections, ``authority`` is a condition on
    columns of the version, ``start`` and ``end`` an inclusive range of dates. They apply to current versions:
    an identity whose current version falls out doesn't show an older one. Only the page's versions reach
    the section join."""
    slim = versions.drop("content")
    current = latest(slim, ["identity_id"], ["created_at", "version_id"])
    if collections is not None:
        current = eligible(current, collections)
    if authority is not None:
        current = current.filter(authority)
    current = between_dates(current, "created_at", start, end).select("identity_id", "version_id", "title", "created_at")
    shown = page(current, [F.desc("created_at"), F.asc("title"), F.asc("version_id")], number, size)
    opening = sections.filter("ordinal = 1").select("version_id", "section_id", F.col("text").alias("passage"))
    return shown.join(opening, "version_id", "left")


def first_sections(sections: DataFrame) -> DataFrame:
    """The first section of every version."""
    return sections.groupBy("version_id").agg(F.min_by(F.struct("section_id", "ordinal", "text"), "ordinal").alias("s")).select(
        "version_id", "s.section_id", "s.ordinal", "s.text")


def document_report(versions: DataFrame, sections: DataFrame, quality: DataFrame, changes: DataFrame) -> DataFrame:
    """One row per current version: title, nested section list, quality outcome and change counts.
    A version's sections are bounded by its document. changes: version_id, changed_count."""
    listed = sections.groupBy("version_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "section_id", "text_sha256"))),
                                                            lambda s: s["section_id"]).alias("section_ids"))
    return (versions.select("version_id", "identity_id", "title").join(listed, "version_id", "left")
            .join(quality.select("version_id", "outcome", "score"), "version_id", "left")
            .join(changes.select("version_id", "changed_count"), "version_id", "left"))


def latest_nested(df: DataFrame, key: str, order: Sequence[Column], columns: Sequence[str], n: int, name: str) -> DataFrame:
    """The ``n`` latest rows per key as an array of structs in order; the rest is pruned before the
    shuffle."""
    last = top_n(df, [key], order, n, "_rank")
    return last.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_rank", F.struct(*columns).alias("_v")))),
                                             lambda s: s["_v"]).alias(name))


def key_report(keys: DataFrame, key: str, parts: Mapping[str, tuple[DataFrame, Sequence[Column], Sequence[str], int]],
               active: DataFrame) -> DataFrame:
    """A row per key with the latest rows of several tables nested and a ``blocked`` flag for keys
    with active work."""
    out = keys.select(key)
    for name, (df, order, columns, n) in parts.items():
        out = out.join(latest_nested(df, key, order, columns, n, name), key, "left")
    busy = active.select(key).distinct().withColumn("blocked", F.lit(True))
    return out.join(busy, key, "left").withColumn("blocked", F.coalesce("blocked", F.lit(False)))
