"""Deterministic keys: fingerprints, canonical JSON, set digests."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def fingerprint(*parts: Column, sep: str = "\n") -> Column:
    """sha256 over the parts joined by a separator (nulls count as empty)."""
    return F.sha2(F.concat_ws(sep, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def configuration_hash(configuration: Mapping) -> str:
    """sha256 of key-sorted compact JSON; for small driver-side configuration objects."""
    text = json.dumps(configuration, sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(text.encode()).hexdigest()


def canonical_json(**fields: Column) -> Column:
    """Compact JSON of a struct with key-sorted fields."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]),
                     {"ignoreNullFields": "false"})


def json_hash(**fields: Column) -> Column:
    return F.sha2(canonical_json(**fields), 256)


def ordered_set_sha256(values: Column) -> Column:
    """sha256 of the sorted distinct values of an array, one per line. For bounded arrays."""
    return F.sha2(F.array_join(F.array_sort(F.array_distinct(values)), "\n"), 256)


def set_digest(value: Column) -> Column:
    """Aggregate: order-free digest of a set of distinct values in a group of any size.

    Each value's sha256 is cut into four numbers that are summed, so partial sums combine on the
    map side and no task ever holds the set. Equal sets give equal digests.
    """
    h = F.sha2(value.cast("string"), 256)
    part = lambda i: F.sum(F.conv(F.substring(h, i * 15 + 1, 15), 16, 10).cast("decimal(20,0)"))
    sums = [part(i).cast("string") for i in range(4)]
    return F.sha2(F.concat_ws(":", F.count(value).cast("string"), *sums), 256)


def stagger_offset(hash_hex: Column, window: int) -> Column:
    """Deterministic offset in ``[0, window)`` from the first eight hex digits of a hash."""
    return F.conv(F.substring(hash_hex, 1, 8), 16, 10).cast("bigint") % F.lit(window)


def pseudonym(value: Column) -> Column:
    """sha256 of the trimmed text, for usage logs that must not keep the raw value."""
    return F.sha2(F.trim(value.cast("string")), 256)


def content_key(sha256: Column, namespace: str = "") -> Column:
    """Content address ``sha256/ab/cd/<hash>`` under an optional namespace."""
    parts = [F.lit("sha256"), F.substring(sha256, 1, 2), F.substring(sha256, 3, 2), sha256]
    if namespace:
        parts.insert(0, F.lit(namespace.strip("/")))
    return F.concat_ws("/", *parts)
