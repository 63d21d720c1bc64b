"""Documents to ordered sections with offsets, all inside the row (no shuffle, linear in its lines)."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import normalize_inline
from palimpsest.functions.udf import vectorized


@vectorized("array<bigint>")
def running_starts(lengths: pd.Series) -> pd.Series:
    """For an array of lengths the sum of those before each element."""
    return lengths.map(lambda a: None if a is None else a.cumsum() - a)


def line_sections(documents: DataFrame, key: str = "version_id", text: str = "content", keep: Sequence[str] = (),
                  heading_every: int | None = None, offsets: bool = True) -> DataFrame:
    """One section per non-empty normalized line of each document; lines are joined by two characters
    when offsets are counted. ``keep``: columns of the document that its sections carry. ``heading_every``: each n-th line from the
    first heads the lines up to the next one and has an empty heading itself (adds ``heading``). Without ``offsets`` there is no
    char_start and char_end, and no Python process."""
    lines = F.filter(F.transform(F.split(F.col(text), "\n"), normalize_inline), lambda l: l != "")
    split = documents.select(key, *keep, lines.alias("_lines"))
    placed = split.withColumn("_starts", running_starts(F.transform("_lines", lambda t: F.length(t).cast("bigint") + 2))) if offsets else split
    rows = F.transform("_lines", lambda t, i: F.struct(
        (i + 1).alias("ordinal"), t.alias("text"),
        *([F.get("_starts", i).alias("char_start"), (F.get("_starts", i) + F.length(t)).alias("char_end")] if offsets else []),
        *([F.when(i % heading_every == 0, "").otherwise(F.get("_lines", i - i % heading_every)).alias("heading")] if heading_every else [])))
    return (
        placed.select(key, *keep, F.inline(rows))
        .select(
            F.concat_ws(":", F.col(key).cast("string"), F.col("ordinal").cast("string")).alias("section_id"),
            key, "ordinal", "text", F.sha2("text", 256).alias("text_sha256"), *(["char_start", "char_end"] if offsets else []), *keep,
            *(["heading"] if heading_every else []))
    )
