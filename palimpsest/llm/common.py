"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.session import stage

Batches = Iterator[pa.RecordBatch]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(text: Column) -> Column:
    """A-Z in lower case, every other character as it is; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def as_bytes(text: str = "text") -> Column:
    """A text column for Python workers: UTF-8 bytes, so that nothing is decoded there; null stays null."""
    return F.col(text).cast("binary")


def broadcast_blocks(small: DataFrame, key: str, limit: int) -> list[DataFrame]:
    """Cut a table by the hash of ``key`` into blocks of about ``limit`` rows at most and mark each for
    broadcast. The rows are counted first, so what a task holds is bounded at any size; a larger table
    means more blocks, each joined with the other side in turn."""
    n = max(1, -(-small.count() // limit))
    if n == 1:
        return [F.broadcast(small)]
    return [F.broadcast(small.where(F.pmod(F.xxhash64(key), F.lit(n)) == i)) for i in range(n)]


def union_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def stage_rows(df: DataFrame, name: str, rows: int, per_file: int = 50_000) -> DataFrame:
    """Stage a table that has about ``rows`` rows at most, in files of a sensible size rather than one for
    each shuffle partition."""
    return stage(df.coalesce(max(1, -(-rows // per_file))), name)


def slices(batches: Batches, rows: int) -> Batches:
    """The same rows in batches of at most ``rows``, so that what Python makes of a batch stays small."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def column_values(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def with_columns(batch: pa.RecordBatch, drop: tuple[str, ...] = (), **new: pa.Array) -> pa.RecordBatch:
    """The batch without the dropped columns and with new ones at its end."""
    kept = [n for n in batch.schema.names if n not in drop]
    return pa.RecordBatch.from_arrays(
        [batch.column(batch.schema.get_field_index(n)) for n in kept] + list(new.values()), names=kept + list(new))
