"""Table-constraint checks: queries that return the violating rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHA256 = r"^[0-9a-f]{64}$"


def key_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count")).filter("row_count > 1")


def row_violations(df: DataFrame, key: Sequence[str], rules: Mapping[str, Column]) -> DataFrame:
    """One row per (row, rule) whose test is false or null."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules.items()]))
    return df.select(*key, F.explode(failed).alias("rule"))


def review_violations(impacts: DataFrame, items: DataFrame, reviews: DataFrame) -> DataFrame:
    """Impacts whose confirmation is not a confirming review of their own item, or whose item did
    not change."""
    j = (impacts.join(items.select("item_id", "change_type"), "item_id", "left")
         .join(reviews.select(F.col("review_id").alias("confirmation_review_id"), F.col("item_id").alias("_item"), F.col("decision").alias("_decision")),
               "confirmation_review_id", "left"))
    reason = (F.when(F.col("change_type").isNull(), "item_missing").when(F.col("_item").isNull(), "confirmation_missing")
              .when(F.col("_item") != F.col("item_id"), "confirmation_of_other_item")
              .when(F.col("_decision") != "confirmed", "not_confirmed").when(F.col("change_type") == "unchanged", "item_unchanged"))
    return j.select("impact_id", reason.alias("reason")).filter("reason is not null")


def plan_diff(wanted: DataFrame, installed: DataFrame, keys: Sequence[str], checksum: str = "checksum") -> DataFrame:
    """create, reuse or conflict for every definition row against the installed one."""
    have = installed.select(*keys, F.col(checksum).alias("_have"))
    action = (F.when(F.col("_have").isNull(), "create").when(F.col("_have") == F.col(checksum), "reuse").otherwise("conflict"))
    return wanted.join(have, list(keys), "left").select(*keys, checksum, action.alias("action"))
