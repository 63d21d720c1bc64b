"""A training corpus from raw documents, stage by stage; each stage's result is written and read again.

1. toxicity: documents whose expected severity reaches the cut go.
2. line_dedup: blocks of lines that repeat an earlier document are deleted; documents left without a word go.
3. near_dedup: of each class of near duplicates (0.8 or more of their runs of five words in common) the document
   with the smallest id stays.
4. decontamination: documents that hold a window of a benchmark item go.
5. bpe: token ids of what is left.

All but the last return the columns of ``documents``. Rows that no stage has a reason to drop are kept as
they are, null and empty texts included (empty ones are near duplicates of each other).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import bpe, decontaminate, line_dedup, near_dedup as near, toxicity
from palimpsest.llm.common import table
from palimpsest.session import stage


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    edited = line_dedup.dedup_lines(docs)
    emptied = (F.col("n_removed_lines") > 0) & F.col("text").rlike(r"^\s*$")
    return edited.where(~F.coalesce(emptied, F.lit(False))).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.keep_first(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = bpe.encode(docs.select("doc_id", "text"), bpe.load(spark))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("toxicity", toxic), ("line_dedup", dedup_lines), ("near_dedup", near_dedup),
          ("decontamination", decontaminated), ("bpe", encode)]

#: Trained weights, alignment, reachability and merges are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result goes to the shared folder before the next stage reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
