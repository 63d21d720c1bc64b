"""Registered queries of this subpackage: one per operator, over whole tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import bpe, centroids, chat, decontaminate, license_scan, line_dedup, lm, neighbours, simhash, topk, toxicity, url_filter, whitening
from palimpsest.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_url_filter(spark, sf_dir):
    return url_filter.verdicts(table(spark, sf_dir, "pages").select("page_id", "url"))


@query
def op2_decontamination(spark, sf_dir):
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op3_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op4_license_scan(spark, sf_dir):
    return license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op5_chat_format(spark, sf_dir):
    return chat.render(table(spark, sf_dir, "conversations"))


@query
def op6_lm_score(spark, sf_dir):
    return lm.score(table(spark, sf_dir, "documents"))


@query
def op7_line_dedup(spark, sf_dir):
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op8_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.severity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))).drop("text")


@query
def op9_top_k(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.where(F.col("vec_id") % 50 == 0))


@query
def op10_bpe(spark, sf_dir):
    return bpe.digests(table(spark, sf_dir, "documents"), bpe.load(spark))


@query
def op11_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@query
def op12_centroids(spark, sf_dir):
    return centroids.cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@query
def op13_neighbours(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.search(vectors, vectors.where(F.col("vec_id") % 20 == 0))


ORACLE_SQL = {"op2_decontamination": decontaminate.SQL, "op5_chat_format": chat.SQL, "op9_top_k": topk.SQL,
              "op12_centroids": centroids.SQL}
