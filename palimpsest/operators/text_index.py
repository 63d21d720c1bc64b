"""A persisted inverted index over sections: ranked search reads its tables and no text.

Each batch of sections is three parquet tables below ``path``, cut by a bucket of the term:

* ``postings``: a row per token (bucket, term, block, section_id, spot, weight, length);
* ``tops``: a row per term and block (holders, top), where ``top`` is the largest share of the score that
  the term gives to any section of the block;
* ``members``: a row per section with the columns kept for filters and grouping.

A block is about ``BLOCK`` sections of one batch. A batch whose last table lacks Spark's ``_SUCCESS`` file is
not read, and adding a batch of a known name does nothing, so an append that dies can simply be repeated.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.text import tokens
from palimpsest.operators.history import top_n
from palimpsest.operators.search import CANDIDATES, WEIGHT_FIFTHS, parse_query_udf
from palimpsest.session import files, stage

BLOCK = 4096
BUCKETS = 64
FIRST_BLOCKS = 8
WORTHWHILE = 8  # a first round is made for queries with this many times FIRST_BLOCKS blocks; results are the same
SCHEMAS = {"postings": "section_id string, block string, length int, term string, spot bigint, weight int, bucket int",
           "tops": "term string, block string, holders bigint, top double, bucket int"}
FIELD_SHIFT = 32  # a spot is field number * 2^32 + position, so words of different fields never adjoin


def bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _spots(column: str, field: int, weight: str) -> Column:
    return F.transform(tokens(F.coalesce(F.col(column), F.lit(""))), lambda t, i: F.struct(
        t.alias("term"), (F.lit(field << FIELD_SHIFT).cast("bigint") + i).alias("spot"), F.lit(WEIGHT_FIFTHS[weight]).alias("weight")))


@dataclass(frozen=True)
class TextIndex:
    """``fields`` maps text columns to weight classes, ``keep`` names the columns of ``members``."""

    spark: SparkSession
    path: str
    fields: Mapping[str, str]
    keep: tuple[str, ...] = ()
    buckets: int = BUCKETS

    def batches(self) -> list[str]:
        """Names of the whole batches."""
        return [p.split("/")[-3] for p in files(self.spark, f"{self.path}/*/tops/_SUCCESS")]

    def add(self, sections: DataFrame, batch: str, block_rows: int = BLOCK) -> "TextIndex":
        """Index a batch of new sections (section_id, the fields, the kept columns). Null texts count as
        empty; a section without words is a member without postings. Section ids must be new."""
        if batch in self.batches():
            return self
        folder = f"{self.path}/{batch}"
        sections.select("section_id", *self.keep).write.mode("overwrite").parquet(f"{folder}/members")
        blocks = max(1, -(-self._read([batch], "members").count() // block_rows))
        block = F.concat_ws("-", F.lit(batch), F.pmod(F.xxhash64("section_id"), F.lit(blocks)).cast("string"))
        spots = F.concat(*[_spots(c, i, w) for i, (c, w) in enumerate(self.fields.items())])
        words = (sections.select("section_id", block.alias("block"), spots.alias("_spots"))
                 .select("section_id", "block", F.size("_spots").alias("length"), F.inline("_spots"))
                 .withColumn("bucket", bucket(F.col("term"), self.buckets)))
        # A frequent term is spread by its blocks; files are sorted so that a term is few row groups.
        (words.repartition("bucket", "term", "block").sortWithinPartitions("bucket", "term", "block", "section_id")
         .write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings"))
        held = (self._read([batch], "postings").groupBy("bucket", "term", "block", "section_id")
                .agg(F.sum("weight").alias("_w"), F.max("length").alias("_n")))
        (held.groupBy("bucket", "term", "block").agg(F.count(F.lit(1)).alias("holders"), F.max(F.col("_w") / (F.col("_n") * 5)).alias("top"))
         .repartition("bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/tops"))
        return self

    def _read(self, batches: Sequence[str], table: str) -> DataFrame:
        reader = self.spark.read.schema(SCHEMAS[table]) if table in SCHEMAS else self.spark.read
        return reader.parquet(*[f"{self.path}/{b}/{table}" for b in batches])

    def _union(self, table: str) -> DataFrame:
        # Batches are separate folders with the same partition column, hence one read each.
        out = None
        for b in self.batches():
            part = self._read([b], table)
            out = part if out is None else out.unionByName(part)
        if out is None:
            raise ValueError(f"no batch in {self.path}")
        return out

    @property
    def members(self) -> DataFrame:
        return self._union("members")

    def search(self, queries: DataFrame, limit: int = CANDIDATES, eligible: DataFrame | None = None) -> DataFrame:
        """Ranked sections per query as :func:`search.full_text` gives them, exactly:
        (query_id, section_id, text_score, text_rank).

        ``eligible`` (section_id) restricts the ranking; it acts before the cut at ``limit``. A block is
        read only if it holds all terms of a clause and, for queries with more than ``limit`` possible
        hits in many blocks, if the sum of its tops reaches the score of the hit of rank ``limit`` in the most promising
        blocks. In a block the rarest term gives the candidates; postings of the other terms are joined
        by section, so each moves at most once for all queries. Clauses, blocks and bars are staged: small
        tables by which the next step is chosen."""
        postings, tops = self._union("postings"), self._union("tops")
        clauses = (queries.select("query_id", F.explode(parse_query_udf("query")).alias("_c")).select("query_id", "_c.*")
                   .withColumn("clause_id", F.xxhash64("query_id", F.to_json(F.struct("terms", "phrases", "excluded")))).distinct())
        clauses = stage(clauses, "index-clauses")
        wanted = clauses.select("query_id", "clause_id", F.size("terms").alias("_need"), F.explode("terms").alias("term"))
        wanted = wanted.withColumn("bucket", bucket(F.col("term"), self.buckets))
        blocks = (wanted.join(tops, ["bucket", "term"]).groupBy("query_id", "clause_id", "block")
                  .agg(F.sum("top").alias("bound"), F.min("holders").alias("holders"), F.min_by("term", F.struct("holders", "term")).alias("term"),
                       F.count(F.lit(1)).alias("_have"), F.max("_need").alias("_need")).filter("_have = _need"))
        blocks = stage(blocks.drop("_have", "_need"), "index-blocks")
        bounds = blocks.groupBy("query_id", "block").agg(F.sum("bound").alias("bound"), F.sum("holders").alias("holders"))
        many = (bounds.groupBy("query_id").agg(F.sum("holders").alias("_most"), F.count(F.lit(1)).alias("_blocks"))
                .filter((F.col("_most") > limit) & (F.col("_blocks") >= WORTHWHILE * FIRST_BLOCKS)).select("query_id"))
        if not many.isEmpty():
            first = top_n(bounds.join(many, "query_id", "left_semi"), ["query_id"], [F.desc("bound"), F.asc("block")], FIRST_BLOCKS, "_rank")
            chosen = blocks.join(first.select("query_id", "block"), ["query_id", "block"], "left_semi")
            bar = (self._rank(self._score(postings, clauses, wanted, chosen, eligible), limit)
                   .filter(F.col("text_rank") == limit).select("query_id", F.col("text_score").alias("_bar")))
            # The margin covers the rounding of scores and of the sum of the tops.
            open_ = bounds.join(stage(bar, "index-bar"), "query_id", "left").filter(F.col("_bar").isNull() | (F.col("bound") + 1e-9 >= F.col("_bar")))
            blocks = blocks.join(open_.select("query_id", "block"), ["query_id", "block"], "left_semi")
        return self._rank(self._score(postings, clauses, wanted, blocks, eligible), limit)

    @staticmethod
    def _rank(scored: DataFrame, limit: int) -> DataFrame:
        best = scored.groupBy("query_id", "section_id").agg(F.sum("_f").alias("_f"), F.max("_n").alias("_n"))
        best = best.withColumn("text_score", F.round(F.col("_f") / (F.col("_n") * 5), 10))
        return top_n(best, ["query_id"], [F.desc("text_score"), F.asc("section_id")], limit, "text_rank").select(
            "query_id", "section_id", "text_score", "text_rank")

    def _score(self, postings: DataFrame, clauses: DataFrame, wanted: DataFrame, blocks: DataFrame,
               eligible: DataFrame | None) -> DataFrame:
        """(query_id, clause_id, section_id, _f, _n) of the sections in ``blocks`` that match a clause."""
        clause, place = ["query_id", "clause_id"], ["bucket", "term", "block", "section_id"]
        seeds = blocks.select(*clause, "block", "term", bucket(F.col("term"), self.buckets).alias("bucket"))
        found = postings.join(seeds, ["bucket", "term", "block"]).select(*clause, "block", "section_id").distinct()
        if eligible is not None:
            found = found.join(eligible.select("section_id"), "section_id", "left_semi")
        held = postings.join(found.join(wanted, clause), place)
        hits = (held.groupBy(*clause, "block", "section_id", "term").agg(F.sum("weight").alias("_w"), F.max("length").alias("_n"), F.max("_need").alias("_need"))
                .groupBy(*clause, "block", "section_id").agg(F.sum("_w").alias("_f"), F.max("_n").alias("_n"), F.count(F.lit(1)).alias("_have"), F.max("_need").alias("_need"))
                .filter("_have = _need"))
        if clauses.filter("size(phrases) + size(excluded) > 0").isEmpty():
            return hits.select(*clause, "section_id", "_f", "_n")
        # A phrase stands where each of its words is found at its distance from the first one.
        parts = clauses.select(*clause, F.explode(F.concat(
            F.transform("phrases", lambda p: F.struct(F.lit(True).alias("wants"), p.alias("part"))),
            F.transform("excluded", lambda p: F.struct(F.lit(False).alias("wants"), p.alias("part"))))).alias("_p")).select(*clause, "_p.*")
        words = (parts.select(*clause, "wants", "part", F.size(F.split("part", " ")).alias("_m"), F.posexplode(F.split("part", " ")).alias("_k", "term"))
                 .withColumn("bucket", bucket(F.col("term"), self.buckets)))
        standing = (postings.join(hits.select(*clause, "block", "section_id").join(words, clause), place)
                    .groupBy(*clause, "section_id", "wants", "part", "_m", (F.col("spot") - F.col("_k")).alias("_start"))
                    .agg(F.count(F.lit(1)).alias("_c")).filter("_c = _m").select(*clause, "section_id", "wants", "part").distinct()
                    .groupBy(*clause, "section_id").agg(F.count_if("wants").alias("_held"), F.count_if(~F.col("wants")).alias("_banned")))
        asked = clauses.select(*clause, F.size("phrases").alias("_asked"))
        return (hits.join(asked, clause).join(standing, [*clause, "section_id"], "left")
                .filter("coalesce(_held, 0) = _asked and coalesce(_banned, 0) = 0").select(*clause, "section_id", "_f", "_n"))
