"""Taxonomy definitions (JSON) to term rows with parent links, with the rules they must keep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = """
    schema_version int, slug string, version int, name string, description string, jurisdiction string, disclaimer string,
    terms array<struct<dimension:string,code:string,label:string,description:string,parent_code:string,aliases:array<string>>>"""

# Slug form, dimensions, size bound.
SLUG = r"^[a-z0-9]+(?:-[a-z0-9]+)*$"
MAX_TERMS = 500


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path, multiLine=True)


def parse(documents: DataFrame, column: str = "definition") -> DataFrame:
    return documents.select(F.from_json(column, SCHEMA.replace("\n", " ")).alias("d")).select("d.*")


def terms(definitions: DataFrame) -> DataFrame:
    """One row per term with its position."""
    taxonomy = F.concat_ws(":", "slug", F.col("version").cast("string"))
    return definitions.select(taxonomy.alias("taxonomy_id"), F.posexplode("terms").alias("position", "t")).select(
        "taxonomy_id", (F.col("position") + 1).alias("position"), "t.dimension", "t.code", "t.label", "t.parent_code", "t.aliases")


def with_parents(term_rows: DataFrame) -> DataFrame:
    """Terms with the position of their parent in the same dimension (null without one)."""
    parents = term_rows.groupBy("taxonomy_id", "dimension", F.col("code").alias("parent_code")).agg(F.min("position").alias("parent_position"))
    return term_rows.join(parents, ["taxonomy_id", "dimension", "parent_code"], "left")


def violations(term_rows: DataFrame, dimensions: list[str], max_terms: int | None = MAX_TERMS) -> DataFrame:
    """(taxonomy_id, dimension, code, position, rule): bad slugs, unknown dimensions, repeated
    (dimension, code), parents that are missing or not earlier, taxonomies of more than ``max_terms``
    terms (None: of any size)."""
    firsts = term_rows.groupBy("taxonomy_id", "dimension", "code").agg(F.min("position").alias("_first"))
    sizes = term_rows.groupBy("taxonomy_id").agg(F.count(F.lit(1)).alias("_size"))
    j = with_parents(term_rows).join(firsts, ["taxonomy_id", "dimension", "code"]).join(sizes, "taxonomy_id")
    rules = {
        "dimension": ~F.coalesce(F.col("dimension").isin(*dimensions), F.lit(False)),
        "code": ~F.coalesce(F.col("code").rlike(SLUG), F.lit(False)),
        "label": F.trim(F.coalesce("label", F.lit(""))) == "",
        "duplicate": F.col("position") > F.col("_first"),
        "parent": F.col("parent_code").isNotNull() & ~F.coalesce(F.col("parent_position") < F.col("position"), F.lit(False)),
        "size": F.col("_size") > max_terms if max_terms is not None else F.lit(False),
    }
    failed = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()]))
    return j.select("taxonomy_id", "dimension", "code", "position", F.explode(failed).alias("rule"))
