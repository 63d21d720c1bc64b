"""Source registry definitions (JSON) to authority, collection, endpoint, configuration and
resource rows, with the rules a definition must keep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import urls

SCHEMA = """
    schema_version int, slug string, version int,
    authority struct<slug:string,name:string,jurisdiction:string,country_code:string,authority_type:string,
        official_domains:array<string>,trust_classification:string>,
    collection struct<slug:string,name:string,document_family:string,priority:string>,
    endpoint struct<name:string,discovery_url:string,connector_type:string,allowed_domains:array<string>,
        polling_interval_minutes:int,pagination_strategy:string,requires_javascript:boolean,
        connector_configuration_version:int,default_enabled:boolean>,
    connector_configurations array<struct<version:int,is_active:boolean,configuration:struct<max_candidates:int,
        include_path_prefixes:array<string>,link_value_prefix:string,link_value_suffix:string>>>,
    resources array<struct<resource_type:string,url:string,is_approved:boolean>>"""

# Definition bounds.
SLUG = r"^[a-z0-9]+(?:-[a-z0-9]+)*$"
POLLING_MINUTES = (5, 43200)
CANDIDATE_LIMIT = (1, 100)
JAVASCRIPT_CONNECTOR = "javascript_listing"


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per definition file."""
    return spark.read.schema(SCHEMA).json(path, multiLine=True)


def parse(documents: DataFrame, column: str = "definition") -> DataFrame:
    """One row per JSON text."""
    return documents.select(F.from_json(column, SCHEMA.replace("\n", " ")).alias("d")).select("d.*")


def checksum(definitions: DataFrame) -> DataFrame:
    """slug, version and checksum of each definition."""
    return definitions.select("slug", "version", F.sha2(F.to_json(F.struct(*sorted(definitions.columns))), 256).alias("checksum"))


def authorities(definitions: DataFrame) -> DataFrame:
    return definitions.select("authority.*").dropDuplicates(["slug"])


def collections(definitions: DataFrame) -> DataFrame:
    return definitions.select(F.col("authority.slug").alias("authority_slug"), "collection.*").dropDuplicates(["authority_slug", "slug"])


def endpoints(definitions: DataFrame) -> DataFrame:
    return definitions.select(F.col("slug").alias("definition_slug"), F.col("authority.slug").alias("authority_slug"),
                              F.col("collection.slug").alias("collection_slug"), "endpoint.*")


def configurations(definitions: DataFrame) -> DataFrame:
    return definitions.select(F.col("slug").alias("definition_slug"), F.inline("connector_configurations"))


def resources(definitions: DataFrame) -> DataFrame:
    return definitions.select(F.col("slug").alias("definition_slug"), F.inline("resources"))


def violations(definitions: DataFrame, authority_types: list[str], connector_types: list[str]) -> DataFrame:
    """(slug, rule) for every rule a definition breaks; a definition is one bounded row."""
    c = F.col
    e, a = "endpoint", "authority"
    versions = F.transform("connector_configurations", lambda x: x["version"])
    active = F.transform(F.filter("connector_configurations", lambda x: x["is_active"]), lambda x: x["version"])
    wrong = lambda test: ~F.coalesce(test, F.lit(False))
    conf = lambda test: F.forall("connector_configurations", lambda x: F.coalesce(test(x["configuration"]), F.lit(False)))
    rules = {
        "schema_version": wrong(c("schema_version") == 1),
        "slug": wrong(c("slug").rlike(SLUG)),
        "version": wrong(c("version") >= 1),
        "required_keys": c(f"{a}.slug").isNull() | c(f"{a}.name").isNull() | c("collection.slug").isNull() | c(f"{e}.discovery_url").isNull(),
        "authority_type": wrong(c(f"{a}.authority_type").isin(*authority_types)),
        "connector_type": wrong(c(f"{e}.connector_type").isin(*connector_types)),
        "polling_interval": wrong(c(f"{e}.polling_interval_minutes").between(*POLLING_MINUTES)),
        "javascript_connector": wrong(c(f"{e}.requires_javascript") == (c(f"{e}.connector_type") == JAVASCRIPT_CONNECTOR)),
        "domains_empty": wrong((F.size(f"{a}.official_domains") > 0) & (F.size(f"{e}.allowed_domains") > 0)),
        "domain_not_official": wrong(F.forall(f"{e}.allowed_domains", lambda d: urls.host_allowed(d, c(f"{a}.official_domains")))),
        "discovery_url": urls.url_safety_reason(c(f"{e}.discovery_url"), c(f"{e}.allowed_domains")).isNotNull(),
        "configuration_versions": wrong((F.size(versions) > 0) & (F.size(F.array_distinct(versions)) == F.size(versions))),
        "active_configuration": wrong(active == F.array(c(f"{e}.connector_configuration_version"))),
        "max_candidates": wrong(conf(lambda x: x["max_candidates"].between(*CANDIDATE_LIMIT))),
        "link_value_pair": wrong(conf(lambda x: x["link_value_prefix"].isNull() == x["link_value_suffix"].isNull())),
        "resource_url": F.exists("resources", lambda r: urls.url_safety_reason(r["url"], c(f"{e}.allowed_domains")).isNotNull()),
    }
    failed = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()]))
    return definitions.select("slug", F.explode(failed).alias("rule"))
