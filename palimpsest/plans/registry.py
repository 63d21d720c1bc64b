"""Query registry and the two faces of a binding: a DataFrame and a SQL common table expression."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
        "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


TEXT_KEYS = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}


@dataclass(frozen=True)
class Query:
    name: str
    operators: tuple[str, ...]
    build: Callable[["Tables"], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}
SHARED: dict[str, Callable] = {}  # binding name -> function(dialect) -> SQL for both engines
SPARK_ONLY: dict[str, Callable] = {}  # binding name -> function(tables) -> DataFrame
SQL_ONLY: dict[str, str] = {}  # binding name -> SQL twin of a SPARK_ONLY binding or a helper


def query(name: str, operators: str, sql: str | None = None):
    """Register a query under ``name`` for the inventory items listed in ``operators``."""

    def keep(build):
        assert name not in REGISTRY, name
        REGISTRY[name] = Query(name, tuple(operators.split()), build, sql)
        return build

    return keep


class SparkDialect:
    name = "spark"

    def sha(self, x): return f"sha2({x}, 256)"
    def minutes(self, x): return f"make_interval(0, 0, 0, 0, 0, cast({x} as int), 0)"
    def seconds(self, x): return f"make_interval(0, 0, 0, 0, 0, 0, cast({x} as decimal(18, 6)))"
    def days(self, x): return f"make_interval(0, 0, 0, cast({x} as int), 0, 0, 0)"
    def ts(self, text): return f"timestamp_ntz'{text}'"
    def json(self, x, key): return f"get_json_object({x}, '$.{key}')"


class DuckDialect:
    name = "duck"

    def sha(self, x): return f"sha256({x})"
    def minutes(self, x): return f"to_minutes(cast({x} as bigint))"
    def seconds(self, x): return f"to_microseconds(cast(round(({x}) * 1000000) as bigint))"
    def days(self, x): return f"to_days(cast({x} as int))"
    def ts(self, text): return f"timestamp '{text}'"
    def json(self, x, key): return f"json_extract_string({x}, '$.{key}')"


def shared(fn):
    SHARED[fn.__name__] = fn
    return fn


def spark_binding(fn):
    SPARK_ONLY[fn.__name__] = fn
    return fn


def _names(sql: str, known) -> list[str]:
    words = set(re.findall(r"[a-z_][a-z_0-9]*", sql))
    return [n for n in known if n in words]


class Tables:
    """Lazy access to the given tables and their bindings: ``t.section``, ``t.run``, ..."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        if spark.conf.get("spark.sql.session.timeZone") != "UTC":
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        self._cache: dict[str, DataFrame] = {}

    def cut(self, **tables: DataFrame) -> "Tables":
        """The same tables with some given ones cut to fewer rows; bindings over those follow."""
        out = Tables(self.spark, self.sf_dir)
        out._cache.update(tables)
        return out

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._cache:
            self._cache[name] = self._load(name)
        return self._cache[name]

    def _load(self, name: str) -> DataFrame:
        if name in BASE:
            return self._spread(self.spark.read.parquet(self.path(name)), name)
        if name in SPARK_ONLY:
            return SPARK_ONLY[name](self)
        if name in SHARED:
            return self.sql(SHARED[name](SparkDialect()))
        raise AttributeError(name)

    def _spread(self, df: DataFrame, name: str) -> DataFrame:
        """Text tables are CPU-bound: a scan with fewer splits than cores (one small file) is dealt
        out by key. A scan that already has enough splits is left alone."""
        key = TEXT_KEYS.get(name)
        cores = self.spark.sparkContext.defaultParallelism
        if key is None or df.rdd.getNumPartitions() >= cores:
            return df
        return df.repartition(cores, key)

    def sql(self, text: str) -> DataFrame:
        """Run SQL in which base tables and bindings are named directly."""
        known = [*BASE, *SPARK_ONLY, *SHARED]
        used = [n for n in _names(text, known) if re.search(rf"(?:from|join)\s+{n}\b", text, re.I)]
        for n in used:
            text = re.sub(rf"\b(from|join)\s+{n}\b", rf"\1 {{{n}}}", text, flags=re.I)
        return self.spark.sql(text, **{n: getattr(self, n) for n in used})


def oracle(sql: str) -> str:
    """Prefix a query with the common table expressions of every binding it uses."""
    order: list[str] = []

    def body(name):
        return SQL_ONLY[name] if name in SQL_ONLY else SHARED[name](DuckDialect())

    def visit(text, seen=()):
        for n in _names(text, [*SQL_ONLY, *SHARED]):
            if n in order or n in seen:
                continue
            if not re.search(rf"(?:from|join|,)\s+{n}\b", text, re.I):
                continue
            visit(body(n), (*seen, n))
            order.append(n)

    visit(sql)
    if not order:
        return sql
    ctes = ",\n".join(f"{n} AS (\n{body(n)}\n)" for n in order)
    stripped = sql.strip()
    if stripped.lower().startswith("with recursive"):
        raise ValueError("recursive queries need their own prefix")
    if stripped.lower().startswith("with "):
        return f"WITH {ctes},\n{stripped[5:]}"
    return f"WITH {ctes}\n{stripped}"
