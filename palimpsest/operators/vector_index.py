"""A persisted inverted-file index of vectors: approximate neighbours from the nearest lists, exact ones on request.

A batch of vectors is a folder of its own below ``lists``; one without Spark's ``_SUCCESS`` file is not read, and adding
a batch of a known name does nothing, so an append that dies can simply be repeated.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.history import top_n
from palimpsest.operators.search import _block_top
from palimpsest.session import files

SAMPLE = 50_000  # vectors, about, on which the centroids are fitted
LISTS = 4_096  # lists at most; the centroids travel with the tasks, so this bounds them
PROBES = 4  # lists read for a query
QUERIES = 4_096  # queries that travel with the tasks of one pass over the index
MARGIN = 1e-4  # of the Euclidean bounds; distances are rounded at the ninth digit


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _gaps(unit: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Euclidean distances of unit vectors to centroids."""
    square = 1.0 + (centroids * centroids).sum(axis=1)[None, :] - 2.0 * unit @ centroids.T
    return np.sqrt(np.maximum(square, 0.0))


def _usable(vector: str, dim: int):
    ok = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return (F.size(vector) == dim) & F.forall(vector, ok) & F.exists(vector, lambda v: v != 0)


@dataclass
class VectorIndex:
    """Files of (item_id, vector, list, residual), sorted by list, and the centroids they refer to. The files'
    row-group statistics let a scan for some lists skip the rest."""

    rows: DataFrame
    path: str
    centroids: np.ndarray

    @classmethod
    def build(cls, corpus: DataFrame, path: str, lists: int | None = None, sample: int = SAMPLE, seed: int = 7) -> VectorIndex:
        """Index every vector of ``corpus`` (item_id, vector) under ``path``; an index that is whole there is opened.

        Centroids are fitted by k-means on about ``sample`` unit vectors picked by a hash of their id; there are
        four times the root of the corpus, ``LISTS`` at most, by default. Vectors that are null, zero, of another
        length than the first one's, or hold null or non-finite entries are left out, as they have no direction."""
        spark = corpus.sparkSession
        if files(spark, f"{path}/lists/batch=first/_SUCCESS"):
            return cls.open(spark, path)
        first = corpus.where("size(vector) > 0").select(F.size("vector").alias("d")).first()
        dim = first["d"] if first else 0
        good = corpus.select("item_id", "vector").where(_usable("vector", dim))
        n = good.count()
        share = min(1.0, sample / max(n, 1))
        picked = good.where(F.pmod(F.xxhash64("item_id"), F.lit(1 << 32)) < F.lit(int(share * (1 << 32))))
        norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
        unit = picked.withColumn("_n", norm).select(array_to_vector(F.transform("vector", lambda x: x.cast("double") / F.col("_n"))).alias("features"))
        k = min(lists or max(1, int(4 * n ** 0.5)), LISTS, max(1, n))
        centroids = np.zeros((1, dim))
        if n and unit.take(1):
            model = KMeans(k=k, seed=seed, maxIter=12, initMode="random", maxBlockSizeInMB=8.0).fit(unit)
            centroids = np.array(model.clusterCenters(), dtype="float64").reshape(-1, dim)
        table = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "list int, centroid array<double>")
        table.coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
        return cls(good, path, centroids).add(good, "first")

    @classmethod
    def open(cls, spark, path: str) -> VectorIndex:
        rows = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()
        batches = [p.rsplit("/", 1)[0] for p in files(spark, f"{path}/lists/batch=*/_SUCCESS")]
        return cls(spark.read.parquet(*batches), path, np.array([r["centroid"] for r in rows], dtype="float64"))

    def add(self, corpus: DataFrame, batch: str) -> VectorIndex:
        """Index new vectors under the same centroids. Ids must be new."""
        if not files(corpus.sparkSession, f"{self.path}/lists/batch={batch}/_SUCCESS"):
            self._write(corpus.select("item_id", "vector").where(_usable("vector", self.centroids.shape[1])), f"lists/batch={batch}")
        return self.open(corpus.sparkSession, self.path)

    def _write(self, corpus: DataFrame, folder: str) -> None:
        centroids, kind = self.centroids, {f.name: f.dataType.simpleString() for f in corpus.schema.fields}

        def assign(batches):
            for pdf in batches:
                if len(pdf):
                    gaps = _gaps(_unit(np.array(pdf["vector"].tolist(), dtype="float64")), centroids)
                    near = gaps.argmin(axis=1)
                    yield pdf.assign(list=near.astype("int32"), residual=gaps[np.arange(len(pdf)), near])

        rows = corpus.mapInPandas(assign, f"item_id {kind['item_id']}, vector {kind['vector']}, list int, residual double")
        # A list of very many vectors is cut by residual; members of equal residual by a hash of their id.
        ranged = rows.repartitionByRange("list", "residual", F.xxhash64("item_id")).sortWithinPartitions("list", "residual")
        ranged.write.mode("overwrite").parquet(f"{self.path}/{folder}")

    def list_sizes(self) -> DataFrame:
        return self.rows.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("residual").alias("radius"))

    def search(self, queries: DataFrame, k: int, probes: int = PROBES, exact: bool = False) -> DataFrame:
        """The k nearest by cosine distance: query_id, item_id, distance, vector_rank (ties: smaller item_id).

        Reads the ``probes`` nearest lists of each query and, with ``exact``, every other list and member that the
        triangle inequality does not keep farther than the k-th found; the result is then that of
        ``search.nearest``. Where a query's lists hold fewer than
        k, fewer come back unless ``exact``. Queries travel with the tasks,
        in passes of at most ``QUERIES``; vectors are not shuffled, only the best of each task are."""
        good = queries.select("query_id", "vector").where(_usable("vector", self.centroids.shape[1]))
        passes = max(1, -(-2 * good.count() // QUERIES))  # hash blocks of half the bound, so that none exceeds it
        near = None
        for i in range(passes):
            some = good if passes == 1 else good.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == i)
            found = self._pass(some.toPandas(), queries.schema["query_id"].dataType.simpleString(), k, probes, exact)
            near = found if near is None else near.unionByName(found)
        return top_n(near, ["query_id"], [F.asc("distance"), F.asc("item_id")], k, "vector_rank")

    def _pass(self, queries: pd.DataFrame, query_type: str, k: int, probes: int, exact: bool) -> DataFrame:
        item_type = self.rows.schema["item_id"].dataType.simpleString()
        schema = f"query_id {query_type}, item_id {item_type}, distance double"
        if queries.empty:
            return self.rows.sparkSession.createDataFrame([], schema)
        ids, m = queries["query_id"].to_numpy(), np.array(queries["vector"].tolist(), dtype="float64")
        gaps = _gaps(_unit(m), self.centroids)
        wanted = np.zeros(gaps.shape, bool)
        np.put_along_axis(wanted, np.argsort(gaps, axis=1, kind="stable")[:, :probes], True, axis=1)
        reach = np.full(len(ids), np.inf)
        found = self._scan(ids, m, gaps, wanted, reach, k, schema)
        if not exact:
            return found
        kth = top_n(found, ["query_id"], [F.asc("distance"), F.asc("item_id")], k, "r").where(F.col("r") == k)
        bound = {r["query_id"]: r["distance"] for r in kth.collect()}
        reach = np.array([np.sqrt(2.0 * max(bound[q], 0.0)) + MARGIN if q in bound else np.inf for q in ids.tolist()])
        radius = np.full(gaps.shape[1], -np.inf)
        for r in self.list_sizes().collect():
            radius[r["list"]] = r["radius"]
        more = ~wanted & (gaps - radius[None, :] <= reach[:, None])
        return found.unionByName(self._scan(ids, m, gaps, more, reach, k, schema))

    def _scan(self, ids, m, gaps, wanted, reach, k: int, schema: str) -> DataFrame:
        """The k best of each task among the members of the wanted lists, by query; members that the bound on their
        residual puts out of reach are passed over."""
        lists = [int(i) for i in np.nonzero(wanted.any(axis=0))[0]]

        def best(batches):
            for pdf in batches:
                for number, part in pdf.groupby("list"):
                    asked = np.nonzero(wanted[:, number])[0]
                    residual = part["residual"].to_numpy()
                    low = np.abs(gaps[asked, number][:, None] - residual[None, :])
                    open_ = low <= reach[asked][:, None]
                    members, asked = open_.any(axis=0), asked[open_.any(axis=1)]
                    if len(asked):
                        vectors = np.array(part["vector"].tolist(), dtype="float64")[members]
                        yield _block_top(part["item_id"].to_numpy()[members], vectors, ids[asked].tolist(), m[asked], k)

        return self.rows.where(F.col("list").isin(lists)).mapInPandas(best, schema)
