"""Embedding whitening with MLlib's distributed block matrices.

Vectors are made integers, so that their sums, and with them the mean, are exact. The centred rows get dense
row numbers and become a matrix of row blocks; the transposed matrix times the matrix is the scatter, summed
over as many splits as there are row blocks. Only the covariance (dimensions squared, whatever the number of
rows) comes to the driver, where its eigenvectors are found; a second multiplication projects all rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.session import stage

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
BLOCK_MB, LEAST_ROWS = 32, 1024  # a row block has at most so many MB, and so many rows at least where it has


def usable(embedding: Column) -> Column:
    """Whether a vector is neither null nor holds null or non-finite components."""
    finite = F.forall(embedding, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(finite, F.lit(False))


def integers(embedding: Column, dims: int) -> Column:
    """floor(1024 c) + 100000 of each component, missing components counting as zero."""
    padded = F.concat(embedding.cast("array<double>"), F.array_repeat(F.lit(0.0), F.lit(dims) - F.size(embedding)))
    return F.transform(padded, lambda c: F.floor(c * float(SCALE)).cast("long") + SHIFT)


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """The rows, written once, with dense numbers from 0 in the column ``at``: the number within a partition
    plus the rows of the partitions before it (one count for each partition)."""
    kept = stage(rows.withColumn("__id", F.monotonically_increasing_id()), name)
    part = F.shiftright("__id", 33)
    counts = kept.groupBy(part.alias("part")).agg(F.count("*").alias("rows"))
    before = counts.selectExpr("part", "sum(rows) over (order by part rows between unbounded preceding and 1 preceding) as before")
    at = F.coalesce("before", F.lit(0)) + F.col("__id").bitwiseAND((1 << 33) - 1)
    return kept.withColumn("part", part).join(before, "part").withColumn("at", at).drop("part", "__id", "before")


def block_matrix(rows: DataFrame, n: int, dims: int, per_block: int) -> BlockMatrix:
    """Rows ``(at, y)``, numbered below n, as blocks of ``per_block`` rows."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("at", array_to_vector("y").alias("y")), "y")
    return IndexedRowMatrix(callMLlibFunc("createIndexedRowMatrix", vectors, n, dims)).toBlockMatrix(per_block, dims)


def scatter(matrix: BlockMatrix) -> np.ndarray:
    """Transposed times itself. The shared dimension is split by row blocks, for which Python's own
    ``multiply`` has no argument: without it one task would get every block."""
    turned = matrix.transpose()
    product = turned._java_matrix_wrapper.call("multiply", matrix._java_matrix_wrapper._java_model, int(matrix.numRowBlocks))
    return BlockMatrix(product, turned.rowsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


def principal(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The largest eigenvalues, falling, their unit eigenvectors (largest entry positive) and the trace."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return values, vectors * np.where(sign == 0, 1, sign), float(np.trace(covariance))


def whiten(table: DataFrame, components: int = COMPONENTS, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row for each vector and component: ``key, component, n, deviation, whitened, explained,
    identity_error``. All vectors that take part are the fit list; repeated rows and null keys count like others.

    Vectors that are null or hold null or non-finite components are left out. The dimension is that of the
    longest vector, missing components are zero. Directions without variance (eigenvalue below the rounding
    of the largest) have ``whitened`` null and don't enter ``identity_error``; where there is no variance at
    all ``explained`` is null. ``deviation`` is exact, and null where it exceeds 64 bits. Components beyond
    a million times a million count as that much."""
    spark = table.sparkSession
    source = table.select(F.col(f"`{key}`").alias("key"), F.col(f"`{embedding}`").alias("e")).where(usable(F.col("e")))
    dims = source.agg(F.max(F.size("e"))).first()[0] or 0
    schema = f"component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not dims:
        return source.select(F.col("key").alias(key)).where("false").select(key, *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in schema.split(", ")])
    held = F.transform("e", lambda c: F.greatest(F.least(c.cast("double"), F.lit(1e12)), F.lit(-1e12)))
    rows = numbered(source.select("key", integers(held, dims).alias("x")), "whitening-rows")
    sums = rows.select(F.posexplode("x")).groupBy("pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).orderBy("pos").collect()
    n, total = sums[0]["n"], [int(r["s"]) for r in sums]

    # x - S/n with one rounding: the integer part of the mean is taken off exactly first
    whole, rest = [s // n for s in total], [(s % n) / n for s in total]
    numbers = lambda values, kind: F.array(*[F.lit(v).cast(kind) for v in values])
    off = F.zip_with("x", numbers(whole, "long"), lambda x, m: (x - m).cast("double"))
    rows = rows.withColumn("y", F.zip_with(off, numbers(rest, "double"), lambda x, m: x - m))
    cores = spark.sparkContext.defaultParallelism
    per_block = min(max(LEAST_ROWS, -(-n // (4 * cores))), max(1, BLOCK_MB * (1 << 20) // (8 * dims)))
    matrix = block_matrix(rows, n, dims, per_block)
    values, vectors, trace = principal(scatter(matrix) / n, components)
    real = values > dims * np.finfo(float).eps * max(values[0], 0)
    project = np.where(real, vectors / np.sqrt(np.where(real, values, 1)), 0)

    width = project.shape[1]
    weights = BlockMatrix(spark.sparkContext.parallelize([((0, 0), Matrices.dense(dims, width, project.ravel(order="F").tolist()))], 1), dims, width)
    projected = callMLlibFunc("getIndexedRows", matrix.multiply(weights).toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    far = F.zip_with("x", numbers(total, "decimal(38,0)"), lambda x, s: F.lit(n).cast("decimal(20,0)") * x - s)
    deviation = F.aggregate(far, F.lit(0).cast("decimal(38,0)"), lambda a, d: (a + d * d).cast("decimal(38,0)"))
    whitened = stage(projected.select(F.col("index").alias("at"), vector_to_array("vector").alias("w")).join(
        rows.select("at", "key", deviation.alias("deviation")), "at"), "whitened")
    error = identity_error(whitened, real)
    explained = [float(v) / trace if trace > 0 else None for v in values]
    item = lambda values, kind: F.element_at(numbers(values, kind), F.col("pos") + 1)
    return whitened.select("key", "deviation", F.posexplode("w")).select(
        F.col("key").alias(key), (F.col("pos") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"),
        F.expr("try_cast(deviation as bigint)").alias("deviation"), F.when(item(real.tolist(), "boolean"), F.col("col")).alias("whitened"),
        item(explained, "double").alias("explained"), F.lit(error).cast("double").alias("identity_error"))


def identity_error(whitened: DataFrame, real: np.ndarray) -> float | None:
    """The largest absolute entry of the covariance of ``w`` less the identity, over real components."""
    used = [int(i) for i in np.nonzero(real)[0]]
    if not used:
        return None
    w = lambda i: F.col("w")[i]
    means = whitened.agg(*[F.avg(w(i)) for i in used]).first()
    off = {i: w(i) - m for i, m in zip(used, means)}
    pairs = [(i, j) for i in used for j in used if j <= i]
    found = whitened.agg(*[F.avg(off[i] * off[j]) for i, j in pairs]).first()
    return max(abs(c - (i == j)) for c, (i, j) in zip(found, pairs))
