"""Exact k-means assignment over zone maps along a Hilbert curve.

Vectors are ordered by their place on a Hilbert curve over all dimensions and packed into blocks that carry a
box: the least and the greatest value of each dimension. For two centroids the difference of the squared
distances is linear in the vector, so its bounds over a box follow from the box's ends; a centroid that is
farther than another over the whole box is no candidate there. The vectors of a block are compared with its
candidates only, exactly, in integers. Blocks are written once and read in every round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import Batches
from palimpsest.llm.whitening import usable
from palimpsest.session import stage

DIMS, SCALE, LIMIT = 64, 64, 1 << 26
CENTROIDS, ROUNDS = 16, 3
BLOCK, BITS = 128, 2  # vectors of a block; bits of each dimension on the curve


def quantised(embedding: Column) -> Column:
    """floor(64 x) of each component, held within 2^26 so that squared distances fit into 64 bits."""
    held = lambda x: F.greatest(F.least(x.cast("double"), F.lit(float(LIMIT // SCALE))), F.lit(-float(LIMIT // SCALE)))
    return F.transform(embedding, lambda x: F.floor(held(x) * float(SCALE)).cast("long"))


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on a Hilbert curve, as rows of bytes that sort like it, of integer cells below 2^bits. The
    transposed form of the place comes from undoing the curve's rotations bit plane by bit plane."""
    x = cells.T.astype(np.uint32).copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = np.uint32(q - 1)
        for i in range(d):
            high = (x[i] & np.uint32(q)) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p).astype(np.uint32)
            x[0] ^= np.where(high, p, swap).astype(np.uint32)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.uint32)
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[-1] & np.uint32(q)) != 0, np.uint32(q - 1), np.uint32(0))
        q >>= 1
    x ^= turn
    planes = np.stack([(x >> np.uint32(b)) & 1 for b in range(bits - 1, -1, -1)])  # bit, dimension, row
    return np.packbits(planes.reshape(bits * d, -1).T.astype(np.uint8), axis=1)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _placed(low: np.ndarray, high: np.ndarray, dims: int):
    def run(batches: Batches) -> Batches:
        width = np.maximum(high - low + 1, 1)
        for batch in batches:
            x = _matrix(batch.column(2), dims)
            places = hilbert(((x - low) << BITS) // width, BITS)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([p.tobytes() for p in places], pa.binary())], names=["key", "row", "x", "place"])

    return run


def _blocked(dims: int):
    def block(key, x: np.ndarray) -> list:
        return [pa.array([key]), pa.array([x.min(axis=0).tolist()], pa.list_(pa.int64())), pa.array([x.max(axis=0).tolist()], pa.list_(pa.int64())), pa.array([x.astype("<i4").tobytes()])]

    def run(batches: Batches) -> Batches:
        keys, held = [], np.zeros((0, dims), np.int64)
        for batch in batches:
            keys += batch.column(0).to_pylist()
            held = np.concatenate((held, _matrix(batch.column(1), dims)))
            whole = len(keys) // BLOCK * BLOCK
            for i in range(0, whole, BLOCK):
                yield pa.RecordBatch.from_arrays(block(keys[i:i + BLOCK], held[i:i + BLOCK]), names=["keys", "low", "high", "x"])
            keys, held = keys[whole:], held[whole:]
        if keys:
            yield pa.RecordBatch.from_arrays(block(keys, held), names=["keys", "low", "high", "x"])

    return run


def zones(rows: DataFrame, dims: int = DIMS) -> DataFrame:
    """``keys, low, high, x``: blocks of vectors ``(key, x)`` that are neighbours on the curve. Equal places
    are told apart by a row number, so many copies of a vector still spread over partitions."""
    kept = stage(rows.select("key", F.monotonically_increasing_id().alias("row"), "x"), "zone-rows")
    ends = kept.select(F.posexplode("x")).groupBy("pos").agg(F.min("col").alias("low"), F.max("col").alias("high")).orderBy("pos").collect()
    low, high = (np.array([r[c] for r in ends] or [0] * dims, np.int64) for c in ("low", "high"))
    placed = kept.mapInArrow(_placed(low, high, dims), "key long, row long, x array<long>, place binary")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = placed.withColumn("salt", F.xxhash64("row")).repartitionByRange(parts, "place", "salt").sortWithinPartitions("place", "salt")
    return stage(ordered.select("key", "x").mapInArrow(_blocked(dims), "keys array<long>, low array<long>, high array<long>, x binary"), "zones")


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The centroids that may be nearest to a vector of the box, in ascending order.

    d(x, b) - d(x, a) is the sum over dimensions of 2 x (a - b) + b^2 - a^2: its greatest value over the box
    takes the upper end where a > b. Where that is negative b is nearer than a all over the box; where it is
    zero b is never farther, which decides for a smaller number."""
    step = 2 * (centroids[:, None] - centroids[None])  # a, b, dimension
    size = (centroids ** 2).sum(axis=1)
    most = np.maximum(step, 0) @ high + np.minimum(step, 0) @ low + size[None] - size[:, None]
    number = np.arange(len(centroids))
    beaten = (most < 0) | ((most == 0) & (number[None] < number[:, None]))
    return np.nonzero(~beaten.any(axis=1))[0]


def nearest(x: np.ndarray, low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the nearest centroid and its squared distance, for each vector of a block."""
    at = candidates(low, high, centroids)
    gap = np.stack([((x - centroids[c]) ** 2).sum(axis=1) for c in at])
    best = gap.argmin(axis=0)  # the first of equal ones, so the smaller number
    return at[best], gap[best, np.arange(len(x))]


def _scan(centroids: np.ndarray, sums: bool):
    k, dims = centroids.shape

    def blocks(batch: pa.RecordBatch):
        for keys, low, high, x in zip(*[c.to_pylist() for c in batch.columns]):
            x = np.frombuffer(x, "<i4").reshape(-1, dims).astype(np.int64)
            yield keys, x, *nearest(x, np.array(low), np.array(high), centroids)

    def totals(batches: Batches) -> Batches:
        total, count = np.zeros((k, dims), object), np.zeros(k, np.int64)  # Python integers
        for batch in batches:
            for _, x, cluster, _ in blocks(batch):
                for c in np.unique(cluster):
                    total[c] += x[cluster == c].sum(axis=0)
                count += np.bincount(cluster, minlength=k)
        at = np.nonzero(count)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(count[at]), pa.array([[str(v) for v in total[c]] for c in at], pa.list_(pa.string()))], names=["cluster", "n", "total"])

    def members(batches: Batches) -> Batches:
        for batch in batches:
            for keys, _, cluster, gap in blocks(batch):
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(cluster, pa.int32()), pa.array(gap)], names=["key", "cluster", "distance"])

    return totals if sums else members


def moved(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: each centroid that is nearest to any vector becomes the floor of their mean. Each task
    sends one row of sums for each centroid."""
    parts = blocks.mapInArrow(_scan(centroids, True), "cluster int, n long, total array<string>")
    sums = (parts.select("cluster", "n", F.posexplode("total")).groupBy("cluster", "pos")
            .agg(F.sum("n").alias("n"), F.sum(F.col("col").cast("decimal(38,0)")).alias("s")).collect())
    out = centroids.copy()
    for r in sums:
        out[r["cluster"], r["pos"]] = int(r["s"]) // r["n"]
    return out


def cluster(table: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``key, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of each vector.

    The first centroids are the k vectors with the smallest sha256 of ``1:<key>`` (of equal keys, the
    smaller vector; a null key comes last); fewer vectors mean fewer centroids. Only vectors of exactly 64
    components, none null or non-finite, take part; their components are held within 2^20. Repeated rows
    count each time. The centroids, k rows, travel through the driver; vectors never do."""
    spark = table.sparkSession
    source = table.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{embedding}`").alias("e"))
    rows = source.where(usable(F.col("e")) & (F.size("e") == DIMS)).select("key", quantised(F.col("e")).alias("x"))
    mark = F.sha2(F.concat(F.lit("1:"), F.col("key").cast("string")), 256)
    first = rows.orderBy(mark.asc_nulls_last(), "x").limit(k).collect()
    centroids = np.array([r["x"] for r in first], np.int64).reshape(-1, DIMS)
    if not len(centroids):
        return source.where("false").selectExpr(f"key as `{key}`", "0 as cluster", "0L as distance", "0L as cluster_inertia", "0L as inertia", "'' as centroid_sha256")
    blocks = zones(rows)
    for _ in range(rounds):
        centroids = moved(blocks, centroids)
    found = stage(blocks.mapInArrow(_scan(centroids, False), "key long, cluster int, distance long"), "clusters")
    texts = spark.createDataFrame([(i, ",".join(map(str, c))) for i, c in enumerate(centroids.tolist())], "cluster int, text string")
    inertia = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    inertia = inertia.join(texts, "cluster").selectExpr("cluster", "cluster_inertia", "sum(cluster_inertia) over () as inertia", "sha2(text, 256) as centroid_sha256")
    return found.join(F.broadcast(inertia), "cluster").select(F.col("key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int, rounds: int) -> str:
    gap = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    out = f"""
with v as (
  select row_number() over () r, vec_id, list_transform(embedding, lambda c: cast(floor({SCALE} * cast(c as double)) as bigint)) x
  from embeddings
  where embedding is not null and len(embedding) = {DIMS} and len(list_filter(embedding, lambda c: c is null or isnan(c) or isinf(c))) = 0),
c0 as (select row_number() over (order by sha256('1:' || vec_id), x) - 1 i, x from v order by i limit {k})"""
    for t in range(rounds + 1):
        out += f""",
g{t} as (select v.r, v.vec_id, v.x, c.i, cast({gap} as bigint) d from v, c{t} c),
a{t} as (select r, vec_id, x, i, d from (select *, row_number() over (partition by r order by d, i) n from g{t}) where n = 1)"""
        if t < rounds:
            out += f""",
e{t} as (select i, unnest(x) u, generate_subscripts(x, 1) p from a{t}),
m{t} as (select i, p, cast((sum(u) - ((sum(u) % count(*)) + count(*)) % count(*)) / count(*) as bigint) u from e{t} group by i, p),
n{t} as (select i, list(u order by p) x from m{t} group by i),
c{t + 1} as (select c.i, coalesce(n.x, c.x) x from c{t} c left join n{t} n on c.i = n.i)"""
    return out + f"""
select a.vec_id, cast(a.i as int) as cluster, a.d as distance, cast(sum(a.d) over (partition by a.i) as bigint) as cluster_inertia,
  cast(sum(a.d) over () as bigint) as inertia, sha256(array_to_string(c.x, ',')) as centroid_sha256
from a{rounds} a join c{rounds} c on a.i = c.i
"""


SQL = _sql(CENTROIDS, ROUNDS)
