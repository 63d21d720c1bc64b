"""Exact top-k inner products with an impact-ordered index, score at a time.

Vectors are integers (floor of 256 times each component). The index keeps, per block of vectors, posting
segments of descending quantised impact: the segment of impact 2^b holds the (dimension, vector, sign)
postings whose magnitude has bit b, as packed bits. A query adds segments to its accumulators from the
highest impact down. After each one the rest can change a score by at most (2^b - 1) times the sum of the
query's magnitudes; a vector whose accumulator is farther than twice that below the k-th cannot be among the
best. Once that proves all but a few vectors out, the query stops and the possible members are scored exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.session import stage

K = 5
BLOCK, QUERIES = 8192, 512  # vectors of an index block, queries of a query block
SPAN, PARTS = 32, 128  # most index blocks and query blocks (of 64 dimensions) that meet in one cell of the grid
CELLS = 32  # least cells, where there are as many pairs of blocks
FEW = 32  # stop once at most one vector in so many is a possible member


def quantised(embedding: Column) -> Column:
    """floor(256 x) of each component; null for a vector that is null, empty of meaning or not finite."""
    good = F.forall(embedding, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.when(good, F.transform(embedding, lambda x: F.floor(x.cast("double") * 256.0).cast("long")))


def vectors(table: DataFrame, key: str, embedding: str) -> DataFrame:
    """``(key, x)``, one row per different key and vector; vectors that take no part are left out."""
    return (table.select(F.col(f"`{key}`").alias("key"), quantised(F.col(f"`{embedding}`")).alias("x"))
            .where("key is not null and x is not null"))


def matrix(rows: list[list[int]], dims: int) -> np.ndarray:
    out = np.zeros((len(rows), dims), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _index(dims: int):
    def build(group: pa.Table) -> pa.Table:
        """One index block; a repeated row counts once."""
        ids = np.array(group.column("key").to_pylist(), np.int64)
        x = matrix(group.column("x").to_pylist(), dims)
        both = np.unique(np.column_stack((ids, x)), axis=0)
        ids, x = both[:, 0], both[:, 1:]
        size = np.abs(x)
        top = int(size.max(initial=0)).bit_length()
        segments = [np.packbits((size >> b) & 1).tobytes() for b in range(top - 1, -1, -1)]
        return pa.table({"block": group.column("block")[:1], "ids": pa.array([ids.tobytes()]), "signs": pa.array([np.packbits(x < 0).tobytes()]), "segments": pa.array([segments], pa.list_(pa.binary()))})

    return build


def _pack(dims: int):
    def build(group: pa.Table) -> pa.Table:
        """One query block, its components in as few bytes as the widest needs."""
        q = matrix(group.column("x").to_pylist(), dims)
        kind = next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= q.min(initial=0) and q.max(initial=0) <= np.iinfo(t).max)
        return pa.table({"part": group.column("part")[:1], "q_ids": pa.array([np.array(group.column("key").to_pylist(), np.int64).tobytes()]), "q": pa.array([q.astype(kind).tobytes()])})

    return build


def best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, signs: np.ndarray, segments: list[np.ndarray], k: int):
    """For each query the k best of a block as ``(query, id, score)`` arrays, ties to smaller ids.
    segments: magnitude bits from the highest impact 2^(n-1) to 1."""
    n = len(ids)
    sign = np.where(signs, -1, 1)
    weight = np.abs(q).sum(axis=1).astype(float)
    high = float(weight.max(initial=0)) * float(1 << len(segments))
    kind = np.float32 if high < 1 << 24 else np.float64
    # sums beyond the type's whole numbers are rounded: what that can amount to is left as a margin
    slack = 0.0 if high < 1 << 53 else weight * float(1 << len(segments)) * (len(segments) + q.shape[1]) * 2.0 ** -50
    acc = np.where(ids[None] == q_ids[:, None], kind(-np.inf), kind(0))  # rows of the query's own key can't win
    going, query = np.arange(len(q)), q.astype(kind)
    members: dict[int, np.ndarray] = {}
    kth = min(k, n)
    for i, segment in enumerate(segments):
        impact = 1 << (len(segments) - 1 - i)
        acc[going] += query[going] @ (segment * sign).astype(kind).T * kind(impact)
        rest = (weight * (impact - 1) + slack)[going]
        bar = np.partition(acc[going], n - kth, axis=1)[:, n - kth] - 2.0 * rest
        possible = acc[going] >= bar[:, None]
        done = possible.sum(axis=1) * FEW <= n
        for j in np.nonzero(done | (impact == 1))[0]:
            members[int(going[j])] = np.nonzero(possible[j])[0]
        going = going[~done]
        if not len(going):
            break

    def rows(at: np.ndarray) -> np.ndarray:
        """The vectors of the possible members, put together from all segments."""
        x = np.zeros((len(at), q.shape[1]), np.int64)
        for segment in segments:
            x = (x << 1) + segment[at]
        return x * sign[at]

    out = []
    for j in range(len(q)):
        at = members.get(j, np.arange(n))
        at = at[ids[at] != q_ids[j]]
        if not len(at):
            continue
        score = rows(at) @ q[j]
        top = np.lexsort((ids[at], -score))[:k]
        out.append((np.full(len(top), q_ids[j]), ids[at][top], score[top]))
    return [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3


def leading(found: list[np.ndarray], k: int) -> list[np.ndarray]:
    """The k best of each query in ``(query, id, score)`` arrays, ties to smaller ids."""
    order = np.lexsort((found[1], -found[2], found[0]))
    query, ids, score = (c[order] for c in found)
    new = np.concatenate((np.ones(len(query[:1]), bool), query[1:] != query[:-1]))
    first = np.nonzero(new)[0]
    near = np.arange(len(query)) - first[np.cumsum(new) - 1] < k
    return [query[near], ids[near], score[near]]


def _search(dims: int, k: int):
    def run(asked: pa.Table, index: pa.Table) -> pa.Table:
        """One cell of the grid: each of its query blocks against each of its index blocks, k rows a query."""
        held: list[list[np.ndarray] | None] = [None] * len(asked)
        for i in range(len(index)):
            row = index.slice(i, 1).to_pylist()[0]
            ids = np.frombuffer(row["ids"], np.int64)
            bits = lambda b: np.unpackbits(np.frombuffer(b, np.uint8), count=len(ids) * dims).reshape(len(ids), dims)  # noqa: B023
            signs, segments = bits(row["signs"]), [bits(s) for s in row["segments"]]
            for j in range(len(asked)):
                q_ids, packed = (np.frombuffer(asked.column(c)[j].as_py(), np.int64 if c == "q_ids" else np.uint8) for c in ("q_ids", "q"))
                q = packed.view(f"i{len(packed) // (len(q_ids) * dims)}").reshape(len(q_ids), dims).astype(np.int64)
                found = best(q_ids, q, ids, signs, segments, k)
                held[j] = found if held[j] is None else leading([np.concatenate(c) for c in zip(held[j], found)], k)
        found = [np.concatenate(c) for c in zip(*[h for h in held if h is not None])] or [np.zeros(0, np.int64)] * 3
        return pa.table([pa.array(c, pa.int64()) for c in found], names=["query_id", "vec_id", "score"])

    return run


def search(table: DataFrame, queries: DataFrame, k: int = K, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k highest integer inner products with all vectors but
    its own, ties to the smaller key; all, if there are fewer. Every row that carries the query's key is taken
    for its own; a key that occurs on several vectors asks with each of them, and their hits are ranked
    together.

    Vectors that are null or hold null or non-finite components take no part; missing components count as
    zero; repeated rows count once. Scores wrap beyond 64 bits. Query blocks meet index blocks in a grid whose
    cells hold a bounded number of either; both are copied to their cells by a shuffle, queries in few bytes and
    nothing by the driver. A cell gives k rows per query, of which a window keeps the best."""
    rows = stage(vectors(table, key, embedding), "top-vectors")
    asked = stage(vectors(queries, key, embedding).distinct(), "top-queries")
    n, dims = rows.agg(F.count("*"), F.max(F.size("x"))).first()
    n_q, q_dims = asked.agg(F.count("*"), F.max(F.size("x"))).first()
    dims, blocks, parts = max(dims or 0, q_dims or 0, 1), -(-max(n, 1) // BLOCK), -(-max(n_q, 1) // QUERIES)
    index = rows.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")).groupBy("block").applyInArrow(
        _index(dims), "block int, ids binary, signs binary, segments array<binary>")
    packed = asked.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int")).groupBy("part").applyInArrow(
        _pack(dims), "part int, q_ids binary, q binary")
    room = lambda most: max(1, most * 64 // max(dims, 64))
    down = max(-(-blocks // room(SPAN)), min(blocks, CELLS))
    across = max(-(-parts // room(PARTS)), min(parts, -(-CELLS // down)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = packed.withColumn("row", every(down)).withColumn("cell", F.col("row") * across + F.pmod("part", F.lit(across)))
    right = index.withColumn("column", every(across)).withColumn("cell", F.pmod("block", F.lit(down)) * across + F.col("column"))
    left, right = (side.repartition(down * across, "cell") for side in (left, right))
    found = left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(_search(dims, k), "query_id long, vec_id long, score long")
    return found.selectExpr("query_id", "row_number() over (partition by query_id order by score desc, vec_id) as rank", "vec_id", "score").where(F.col("rank") <= k)


SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) x
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (
  select q.vec_id query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) as bigint) score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) rank from s)
select query_id, cast(rank as int) as rank, vec_id, score from r where rank <= 5
"""
