"""Approximate nearest neighbours: a graph by NN-descent, queries by greedy search in it.

Equal vectors are one node, which keeps the smallest keys of its copies. Nodes get a place on the unit sphere
in one dimension more, so that the largest inner product is the smallest distance: vectors are divided by
the greatest norm M and extended to length one.

A first graph comes from several partitions of the nodes by their nearest pivot, each block compared with
itself. NN-descent then improves it: a node's neighbours, and a few of the nodes that have it as
neighbour, are joined to it with their places; what lies two steps apart there is compared, and pairs that beat
the worst neighbour of one side are offered to it. It ends when few neighbours change. A hub is in many lists,
but joins back only ``REVERSE`` of them in a round, other ones each time.

Queries walk the graph together, one join a round: each sends the best nodes it has not opened yet to those
nodes' lists, which answer with the members that are better than what it holds. It ends when the best ``OPEN``
nodes of every query are open. The best ``OPEN`` are then scored exactly on the original vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import Batches
from palimpsest.llm.whitening import usable
from palimpsest.session import scratch, stage

K = 20
DEGREE, REVERSE = 48, 24  # neighbours of a node; lists that a node joins back in a round
BLOCK, TABLES = 2048, 4  # nodes that are compared with each other at first, in so many partitions
PIVOTS = 4096  # most pivots of a level: a bounded sample, which alone decides the blocks
ROUNDS, SETTLED = 8, 0.05  # NN-descent ends when less than this share of the neighbours is new
OPEN, STEP = 96, 32  # nodes that a query opens at least, and at a time

EDGES = "v long, u long, sim float"


def nodes_of(table: DataFrame, key: str, embedding: str, copies: int) -> DataFrame:
    """``node, x, keys``: the different vectors, each with the smallest keys of its copies (in order)."""
    rows = table.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{embedding}`").cast("array<double>").alias("x"))
    rows = rows.where(usable(F.col("x"))).where(F.exists("x", lambda c: c != 0)).where("key is not null").withColumn("h", F.xxhash64("x"))
    rank = F.row_number().over(Window.partitionBy("h", "x").orderBy("key"))
    least = rows.withColumn("rank", rank).where(F.col("rank") <= copies)  # cut before the shuffle: copies may be many
    grouped = least.groupBy("h", "x").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    return grouped.select(F.monotonically_increasing_id().alias("node"), "h", "x", "keys")


def norm(x: str) -> Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, c: a + c * c))


def _rows(column: pa.Array, kind) -> np.ndarray:
    """Packed vectors of one length as a matrix."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1)


def _lists(column: pa.Array) -> np.ndarray:
    values = column.to_pylist()
    return np.array(values, np.float64).reshape(len(values), -1)


def _packed(matrix: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in matrix], pa.binary())


def runs(batches: Batches, *on: str) -> Batches:
    """The batches of a sorted stream, cut so that no run of equal values of ``on`` is split."""
    held = None
    for batch in batches:
        held = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        same = np.ones(held.num_rows, bool)
        for c in on:
            values = held.column(c).to_numpy(zero_copy_only=False)
            same &= values == values[-1]
        cut = int(np.nonzero(~same)[0][-1]) + 1 if not same.all() else 0
        if cut:
            yield held.slice(0, cut)
            held = held.slice(cut)
    if held is not None and held.num_rows:
        yield held


def borders(batch: pa.RecordBatch, *on: str) -> list[tuple[int, int]]:
    change = np.zeros(batch.num_rows, bool)
    for c in on:
        values = batch.column(c).to_numpy(zero_copy_only=False)
        change[1:] |= values[1:] != values[:-1]
    starts = [0, *np.nonzero(change)[0].tolist()]
    return list(zip(starts, [*starts[1:], batch.num_rows]))


def _edges(parts: list) -> Batches:
    if parts:
        v, u, sim = (np.concatenate(c) for c in zip(*parts))
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), pa.array(u, pa.int64()), pa.array(sim.astype(np.float32))], names=["v", "u", "sim"])


# places and blocks

def _place(most: float):
    def run(batches: Batches) -> Batches:
        for batch in batches:
            x = _lists(batch.column("x")) / most
            last = np.sqrt(np.maximum(1 - (x * x).sum(axis=1, keepdims=True), 0))
            yield pa.RecordBatch.from_arrays([batch.column("node"), _packed(np.hstack((x, last)).astype("<f2"))], names=["node", "place"])

    return run


def _blocks(levels: list[list[np.ndarray]]):
    """The nearest pivot of each level, as one number, for each table."""
    def run(batches: Batches) -> Batches:
        for batch in batches:
            x = _rows(batch.column("place"), "<f2").astype(np.float32)
            for t, level in enumerate(levels):
                at = np.zeros(len(x), np.int64)
                for pivots in level:
                    at = at * PIVOTS + (x @ pivots.T).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t), pa.int32()), pa.array(at), batch.column("node"), batch.column("place")], names=["part", "block", "node", "place"])

    return run


def _compare(batches: Batches) -> Batches:
    """The nearest members of its block for each member."""
    for batch in runs(batches, "part", "block", "chunk"):
        for a, b in borders(batch, "part", "block", "chunk"):
            ids = batch.column("node").slice(a, b - a).to_numpy()
            x = _rows(batch.column("place").slice(a, b - a), "<f2").astype(np.float32)
            k = min(DEGREE, len(x) - 1)
            for i in range(0, len(x), 512) if k else ():
                sim = x[i:i + 512] @ x.T
                sim[np.arange(len(sim)), np.arange(i, i + len(sim))] = -np.inf
                best = np.argpartition(-sim, k - 1, axis=1)[:, :k]
                yield from _edges([(np.repeat(ids[i:i + 512], k), ids[best.ravel()], np.take_along_axis(sim, best, 1).ravel())])


def pivots_of(places: DataFrame, n: int) -> list[list[np.ndarray]]:
    """For each table the pivots of one level, or of two where a level would need more than ``PIVOTS``."""
    blocks = max(1, n // BLOCK)
    sizes = [blocks] if blocks <= PIVOTS else [min(PIVOTS, int(np.ceil(np.sqrt(blocks))))] * 2
    found = places.orderBy(F.xxhash64("node", F.lit(1)), "node").limit(min(n, sum(sizes) * TABLES)).collect()
    x = np.stack([np.frombuffer(r["place"], "<f2") for r in found]).astype(np.float32)
    rows = np.array_split(np.arange(sum(sizes) * TABLES) % len(x), TABLES)
    return [[x[part] for part in np.split(r, np.cumsum(sizes)[:-1])] for r in rows]


def first_graph(places: DataFrame, n: int) -> DataFrame:
    levels = pivots_of(places, n)
    blocks = stage(places.mapInArrow(_blocks(levels), "part int, block long, node long, place binary"), "ann-blocks")
    sizes = blocks.groupBy("part", "block").agg(F.count("*").alias("size"))
    chunk = F.pmod(F.xxhash64("node", "part"), F.ceil(F.col("size") / F.lit(float(BLOCK)))).cast("int")  # a large block is cut
    dealt = blocks.join(sizes, ["part", "block"]).withColumn("chunk", chunk).select("part", "block", "chunk", "node", "place")
    parts = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = dealt.repartition(parts, "part", "block", "chunk").sortWithinPartitions("part", "block", "chunk")
    return best_edges(ordered.mapInArrow(_compare, EDGES).withColumn("new", F.lit(1)))


# NN-descent

def best_edges(edges: DataFrame) -> DataFrame:
    """The ``DEGREE`` best different neighbours of each node. The rank is cut before the shuffle; a pair that
    comes more than once has one rank."""
    rank = F.dense_rank().over(Window.partitionBy("v").orderBy(F.desc("sim"), "u"))
    merged = edges.withColumn("sim", F.round("sim", 6)).withColumn("rank", rank).where(F.col("rank") <= DEGREE)
    return merged.groupBy("v", "u").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))


def around(graph: DataFrame, seed: int) -> DataFrame:
    """``v, u``: the neighbours of each node and some of the nodes that have it as neighbour."""
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.xxhash64("v", F.lit(seed)), "v"))
    back = graph.select("u", "v").withColumn("rank", rank).where(F.col("rank") <= REVERSE).select(F.col("u").alias("v"), F.col("v").alias("u"))
    return graph.select("v", "u").unionByName(back).distinct()


def _local_join(batches: Batches) -> Batches:
    for batch in runs(batches, "v"):
        ids, bar = batch.column("u").to_numpy(), batch.column("bar").to_numpy()
        x, out = _rows(batch.column("place"), "<f2").astype(np.float32), []
        for a, b in borders(batch, "v"):
            sim = x[a:b] @ x[a:b].T
            np.fill_diagonal(sim, -np.inf)
            i, j = np.nonzero(sim > bar[a:b, None])
            out.append((ids[a:b][i], ids[a:b][j], sim[i, j]))
        yield from _edges(out)


def descend(graph: DataFrame, places: DataFrame, seed: int) -> DataFrame:
    """One round: neighbours of neighbours, over a common node, become neighbours where they are nearer."""
    bar = graph.groupBy("v").agg(F.count("*").alias("n"), F.min("sim").alias("least"))
    bar = bar.select(F.col("v").alias("node"), F.when(F.col("n") >= DEGREE, F.col("least")).otherwise(F.lit(-2.0)).cast("float").alias("bar"))
    sides = places.join(bar, "node").withColumnRenamed("node", "u")
    parts = int(graph.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    gathered = around(graph, seed).join(sides, "u").select("v", "u", "place", "bar").repartition(parts, "v").sortWithinPartitions("v")
    offers = gathered.mapInArrow(_local_join, EDGES)
    return best_edges(graph.withColumn("new", F.lit(0)).unionByName(offers.withColumn("new", F.lit(1))))


def build(places: DataFrame, n: int) -> DataFrame:
    """``v, u, sim``: the neighbour graph, staged. Each round is written, which cuts the lineage."""
    graph = stage(first_graph(places, n), "ann-graph")
    for seed in range(ROUNDS):
        graph = stage(descend(graph.drop("new"), places, seed), "ann-graph")
        new, edges = graph.agg(F.sum("new"), F.count("*")).first()
        if (new or 0) <= SETTLED * edges:
            break
    return graph.drop("new")


# greedy search

def _as_lists(batches: Batches) -> Batches:
    for batch in runs(batches, "v"):
        cut = borders(batch, "v")
        v, u, places = batch.column("v").to_numpy(), batch.column("u").to_numpy(), batch.column("place").to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([v[a] for a, _ in cut], pa.int64()), pa.array([u[a:b].tobytes() for a, b in cut], pa.binary()), pa.array([b"".join(places[a:b]) for a, b in cut], pa.binary())], names=["node", "ids", "places"])


def lists(graph: DataFrame, places: DataFrame) -> DataFrame:
    """``node, ids, places``: each node's surroundings, and itself, packed; dealt out by node."""
    parts = int(graph.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = around(graph, ROUNDS).unionByName(places.select(F.col("node").alias("v"), F.col("node").alias("u")))
    gathered = pairs.join(places.withColumnRenamed("node", "u"), "u").select("v", "u", "place")
    return gathered.repartition(parts, "v").sortWithinPartitions("v").mapInArrow(_as_lists, "node long, ids binary, places binary")


def _answer(batches: Batches) -> Batches:
    """The members of an opened node's list that are better than what the query holds."""
    for batch in batches:
        out = []
        for q, bar, ids, places in zip(*[batch.column(c).to_pylist() for c in ("x", "bar", "ids", "places")]):
            ids, q = np.frombuffer(ids, np.int64), np.frombuffer(q, "<f4")
            sim = np.frombuffer(places, "<f2").reshape(len(ids), -1)[:, :-1].astype(np.float32) @ q
            good = sim > bar
            out.append((ids[good].tobytes(), sim[good].astype("<f4").tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column("qid"), pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.binary())], names=["qid", "ids", "sims"])


def _take(batches: Batches) -> Batches:
    """Merge the answers into what a query holds: the best ``OPEN`` nodes, which of them are open, and those to
    open next."""
    for batch in batches:
        out = []
        for held, sims, opened, found in zip(*[batch.column(c).to_pylist() for c in ("held", "sims", "opened", "found")]):
            ids = np.concatenate([np.frombuffer(held, np.int64), *[np.frombuffer(f["ids"], np.int64) for f in found or ()]])
            sim = np.concatenate([np.frombuffer(sims, "<f4"), *[np.frombuffer(f["sims"], "<f4") for f in found or ()]])
            done = np.zeros(len(ids), bool)
            done[:len(opened)] = np.frombuffer(opened, bool)
            order = np.lexsort((ids, ~done, -sim))  # of equal ids the open one, which was there first
            ids, sim, done = ids[order], sim[order], done[order]
            first = np.sort(np.unique(ids, return_index=True)[1])[:OPEN]
            ids, sim, done = ids[first], sim[first], done[first].copy()
            todo = np.nonzero(~done)[0][:STEP]
            done[todo] = True
            out.append((ids.tobytes(), sim.tobytes(), done.tobytes(), ids[todo].tolist(), float(sim[-1]) if len(ids) == OPEN else -np.inf))
        columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.float32()))]
        yield pa.RecordBatch.from_arrays([batch.column("qid"), batch.column("x"), *columns], names=["qid", "x", "held", "sims", "opened", "todo", "bar"])


STATE = "qid long, x binary, held binary, sims binary, opened binary, todo array<long>, bar float"


def _start(most: float, entries: np.ndarray, ids: np.ndarray):
    """A query begins at its own node, where it is one, and at the entries nearest to it."""
    def run(batches: Batches) -> Batches:
        for batch in batches:
            x = (_lists(batch.column("x")) / most).astype(np.float32)
            sim = x @ entries.T
            best = np.argsort(-sim, axis=1)[:, :8]
            todo = [[*([own] if own is not None else []), *ids[b].tolist()] for own, b in zip(batch.column("own").to_pylist(), best)]
            empty = pa.array([b""] * len(x), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("qid"), _packed(x.astype("<f4")), empty, empty, empty, pa.array([list(dict.fromkeys(t)) for t in todo], pa.list_(pa.int64())), pa.array(np.full(len(x), -np.inf, np.float32))], names=["qid", "x", "held", "sims", "opened", "todo", "bar"])

    return run


def walk(state: DataFrame, index: DataFrame) -> DataFrame:
    """Rounds of the search until no query has a node to open; ``qid, held`` at the end."""
    state = stage(state, "ann-walk")
    while state.where(F.size("todo") > 0).limit(1).count():
        asked = state.select("qid", "x", "bar", F.explode("todo").alias("node"))
        answers = asked.join(index, "node").mapInArrow(_answer, "qid long, ids binary, sims binary")
        found = answers.groupBy("qid").agg(F.collect_list(F.struct("ids", "sims")).alias("found"))  # at most STEP of them
        merged = state.join(found, "qid", "left").select("qid", "x", "held", "sims", "opened", "found")
        state = stage(merged.mapInArrow(_take, STATE), "ann-walk")
    return state.select("qid", "held")


def _unpack(batches: Batches) -> Batches:
    for batch in batches:
        held = [np.frombuffer(h, np.int64) for h in batch.column("held").to_pylist()]
        ids = np.concatenate(held) if held else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("qid").to_numpy(), [len(h) for h in held])), pa.array(ids)], names=["qid", "node"])


def search(table: DataFrame, queries: DataFrame, k: int = K, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k rows with the largest inner products that the search finds for each row of
    ``queries``, nearest first, ties to the smaller key; scores are exact.

    A query's own row (the same key and vector, once) is no candidate. Vectors that are null, zero or hold
    null or non-finite components take no part, nor do null keys; repeated rows are candidates, and queries,
    each time. All vectors must have one length: those of another than the longest are left out."""
    with scratch(table.sparkSession):
        return _search(table, queries, k, key, embedding)


def _search(table: DataFrame, queries: DataFrame, k: int, key: str, embedding: str) -> DataFrame:
    dims = table.where(usable(F.col(f"`{embedding}`"))).agg(F.max(F.size(f"`{embedding}`"))).first()[0] or 0
    nodes = stage(nodes_of(table.where(F.size(f"`{embedding}`") == dims), key, embedding, k + 1), "ann-nodes")
    n, most = nodes.agg(F.count("*"), F.max(norm("x"))).first()
    asked = queries.select(F.col(f"`{key}`").cast("long").alias("query_id"), F.col(f"`{embedding}`").cast("array<double>").alias("x"))
    asked = asked.where(usable(F.col("x")) & (F.size("x") == dims)).where(F.exists("x", lambda c: c != 0)).where("query_id is not null")
    asked = stage(asked.select(F.monotonically_increasing_id().alias("qid"), "query_id", "x", F.xxhash64("x").alias("h")), "ann-queries")
    if not n:
        return stage(asked.where("false").selectExpr("query_id", "0 as rank", "0L as vec_id", "0d as score"), "ann-found", keep=True)
    places = stage(nodes.mapInArrow(_place(most), "node long, place binary"), "ann-places")
    index = lists(build(places, n), places).persist(StorageLevel.DISK_ONLY)  # dealt out once, asked in every round
    entries = places.orderBy(F.xxhash64("node", F.lit(2)), "node").limit(min(n, PIVOTS)).collect()
    own = asked.join(nodes.select("h", F.col("x").alias("same"), F.col("node").alias("own")), "h", "left").where("own is null or same = x")
    own = asked.join(own.select("qid", "own"), "qid", "left").select("qid", "x", "own")
    at = np.stack([np.frombuffer(e["place"], "<f2") for e in entries]).astype(np.float32)[:, :-1]
    held = walk(own.mapInArrow(_start(most, at, np.array([e["node"] for e in entries])), STATE), index).mapInArrow(_unpack, "qid long, node long")

    product = F.aggregate(F.zip_with("q", "x", lambda a, b: a * b), F.lit(0.0), lambda a, c: a + c)
    scored = held.join(nodes.select("node", "x", "keys"), "node").join(asked.select("qid", "query_id", F.col("x").alias("q")), "qid")
    at_own = F.when(F.col("q") == F.col("x"), F.array_position("keys", F.col("query_id"))).otherwise(0)
    others = F.filter("keys", lambda c, i: i + 1 != at_own)
    hits = scored.select("qid", "query_id", product.alias("score"), F.explode(others).alias("vec_id"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))
    found = stage(hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "ann-found", keep=True)
    index.unpersist()
    return found
