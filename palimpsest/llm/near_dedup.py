"""Near duplicates: SimHash links, completed by an exact join of sets of word shingles.

Documents whose fingerprints are within a few bits are linked by the operator of ``simhash``, if their sets of
shingles are as similar as asked: texts that share most words but not most runs may have near fingerprints.
SimHash misses many pairs that share 0.8 or more of their shingles, so these are then found by prefix
filtering: the shingles of a set are ordered from rare to common, and two sets of similarity s must share one of the first
``n - ceil(s n) + 1``. Shared boilerplate is common, so it stands behind the prefix and is no join key. Each
such pair is bounded by lengths, positions and parity bits and counted on the whole sets.

How common a shingle is comes from a table of counters (its size is fixed) over all documents. Counters may
be too high where shingles share one; the order is the same for all sets, so the join stays exact.

Texts with equal sets are one node. Only nodes of different classes are compared. Members of a shingle's run
are first compared with a few others, in rounds of another order each, and what is alike becomes one class,
so a large group of near copies takes few pairs per member; what is then left in a run is compared in full.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm import simhash
from palimpsest.llm.common import Batches, as_bytes, column_values, slices, union_all, with_columns
from palimpsest.llm.components import components
from palimpsest.session import scratch, stage

WORDS, LEAST, SEED = 5, 0.8, 42
NEIGHBOURS, ROUNDS = 3, 8
SETTLED = 20  # rounds end when less than one link in so many is new
PARITY = 16  # words of 64 bits in a set's parity bits
CELLS, CHUNKS, TOGETHER = 21, 32, 32  # counters (bits), pieces they travel in, pieces added by a task


def shingles(text: bytes | None, n: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a whole text's runs of ``n`` words; a shorter text is one run."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    flat, n = b" ".join(words), min(n, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - n + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(flat[i:j], SEED) for i, j in zip(starts, ends[n - 1:].tolist())], np.uint64))


def node_of(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED)


def _signed(x) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


def _cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - CELLS)).astype(np.int64)


def _sketched(source: DataFrame, words: int) -> DataFrame:
    """``node`` (hash of the set), ``n`` (its size) and ``fp`` (fingerprint) in place of the text; and from
    each task its counters, in rows of their own with ``chunk``. No shuffle."""
    kept = [f for f in source.schema.fields if f.name != "text"]
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in kept], *[T.StructField(c, T.LongType()) for c in ("node", "n", "fp")], T.StructField("part", T.IntegerType()), T.StructField("chunk", T.IntegerType()), T.StructField("counts", T.BinaryType())])

    def run(batches: Batches) -> Batches:
        total, types = np.zeros(1 << CELLS, np.uint32), None
        none = lambda n, kind: pa.nulls(n, kind)
        for batch in slices(batches, 500):
            texts = column_values(batch, "text")
            sets = [shingles(t, words) for t in texts]
            for s in sets:
                np.add.at(total, _cells(s), 1)
            types = [batch.schema.field(f.name).type for f in kept]
            yield with_columns(batch, ("text",), node=pa.array(_signed([node_of(s) for s in sets])), n=pa.array([len(s) for s in sets], pa.int64()),
                               fp=pa.array(_signed([simhash.fingerprint(t, words) for t in texts])), part=none(len(sets), pa.int32()), chunk=none(len(sets), pa.int32()), counts=none(len(sets), pa.binary()))
        if types:
            pieces = [p.tobytes() for p in np.minimum(total, 255).astype(np.uint8).reshape(CHUNKS, -1)]
            columns = [none(CHUNKS, t) for t in types] + [none(CHUNKS, pa.int64())] * 3
            columns += [pa.array(np.full(CHUNKS, TaskContext.get().partitionId()), pa.int32()), pa.array(range(CHUNKS), pa.int32()), pa.array(pieces, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return source.mapInArrow(run, schema)


def _counts(piece: bytes) -> np.ndarray:
    """A task's own piece has a byte for each counter, a sum of several has four."""
    return np.frombuffer(piece, np.uint8 if len(piece) == (1 << CELLS) // CHUNKS else np.uint32).astype(np.uint32)


def _added(group: pa.Table) -> pa.Table:
    total = sum(_counts(c) for c in group.column("counts").to_pylist())
    return pa.table({"part": group.column("to")[:1], "chunk": group.column("chunk")[:1], "counts": pa.array([total.tobytes()])})


def counters(pieces: DataFrame) -> np.ndarray:
    """The sum of the tasks' counters, a few at a time; what comes to the driver has a fixed size (8 MB)."""
    last = pieces.agg(F.max("part")).first()[0]
    while last:
        pieces = stage(pieces.withColumn("to", F.floor(F.col("part") / TOGETHER).cast("int")).groupBy("chunk", "to").applyInArrow(_added, "part int, chunk int, counts binary"), "near-counts")
        last //= TOGETHER
    found = {r["chunk"]: _counts(r["counts"]) for r in pieces.select("chunk", "counts").collect()}
    return np.concatenate([found[i] for i in range(CHUNKS)]) if found else np.zeros(1 << CELLS, np.uint32)


def _prefixes(texts: DataFrame, counts: np.ndarray, least: float, words: int) -> DataFrame:
    """``token, at, node, n``: the rare first shingles of each set with their places. A shingle whose counter is
    one occurs nowhere else and is left out."""
    held = texts.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Batches) -> Batches:
        counts = held.value
        for batch in slices(batches, 200):
            out = []
            for text in column_values(batch, "text"):
                hashes = shingles(text, words)
                node, n, common = int(_signed([node_of(hashes)])[0]), len(hashes), counts[_cells(hashes)]
                order = np.lexsort((hashes, common))[:n - int(np.ceil(least * n - 1e-9)) + 1]
                order, at = order[common[order] > 1], np.nonzero(common[order] > 1)[0]
                out.append((hashes[order], at, np.full(len(at), node), np.full(len(at), n)))
            token, at, node, n = (np.concatenate(c) for c in zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(_signed(token)), pa.array(at, pa.int32()), pa.array(node, pa.int64()), pa.array(n, pa.int64())], names=["token", "at", "node", "n"])

    return texts.mapInArrow(run, "token long, at int, node long, n long")


def _sets(source: DataFrame, words: int) -> DataFrame:
    def run(batches: Batches) -> Batches:
        for batch in slices(batches, 200):
            sets = [shingles(t, words) for t in column_values(batch, "text")]
            yield with_columns(batch, ("text",), hashes=pa.array([_signed(s) for s in sets], pa.list_(pa.int64())), bits=pa.array([parity(s) for s in sets], pa.list_(pa.int64())))

    return source.mapInArrow(run, "node long, hashes array<long>, bits array<long>")


def parity(hashes: np.ndarray) -> np.ndarray:
    """For each cell of a small table whether an odd number of the set's hashes fall into it. Two sets differ in at least
    as many elements as their tables do in bits."""
    odd = np.bincount((hashes % np.uint64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _alike(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs ``(a, b)`` whose sets have at least that similarity. Pairs are written first: while they are
    few they go to the sets, which then are not shuffled."""
    ends = stage(pairs, "near-pairs").select("a", "b", F.explode(F.array("a", "b")).alias("node"))
    both = ends.join(sets.select("node", "hashes"), "node").groupBy("a", "b").agg(F.collect_list("hashes").alias("sets"))
    shared, x, y = F.size(F.array_intersect(F.col("sets")[0], F.col("sets")[1])), F.size(F.col("sets")[0]), F.size(F.col("sets")[1])
    return both.where(shared + 1e-9 >= F.lit(least) * (x + y - shared)).select("a", "b")


def _possible(least: float, l: str, r: str, bits: bool = False) -> Column:
    """Whether two members of a shingle's run can be alike if it is the first that they share: the sets' sizes,
    what follows it in both and, with ``bits``, their parity bits allow it."""
    n = lambda s: F.col(f"{s}n")
    shared = F.ceil(F.lit(least / (1 + least)) * (n(l) + n(r)) - 1e-9)
    fits = F.least(n(l) - F.col(f"{l}at"), n(r) - F.col(f"{r}at")) >= shared
    if not bits:
        return fits
    differ = sum(F.bit_count(F.col(f"{l}bits")[i].bitwiseXOR(F.col(f"{r}bits")[i])) for i in range(PARITY))
    return fits & (differ <= n(l) + n(r) - 2 * shared)


def _classes(links: list[DataFrame]) -> DataFrame:
    found = stage(union_all(links), "near-links")
    return components(found, rows=found.count())


def simhash_links(nodes: DataFrame, bits: int) -> DataFrame:
    """Links ``(a, b)`` between nodes ``(node, fp)`` within so many bits: one node stands for each fingerprint."""
    named = nodes.groupBy("fp").agg(F.min("node").alias("first"))
    of = lambda side: named.select(F.col("fp").alias(side), F.col("first").alias(f"node_{side}"))
    far = simhash.near_links(named.select("fp"), bits).join(of("a"), "a").join(of("b"), "b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    return nodes.join(named, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).unionByName(far)


def classes(nodes: DataFrame, texts, every: DataFrame, counts: np.ndarray, least: float = LEAST, words: int = WORDS, bits: int = simhash.BITS) -> DataFrame:
    """``(node, root)`` of the nodes ``(node, n, fp)`` that are not their class's root. ``texts`` gives
    ``(node, text)`` for a table of nodes, ``every`` the text of each node once."""
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    near = stage(simhash_links(nodes.select("node", "fp"), bits), "near-simhash")
    ends = near.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    found = lambda: sum(x.count() for x in links)
    links = [stage(_alike(near, stage(_sets(texts(ends), words), "near-sets"), least), "near-alike")]
    roots = _classes(links)
    def opened(runs: DataFrame) -> DataFrame:
        """Runs that hold members of several classes, with the members' roots."""
        member = runs.select("token", "at", "node", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        run = Window.partitionBy("token")
        return stage(member.withColumn("low", F.min("root").over(run)).withColumn("high", F.max("root").over(run)).where("low <> high").drop("low", "high"), "near-runs")

    runs = opened(_prefixes(every, counts, least, words))
    sets = stage(_sets(texts(runs.select("node").distinct()), words), "near-sets")
    for turn in range(ROUNDS):
        order = Window.partitionBy("token").orderBy(F.xxhash64("node", "token", F.lit(turn)), "node")
        others = F.array(*[F.lag(F.struct("at", "node", "n", "root"), k).over(order) for k in range(1, NEIGHBOURS + 1)])
        near = runs.withColumn("others", others).select("at", "node", "n", "root", F.explode("others").alias("o")).where("o is not null and root <> o.root")
        near = near.select("node", F.col("o.node").alias("other"), F.col("n").alias("l_n"), F.col("at").alias("l_at"), F.col("o.n").alias("r_n"), F.col("o.at").alias("r_at"))
        new = stage(_alike(near.where(_possible(least, "l_", "r_")).select(*pair(F.col("node"), F.col("other"))).distinct(), sets, least), "near-alike")
        links.append(new)
        roots = _classes(links)
        runs = opened(runs)
        if new.count() * SETTLED <= found():
            break
    runs = runs.join(sets.select("node", "bits"), "node")
    left, right = (runs.select("token", *[F.col(c).alias(f"{s}_{c}") for c in ("at", "node", "n", "root", "bits")]) for s in "lr")
    rest = left.join(right, "token").where((F.col("l_root") < F.col("r_root")) & _possible(least, "l_", "r_", bits=True))
    return _classes([*links, _alike(rest.select(*pair(F.col("l_node"), F.col("r_node"))).distinct(), sets, least)])


def _is_scan(docs: DataFrame) -> bool:
    """Whether the table is nothing but what was read from Parquet files, whose rows have a place."""
    try:
        docs.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        return False
    return docs._jdf.queryExecution().analyzed().children().isEmpty()


def _in_files(docs: DataFrame) -> DataFrame:
    """The rows of a table of files with ``__row``, made of the number of the file and the place in it: the same
    number at every reading, so that no copy has to hold it."""
    names = docs.select(F.col("_metadata.file_path").alias("__file")).distinct()
    numbers = stage(names.select("__file", F.row_number().over(Window.orderBy("__file")).cast("long").alias("__number")), "near-files")
    placed = docs.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__place"))
    return placed.join(F.broadcast(numbers), "__file").withColumn("__row", F.col("__number") * F.lit(1 << 40) + F.col("__place")).drop("__file", "__number", "__place")


def keep_first(docs: DataFrame, text: str = "text", key: str = "doc_id", least: float = LEAST, words: int = WORDS, bits: int = simhash.BITS) -> DataFrame:
    """One row of each class of near duplicates, with all columns: texts reachable through pairs whose sets of
    ``words``-word shingles have similarity ``least`` or more; ``bits`` is the distance up to which SimHash
    proposes pairs. Texts are compared without regard to the case of A-Z and to white space; null and blank texts are one
    class.

    The row that stays is the first by ``key`` (null last), then by a hash of the text: keys need be neither
    unique nor present. Of rows equal in all columns one stays. Of a table
    that is nothing but Parquet files (as ``stage`` gives it) no copy is written."""
    with scratch(docs.sparkSession):
        source = _in_files(docs) if _is_scan(docs) else stage(docs.withColumn("__row", F.monotonically_increasing_id()), "near-source")
        rank = F.struct(F.col(f"`{key}`").isNull().alias("no_key"), F.col(f"`{key}`").alias("key"), F.xxhash64(F.col(f"`{text}`")).alias("uid"), F.col("__row").alias("row"))
        sketched = stage(_sketched(source.select(rank.alias("rank"), as_bytes(f"`{text}`").alias("text")), words), "near-sketches")
        counts = counters(sketched.where("chunk is not null").select("part", "chunk", "counts"))
        printed = sketched.where("chunk is null")
        nodes = stage(printed.groupBy("node").agg(F.min("rank").alias("rank"), F.min("n").alias("n"), F.min("fp").alias("fp")), "near-nodes")

        def texts(wanted: DataFrame) -> DataFrame:
            rows = nodes.select(F.col("rank.row").alias("__row"), "node").join(wanted, "node", "left_semi")
            return source.select("__row", as_bytes(f"`{text}`").alias("text")).join(stage(rows, "near-wanted"), "__row").select("node", "text")

        # Rows to leave out are few where there are few duplicates; then no text is shuffled to leave them out.
        row = F.col("rank.row").alias("__row")
        copies = stage(printed.select("node", "rank").join(nodes.select("node", F.col("rank").alias("first")), "node").where("rank <> first").select(row), "near-copies")
        every = source.join(copies, "__row", "left_anti").select(as_bytes(f"`{text}`").alias("text"))
        roots = classes(nodes.select("node", "n", "fp"), texts, every, counts, least, words, bits)
        member = nodes.select("node", "rank").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        first = member.groupBy("root").agg(F.min("rank").alias("first"))
        later = member.join(first, "root").where("rank <> first").select(row)
        dropped = stage(later.unionByName(copies), "near-dropped")
        kept = source.join(dropped, "__row", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
        return stage(kept, "near-kept", keep=True)
