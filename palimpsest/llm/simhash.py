"""SimHash near-duplicates: fingerprints within a few bits, linked through deletion-variant signatures.

Fingerprints that differ in at most ``2 s - 1`` bits, cut into ``s`` segments, agree on one segment but for
at most one bit. So each segment is indexed in all its one-wildcard variants (one bit deleted): two
segments that differ by at most one bit share a variant, an equality join. For 4 bits, 3 segments do.
A pair is verified, and is taken from the first segment and variant that shows it, so no pair comes twice.

Copies of a fingerprint are one node. Rows that share a variant are compared in the sorted stream of a
partition: small runs pair by pair with vector arithmetic. A long run (many different fingerprints that
share a variant, such as a large group of near copies) is searched breadth first and gives a spanning
forest of its links: never more links than members, while the classes stay the same. Its memory is the run's
fingerprints, 8 bytes each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import Batches, as_bytes, column_values, with_columns
from palimpsest.llm.components import components
from palimpsest.session import stage

WORDS, BITS, SEED = 4, 4, 42
LONG_RUN = 48  # members of a variant above which links are thinned to a spanning forest
PIECE = 1 << 16  # shingles whose bits are unpacked at a time


def fingerprint(text: bytes | None, n: int = WORDS, seed: int = SEED) -> int:
    """The 64 majority bits of the hashed word shingles of a whole text; 0 without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    flat, n = b" ".join(words), min(n, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - n + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(flat[i:j], seed) for i, j in zip(starts, ends[n - 1:].tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), PIECE):
        ones += np.unpackbits(hashes[i:i + PIECE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", n: int = WORDS, seed: int = SEED) -> DataFrame:
    """The documents without their text, and ``fp``, the fingerprint as a signed long. No shuffle."""
    kept = [f for f in docs.schema.fields if f.name not in (text, "fp")]

    def run(batches: Batches) -> Batches:
        for batch in batches:
            out = np.array([fingerprint(t, n, seed) for t in column_values(batch, "__text")], np.uint64)
            yield with_columns(batch, ("__text",), fp=pa.array(out.view(np.int64)))

    source = docs.select(*[F.col(f"`{f.name}`") for f in kept], as_bytes(f"`{text}`").alias("__text"))
    return source.mapInArrow(run, T.StructType([*kept, T.StructField("fp", T.LongType())]))


def segment_masks(bits: int) -> list[int]:
    """Masks of the fewest segments of which one differs by at most one bit."""
    count = (bits + 2) // 2
    edges = [64 * i // count for i in range(count + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


class Links:
    """Verified links within the runs of one sorted stream of (signature, fingerprint)."""

    def __init__(self, bits: int):
        self.bits, self.masks = bits, np.array(segment_masks(bits), np.uint64)

    def own(self, x: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Which differences x are within the distance and belong to the variant ``kind`` (the deleted bit,
        0 to 63): the first segment with at most one differing bit, at that bit or else at its lowest."""
        near = _popcount(x) <= self.bits
        first = np.full(x.shape, 255, np.uint8)
        for mask in self.masks[::-1]:
            part = x & mask
            low = mask & (~mask + np.uint64(1))
            bit = np.where(part == 0, _popcount(low - np.uint64(1)), _popcount(part - np.uint64(1)))
            first = np.where(_popcount(part) <= 1, bit, first)
        return near & (first == kind)

    def short(self, sig: np.ndarray, kind: np.ndarray, fp: np.ndarray, most: int):
        """All links in runs of at most ``most`` members."""
        for d in range(1, most):
            same = np.nonzero((sig[d:] == sig[:-d]) & (kind[d:] == kind[:-d]))[0]
            if not len(same):
                return
            a, b = fp[same], fp[same + d]
            good = self.own(a ^ b, kind[same])
            yield a[good], b[good]

    def long(self, kind: int, fp: np.ndarray):
        """A spanning forest of the links of one run, breadth first."""
        rest, a, b = fp, [], []
        while len(rest):
            todo, rest = [rest[0]], rest[1:]
            while todo and len(rest):
                x = todo.pop()
                hit = self.own(rest ^ x, np.uint8(kind))
                if hit.any():
                    new, rest = rest[hit], rest[~hit]
                    a.append(np.full(len(new), x))
                    b.append(new)
                    todo.extend(new)
        if a:
            yield np.concatenate(a), np.concatenate(b)


def _scan(bits: int):
    def run(batches: Batches) -> Batches:
        links, held = Links(bits), None

        def out(sig, kind, fp):
            if not len(sig):
                return
            change = np.nonzero((sig[1:] != sig[:-1]) | (kind[1:] != kind[:-1]))[0] + 1
            starts = np.concatenate(([0], change))
            sizes = np.diff(np.concatenate((starts, [len(sig)])))
            big = sizes > LONG_RUN
            for s, n in zip(starts[big], sizes[big]):
                yield from links.long(int(kind[s]), fp[s:s + n])
            small = np.repeat(~big & (sizes > 1), sizes)
            yield from links.short(sig[small], kind[small], fp[small], LONG_RUN)

        def write(pairs):
            for a, b in pairs:
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            new = [new[0], new[1].astype(np.uint8), new[2].view(np.uint64)]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            sig, kind, fp = held
            last = np.nonzero((sig != sig[-1]) | (kind != kind[-1]))[0]
            cut = int(last[-1]) + 1 if len(last) else 0  # the last run may go on in the next batch
            yield from write(out(sig[:cut], kind[:cut], fp[:cut]))
            held = [x[cut:] for x in held]
        if held is not None:
            yield from write(out(*held))

    return run


def variants(nodes: DataFrame, bits: int = BITS) -> DataFrame:
    """``(sig, kind, fp)``: for each deleted bit ``kind`` the rest of its segment."""
    masks = segment_masks(bits)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    of_bit = [next(m for m, plain in zip(signed, masks) if plain >> i & 1) for i in range(64)]
    clear = F.array(*[F.lit(m & ~((1 << i) - (1 << 64) if i == 63 else 1 << i)) for i, m in enumerate(of_bit)])
    return nodes.select(F.posexplode(clear).alias("kind", "mask"), "fp").select(
        F.col("fp").bitwiseAND(F.col("mask")).alias("sig"), "kind", "fp")


def near_links(nodes: DataFrame, bits: int = BITS) -> DataFrame:
    """Links ``(a, b)`` between the distinct fingerprints of ``nodes`` that keep their classes whole."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = variants(nodes, bits).repartition(parts, "sig", "kind").sortWithinPartitions("sig", "kind", "fp")
    return runs.mapInArrow(_scan(bits), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", bits: int = BITS) -> DataFrame:
    """``key``, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest key of the document's
    class: documents reachable through links of at most ``bits`` differing bits.

    Null and blank texts have fingerprint zero and are linked like any other; repeated rows share a
    class; a null key is a document like others but never names a class unless it has no other key."""
    printed = stage(fingerprints(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))), "fingerprints")
    nodes = printed.groupBy("fp").agg(F.min("key").alias("low"))
    roots = components(near_links(nodes.select("fp"), bits), rows=printed.count())
    member = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    named = member.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = member.join(named, "root").select("fp", "component_id")
    return printed.join(classes, "fp").select(
        F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """One document of each class: that with the smallest ``doc_id`` (of repeated ids, one row). A
    document without an id stays."""
    classes = near_duplicates(docs, bits=bits)
    first = classes.where("doc_id = component_id").select("doc_id").distinct()
    return (docs.where("doc_id is not null").join(first, "doc_id", "left_semi").dropDuplicates(["doc_id"])
            .unionByName(docs.where("doc_id is null")).select(*docs.columns))
