"""Language-model scores by deleted interpolation.

The model mixes maximum-likelihood estimates: the word after its predecessor, the word alone, and every word
alike. The mixture depends on how often the predecessor was seen (buckets by powers of two). Its weights come
from expectation-maximisation on held-out counts: a tenth of the training documents is deleted from the
counts and predicted by the rest; the final estimates use all training documents.

N-gram counts don't fit in one place, and a row per token would move the corpus many times over. So documents
are cut into blocks of about ``BLOCK`` tokens, kept as compressed local word numbers. A block asks for the
counts of its distinct n-grams (64-bit hashes), one sorted packet for each hash range; a range adds up what
all blocks sent and answers each packet in its own order. What moves is some bytes per distinct n-gram and
block, and grows with the corpus. No task holds more than a block or a range.
"""

from __future__ import annotations

import math
import uuid
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import Batches, as_bytes, column_values
from palimpsest.session import stage

BLOCK = 2_000_000  # tokens
END, BEGIN = b"\n", b" "  # no words, as words hold no white space
BUCKETS = 40  # of the predecessor's frequency: 0, 1, 2-3, 4-7, ...
FINE = 8  # histogram cells per octave of a probability
HELD, KEPT, DELETED = 0, 1, 2  # parts: not for training, counted, counted but held out for the weights
ADD = 0.1
ROUNDS = 60

CODEC = "zstd"


def pack(x: np.ndarray) -> bytes:
    """Numbers as compressed byte planes, after their size and kind."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()
    return f"{len(x)},{x.dtype.str};".encode() + pa.compress(planes, codec=CODEC, asbytes=True)


def unpack(b: bytes) -> np.ndarray:
    head, _, body = b.partition(b";")
    n, kind = head.decode().split(",")
    dtype, n = np.dtype(kind), int(n)
    planes = np.frombuffer(pa.decompress(body, n * dtype.itemsize, codec=CODEC, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(dtype.itemsize, n).T).view(dtype).reshape(n)


def pair_keys(words: np.ndarray, stream: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """56-bit hash of each token with its predecessor (the begin mark at a document's start), in the upper
    bits: among 10^10 pairs one in ten million shares its hash with another."""
    now = words[stream]
    before = np.empty_like(now)
    before[1:] = now[:-1]
    before[starts] = np.uint64(xxhash.xxh64_intdigest(BEGIN))
    x = before * np.uint64(0x9E3779B97F4A7C15) + now
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(29))) & ~np.uint64(0xFF)


def blocks(docs: DataFrame, key: str, text: str, tokens: int) -> DataFrame:
    """Rows of about ``tokens`` tokens: keys, parts and sizes of the documents, token numbers, word hashes.
    The part goes by crc32 of the key as text (null: the empty text) modulo 10: 0 is not for training, 1 is
    deleted while weights are learnt."""
    rest = F.crc32(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))) % 10
    part = F.when(rest == 0, HELD).when(rest == 1, DELETED).otherwise(KEPT)
    source = docs.select(F.col(f"`{key}`").alias("key"), part.cast("int").alias("part"), as_bytes(f"`{text}`").alias("text"))
    kind = source.schema["key"].dataType.simpleString()

    def run(batches: Batches) -> Batches:
        def fresh():
            words = defaultdict(count().__next__)
            return words, array("i"), [], [], []

        def row():
            hashes = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
            return pa.RecordBatch.from_arrays([
                pa.array([uuid.uuid4().hex]), pa.array([keys], pa.list_(key_type)), pa.array([pack(np.array(parts, np.uint8))]),
                pa.array([pack(np.array(sizes, np.int64))]), pa.array([pack(np.frombuffer(stream, np.int32))]), pa.array([pack(hashes)])],
                names=["block", "keys", "parts", "sizes", "stream", "words"])

        words, stream, keys, parts, sizes = fresh()
        key_type = None
        for batch in batches:
            key_type = batch.schema.field("key").type
            for k, p, t in zip(*[column_values(batch, c) for c in ("key", "part", "text")]):
                tokens_ = (t or b"").lower().split()
                tokens_.append(END)
                stream.extend(map(words.__getitem__, tokens_))
                keys.append(k)
                parts.append(p)
                sizes.append(len(tokens_))
                if len(stream) >= tokens:
                    yield row()
                    words, stream, keys, parts, sizes = fresh()
        if keys:
            yield row()

    return source.mapInArrow(run, f"block string, keys array<{kind}>, parts binary, sizes binary, stream binary, words binary")


class Block:
    """A block's arrays, read back from its row."""

    def __init__(self, row: dict):
        self.name, self.keys = row["block"], row["keys"]
        self.parts, self.sizes, self.stream, self.words = (unpack(row[c]) for c in ("parts", "sizes", "stream", "words"))
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)[:-1]))
        self.part = np.repeat(self.parts, self.sizes)
        self.pairs, self.pair = np.unique(pair_keys(self.words, self.stream, self.starts), return_inverse=True)
        self.order = np.argsort(self.words)
        self.single = np.empty(len(self.words), np.int64)
        self.single[self.order] = np.arange(len(self.words))
        self.grams = {1: (self.words[self.order], self.single[self.stream]), 2: (self.pairs, self.pair)}


def _requests(bits: int):
    def run(batches: Batches) -> Batches:
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row)
                for order, (keys, token) in b.grams.items():
                    n = [np.bincount(token[b.part == p], minlength=len(keys)).astype(np.uint32) for p in (KEPT, DELETED)]
                    cuts = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else [0]
                    cuts = [*cuts, len(keys)]
                    rows = []
                    for r, (i, j) in enumerate(zip(cuts, cuts[1:])):
                        if i < j:
                            part = keys[i:j]
                            rows.append({"order": order, "range": r, "block": b.name, "first": pack(np.diff(part, prepend=np.uint64(0))),
                                         "kept": pack(n[0][i:j]), "deleted": pack(n[1][i:j])})
                    for i in range(0, len(rows), 256):
                        yield pa.RecordBatch.from_pylist(rows[i:i + 256], schema=pa.schema([
                            ("order", pa.int32()), ("range", pa.int32()), ("block", pa.string()), ("first", pa.binary()), ("kept", pa.binary()), ("deleted", pa.binary())]))

    return run


def _answer(group: pa.Table) -> pa.Table:
    """Totals of one hash range, sent back to each block in the order of its packet. One row also carries the
    range's number of trained n-grams and the sum of their counts, with all and with kept documents only."""
    rows = group.to_pylist()
    keys = [np.cumsum(unpack(r["first"]), dtype=np.uint64) for r in rows]
    _, where = np.unique(np.concatenate(keys), return_inverse=True)
    kept = np.bincount(where, weights=np.concatenate([unpack(r["kept"]) for r in rows]))
    both = kept + np.bincount(where, weights=np.concatenate([unpack(r["deleted"]) for r in rows]))
    out, i = [], 0
    for n, (r, k) in enumerate(zip(rows, keys)):
        at = where[i:i + len(k)]
        i += len(k)
        first = n == 0 and r["order"] == 1
        out.append({"block": r["block"], "order": r["order"], "range": r["range"], "both": pack(both[at].astype(np.uint64)), "deleted": pack((both - kept)[at].astype(np.uint64)),
                    "distinct": int((both > 0).sum()) if first else 0, "total": int(both.sum()) if first else 0,
                    "kept_distinct": int((kept > 0).sum()) if first else 0, "kept_total": int(kept.sum()) if first else 0})
    return pa.Table.from_pylist(out, schema=pa.schema([
        ("block", pa.string()), ("order", pa.int32()), ("range", pa.int32()), ("both", pa.binary()), ("deleted", pa.binary()),
        *[(c, pa.int64()) for c in ("distinct", "total", "kept_distinct", "kept_total")]]))


def fine(x: np.ndarray) -> np.ndarray:
    return np.round(np.log2(np.maximum(x, 1e-300)) * FINE).astype(np.int64)


def bucket(n: np.ndarray) -> np.ndarray:
    return np.where(n > 0, np.floor(np.log2(np.maximum(n, 1))) + 1, 0).astype(np.int64).clip(0, BUCKETS - 1)


def _estimates(now: np.ndarray, pair: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per token, from its count and that of its pair: the predecessor's count, the token's share after it."""
    ends = np.cumsum(sizes)
    before = np.empty_like(now)
    before[1:] = now[:-1]
    before[ends - sizes] = now[ends - 1]  # documents begin as often as they end
    return before, pair / np.maximum(before, 1)


def _merge(left: pa.Table, right: pa.Table) -> pa.Table:
    """Counts of a block's tokens and pairs in the order of its text, from the answers, and the histogram of
    its deleted tokens for the weights."""
    out = []
    answers = sorted(right.to_pylist(), key=lambda r: (r["order"], r["range"]))
    totals = {c: sum(r[c] for r in answers) for c in ("distinct", "total", "kept_distinct", "kept_total")}
    counts = {(o, c): np.concatenate([unpack(r[c]) for r in answers if r["order"] == o]) for o in (1, 2) for c in ("both", "deleted")}
    for row in left.to_pylist():
        b = Block(row)
        now, pair = (counts[o, "both"][token] for o, (_, token) in b.grams.items())
        kept = [(counts[o, "both"] - counts[o, "deleted"])[token].astype(float) for o, (_, token) in b.grams.items()]
        before, after = _estimates(*kept, b.sizes)
        cells = np.stack((bucket(before), np.where(after > 0, fine(after), 1), np.where(kept[0] > 0, fine(kept[0]), -1)))[:, b.part == DELETED]
        found, n = np.unique(cells, axis=1, return_counts=True)
        out.append({**{c: row[c] for c in ("keys", "parts", "sizes")}, "now": pack(now), "pair": pack(pair), "cells": pa_rows(found, n), **totals})
    return pa.Table.from_pylist(out, schema=pa.schema([
        ("keys", left.schema.field("keys").type), *[(c, pa.binary()) for c in ("parts", "sizes", "now", "pair")],
        ("cells", pa.list_(pa.list_(pa.int64()))), *[(c, pa.int64()) for c in totals]]))


def pa_rows(cells: np.ndarray, n: np.ndarray) -> list[list[int]]:
    return np.vstack((cells, n)).T.tolist()


def weights(cells: np.ndarray, total: int, distinct: int, rounds: int = ROUNDS) -> np.ndarray:
    """Mixture weights per bucket (pair, word, any) by expectation-maximisation over a histogram of held-out
    tokens: rows of bucket, share after the predecessor, count of the word (both logarithms), number.
    Every bucket starts from half a token for each part, so no weight vanishes; without a predecessor the
    pair has none."""
    lam = np.full((BUCKETS, 3), 1 / 3)
    lam[0] = (0, 0.5, 0.5)
    if not len(cells):
        return lam
    b, n = cells[:, 0].astype(int), cells[:, 3].astype(float)
    p = np.stack((np.where(cells[:, 1] <= 0, 2.0 ** (cells[:, 1] / FINE), 0),
                  np.where(cells[:, 2] >= 0, 2.0 ** (cells[:, 2] / FINE) / max(total, 1), 0), np.full(len(cells), 1 / (distinct + 1))), axis=1)
    for _ in range(rounds):
        part = lam[b] * p
        part *= (n / part.sum(axis=1))[:, None]
        got = np.stack([np.bincount(b, weights=part[:, k], minlength=BUCKETS) for k in range(3)], axis=1) + 0.5
        got[0, 0] = 0
        lam = got / got.sum(axis=1, keepdims=True)
    return lam


def _scores(lam: np.ndarray, total: int, distinct: int):
    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                parts, sizes, now, pair = (unpack(row[c]) for c in ("parts", "sizes", "now", "pair"))
                now, starts = now.astype(float), np.cumsum(sizes) - sizes
                before, after = _estimates(now, pair.astype(float), sizes)
                mix = lam[bucket(before)]
                p = mix[:, 0] * after + mix[:, 1] * now / max(total, 1) + mix[:, 2] / (distinct + 1)
                base = np.log10((now + ADD) / (total + ADD * (distinct + 1)))
                add = lambda x: np.add.reduceat(x, starts)
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["keys"], batch.schema.field("keys").type.value_type), pa.array(parts == HELD), pa.array(sizes), pa.array(add((now > 0).astype(np.int64))),
                    pa.array(np.full(len(sizes), total, np.int64)), pa.array(add(base)), pa.array(add(np.log10(p)))],
                    names=["key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", tokens: int = BLOCK) -> DataFrame:
    """Per document row: ``key``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``
    and ``score``, log10 of the text's probability under the smoothed word counts and under the model.

    Tokens are words (A-Z lowered, cut at ASCII white space) and one end per text; a null text is empty.
    Repeated rows are scored and counted each. Without training documents every word is as likely as any
    other. A document longer than a block is a block of its own."""
    cut = stage(blocks(docs, key, text, tokens), "lm-blocks")
    kind = cut.schema["keys"].dataType.elementType.simpleString()
    n_blocks = cut.count()
    bits = max(0, math.ceil(math.log2(max(n_blocks, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))))
    asked = cut.mapInArrow(_requests(bits), "order int, range int, block string, first binary, kept binary, deleted binary")
    told = asked.groupBy("order", "range").applyInArrow(_answer, "block string, order int, range int, both binary, deleted binary, distinct long, total long, kept_distinct long, kept_total long")
    both = stage(cut.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(
        _merge, f"keys array<{kind}>, parts binary, sizes binary, now binary, pair binary, cells array<array<bigint>>, "
                "distinct long, total long, kept_distinct long, kept_total long"), "lm-counts")
    totals = both.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("distinct", "total", "kept_distinct", "kept_total")]).first()
    cells = (both.select(F.explode("cells").alias("c")).groupBy(*[F.col("c")[i].alias(f"c{i}") for i in range(3)])
             .agg(F.sum(F.col("c")[3]).alias("n")).toPandas().to_numpy())  # cells are logarithms: their number has a bound
    lam = weights(cells, totals.kept_total, totals.kept_distinct)
    return both.select("keys", "parts", "sizes", "now", "pair").mapInArrow(
        _scores(lam, totals.total, totals.distinct),
        f"key {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").withColumnRenamed("key", key)
