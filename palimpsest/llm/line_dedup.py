"""Line dedup by pairwise alignment.

Overlapping documents are found through shared rare line hashes: the hash of a run of consecutive lines that
together hold ``min_words`` words, cut as short as possible. Such a run is rare unless it was copied, and
every shared block of ``min_words`` words or more begins with one. Each document is paired with the earliest
holder of each of its shared runs (never all holders with each other), rarest run first. The pair's line
sequences are aligned with patience diff, and aligned common blocks of at least ``min_words`` words are
deleted from the later document. What is left of it is aligned again, and where that yields no block, runs
of ``min_words`` words that stand elsewhere in the earlier document are looked up, so that blocks in another
order are found too.

By induction over the order of documents a copy of every deleted line stays in an earlier document.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import Batches, as_bytes, column_values
from palimpsest.session import stage

MIN_WORDS = 25


def line_rows(text: bytes | None, min_words: int) -> tuple[list[int], list[int], list[int], int, list[int]]:
    """Hash, words and position of each line that isn't blank, the number of lines, and the run that begins
    at each line (as far as there are words enough)."""
    hashes, words, at = [], [], []
    lines = text.split(b"\n") if text is not None else []
    for i, line in enumerate(lines):
        if n := len(line.split()):
            hashes.append(xxhash.xxh64_intdigest(line.strip()))
            words.append(n)
            at.append(i)
    flat, runs, total, j = np.array(hashes, np.uint64), [], 0, 0
    for i in range(len(words)):
        while j < len(words) and total < min_words:
            total += words[j]
            j += 1
        if total < min_words:
            break
        runs.append(xxhash.xxh64_intdigest(flat[i:j].tobytes()))
        total -= words[i]
    return hashes, words, at, len(lines), runs


def line_table(docs: DataFrame, key: str, text: str, min_words: int) -> DataFrame:
    """One row per document, its lines as arrays. A document is known by its key and a hash of its text."""
    source = docs.select(F.col(f"`{key}`").alias("key"), F.xxhash64(F.col(f"`{text}`")).alias("uid"), as_bytes(f"`{text}`").alias("text"))

    def run(batches: Batches) -> Batches:
        signed = lambda rows: [np.array(x, np.uint64).view(np.int64) for x in rows]
        for batch in batches:
            cols = list(zip(*[line_rows(t, min_words) for t in column_values(batch, "text")])) or [[]] * 5
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(signed(cols[0]), pa.list_(pa.int64())), pa.array(cols[1], pa.list_(pa.int32())),
                pa.array(cols[2], pa.list_(pa.int32())), pa.array(cols[3], pa.int32()), pa.array(signed(cols[4]), pa.list_(pa.int64()))],
                names=["key", "uid", "hashes", "words", "at", "n_lines", "runs"])

    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, uid long, hashes array<long>, words array<int>, at array<int>, n_lines int, runs array<long>")


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain of pairs that rises in both members; pairs come in order of the first."""
    tops, where, back = [], [], []
    for n, (_, j) in enumerate(pairs):
        k = bisect_left(tops, j)
        back.append(where[k - 1] if k else -1)
        if k == len(tops):
            tops.append(j)
            where.append(n)
        else:
            tops[k], where[k] = j, n
    out, n = [], where[-1] if where else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def _anchors(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of equal lines: those that are unique on both sides, else each line's k-th copies."""
    ca, cb = Counter(a), Counter(b)
    at = {x: i for i, x in enumerate(a) if ca[x] == 1 and cb[x] == 1}
    if at:
        return sorted((at[x], j) for j, x in enumerate(b) if x in at)
    seen, at = Counter(), {}
    for i, x in enumerate(a):
        at[x, seen[x]] = i
        seen[x] += 1
    seen, out = Counter(), []
    for j, x in enumerate(b):
        if (x, seen[x]) in at:
            out.append((at[x, seen[x]], j))
        seen[x] += 1
    return sorted(out)


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned positions of equal lines, rising on both sides."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i == m or j == n:
            continue
        chain = [(i + x, j + y) for x, y in _rising(_anchors(a[i:m], b[j:n]))]
        out.extend(chain)
        for (x, y), (p, q) in zip([(i - 1, j - 1), *chain], [*chain, (m, n)]):
            if chain and x + 1 < p and y + 1 < q:
                todo.append((x + 1, p, y + 1, q))
    return sorted(out)


def shared_runs(early: list, late: list, words: list, free: list, min_words: int) -> list[int]:
    """Positions of the later document's free lines that lie in a run of at least ``min_words`` words that
    stands anywhere in the earlier one. Linear: the longest match that ends at each line, by a suffix automaton."""
    known, most, total = set(early), 0, 0
    for x, w, ok in zip(late, words, free):
        total = total + w if ok and x in known else 0
        most = max(most, total)
    if most < min_words:
        return []
    wanted = {x for x, ok in zip(late, free) if ok}
    step, link, length, last = [{}], [-1], [0], 0
    for i, x in enumerate(early):
        if x not in wanted:
            if i and early[i - 1] not in wanted:
                continue
            x = None  # no match goes over it
        new, p = len(step), last
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        while p >= 0 and x not in step[p]:
            step[p][x] = new
            p = link[p]
        if p >= 0:
            q = step[p][x]
            if length[q] != length[p] + 1:
                copy = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and step[p].get(x) == q:
                    step[p][x] = copy
                    p = link[p]
                link[q] = q = copy
            link[new] = q
        last = new
    sums, starts, state, n = [0, *accumulate(words)], [], 0, 0
    for j, (x, ok) in enumerate(zip(late, free)):
        while state and not (ok and x in step[state]):
            state = link[state]
            n = length[state]
        if ok and x in step[state]:
            state, n = step[state][x], n + 1
        starts.append(j + 1 - n if sums[j + 1] - sums[j + 1 - n] >= min_words else j + 1)
    out, begin = [], len(late)
    for j in range(len(late) - 1, -1, -1):
        begin = min(begin, starts[j])
        if begin <= j:
            out.append(j)
    return out[::-1]


def common_blocks(early: list, late: list, words: list, free: list, min_words: int) -> list[int]:
    """Positions of the later document's free lines that lie in aligned common blocks; they stop being free.

    Where the alignment, whose chain weighs lines by number, leaves runs of ``min_words`` in another order,
    these are looked up and taken too, until none is left."""
    taken: list[int] = []
    while True:
        left = [j for j, ok in enumerate(free) if ok]
        pairs = [(i, left[j]) for i, j in patience(early, [late[j] for j in left])]
        new, block = [], []
        for i, j in [*pairs, (-9, -9)]:
            if block and (i != block[-1][0] + 1 or j != block[-1][1] + 1):
                if sum(words[q] for _, q in block) >= min_words:
                    new += [q for _, q in block]
                block = []
            block.append((i, j))
        if not new:
            new = shared_runs(early, late, words, free, min_words)
        if not new:
            return taken
        taken += new
        for j in new:
            free[j] = False


def _align(min_words: int):
    def run(batches: Batches) -> Batches:
        now, free, row = None, [], None

        def done():
            gone = [not x for x in free]
            keep = np.ones(row["n_lines"], bool)
            lines = row["at"]
            for n, (p, g) in enumerate(zip(lines, gone)):
                if g:  # blank lines go with the block around them
                    keep[p:lines[n + 1] if n + 1 < len(lines) and gone[n + 1] else p + 1] = False
            if not keep.all():
                yield {"key": row["key"], "uid": row["uid"], "keep": keep.tolist(), "n_removed_lines": sum(gone), "n_removed_words": sum(w for w, g in zip(row["words"], gone) if g)}

        def write(rows):
            rows = list(rows)
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

        schema = None
        for batch in batches:
            schema = schema or pa.schema([("key", batch.schema.field("key").type), ("uid", pa.int64()), ("keep", pa.list_(pa.bool_())), ("n_removed_lines", pa.int32()), ("n_removed_words", pa.int64())])
            for new in batch.to_pylist():
                if now != (new["key"], new["uid"]):
                    if row is not None:
                        yield from write(done())
                    now, row, free = (new["key"], new["uid"]), new, [True] * len(new["hashes"])
                common_blocks(new["early"], new["hashes"], new["words"], free, min_words)
        if row is not None:
            yield from write(done())

    return run


def edits(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``(key, uid, keep, n_removed_lines, n_removed_words)`` for the documents that lose lines."""
    lines = stage(line_table(docs, key, text, min_words), "line-table").dropDuplicates(["key", "uid"])
    runs = lines.select("key", "uid", F.explode("runs").alias("run"))
    shared = (runs.groupBy("run").agg(F.min(F.struct("key", "uid")).alias("first"), F.max(F.struct("key", "uid")).alias("last"), F.count("*").alias("n"))
              .where("first <> last").select("run", "first", "n"))
    pairs = (runs.join(shared, "run").where(F.struct("key", "uid") != F.col("first"))
             .groupBy("key", "uid", "first").agg(F.min("n").alias("n")))
    same = lambda x, k, u: (x["key"].eqNullSafe(F.col(k))) & (x["uid"] == F.col(u))
    late, early = lines.alias("l"), lines.select(F.col("key").alias("ekey"), F.col("uid").alias("euid"), F.col("hashes").alias("early")).alias("e")
    p = pairs.select(F.col("key").alias("pkey"), F.col("uid").alias("puid"), F.col("first.key").alias("fkey"), F.col("first.uid").alias("fuid"), "n")
    both = (p.join(early, F.col("ekey").eqNullSafe(F.col("fkey")) & (F.col("euid") == F.col("fuid")))
            .join(late, same(lines, "pkey", "puid"))
            .select("key", "uid", "hashes", "words", "at", "n_lines", "early", "n", "fkey", "fuid"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = both.repartition(parts, "key", "uid").sortWithinPartitions("key", "uid", "n", "fkey", "fuid")
    kind = lines.schema["key"].dataType.simpleString()
    return sorted_.mapInArrow(_align(min_words), f"key {kind}, uid long, keep array<boolean>, n_removed_lines int, n_removed_words long")


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with their columns, the text without the deleted blocks, and ``n_removed_lines`` and
    ``n_removed_words`` (such columns of the input are replaced).

    Earlier means a smaller key (null first, then by a hash of the text). Rows of equal key and text are one
    document and stay equal. A null text stays null and an empty one empty; a document whose lines all stand
    in earlier ones gets an empty text. Blank lines go with the block around them. Lines are compared without
    white space at their ends."""
    changes = edits(docs, key, text, min_words).select(F.col("key").alias("__key"), F.col("uid").alias("__uid"), F.col("keep").alias("__keep"), *[F.col(c).alias("__" + c) for c in ("n_removed_lines", "n_removed_words")])
    kept = [c for c in docs.columns if c not in ("n_removed_lines", "n_removed_words")]
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.xxhash64(F.col(f"`{text}`")).alias("__id"))
    joined = source.join(changes, F.col(f"`{key}`").eqNullSafe(F.col("__key")) & (F.col("__id") == F.col("__uid")), "left")
    lines = F.filter(F.split(F.col(f"`{text}`"), "\n"), lambda _, i: F.get("__keep", i))
    new = F.when(F.col("__keep").isNull(), F.col(f"`{text}`")).otherwise(F.array_join(lines, "\n"))
    return joined.select(*[new.alias(c) if c == text else F.col(f"`{c}`") for c in kept],
                         F.coalesce("__n_removed_lines", F.lit(0)).alias("n_removed_lines"), F.coalesce("__n_removed_words", F.lit(0)).cast("long").alias("n_removed_words"))
