"""Longest-matching-block similarity (Ratcliff/Obershelp) as small Arrow-batched helpers.

Results equal ``difflib.SequenceMatcher(autojunk=False)``; the inner search runs row by row over a
numpy table so that long texts do not fall into a Python loop per character.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd

from palimpsest.functions.udf import vectorized


# Below this size the standard library's own search has less overhead than numpy rows.
SMALL = 4096
# Ranges at least this long are searched by hashes of their windows.
LONG = 64


def _codes(left, right):
    """Two sequences as integer arrays over one shared alphabet."""
    if isinstance(left, str):
        as_array = lambda s: np.frombuffer(s.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        return as_array(left), as_array(right)
    table: dict = {}
    as_ids = lambda seq: np.array([table.setdefault(x, len(table)) for x in seq], dtype=np.int64)
    return as_ids(left), as_ids(right)


class _Index:
    """Positions of every symbol of b, and reusable run-length rows for the block search."""

    def __init__(self, b):
        order = np.argsort(b, kind="stable")
        symbols, starts = np.unique(b[order], return_index=True)
        self.where = dict(zip(symbols.tolist(), np.split(order, starts[1:])))
        self.rows = (np.zeros(len(b) + 1, dtype=np.int32), np.zeros(len(b) + 1, dtype=np.int32))
        self.none = np.zeros(0, dtype=np.int64)


class _Windows:
    """Hashes of all windows of one length in a range of a or b, from running sums made once."""

    def __init__(self, a, b):
        n = max(len(a), len(b))
        self.texts, self.n = (a, b), n
        self.power = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n, 0x9E3779B97F4A7C15, np.uint64))))
        self.sums = []
        for x in (a, b):
            mixed = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            self.sums.append(np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed * self.power[:len(x)]))))

    def at(self, side, lo, hi, k):
        s, starts = self.sums[side], np.arange(lo, hi - k + 1)
        return (s[lo + k:hi + 1] - s[lo:hi - k + 1]) * self.power[self.n - starts]

    def longest(self, alo, ahi, blo, bhi):
        """As :func:`_longest`; None where a hash stands for two different windows.

        Equal windows have equal hashes, so a length without a common hash has no common block and neither has any
        greater one. What the ranges begin or end with is a first bound; near copies need no other."""
        a, b = self.texts[0][alo:ahi], self.texts[1][blo:bhi]
        most = min(len(a), len(b))
        differ = np.nonzero(a[:most] != b[:most])[0]
        head = int(differ[0]) if len(differ) else most
        if head == most:
            return alo, blo, most
        differ = np.nonzero(a[len(a) - most:] != b[len(b) - most:])[0]
        least = max(head, most - 1 - int(differ[-1]) if len(differ) else most)
        common = lambda k: np.isin(self.at(0, alo, ahi, k), self.at(1, blo, bhi, k))
        step, above = 1, most + 1  # a block of ``least`` exists, none of ``above``
        while least + 1 < above:
            k = min(least + step, (least + above) // 2 if step > 1 else least + 1)
            if common(k).any():
                least, step = k, step * 2
            else:
                above, step = k, max(1, min(step, (above - least) // 2))
        if not least or head == least:
            return alo, blo, least
        i = alo + int(np.argmax(common(least)))
        j = blo + int(np.argmax(self.at(1, blo, bhi, least) == self.at(0, i, i + least, least)[0]))
        same = np.array_equal(self.texts[0][i:i + least], self.texts[1][j:j + least])
        return (i, j, least) if same else None


def _longest(a, index, alo, ahi, blo, bhi, windows=None):
    """Earliest longest common block of a[alo:ahi] and b[blo:bhi]."""
    if windows is not None and min(ahi - alo, bhi - blo) >= LONG:
        found = windows.longest(alo, ahi, blo, bhi)
        if found is not None:
            return found
    run, nxt = index.rows
    best, previous, older = (alo, blo, 0), index.none, index.none
    for i, symbol in enumerate(a[alo:ahi].tolist(), alo):
        hit = index.where.get(symbol, index.none)
        if hit.size and (hit[0] < blo or hit[-1] >= bhi):
            hit = hit[np.searchsorted(hit, blo):np.searchsorted(hit, bhi)]
        nxt[older] = 0
        if hit.size:
            # run[p] is the length of the block that ends right before position p of b.
            lengths = run[hit] + 1
            if blo and hit[0] == blo:
                lengths[0] = 1
            nxt[hit + 1] = lengths
            j = int(np.argmax(lengths))
            if lengths[j] > best[2]:
                k = int(lengths[j])
                best = (i - k + 1, int(hit[j]) - k + 1, k)
        older, previous = previous, hit + 1
        run, nxt = nxt, run
    run[previous] = 0
    nxt[older] = 0
    return best


def matching_blocks(left, right, threshold: float = 0.0) -> list[tuple[int, int, int]] | None:
    """Non-adjacent matching blocks in order.

    With a threshold, the search stops with None as soon as the blocks still possible cannot bring
    the ratio up to it."""
    if not threshold and len(left) * len(right) <= SMALL:
        found = SequenceMatcher(None, left, right, autojunk=False).get_matching_blocks()
        return [tuple(m) for m in found if m.size]
    a, b = _codes(left, right)
    if len(a) == len(b) and np.array_equal(a, b):
        return [(0, 0, len(a))] if len(a) else []
    index, total = _Index(b), len(a) + len(b)
    windows = _Windows(a, b) if min(len(a), len(b)) >= LONG else None
    stack, found = [(0, len(a), 0, len(b))], []
    possible = min(len(a), len(b))
    while stack:
        if 2.0 * possible / total < threshold:
            return None
        if threshold:
            # The widest range first: its split lowers the bound most.
            stack.sort(key=lambda r: min(r[1] - r[0], r[3] - r[2]))
        alo, ahi, blo, bhi = stack.pop()
        i, j, k = _longest(a, index, alo, ahi, blo, bhi, windows)
        possible -= min(ahi - alo, bhi - blo)
        if k:
            found.append((i, j, k))
            possible += k
            for r in ((alo, i, blo, j), (i + k, ahi, j + k, bhi)):
                if r[0] < r[1] and r[2] < r[3]:
                    stack.append(r)
                    possible += min(r[1] - r[0], r[3] - r[2])
    if 2.0 * possible / total < threshold:
        return None
    merged: list[tuple[int, int, int]] = []
    for i, j, k in sorted(found):
        if merged and merged[-1][0] + merged[-1][2] == i and merged[-1][1] + merged[-1][2] == j:
            merged[-1] = (merged[-1][0], merged[-1][1], merged[-1][2] + k)
        else:
            merged.append((i, j, k))
    return merged


def ratio(left, right, threshold: float = 0.0) -> float:
    """Share of both sequences inside matching blocks; 0.0 when it cannot reach the threshold."""
    total = len(left) + len(right)
    if not total:
        return 1.0
    blocks = matching_blocks(left, right, threshold)
    return 0.0 if blocks is None else 2.0 * sum(k for _, _, k in blocks) / total


def opcodes(left, right) -> list[tuple[str, int, int, int, int]]:
    """Edit steps that turn left into right: equal, replace, delete, insert."""
    steps, i, j = [], 0, 0
    for ai, bj, k in [*matching_blocks(left, right), (len(left), len(right), 0)]:
        if i < ai or j < bj:
            tag = "replace" if i < ai and j < bj else "delete" if i < ai else "insert"
            steps.append((tag, i, ai, j, bj))
        if k:
            steps.append(("equal", ai, ai + k, bj, bj + k))
        i, j = ai + k, bj + k
    return steps


@vectorized("double")
def ratio_udf(left: pd.Series, right: pd.Series) -> pd.Series:
    """Character similarity ratio of two texts in [0, 1]."""
    return pd.Series([None if x is None or y is None else ratio(x, y)
                      for x, y in zip(left, right)], dtype="float64")


DELTA = ("struct<opcodes:array<struct<tag:string,before_start:int,before_end:int,"
         "after_start:int,after_end:int>>,truncated:boolean>")


def word_delta_udf(maximum: int = 200):
    """Word-level edit steps, at most ``maximum`` (the feature's own bound) with a flag."""

    @vectorized(DELTA)
    def delta(left: pd.Series, right: pd.Series) -> pd.DataFrame:
        out = []
        for x, y in zip(left, right):
            steps = opcodes((x or "").split(), (y or "").split())
            out.append(([dict(zip(("tag", "before_start", "before_end", "after_start", "after_end"), s))
                         for s in steps[:maximum]], len(steps) > maximum))
        return pd.DataFrame(out, columns=["opcodes", "truncated"])

    return delta


@vectorized("array<string>")
def stable_keys_udf(before: pd.Series, after: pd.Series) -> pd.Series:
    """Keys inside matching blocks of two key sequences: present in the same relative order."""
    return pd.Series([[key for i, _, k in matching_blocks(list(x), list(y)) for key in x[i:i + k]]
                      if x is not None and y is not None else []
                      for x, y in zip(before, after)])
