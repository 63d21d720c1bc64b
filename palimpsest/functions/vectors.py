"""Feature-hash text vectors and vector checks."""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pandas as pd

from palimpsest.functions.udf import vectorized

_TOKEN = re.compile(r"\w+", re.UNICODE)


def _md5_slot(feature: str, dimensions: int) -> tuple[int, float]:
    h = hashlib.md5(feature.encode()).hexdigest()
    return int(h[:8], 16) % dimensions, 1.0 if int(h[8], 16) & 1 else -1.0


def _blake2b_slot(feature: str, dimensions: int) -> tuple[int, float]:
    # 16-byte digest, index from its first 8 bytes, sign from the ninth byte.
    d = hashlib.blake2b(feature.encode(), digest_size=16).digest()
    return int.from_bytes(d[:8], "big") % dimensions, 1.0 if d[8] & 1 else -1.0


SLOTS = {"md5": _md5_slot, "blake2b": _blake2b_slot}


@lru_cache(maxsize=4)
def _coder(dimensions: int, digest: str):
    """Feature to bucket number from 1, negative for a negative sign; codes are kept from batch to batch of a process."""

    @lru_cache(maxsize=1 << 18)
    def code(feature):
        index, sign = SLOTS[digest](feature, dimensions)
        return int(sign) * (index + 1)

    return code


def embed_batch(texts, dimensions: int = 384, digest: str = "md5") -> np.ndarray:
    """Signed hashing of word uni- and bigrams into unit vectors, one row per text."""
    code = _coder(dimensions, digest)
    out = np.zeros((len(texts), dimensions))
    for row, text in enumerate(texts):
        words = _TOKEN.findall((text or "").lower())
        features = words + [f"{left}\x1f{right}" for left, right in zip(words, words[1:])]
        codes = np.fromiter(map(code, features), dtype=np.int64, count=len(features))
        out[row] = np.bincount(np.abs(codes) - 1, weights=np.sign(codes), minlength=dimensions) if features else 0.0
    norms = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, norms, out=out, where=norms > 0)


def embed_udf(dimensions: int = 384, digest: str = "md5"):
    """Arrow-batched text to vector; needs no shuffle because a row's features stay in its row."""

    @vectorized("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series(list(embed_batch(texts.tolist(), dimensions, digest)))

    return embed


def summary_udf(dimensions: int = 384, digest: str = "md5"):
    """Text to ``struct(nonzero, norm, checksum)`` of its vector, so that the vector itself need not leave the Python process."""

    @vectorized("nonzero bigint, norm double, checksum double")
    def summarize(texts: pd.Series) -> pd.DataFrame:
        v = embed_batch(texts.tolist(), dimensions, digest)
        return pd.DataFrame({"nonzero": np.count_nonzero(v, axis=1), "norm": (v * v).sum(axis=1), "checksum": v @ np.arange(1.0, dimensions + 1)})

    return summarize


# Embedding providers by name; each is a column function (text column) -> vector column.
PROVIDERS = {"local_hash": embed_udf(digest="blake2b"), "local_md5": embed_udf(digest="md5")}


def register_provider(name: str, embed) -> None:
    """Add an embedding provider, for example a pandas UDF around a hosted model."""
    PROVIDERS[name] = embed
