"""Toxicity by cumulative-link ordinal regression.

Severity has the grades 0 to K. One weight vector over sparse word features serves all K thresholds:
P(grade >= k) = sigmoid(w x - theta_k) with rising theta. The output is the expected severity, the sum of
these probabilities.

Where the labels carry a grade it is learnt as it is. Where they only say toxic or not, the grades of the
toxic ones come from the labels too: features that set toxic documents apart form a lexicon, and toxic
documents are graded 1 to 3 by thirds of their number of lexicon hits.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import Batches, as_bytes, column_values, slices, with_columns
from palimpsest.session import stage

MAX_LABELS = 20_000  # labelled documents that the model is fitted on
MAX_WORDS = 4_096  # features
GRADES = 3
CUT = 0.4  # expected severity from which a document counts as toxic
WORD = re.compile(rb"[a-z\x80-\xff]+")
STEMS = (4, 5, 6)  # word beginnings, in bytes, that are features besides the words; they catch inflected forms


def features(text: bytes | None, known=None) -> Counter:
    """Words of the whole text and their beginnings (marked by a star), with their numbers; with ``known``
    only those in it."""
    out: Counter = Counter()
    for w, n in Counter(WORD.findall((text or b"").lower())).items():
        for f in (w, *[w[:k] + b"*" for k in STEMS if k <= len(w)]):
            if known is None or f in known:
                out[f] += n
    return out


@dataclass
class Model:
    weights: dict[bytes, float]
    thresholds: np.ndarray

    def score(self, text: bytes | None) -> float:
        known = self.weights
        return sum(known[f] * math.log1p(n) for f, n in features(text, known).items())

    def at_least(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1.., one row per score."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - scores[:, None], -60, 60)))


def ordinal_fit(rows: np.ndarray, cols: np.ndarray, x: np.ndarray, grade: np.ndarray, n_cols: int, grades: int,
                l2: float = 0.1, steps: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds that maximise the penalised likelihood of the cumulative-link model.

    The design is sparse (row, column, value). Thresholds are a first value and positive gaps, so they stay
    in order; full gradients with adaptive steps."""
    n = len(grade)
    params = np.concatenate((np.zeros(n_cols), [1.0], np.zeros(grades - 1)))
    first, second = np.zeros_like(params), np.zeros_like(params)
    k = np.arange(1, grades + 1)
    for step in range(1, steps + 1):
        w, start, gaps = params[:n_cols], params[n_cols], np.exp(params[n_cols + 1:])
        theta = start + np.concatenate(([0.0], np.cumsum(gaps)))
        s = np.bincount(rows, weights=w[cols] * x, minlength=n)
        up = np.column_stack((np.ones(n), 1 / (1 + np.exp(np.clip(theta - s[:, None], -60, 60))), np.zeros(n)))
        p = np.maximum(up[np.arange(n), grade] - up[np.arange(n), grade + 1], 1e-12)
        slope = up * (1 - up)
        ds = (slope[np.arange(n), grade] - slope[np.arange(n), grade + 1]) / p
        dtheta = np.array([np.sum(np.where(grade == j, -slope[:, j], np.where(grade == j - 1, slope[:, j], 0)) / p) for j in k])
        grad = np.concatenate((np.bincount(cols, weights=ds[rows] * x, minlength=n_cols) - l2 * w,
                               [dtheta.sum()], [dtheta[j:].sum() * gaps[j - 1] for j in range(1, grades)]))
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad ** 2
        params = params + 0.2 * 0.99 ** step * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    theta = params[n_cols] + np.concatenate(([0.0], np.cumsum(np.exp(params[n_cols + 1:]))))
    return params[:n_cols], theta


def least_pairs(text: bytes | None) -> list[int]:
    """Under two hashes the least of a text's word pairs: near copies agree on one of them nearly always."""
    w = WORD.findall((text or b"").lower())
    pairs = {a + b" " + b for a, b in zip(w, w[1:])} or set(w)
    return [min((xxhash.xxh32_intdigest(p, seed) for p in pairs), default=-1) for seed in (1, 2)]


def _counts(batches: Batches) -> Batches:
    for batch in slices(batches, 200):
        counts = [features(t) for t in column_values(batch, "text")]
        sketch = [least_pairs(t) for t in column_values(batch, "text")]
        yield with_columns(batch, ("text",), sketch=pa.array(sketch, pa.list_(pa.int64())), features=pa.array([list(c) for c in counts], pa.list_(pa.binary())),
                           counts=pa.array([list(c.values()) for c in counts], pa.list_(pa.int32())))


def _known(index: dict[bytes, int]):
    """Keep of each document's features those that the model uses, by number."""
    def run(batches: Batches) -> Batches:
        for batch in batches:
            cols, counts = [], []
            for fs, ns in zip(column_values(batch, "features"), column_values(batch, "counts")):
                pairs = [(index[f], n) for f, n in zip(fs, ns) if f in index]
                cols.append([p[0] for p in pairs])
                counts.append([p[1] for p in pairs])
            yield with_columns(batch, ("features", "counts"), cols=pa.array(cols, pa.list_(pa.int32())), counts=pa.array(counts, pa.list_(pa.int32())))

    return run


def fit(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS, max_words: int = MAX_WORDS, grade: str | None = None) -> Model:
    """Fit on at most ``max_labels`` labelled documents, those of the smallest hashed ids.

    Labels are ``doc_id`` and ``toxic`` (0 or 1), or a column ``grade`` (0 to 3); null labels are left out,
    and of several for a document the highest counts. The sample is broadcast and its features, at most
    ``max_labels * max_words`` numbers, are fitted on the driver: both bounds are parameters. Without
    labels of both kinds the model finds nothing toxic."""
    given = F.col(grade or "toxic").cast("int")
    sample = (labels.where(F.col("doc_id").isNotNull() & given.isNotNull()).groupBy("doc_id").agg(F.max(given).alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels))
    chosen = docs.select("doc_id", as_bytes().alias("text")).join(F.broadcast(sample), "doc_id").select("label", "text")
    counted = stage(chosen.mapInArrow(_counts, "label int, sketch array<long>, features array<binary>, counts array<int>")
                    .withColumn("n", F.monotonically_increasing_id()), "labelled-words")
    for i in range(2):  # of copies and near copies one is learnt from: those with the same least word pair
        one = counted.select(F.col("sketch")[i].alias("s"), "label", "n").groupBy("s", "label").agg(F.min("n").alias("n"))
        counted = stage(counted.join(one.select("n"), "n", "left_semi"), "labelled-words")
    n_pos, n_neg = counted.agg(F.count_if(F.col("label") > 0), F.count_if(F.col("label") == 0)).first()
    if not n_pos or not n_neg:
        return Model({}, np.full(GRADES, 60.0))
    pos, neg, total = F.count_if(F.col("label") > 0), F.count_if(F.col("label") == 0), n_pos + n_neg
    seen = F.col("pos") + F.col("neg")
    gap = F.col("pos") * F.lit(float(n_neg)) - F.col("neg") * F.lit(float(n_pos))
    chi2 = gap * gap * total / (seen * (total - seen) * float(n_pos) * float(n_neg))
    vocab = (counted.select("label", F.explode("features").alias("word")).groupBy("word").agg(pos.alias("pos"), neg.alias("neg"))
             .where((seen >= max(3, total // 2500)) & (seen < total)).withColumn("chi2", chi2)
             .where(F.col("chi2") >= 5 * math.log(total) - 12)  # more words to try, a higher bar
             .orderBy(F.desc("chi2"), "word").limit(max_words).select("word", "pos", "neg").collect())
    if not vocab:
        return Model({}, np.full(GRADES, 60.0))
    index = {bytes(r.word): i for i, r in enumerate(vocab)}
    odds = np.array([math.log((r.pos + 0.5) / (n_pos + 1)) - math.log((r.neg + 0.5) / (n_neg + 1)) for r in vocab])
    small = counted.select("n", "label", "features", "counts").mapInArrow(
        _known(index), "n long, label int, cols array<int>, counts array<int>")
    rows, cols, x, labels_, hits = [], [], [], [], []
    for i, r in enumerate(small.orderBy("n").toLocalIterator()):
        labels_.append(r.label)
        hits.append(sum(n for c, n in zip(r.cols, r.counts) if odds[c] > 2))
        rows += [i] * len(r.cols)
        cols += r.cols
        x += [math.log1p(n) for n in r.counts]
    label, hit = np.array(labels_), np.array(hits)
    if grade is None and (hit[label > 0] > 0).any():
        thirds = np.quantile(hit[(label > 0) & (hit > 0)], [1 / 3, 2 / 3])
        label = np.where(label > 0, 1 + (hit > thirds[0]) + (hit > thirds[1]), 0)
    w, theta = ordinal_fit(np.array(rows, int), np.array(cols, int), np.array(x, float), np.clip(label, 0, GRADES), len(vocab), GRADES)
    return Model({word: float(w[i]) for word, i in index.items()}, theta)


def severity(docs: DataFrame, model: Model, text: str = "text", cut: float = CUT) -> DataFrame:
    """Add ``severity`` (expected grade), ``p_at_least`` (probabilities of grade 1, 2, 3 or more) and
    ``toxic`` (severity of ``cut`` or more) from the whole text; such columns of the input are replaced.
    Null and empty texts carry no features and get the base rate. No shuffle."""
    added = ("severity", "p_at_least", "toxic")
    kept = [f for f in docs.schema.fields if f.name not in added]
    source = docs.select(*[F.col(f"`{f.name}`") for f in kept])
    if text in source.columns:  # the worker takes the text from its column, so that it is sent once
        return source.mapInArrow(_scores(model, cut, lambda batch: batch.column(batch.schema.get_field_index(text))), _scored(kept))
    source = docs.select(*[F.col(f"`{f.name}`") for f in kept], as_bytes(f"`{text}`").alias("__text"))
    return source.mapInArrow(_scores(model, cut, lambda batch: batch.column(batch.num_columns - 1), ("__text",)), _scored(kept))


def _scored(kept: list[T.StructField]) -> T.StructType:
    return T.StructType([*kept, T.StructField("severity", T.DoubleType()), T.StructField("p_at_least", T.ArrayType(T.DoubleType())), T.StructField("toxic", T.BooleanType())])


def _scores(model: Model, cut: float, texts, drop: tuple[str, ...] = ()):
    """Add the model's columns to batches whose texts ``texts`` takes out."""
    def run(batches: Batches) -> Batches:
        for batch in slices(batches, 1000):
            s = np.array([model.score(t) for t in texts(batch).cast(pa.binary()).to_pylist()], float)
            p = model.at_least(s)
            expected = p.sum(axis=1)
            yield with_columns(batch, drop, severity=pa.array(expected), p_at_least=pa.array(list(p), pa.list_(pa.float64())), toxic=pa.array(expected >= cut))

    return run


def drop_toxic(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The documents below the cut, with their own columns, whatever their names. Null and empty texts get the base
    rate, repeated rows are judged each."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"))
    at = docs.columns.index("text")
    scored = whole.mapInArrow(_scores(fit(docs, labels), cut, lambda batch: pc.struct_field(batch.column(0), [at])), _scored(whole.schema.fields))
    return scored.where("not toxic").select("__doc.*")
