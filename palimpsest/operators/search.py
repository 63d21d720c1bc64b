"""Full-text, vector and hybrid search of a table of queries over a corpus of sections.

A single search is a one-row query table. Every ranking is exact; the limits are the features'
own (candidate list length, passages per document, results).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.text import bounded_excerpt, query_title_overlap, tokens
from palimpsest.functions.udf import vectorized
from palimpsest.functions.vectors import embed_batch
from palimpsest.operators.history import top_n
from palimpsest.session import stage

# Rank constant, title boost, list lengths.
RRF_K = 60
TITLE_WEIGHT = 0.025
CANDIDATES = 300
PASSAGES = 3
RESULTS = 200

BROADCAST_QUERIES = 4096

# Integer field weights in fifths (A = 1.0, B = 0.4, C = 0.2), so sums are exact.
WEIGHT_FIFTHS = {"A": 5, "B": 2, "C": 1}

CLAUSE = "array<struct<terms:array<string>,phrases:array<string>,excluded:array<string>>>"


@vectorized(CLAUSE)
def parse_query_udf(text: pd.Series) -> pd.Series:
    """Web-style query text to OR-ed clauses: required terms, quoted phrases, ``-excluded`` terms."""
    import re

    words = re.compile(r"\w+", re.UNICODE)

    def parse(query: str):
        clauses, current = [], {"terms": [], "phrases": [], "excluded": []}
        for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', (query or "").lower()):
            if word == "or" and not minus:
                clauses.append(current)
                current = {"terms": [], "phrases": [], "excluded": []}
                continue
            parts = words.findall(phrase or word)
            if minus:
                current["excluded"].append(" ".join(parts))
            else:
                current["terms"].extend(parts)
                if len(parts) > 1:
                    current["phrases"].append(" ".join(parts))
        clauses.append(current)
        out = []
        for c in clauses:
            c = {k: list(dict.fromkeys(x for x in v if x)) for k, v in c.items()}
            if c["terms"]:
                out.append(c)
        return out

    return pd.Series([parse(q) for q in text])


def _clause_udf(clauses: pd.DataFrame):
    """Text to the ids of the clauses of which it holds all terms. clauses: clause_id, terms."""
    import re

    words = re.compile(r"\w+", re.UNICODE)
    by_word: dict[str, list[tuple[int, frozenset]]] = {}
    for clause_id, terms in zip(clauses["clause_id"], clauses["terms"]):
        by_word.setdefault(max(terms, key=lambda t: (len(t), t)), []).append((int(clause_id), frozenset(terms)))

    @vectorized("array<bigint>")
    def held(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            here = set(words.findall(text.lower()))
            out.append([i for w in by_word.keys() & here for i, terms in by_word[w] if terms <= here])
        return pd.Series(out, index=texts.index, dtype=object)

    return held


def full_text(sections: DataFrame, queries: DataFrame, fields: dict[str, str],
              limit: int = CANDIDATES, keep: Sequence[str] = (), broadcast: int = BROADCAST_QUERIES) -> DataFrame:
    """Ranked sections per query: (query_id, section_id, text_score, text_rank) and the sections'
    columns named by ``keep``.

    ``fields`` maps a text column to its weight class. A section matches when one clause of the
    query has all its terms and phrases and none of its exclusions; the score is the weighted
    count of the query's terms divided by the section's token count.

    The corpus is read once. Each clause is looked up by its longest term; any of its terms would do,
    since a section must hold them all. Up to ``broadcast`` clauses travel with the tasks, and no
    text is shuffled; beyond that the sections' words are joined with these terms. Fields are cut
    into tokens only in sections that hold all terms of a clause.
    """
    clauses = (queries.select("query_id", F.explode(parse_query_udf("query")).alias("_c")).select("query_id", "_c.*")
               .withColumn("clause_id", F.xxhash64("query_id", F.to_json(F.struct("terms", "phrases", "excluded")))).distinct())
    clauses = stage(clauses, "text-clauses")
    # White space between fields keeps their words apart.
    whole = F.concat_ws(" ", *fields)
    corpus = sections.select("section_id", *dict.fromkeys([*keep, *fields]))
    head = clauses.select("clause_id", "terms").limit(broadcast + 1).toPandas()
    if len(head) <= broadcast:
        found = corpus.withColumn("_ids", _clause_udf(head)(whole)).filter("size(_ids) > 0").withColumn("clause_id", F.explode("_ids")).drop("_ids")
    else:
        longest = F.array_max(F.transform("terms", lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))["t"]
        words = corpus.withColumn("_word", F.explode(F.array_distinct(tokens(whole))))
        found = words.join(clauses.select("clause_id", longest.alias("_word")), "_word").drop("_word")
    split = found.select("clause_id", "section_id", *keep, *[tokens(F.coalesce(c, F.lit(""))).alias(f"_t_{c}") for c in fields])
    hits = split.withColumn("_all", F.concat(*[F.col(f"_t_{c}") for c in fields])).join(clauses, "clause_id")
    in_field = lambda phrase: _any([F.contains(
        F.concat(F.lit(" "), F.array_join(f"_t_{c}", " "), F.lit(" ")),
        F.concat(F.lit(" "), phrase, F.lit(" "))) for c in fields])
    matches = (
        F.forall("terms", lambda t: F.array_contains("_all", t))
        & F.forall("phrases", in_field)
        & ~F.exists("excluded", in_field))
    weight = lambda term: sum(
        (F.size(F.filter(f"_t_{c}", lambda x: x == term)) * WEIGHT_FIFTHS[w] for c, w in fields.items()),
        F.lit(0))
    fifths = F.aggregate("terms", F.lit(0), lambda acc, t: acc + weight(t))
    scored = hits.filter(matches).select(
        "query_id", "section_id", *keep, fifths.alias("_fifths"), F.size("_all").alias("_n"))
    # When several clauses of a query hit one section, their weights add up.
    best = scored.groupBy("query_id", "section_id").agg(
        F.sum("_fifths").alias("_f"), F.max("_n").alias("_n"), *[F.first(c).alias(c) for c in keep])
    best = best.withColumn("text_score", F.round(F.col("_f") / (F.col("_n") * 5), 10))
    return top_n(best, ["query_id"], [F.desc("text_score"), F.asc("section_id")], limit,
                 "text_rank").select("query_id", "section_id", "text_score", "text_rank", *keep)


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def _block_top(ids: np.ndarray, vectors: np.ndarray, qids: list, qmat: np.ndarray, k: int) -> pd.DataFrame:
    """The k nearest rows of one block for every query, by cosine distance then id."""
    norms = np.sqrt((vectors * vectors).sum(axis=1))
    keep = norms > 0
    ids, vectors, norms = ids[keep], vectors[keep], norms[keep]
    frames = []
    if len(ids):
        qn = np.sqrt((qmat * qmat).sum(axis=1))
        distance = 1.0 - (qmat @ vectors.T) / (qn[:, None] * norms[None, :])
        distance = np.round(distance, 9) + 0.0
        for q, qid in enumerate(qids):
            d = distance[q]
            if len(d) > k:
                # Everything not farther than the k-th distance, so ties are cut by id, not by luck.
                chosen = np.nonzero(d <= np.partition(d, k - 1)[k - 1])[0]
            else:
                chosen = np.arange(len(d))
            order = sorted(chosen.tolist(), key=lambda i: (d[i], ids[i]))[:k]
            frames.append(pd.DataFrame({"query_id": qid, "item_id": ids[order], "distance": d[order]}))
    if not frames:
        return pd.DataFrame({"query_id": [], "item_id": [], "distance": []})
    return pd.concat(frames, ignore_index=True)


def _keep_top(a: pd.DataFrame, b: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest rows of two lists for every query."""
    both = pd.concat([a, b], ignore_index=True).sort_values(["query_id", "distance", "item_id"], ignore_index=True)
    return both[both.groupby("query_id").cumcount() < k]


def nearest(corpus: DataFrame, queries: DataFrame, k: int, limit: int = BROADCAST_QUERIES,
            block_rows: int = 50_000) -> DataFrame:
    """Exact cosine top-k: (query_id, item_id, distance, vector_rank).

    corpus: item_id and either ``vector`` or ``text`` (embedded on the fly); queries: query_id and
    ``vector``. The query table is counted first. Up to ``limit`` queries travel with the task and
    the corpus is scanned without a shuffle; beyond that both sides are cut into blocks that meet
    in a grid, so neither side is ever held whole. Each block keeps its own top k.
    """
    query_type = queries.schema["query_id"].dataType.simpleString()
    item_type = corpus.schema["item_id"].dataType.simpleString()
    schema = f"query_id {query_type}, item_id {item_type}, distance double"
    queries = queries.filter(F.exists("vector", lambda v: v != 0)).select("query_id", "vector")
    head = queries.limit(limit + 1).toPandas()
    if head.empty:
        return corpus.sparkSession.createDataFrame([], schema + ", vector_rank int")
    dim = len(head["vector"].iloc[0])
    embeds = "text" in corpus.columns
    column = "text" if embeds else "vector"

    def matrix(series: pd.Series) -> np.ndarray:
        if embeds:
            return embed_batch(series.tolist(), dim)
        return np.array(series.tolist(), dtype="float64").reshape(len(series), -1)

    if len(head) <= limit:
        qids, qmat = head["query_id"].tolist(), np.array(head["vector"].tolist(), dtype="float64")

        def scan(batches):
            # One list for each query and task, whatever the number of its batches.
            best = None
            for pdf in batches:
                if len(pdf):
                    top = _block_top(pdf["item_id"].to_numpy(), matrix(pdf[column]), qids, qmat, k)
                    best = top if best is None or best.empty else _keep_top(best, top, k)
            if best is not None:
                yield best

        near = corpus.select("item_id", column).mapInPandas(scan, schema)
    else:
        corpus_blocks = max(1, -(-corpus.count() // block_rows))
        query_blocks = max(1, -(-queries.count() // limit))
        c = (corpus.select("item_id", column)
             .withColumn("_g", F.pmod(F.xxhash64("item_id"), F.lit(corpus_blocks)))
             .withColumn("_h", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))))
        q = (queries.withColumn("_h", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int"))
             .withColumn("_g", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(corpus_blocks - 1).cast("bigint")))))

        def cell(cs: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
            if not len(cs) or not len(qs):
                return pd.DataFrame({"query_id": [], "item_id": [], "distance": []})
            return _block_top(cs["item_id"].to_numpy(), matrix(cs[column]), qs["query_id"].tolist(),
                              np.array(qs["vector"].tolist(), dtype="float64"), k)

        near = c.groupBy("_g", "_h").cogroup(q.groupBy("_g", "_h")).applyInPandas(cell, schema)
    return top_n(near, ["query_id"], [F.asc("distance"), F.asc("item_id")], k, "vector_rank")


def fuse(text: DataFrame, vector: DataFrame, boost: Column | None = None) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists keyed by (query_id, section_id); ``boost`` may
    use columns of the text list and applies to text hits only."""
    t = text.select("query_id", "section_id", "text_score", "text_rank",
                    (boost if boost is not None else F.lit(0.0)).alias("_boost"))
    both = t.join(vector, ["query_id", "section_id"], "full_outer")
    rr = lambda c: F.coalesce(F.lit(1.0) / (F.lit(RRF_K) + F.col(c)), F.lit(0.0))
    score = F.coalesce("_boost", F.lit(0.0)) + rr("text_rank") + rr("vector_rank")
    return both.withColumn("score", F.round(score, 10)).drop("_boost")


def hybrid(sections: DataFrame, queries: DataFrame, query_vectors: DataFrame, fields: dict[str, str],
           limit: int = CANDIDATES, title: str | None = None, mode: str = "hybrid", index=None,
           eligible: DataFrame | None = None) -> DataFrame:
    """Fused section ranking (query_id, section_id, text_score, text_rank, distance, vector_rank,
    score). ``title`` names the column whose overlap with the query boosts text hits. ``mode`` is
    hybrid, full_text or vector. With ``index`` (a :class:`text_index.TextIndex` over the sections)
    text hits come from it and ``sections`` is read for titles and vectors only; sections with a
    ``vector`` column are not embedded again. ``eligible`` (section_id) restricts both lists before
    they are cut at ``limit``."""
    if eligible is not None:
        allowed = eligible.select("section_id").distinct()
        sections = sections.join(allowed, "section_id", "left_semi")
    empty = "query_id bigint, section_id string, distance double, vector_rank int"
    if mode in ("hybrid", "full_text"):
        kept = [title] if title else []
        text = full_text(sections, queries, fields, limit, kept) if index is None else index.search(queries, limit, eligible)
        text = stage(text, "text-list")
        if title:
            if index is not None:
                text = text.join(index.members.select("section_id", title), "section_id")
            text = text.join(queries.select("query_id", "query"), "query_id")
            boost = TITLE_WEIGHT * query_title_overlap(F.col("query"), F.col(title))
        else:
            boost = None
    else:
        text = sections.sparkSession.createDataFrame(
            [], "query_id bigint, section_id string, text_score double, text_rank int")
        boost = None
    if mode in ("hybrid", "vector"):
        corpus = sections.select(F.col("section_id").alias("item_id"), "vector" if "vector" in sections.columns else "text")
        near = stage(nearest(corpus, query_vectors, limit).withColumnRenamed("item_id", "section_id"), "vector-list")
    else:
        near = sections.sparkSession.createDataFrame([], empty)
    return fuse(text, near, boost)


def group_documents(ranked: DataFrame, sections: DataFrame, queries: DataFrame | None = None,
                    results: int = RESULTS, passages: int = PASSAGES) -> DataFrame:
    """Best documents per query with at most ``passages`` passages each.

    Output rows are passages: query_id, identity_id, document_rank, document_score, passage,
    section_id, score and, with ``queries``, the excerpt."""
    slim = sections.select("section_id", "identity_id", *(["text"] if queries is not None else []))
    # Staged, so that a ranking that is small does not make the sections move.
    rows = stage(ranked, "ranked").join(slim, "section_id")
    per_doc = stage(top_n(rows, ["query_id", "identity_id"], [F.desc("score"), F.asc("section_id")],
                          passages, "passage"), "passages")
    docs = (per_doc.filter("passage = 1")
            .select("query_id", "identity_id", F.col("score").alias("document_score"),
                    F.col("section_id").alias("_first")))
    docs = top_n(docs, ["query_id"], [F.desc("document_score"), F.asc("_first")], results,
                 "document_rank").drop("_first")
    out = per_doc.join(docs, ["query_id", "identity_id"])
    if queries is not None:
        out = out.join(queries.select("query_id", "query"), "query_id")
        excerpt = bounded_excerpt(F.col("text"), F.col("query"))
        out = out.withColumn("excerpt", excerpt["excerpt"]).withColumn("truncated", excerpt["truncated"])
    keep = ["query_id", "identity_id", "document_rank", F.round("document_score", 8).alias("document_score"),
            "passage", "section_id", F.round("score", 8).alias("score")]
    return out.select(*keep, *(["excerpt", "truncated"] if queries is not None else []))


def first_hits(ranked: DataFrame, sections: DataFrame, limit: int = 5, rank: str = "vector_rank") -> DataFrame:
    """Identities in the order of their first hit, re-ranked, at most ``limit`` per query."""
    per = (stage(ranked, "ranked").join(sections.select("section_id", "identity_id"), "section_id")
           .groupBy("query_id", "identity_id").agg(F.min(rank).alias("_first")))
    return top_n(per, ["query_id"], [F.asc("_first")], limit, "document_rank").drop("_first")


def relevant_documents(documents: DataFrame, impacts: DataFrame) -> DataFrame:
    """Ranked documents that have impacts for a profile, once per profile, with the number of impacts.
    Ranks stay those of the whole result. documents: query_id, identity_id, document_rank; impacts:
    profile_id, identity_id, impact_id."""
    counts = impacts.groupBy("profile_id", "identity_id").agg(F.count_distinct("impact_id").alias("impact_count"))
    return documents.join(counts, "identity_id")


def retrieval_metrics(queries: DataFrame, documents: DataFrame, expected: DataFrame) -> DataFrame:
    """Mean reciprocal rank and hit@1/3/5 of ranked documents against expected identities.

    queries: query_id; documents: query_id, identity_id, document_rank; expected: query_id,
    identity_id."""
    hit = (documents.join(expected, ["query_id", "identity_id"], "left_semi")
           .groupBy("query_id").agg(F.min("document_rank").alias("rank")))
    r = queries.select("query_id").join(hit, "query_id", "left")
    at = lambda n: F.round(F.avg(F.coalesce((F.col("rank") <= n).cast("double"), F.lit(0.0))), 8)
    return r.agg(F.count(F.lit(1)).alias("case_count"),
                 F.round(F.avg(F.coalesce(F.lit(1.0) / F.col("rank"), F.lit(0.0))), 8).alias("mean_reciprocal_rank"),
                 at(1).alias("hit_at_1"), at(3).alias("hit_at_3"), at(5).alias("hit_at_5"))


def chat_sources(ranked: DataFrame, sections: DataFrame, threads: DataFrame, limit: int = 8) -> DataFrame:
    """Numbered sources per thread: best fused sections; a document-scoped thread without hits
    falls back to the document's first sections.

    ranked: query_id (= thread), section_id, score; threads: query_id, scope_version_id."""
    best = top_n(ranked, ["query_id"], [F.desc("score"), F.asc("section_id")], limit, "source_number")
    best = best.select("query_id", "section_id", "source_number", F.lit(False).alias("fallback"))
    bare = threads.filter("scope_version_id is not null").join(best.select("query_id"), "query_id", "left_anti")
    opening = sections.filter(F.col("ordinal") <= limit).select("version_id", "section_id", "ordinal")
    fallback = (bare.join(opening, F.col("scope_version_id") == F.col("version_id"))
                .select("query_id", "section_id", "ordinal"))
    fallback = top_n(fallback, ["query_id"], [F.asc("ordinal"), F.asc("section_id")], limit, "source_number")
    return best.unionByName(fallback.select("query_id", "section_id", "source_number", F.lit(True).alias("fallback")))
