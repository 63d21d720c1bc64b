"""The inverted-file index against brute force: recall, share of the corpus read, exact search, appends."""

import numpy as np
import pytest

import __spark_entry__ as entry
from palimpsest.operators import search
from palimpsest.operators.vector_index import VectorIndex

D = "vector array<double>"


def frame(spark, name, m):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in m], f"{name} bigint, {D}")


def brute(items, queries, k):
    out = {}
    for qid, q in queries:
        d = [(round(1 - float(q @ v) / (np.linalg.norm(q) * np.linalg.norm(v)), 9) + 0.0, i) for i, v in items]
        out[qid] = [i for _, i in sorted(d)[:k]]
    return out


def take(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.vector_rank)):
        out.setdefault(r.query_id, []).append(r.item_id)
    return out


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(120, 24))
    items = [(i, centres[i % 120] + 0.35 * rng.normal(size=24)) for i in range(6000)]
    queries = [(i, centres[i] + 0.35 * rng.normal(size=24)) for i in range(60)]
    return items, queries


def test_recall_and_share(spark, cloud, tmp_path):
    items, queries = cloud
    index = VectorIndex.build(frame(spark, "item_id", items), str(tmp_path / "i"))
    got, want = take(index.search(frame(spark, "query_id", queries), 10)), brute(items, queries, 10)
    recall = np.mean([len(set(got[q]) & set(want[q])) / 10 for q in want])
    sizes = {r["list"]: r["n"] for r in index.list_sizes().collect()}
    assert sum(sizes.values()) == 6000
    units = np.array([q / np.linalg.norm(q) for _, q in queries])
    gaps = ((units[:, None, :] - index.centroids[None]) ** 2).sum(axis=2)
    read = np.mean([sum(sizes.get(int(c), 0) for c in np.argsort(g)[:4]) for g in gaps]) / 6000
    print("recall", recall, "share", read)
    assert recall >= 0.9 and read < 0.05


def test_exact_equals_brute_force(spark, cloud, tmp_path):
    rng = np.random.default_rng(4)
    items = [(i, rng.normal(size=6)) for i in range(500)]
    items += [(500 + i, items[7][1]) for i in range(200)] + [(700 + i, 3.0 * items[7][1]) for i in range(5)]
    queries = [(i, rng.normal(size=6)) for i in range(12)] + [(50, items[7][1])]
    index = VectorIndex.build(frame(spark, "item_id", items), str(tmp_path / "i"))
    q = frame(spark, "query_id", queries)
    want = brute(items, queries, 9)
    assert take(index.search(q, 9, probes=1, exact=True)) == want == take(search.nearest(frame(spark, "item_id", items), q, 9))


def test_recall_of_the_registered_query(spark):
    run = lambda name: {(r.query_id, r.item_id) for r in entry.queries()[name](spark, "/root/testdata/sf0.01").collect()}
    got, want = run("approximate_vector_search"), run("vector_search")
    assert len(got & want) >= 0.9 * len(want)


def test_append_repeats_and_bad_rows(spark, tmp_path):
    rng = np.random.default_rng(6)
    items = [(i, rng.normal(size=4)) for i in range(80)]
    bad = [(1000, None), (1001, np.zeros(4)), (1002, np.array([np.nan, 1, 1, 1])), (1003, np.array([np.inf, 1, 1, 1])), (1004, np.ones(3))]
    index = VectorIndex.build(frame(spark, "item_id", items[:50] + bad), str(tmp_path / "i"), lists=5)
    for _ in range(2):
        index = index.add(frame(spark, "item_id", items[50:] + bad), "b1")
    assert index.rows.count() == 80
    queries = [(1, items[3][1]), (2, items[70][1])]
    q = frame(spark, "query_id", queries + [(3, np.zeros(4)), (4, None)])
    assert take(VectorIndex.open(spark, str(tmp_path / "i")).search(q, 5, exact=True)) == brute(items, queries, 5)


def test_nothing(spark, tmp_path):
    index = VectorIndex.build(frame(spark, "item_id", []), str(tmp_path / "i"))
    assert index.rows.count() == 0 and index.search(frame(spark, "query_id", [(1, np.ones(3))]), 5, exact=True).count() == 0
