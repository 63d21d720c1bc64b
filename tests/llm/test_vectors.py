"""Whitening, centroid clustering and approximate neighbours against brute force."""
import hashlib

import duckdb
import numpy as np
import pytest

from palimpsest.llm import centroids, neighbours, topk, whitening
from palimpsest.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, component string, cluster string, keys int"
NAN, INF = float("nan"), float("inf")


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "c", "k", 1) for i, v in rows], SCHEMA)


def drawn(n, dims, seed, copies=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims)) * np.linspace(1, 3, dims)
    if copies:
        x[rng.choice(n, copies, replace=False)] = x[0]
    return [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]


BROKEN = [(900, None), (901, [NAN] * 64), (902, [INF] + [0.0] * 63), (903, [None] + [1.0] * 63)]


# whitening

def whitened_by_numpy(rows, most=8):
    x = np.array([[int(np.floor(1024 * c)) + 100000 for c in v] for _, v in rows], dtype=object)
    n, total = len(x), x.sum(axis=0)
    deviation = ((n * x - total) ** 2).sum(axis=1)
    y = (x - np.array([s / n for s in total])).astype(float)
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    return deviation, (y @ vectors[:, :most]) / np.sqrt(values[:most]), values[:most] / values.sum()


def test_whitening_is_that_of_the_whole_table(spark):
    good = [*drawn(1500, 64, 1, copies=500), (3, [0.5] * 64), (None, [0.25] * 64)]
    good = [*good, good[5], good[5]]
    got = whitening.whiten(frame(spark, [*BROKEN, *good])).collect()
    assert len(got) == 8 * len(good)
    deviation, w, explained = whitened_by_numpy(good)
    sign = np.zeros(8)
    for c in range(8):
        mine = sorted((r for r in got if r.component == c + 1), key=lambda r: (r.vec_id is None, r.vec_id or 0, r.deviation))
        want = sorted(range(len(good)), key=lambda i: (good[i][0] is None, good[i][0] or 0, deviation[i]))
        assert [r.deviation for r in mine] == [deviation[i] for i in want]
        values, expected = np.array([r.whitened for r in mine]), w[want, c]
        sign[c] = np.sign(values @ expected)
        assert np.abs(values * sign[c] - expected).max() < 1e-9
        assert abs(mine[0].explained / explained[c] - 1) < 1e-9
    assert {r.n for r in got} == {len(good)} and got[0].identity_error < 1e-9


def test_whitening_of_few_equal_short_and_no_vectors(spark):
    assert whitening.whiten(frame(spark, BROKEN)).count() == 0
    assert whitening.whiten(frame(spark, []).where("false")).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    same = whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [(r.component, r.deviation, r.whitened, r.explained, r.identity_error) for r in same if r.vec_id == 1] == [(1, 0, None, None, None), (2, 0, None, None, None)]
    line = whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [3.0, 2.0]), (3, [2.0, 2.0]), (4, [])])).collect()
    assert len(line) == 8 and {r.component for r in line} == {1, 2}  # the empty vector counts as zeros
    huge = whitening.whiten(frame(spark, [(1, [3e38, 1.0]), (2, [-3e38, 1.0]), (3, [0.0, 2.0])])).collect()
    assert all(r.deviation is None for r in huge if r.vec_id == 1)


def test_numbers_are_dense(spark):
    numbered = whitening.numbered(spark.range(1000).repartition(7).where("id % 3 = 0"), "numbers")
    assert sorted(r["at"] for r in numbered.collect()) == list(range(334))


# clustering

def clustered_by_numpy(rows, k=16, rounds=3):
    kept = [(i, np.array([int(np.floor(64 * c)) for c in v], dtype=np.int64)) for i, v in rows]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1].tolist()))
    c = np.array([x for _, x in order[:k]])
    x = np.array([x for _, x in kept])
    for t in range(rounds + 1):
        gap = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        at = gap.argmin(axis=1)
        if t < rounds:
            c = np.array([[int(s) // int((at == j).sum()) for s in x[at == j].sum(axis=0)] if (at == j).any() else c[j] for j in range(len(c))])
    gap = gap.min(axis=1)
    sha = [hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for v in c.tolist()]
    return sorted(((-1 if i is None else i), int(a), int(g), int(gap[at == a].sum()), int(gap.sum()), sha[a]) for (i, _), a, g in zip(kept, at, gap))


def test_clusters_are_those_of_comparing_all(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(9, 64)) * 4
    near = [(i, [float(np.float32(c)) for c in centres[i % 9] + rng.normal(size=64) * 0.2]) for i in range(600)]
    rows = [*near, *[(i, [0.0] * 64) for i in range(2000, 2300)], (None, [1.0] * 64), near[4], near[4], (5, [0.5] * 64), (7, [2.0 ** 19] * 64)]
    table = frame(spark, [*BROKEN, *rows, (904, [1.0] * 63), (905, [])])
    got = sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in centroids.cluster(table).collect())
    assert got == clustered_by_numpy(rows)
    few = [(i, [float(i)] * 64) for i in range(5)]
    assert sorted(tuple(r) for r in centroids.cluster(frame(spark, few)).collect()) == clustered_by_numpy(few)
    assert centroids.cluster(frame(spark, BROKEN)).count() == 0
    held = {r.vec_id: r.distance for r in centroids.cluster(frame(spark, [(1, [3e38] * 64), (2, [-3e38] * 64), (3, [0.0] * 64)])).collect()}
    assert held == {1: 0, 2: 0, 3: 0}


def test_boxes_leave_the_nearest_and_drop_the_far():
    rng = np.random.default_rng(4)
    c = rng.integers(-50, 50, (16, 64))
    c[9] = c[2]
    for spread in (0, 1, 5, 40):
        x = c[rng.integers(0, 16)] + rng.integers(-spread, spread + 1, (128, 64))
        kept = centroids.candidates(x.min(axis=0), x.max(axis=0), c)
        gap = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        assert set(gap.argmin(axis=1)) <= set(kept.tolist()) and 9 not in kept
        assert spread > 5 or len(kept) < 4


def test_curve_visits_neighbouring_cells_in_turn():
    for dims, bits in ((2, 3), (3, 2)):
        cells = np.array(np.meshgrid(*[np.arange(1 << bits)] * dims)).reshape(dims, -1).T
        order = sorted(range(len(cells)), key=lambda i: centroids.hilbert(cells, bits)[i].tobytes())
        step = np.abs(np.diff(cells[order], axis=0)).sum(axis=1)
        assert len(set(map(bytes, centroids.hilbert(cells, bits)))) == len(cells) and set(step) == {1}


# approximate neighbours

def nearest_by_numpy(rows, wanted, k):
    """Per query row the scores of the k best other rows, and the keys in order of score and key."""
    x, keys = np.array([v for _, v in rows]), np.array([i for i, _ in rows])
    out = {}
    for j in wanted:
        score = x @ x[j]
        other = np.arange(len(rows)) != j
        order = np.lexsort((keys[other], -np.round(score[other], 9)))[:k]
        out[j] = [(int(i), s) for i, s in zip(keys[other][order], score[other][order])]
    return out


def test_neighbours_reach_their_recall_with_a_large_group_of_copies(spark):
    rows = drawn(3000, 24, 5, copies=1000)
    copy = rows[0][1]
    table = frame(spark, [*rows, *[(i, v) for i, v in BROKEN], (904, [0.0] * 24), (905, [1.0] * 20)])
    got = neighbours.search(table, table.where("vec_id % 20 = 0 and size(embedding) = 24"))
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    found = {}
    for r in got.collect():
        found.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    want = nearest_by_numpy(rows, range(0, 3000, 20), 20)
    hits = 0
    for q, expected in want.items():
        mine = [found[q][i] for i in range(1, 21)]
        assert [s for _, s in mine] == sorted((s for _, s in mine), reverse=True) and q not in [i for i, _ in mine]
        assert all(abs(s - np.dot(rows[i][1], rows[q][1])) < 1e-9 for i, s in mine)
        hits += len({i for i, _ in mine} & {i for i, _ in expected})
        if rows[q][1] == copy and np.dot(copy, copy) > max(np.dot(copy, v) for _, v in rows if v != copy):
            assert [i for i, _ in mine] == [i for i, _ in expected]
    assert hits >= 0.9 * 20 * len(want)


def test_few_vectors_give_all_others(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (20, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [-1.0, 0.5]), (None, [1.0, 1.0])]
    table = frame(spark, rows)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in neighbours.search(table, table.where("vec_id % 20 = 0")).collect())
    known = [r for r in rows if r[0] is not None]
    want = [(20, i + 1, key, s) for j, near in nearest_by_numpy(known, (0, 1, 2), 20).items() for i, (key, s) in enumerate(near)]
    assert got == sorted(want)
    other = spark.createDataFrame([(1, [2.0, 1.0])], "vec_id long, embedding array<double>")  # no row of the table
    assert [(r.vec_id, r.score) for r in neighbours.search(table, other).orderBy("rank").collect()] == [(3, 2.0), (20, 2.0), (20, 2.0), (20, 1.0), (4, -1.5)]
    assert neighbours.search(frame(spark, BROKEN), table).count() == 0
    assert neighbours.search(table, table.where("false")).count() == 0


@pytest.mark.parametrize("name", ["op11_whitening", "op12_centroids", "op13_neighbours"])
def test_registered(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


# exact top k

def test_top_k_with_many_vectors_of_a_key_and_large_components():
    rng = np.random.default_rng(8)
    for trial in range(60):
        dims, size = int(rng.integers(1, 9)), int(rng.choice([3, 300, 2 ** 20, 2 ** 27]))
        ids = np.repeat(np.arange(60), rng.integers(1, 11, 60))
        x = rng.integers(-size, size + 1, (len(ids), dims))
        x[rng.random(len(ids)) < 0.3] = x[0]
        at = rng.choice(len(ids), 8, replace=False)
        bits = int(np.abs(x).max()).bit_length()
        segments = [((np.abs(x) >> b) & 1).astype(np.uint8) for b in range(bits - 1, -1, -1)]
        got = list(zip(*[c.tolist() for c in topk.best(ids[at], x[at], ids, (x < 0).astype(np.uint8), segments, 5)]))
        want = []
        for j in at:
            score = [(-sum(int(a) * int(b) for a, b in zip(x[j], v)), int(i)) for i, v in zip(ids, x) if i != ids[j]]
            want += [(int(ids[j]), i, -s) for s, i in sorted(score)[:5]]
        assert got == want, trial


def test_top_k_of_a_key_on_several_vectors(spark):
    rows = [*[(50, [float(i), 1.0]) for i in range(7)], *[(i, [0.5, float(i % 3)]) for i in range(80) if i != 50]]
    table = frame(spark, rows)
    got = [(r.vec_id, r.score) for r in topk.search(table, table.where("vec_id = 50")).orderBy("rank").collect()]
    pairs = sorted((-(int(256 * a) * 128 + 256 * int(256 * v[1])), key) for a in range(7) for key, v in rows if key != 50)
    assert got == [(key, -s) for s, key in pairs[:5]]


def test_top_k_sends_no_grid_to_the_driver(spark, monkeypatch):
    for name, value in (("BLOCK", 32), ("QUERIES", 4), ("SPAN", 3), ("PARTS", 2), ("CELLS", 4)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(9)
    x = rng.integers(-400, 401, (500, 6))
    x[rng.random(500) < 0.2] = x[0]
    table = frame(spark, [(i, [float(c) / 256 for c in v]) for i, v in enumerate(x.tolist())])
    found = topk.search(table, table.where("vec_id % 20 = 0"))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found.collect())
    best = {q: sorted((-int(x[q] @ v), i) for i, v in enumerate(x) if i != q)[:5] for q in range(0, 500, 20)}
    assert got == [(q, n, i, -s) for q in best for n, (s, i) in enumerate(best[q], 1)]
