"""Alias chains and cycles against a walk of the pointers."""

import random

import pytest

from palimpsest.operators import aliases


def walk(pairs):
    out = {}
    for source in pairs:
        seen, at = [], source
        while at in pairs and at not in seen:
            seen.append(at)
            at = pairs[at]
        out[source] = (min(seen[seen.index(at):]), True) if at in seen else (at, False)
    return out


def resolved(spark, pairs):
    df = spark.createDataFrame(list(pairs.items()), "source_id long, target_id long")
    return {r.source_id: (r.resolved_id, r.cyclic) for r in aliases.resolve(df).collect()}


CASES = {
    "long chain": {i: i + 1 for i in range(300)},
    "chain down": {i: i - 1 for i in range(1, 65)},
    "star": {i: 0 for i in range(1, 100)},
    "cycles and tails": {1: 2, 2: 3, 3: 1, 9: 3, 10: 9, 0: 10, 20: 21, 21: 20, 30: 31, 31: 32},
    "one long cycle": {i: (i + 1) % 37 for i in range(37)} | {100 + i: 101 + i for i in range(20)} | {120: 5},
}


@pytest.mark.parametrize("name", CASES)
def test_resolve(spark, name):
    assert resolved(spark, CASES[name]) == walk(CASES[name])


def test_resolve_random(spark):
    rng = random.Random(3)
    pairs = {i: rng.randrange(400) for i in rng.sample(range(400), 340)}
    pairs = {a: b for a, b in pairs.items() if a != b}
    assert resolved(spark, pairs) == walk(pairs)


def test_resolve_nothing(spark):
    assert resolved(spark, {}) == {} and resolved(spark, {1: 1}) == {}


def test_alias_rows(spark):
    reason = "same text as the older one"
    rows = [(1, 2, reason, "user", "a", 5), (1, 3, reason, "user", "a", 6), (1, 2, reason, "user", "b", 7), (2, 2, reason, "user", "a", 1),
            (4, 2, "  short   ", "user", "a", 1), (5, 2, reason, " ", "a", 1), (6, None, reason, "user", "a", 1), (7, 9, reason, "user", "a", None)]
    df = spark.createDataFrame([(s, t, r, k, a, "h", n) for s, t, r, k, a, n in rows],
                               "source_id long, target_id long, reason string, actor_type string, actor_id string, content_sha256 string, recorded_at long")
    got = {(r.source_id, r.target_id, r.recorded_at): r for r in aliases.alias_rows(df).collect()}
    assert {k: r.rejection for k, r in got.items()} == {
        (1, 2, 5): None, (1, 3, 6): "already_superseded", (1, 2, 7): "already_resolved", (2, 2, 1): "same_identity",
        (4, 2, 1): "reason_length", (5, 2, 1): "actor_missing", (6, None, 1): "identity_missing", (7, 9, None): None}
    assert all((r.basis is None) == (r.rejection is not None) for r in got.values())
    assert '"target_identity_id":"2"' in got[1, 2, 5].basis.replace(" ", "")


def test_workflow_updates(spark):
    links = aliases.resolve(spark.createDataFrame([(1, 2), (2, 3), (8, 9), (9, 8)], "source_id long, target_id long"))
    flows = spark.createDataFrame([(10 * i, i, "quality_review_required", 1) for i in (1, 2, 3, 4, 8, 9)] + [(11, 1, "running", 1)],
                                  "workflow_id long, identity_id long, status string, retry_count long")
    got = {r.workflow_id: (r.new_status, r.new_stage, r.finished, r.retry_count) for r in aliases.workflow_updates(links, flows).collect()}
    gone, back = ("completed", "completed", True, 1), ("pending", "artifact", False, 2)
    assert got == {10: gone, 20: gone, 30: back, 80: back, 90: gone}
