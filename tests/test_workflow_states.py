"""The fold of stage attempts against a plain loop, and the states that the registered twin covers."""

import random

import duckdb

import __spark_entry__ as entry
from palimpsest.operators import workflow

SF = "/root/testdata/sf0.01"


def loop(attempts):
    """(status, stage) by walking the transitions, for the latest outcome of each stage."""
    table = {(s, o): (status, then, go) for s, o, status, then, go in workflow.TRANSITIONS}
    status, stage = "pending", "artifact"
    while True:
        status, then, go = table.get((stage, attempts.get(stage)), ("failed", stage, False))
        if not go:
            return status, then
        stage = then


def test_fold_against_loop(spark):
    rng = random.Random(5)
    outcomes = sorted({o for _, o, *_ in workflow.TRANSITIONS if o}) + ["odd", None]
    rows, want = [], {}
    for i in range(1500):
        last = {}
        for s in workflow.STAGES[:9]:
            for n in range(rng.choice((0, 1, 1, 1, 2))):
                good = [o for t, o, _, _, go in workflow.TRANSITIONS if t == s and go]
                o = rng.choice(good) if good and rng.random() < 0.8 else rng.choice(outcomes)
                rows.append((i, s, n, o))
                last[s] = o or "?"
        want[i] = loop(last)
    rows.append((0, "no such stage", 1, "failed"))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "workflow_id long, stage string, attempt_number int, outcome string")
    got = {r.workflow_id: (r.status, r.stage) for r in workflow.workflow_states(spark.range(1500).withColumnRenamed("id", "workflow_id"), df).collect()}
    assert got == want


def test_hot_workflow_and_none(spark):
    hot = spark.range(20_000).selectExpr("1L AS workflow_id", "'artifact' AS stage", "id AS attempt_number", "if(id = 19999, 'queued', 'failed') AS outcome")
    flows = spark.createDataFrame([(1,), (2,)], "workflow_id long")
    got = {r.workflow_id: (r.status, r.stage, r.passed) for r in workflow.workflow_states(flows, hot).collect()}
    assert got == {1: ("queued", "artifact", 0), 2: ("pending", "artifact", 0)}


def test_twin_covers_every_state():
    con = duckdb.connect()
    for name in ("orders", "lineitem"):
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    rows = con.execute(entry.oracle_sql()["workflow_states"]).fetchall()
    assert {r[1] for r in rows} == set(workflow.STATUSES)
    assert {r[2] for r in rows} == set(workflow.STAGES)
