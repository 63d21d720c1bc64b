"""Histories, rules, matching, search and sinks on literal rows; replay and partition invariance."""

import random

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.vectors import embed_udf
from palimpsest.operators import gates, history, impacts, quality, reliability, search, usage, workflow
from palimpsest.operators.vector_index import VectorIndex
from palimpsest.sinks import tables as sinks


def log(spark, n=400, seed=5):
    """A log where one key holds most rows, with equal times and nulls."""
    rng = random.Random(seed)
    rows = [(i, "hot" if rng.random() < 0.7 else f"k{rng.randrange(4)}", rng.randrange(0, 60 * 48), rng.choice([None, 1, 2, 3]), rng.choice(["failed", "failed", "completed"]))
            for i in range(n)]
    df = spark.createDataFrame(rows, "id bigint, k string, m int, v int, status string")
    return df.withColumn("at", F.expr("timestamp_ntz'2024-01-01' + make_interval(0,0,0,0,0,m,0)"))


def test_chunked_history_equals_plain_windows(spark):
    df = log(spark)
    got = (history.History(df, ["k"], ["at", "id"], history.hour_chunk("at")).previous(p="v", pid="id").carried("c", F.col("v"))
           .carried("cb", F.col("v"), inclusive=False).running("r", F.coalesce("v", F.lit(0)).cast("bigint")).numbered("n").result())
    w = W.partitionBy("k").orderBy("at", "id")
    want = df.select("*", F.lag("v").over(w).alias("p"), F.lag("id").over(w).alias("pid"), F.last("v", True).over(w).alias("c"),
                     F.last("v", True).over(w.rowsBetween(W.unboundedPreceding, -1)).alias("cb"),
                     F.sum(F.coalesce("v", F.lit(0)).cast("bigint")).over(w).alias("r"), F.row_number().over(w).alias("n"))
    cols = ["id", "p", "pid", "c", "cb", "r", "n"]
    key = lambda d: sorted(tuple(r) for r in d.select(*cols).na.fill(-1).collect())
    assert key(got) == key(want)


def test_hot_key_windows_stay_chunked(spark):
    """No window of a history operator is partitioned by the key alone over the rows themselves."""
    plan = history.History(log(spark), ["k"], ["at", "id"], history.hour_chunk("at")).previous(p="v").result()._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) == 2 and sum("_chunk" in line.split("], [")[1] for line in windows) >= 1


def test_failure_streak_states(spark):
    df = spark.createDataFrame([(1, "e", "failed"), (2, "e", "failed"), (3, "e", "failed"), (4, "e", "completed")], "run_id bigint, endpoint_id string, status string")
    df = df.withColumn("finished_at", F.expr("timestamp_ntz'2024-01-01' + make_interval(0,0,0,0,cast(run_id as int),0,0)"))
    got = [r.health_state for r in history.failure_streaks(df).orderBy("run_id").collect()]
    assert got == ["degraded", "degraded", "unhealthy", "healthy"]


def test_signals_alert_once_and_recover_once(spark):
    states = ["healthy", "critical", "critical", "processing", "healthy", "healthy", "warning", "critical"]
    df = spark.createDataFrame([(i, "e", s) for i, s in enumerate(states)], "assessment_id bigint, endpoint_id string, status string")
    df = df.withColumn("assessed_at", F.expr("timestamp_ntz'2024-01-01' + make_interval(0,0,0,0,cast(assessment_id as int),0,0)"))
    got = [(r.assessment_id, r.signal) for r in history.status_signals(df).orderBy("assessment_id").collect()]
    assert got == [(1, "alert"), (4, "recovered"), (6, "alert"), (7, "alert")]


def test_not_modified_keeps_validators(spark):
    df = spark.createDataFrame([(1, "r", 200, "e1", "h1"), (2, "r", 304, None, None), (3, "r", 200, "e2", "h2")], "observation_id bigint, resource_id string, response_status int, etag string, content_sha256 string")
    df = df.withColumn("last_modified", F.lit(None).cast("string")).withColumn("checked_at", F.expr("timestamp_ntz'2024-01-01' + make_interval(0,0,0,0,cast(observation_id as int),0,0)"))
    got = [(r.etag, r.content_sha256, r.outcome) for r in history.with_carried_validators(df).orderBy("observation_id").collect()]
    assert got == [("e1", "h1", "first_seen"), ("e1", "h1", "not_modified"), ("e2", "h2", "fetched")]


TERMS = "jurisdiction:malaysia regulated_role:data-user activity:process-personal-data"


def match(spark, profile, targets):
    split = lambda text: [tuple(x.split(":")) for x in text.split()]
    terms = spark.createDataFrame([("p", d, c) for d, c in split(profile)], "profile_id string, dimension string, code string")
    goal = spark.createDataFrame([("i", d, c, "excluded" if d.startswith("-") else "included") for d, c in split(targets)], "impact_id string, dimension string, code string, disposition string")
    goal = goal.withColumn("dimension", F.regexp_replace("dimension", "^-", ""))
    pairs = spark.createDataFrame([("p", "i")], "profile_id string, impact_id string")
    r = impacts.match_profiles(pairs, terms, goal).first()
    return r.outcome, r.unmet, r.unresolved


def test_profile_matching_scenarios(spark):
    goal = TERMS + " size:any-size"
    assert match(spark, TERMS, goal) == ("matched", [], [])
    assert match(spark, "jurisdiction:malaysia activity:process-personal-data", goal) == ("insufficient_context", [], ["regulated_role"])
    assert match(spark, "jurisdiction:malaysia regulated_role:employer activity:process-personal-data", goal) == ("not_matched", ["regulated_role"], [])
    assert match(spark, TERMS, "jurisdiction:malaysia -regulated_role:data-user")[0] == "not_matched"
    assert match(spark, TERMS, "-regulated_role:employer") == ("insufficient_context", [], ["included_target"])


def test_impact_rules_on_their_own_wording(spark):
    text = "A data user must notify the board within 30 days and shall not retain personal data; a penalty applies."
    df = spark.createDataFrame([(text,), ("A bank may pay.",), ("Nothing here.",)], "t string")
    got = [(r.k, sorted(f"{x.dimension}:{x.code}" for x in r.g)) for r in df.select(impacts.impact_types(F.col("t")).alias("k"), impacts.target_terms(F.col("t")).alias("g")).collect()]
    assert got[0][0] == ["obligation", "reporting", "deadline", "prohibition", "penalty"]
    assert got[0][1] == ["activity:process-personal-data", "jurisdiction:malaysia", "regulated_role:data-user", "sector:cross-sector", "size:any-size"]
    assert got[1] == (["permission"], ["jurisdiction:malaysia", "sector:financial-services", "size:any-size"])
    assert got[2][0] == []


def test_answer_citations(spark):
    answers = spark.createDataFrame([("x", "Yes [1, 2]."), ("y", "Yes [1]."), ("z", "No marker.")], "answer_id string, answer string")
    cites = spark.createDataFrame([("x", 1, 1, "keep records"), ("x", 2, 2, "made up"), ("y", 1, 1, "KEEP  records"), ("y", 2, 2, "pay fees")], "answer_id string, position int, source_number int, quote string")
    src = spark.createDataFrame([(a, n, f"s{n}", t) for a in "xyz" for n, t in ((1, "Firms keep\nrecords."), (2, "Firms pay fees."))], "answer_id string, source_number int, section_id string, text string")
    got = {r.answer_id: (r.reason, r.source_numbers) for r in impacts.answer_citations(answers, cites, src).collect()}
    assert got == {"x": ("unverified_answer_markers", []), "y": (None, [1]), "z": ("missing_answer_markers", [])}


def corpus(spark):
    rows = [("1:1", "d1", "Data rules", "personal data must be kept safe by every data user"), ("2:1", "d2", "Fees", "annual fees are due in march"),
            ("3:1", "d3", "Notice", "give notice of any transfer of personal data"), ("4:1", "d4", "Old", "safe storage of paper files")]
    return spark.createDataFrame(rows, "section_id string, identity_id string, title string, text string").withColumn("heading", F.lit(""))


@pytest.mark.parametrize("query,hits", [
    ("personal data", ["1:1", "3:1"]), ("personal data -notice", ["1:1"]), ('"data user"', ["1:1"]), ('"user data"', []), ("fees or notice", ["2:1", "3:1"]), ("absentword", []), ("-fees", [])])
def test_web_query_forms(spark, query, hits):
    q = spark.createDataFrame([(1, query)], "query_id bigint, query string")
    got = sorted(r.section_id for r in search.full_text(corpus(spark), q, {"title": "A", "heading": "B", "text": "C"}).collect())
    assert got == hits


def test_text_score_is_weighted_frequency_over_length(spark):
    q = spark.createDataFrame([(1, "data")], "query_id bigint, query string")
    got = {r.section_id: r.text_score for r in search.full_text(corpus(spark), q, {"title": "A", "heading": "B", "text": "C"}).collect()}
    assert got["1:1"] == pytest.approx((1.0 + 2 * 0.2) / 12) and got["3:1"] == pytest.approx(0.2 / 9)


def test_nearest_paths_equal_brute_force(spark, tmp_path):
    rng = np.random.default_rng(1)
    vs, qs = rng.normal(size=(60, 8)), rng.normal(size=(7, 8))
    vs[5] = vs[6]
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vs)], "item_id bigint, vector array<double>")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(qs)], "query_id bigint, vector array<double>")
    d = np.round(1 - (qs @ vs.T) / (np.linalg.norm(qs, axis=1)[:, None] * np.linalg.norm(vs, axis=1)[None]), 9)
    want = {(i, j, r + 1) for i in range(7) for r, j in enumerate(sorted(range(60), key=lambda x: (d[i, x], x))[:5])}
    take = lambda df: {(r.query_id, r.item_id, r.vector_rank) for r in df.collect()}
    assert take(search.nearest(c, q, 5)) == want
    assert take(search.nearest(c, q, 5, limit=2, block_rows=13)) == want
    index = VectorIndex.build(c, f"{tmp_path}/index", lists=8)
    assert take(index.search(q, 5, exact=True)) == want
    found = take(index.search(q, 5, probes=6))
    assert len({(a, b) for a, b, _ in found} & {(a, b) for a, b, _ in want}) >= 0.8 * len(want)


def test_embeddings_are_deterministic_unit_vectors(spark):
    df = spark.createDataFrame([("Personal data rules",), ("Personal data rules",), ("",)], "t string")
    for digest in ("md5", "blake2b"):
        a, b, empty = [r.v for r in df.select(embed_udf(digest=digest)("t").alias("v")).collect()]
        assert a == b and len(a) == 384 and sum(x * x for x in a) == pytest.approx(1.0) and not any(empty)


def test_duplicate_quality_findings(spark):
    text = "Title words\n" + "personal data protection guidance for organizations and the public at large " * 8
    v = spark.createDataFrame([(1, "Title words", text), (2, "Title words", text), (3, "Other", "Other\n" + text.upper())], "version_id bigint, title string, content string").withColumn("content_sha256", F.sha2("content", 256))
    s = v.select(F.concat(F.col("version_id").cast("string"), F.lit(":1")).alias("section_id"), "version_id", F.posexplode(F.split("content", "\n")).alias("ordinal", "text")).withColumn("text_sha256", F.sha2("text", 256))
    got = {r.version_id: (r.outcome, [f.code for f in r.findings]) for r in quality.assess(v, s).collect()}
    assert got[1] == got[2] == ("review_required", ["duplicate_normalized_content", "high_repeated_content"]) and got[3] == ("passed", [])


def test_pdf_findings(spark):
    v = spark.createDataFrame([(1, "t", "t words " * 80, "a", True, 10, 7, True), (2, "t", "t other " * 80, "b", True, 10, 9, False)],
                              "version_id bigint, title string, content string, content_sha256 string, is_pdf boolean, page_count int, extracted_pages int, requires_ocr boolean")
    s = v.select("version_id", F.explode(F.array(F.lit("x1"), F.lit("x2"))).alias("text")).withColumn("text_sha256", F.concat("text", F.col("version_id").cast("string")))
    got = {r.version_id: [f.code for f in r.findings] for r in quality.assess(v, s).collect()}
    assert got == {1: ["low_pdf_page_coverage", "pdf_requires_ocr"], 2: ["incomplete_pdf_page_coverage"]}


def test_processing_inside_grace_then_warning(spark):
    e = spark.sql("select 1 as endpoint_id, true as is_enabled, false as requires_javascript, 'healthy' as health_state, timestamp_ntz'2024-01-02' as next_poll_at, 60 as polling_interval_minutes")
    r = spark.sql("select 10 as run_id, 1 as endpoint_id, 'completed' as status, timestamp_ntz'2024-01-01 00:00:00' as created_at, timestamp_ntz'2024-01-01 00:00:00' as finished_at")
    cov = spark.sql("select 1 as endpoint_id, 10 as run_id, 2L as candidate_count, 0L as artifact_ready, 0L as extraction_ready, 0L as graph_ready, 0L as version_count, 0L as section_count, 0L as local_embedding_ready, 0L as configured_embedding_ready")
    ch = spark.sql("select 1 as endpoint_id, false as set_changed")
    status = lambda t: reliability.assess(e, r, cov, ch, t).first().status
    assert status("2024-01-01 00:20:00") == "processing" and status("2024-01-01 02:00:00") == "warning" and status("2024-01-03 00:00:00") == "critical"


def test_engaged_users_need_everything(spark):
    rows = [(u, a, p) for u in (1, 2, 3) for a, p in (("search", u), ("download", None), ("feedback", None))] + [(4, "search", None), (4, "download", None), (4, "feedback", None)]
    ev = spark.createDataFrame(rows, "actor_id bigint, action string, profile_id bigint")
    owners = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "user_id bigint")
    assert sorted(r.user_id for r in usage.engaged_users(ev, owners).collect()) == [1, 2, 3]


def test_gates_and_workflow_status(spark):
    df = spark.createDataFrame([(1, True, None), (2, True, True)], "k bigint, a boolean, b boolean")
    roll = {r.k: (r.passed_count, r.ready) for r in gates.gate_rollup(gates.to_gates(df, "k", {"a": F.col("a"), "b": F.col("b")}), "k").collect()}
    assert roll == {1: (1, False), 2: (2, True)}
    cols = "workflow_id bigint, stored_ok boolean, extraction_status string, content_changed boolean, quality_outcome string, provenance_status string, has_pair boolean, material_changes bigint"
    st = spark.createDataFrame([(1, True, "succeeded", True, "passed", "verified", False, None), (2, True, "succeeded", True, "warning", "verified", True, 2),
                                (3, True, "succeeded", False, None, None, None, None), (4, True, "ocr_required", None, None, None, None, None)], cols)
    got = {r.workflow_id: r.status for r in workflow.workflow_status(st).collect()}
    assert got == {1: "completed", 2: "review_required", 3: "no_content_change", 4: "waiting_ocr"}


def test_appending_twice_adds_nothing(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k bigint, v string")
    path = str(tmp_path / "t")
    sinks.append_new(df, path, ["k"])
    sinks.append_new(df, path, ["k"])
    sinks.append_new(spark.createDataFrame([(2, "z"), (3, "c")], "k bigint, v string"), path, ["k"])
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "b"), (3, "c")]
    blob = spark.createDataFrame([(bytearray(b"x"),), (bytearray(b"x"),), (bytearray(b"y"),)], "content binary")
    for _ in range(2):
        sinks.put_blobs(blob, "content", str(tmp_path / "b"), "ns")
    assert spark.read.parquet(str(tmp_path / "b")).count() == 2


def test_results_do_not_depend_on_partitions(spark):
    df = log(spark, 200)
    seen = set()
    for n in (1, 8, 60):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        out = history.failure_streaks(df.withColumnRenamed("id", "run_id").withColumnRenamed("k", "endpoint_id").withColumnRenamed("at", "finished_at").repartition(n))
        seen.add(tuple(sorted((r.run_id, r.consecutive_failures) for r in out.collect())))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert len(seen) == 1
