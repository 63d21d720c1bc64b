"""Registered queries next to their SQL twins on small tables made for one rule."""

import random
from datetime import datetime, timedelta
from pathlib import Path

import duckdb

from palimpsest import plans
from palimpsest.operators import search
from palimpsest.plans.registry import Tables, oracle
from palimpsest.session import shared_folder


def both(spark, folder, name, *tables):
    """Rows of a registered query and of its twin over the tables in ``folder``."""
    query, con = plans.load()[name], duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    df = query.build(Tables(spark, str(folder)))
    return sorted(map(tuple, df.collect()), key=str), sorted(con.execute(f"select {', '.join(df.columns)} from ({oracle(query.sql)})").fetchall(), key=str)


def test_taxonomies_of_more_than_500_terms_keep_to_the_sql(spark, tmp_path):
    parts = [(i, f"blue bolt{i % 590}", "Brand#1", "SMALL", 5 + i % 44) for i in range(600)]
    spark.createDataFrame(parts, "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    got, want = both(spark, tmp_path, "taxonomy_violations", "part")
    assert got == want and {r[-1] for r in got} == {"dimension", "label", "duplicate", "parent"}


def test_searches_stage_less_than_they_read(spark, tmp_path):
    lines = [" ".join(f"w{(i * 7 + j * j) % 997}" for j in range(40)) for i in range(60)]
    docs = [(i, "\n".join(lines[(i + k) % 60] for k in range(20)), "en", f"src{i % 3}") for i in range(300)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string").write.option("compression", "none").parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, lines[i]) for i in range(5)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    size = lambda folder: sum(f.stat().st_size for f in Path(folder).rglob("*.parquet") if f.is_file())
    before = size(shared_folder(spark))
    for name in ("full_text_search", "knowledge_text_search", "eligible_search"):
        got, want = both(spark, tmp_path, name, "documents", "benchmark")
        assert got == want and got
    assert size(shared_folder(spark)) - before < size(tmp_path / "documents.parquet") / 10


def test_clauses_that_travel_and_clauses_that_are_joined_find_the_same(spark, rows):
    corpus = spark.createDataFrame([("a", "alpha beta", "x gamma"), ("b", None, "beta gamma gamma"), ("c", "alpha", None)], "section_id string, title string, text string")
    asked = spark.createDataFrame([(1, "alpha"), (2, "beta gamma"), (3, '"gamma gamma" or "alpha beta"'), (4, "gamma -alpha"), (5, "beta"), (6, "")], "query_id bigint, query string")
    cols = ("query_id", "section_id", "text_score", "text_rank", "title")
    found = [rows(search.full_text(corpus, asked, {"title": "A", "text": "C"}, keep=["title"], broadcast=n), *cols) for n in (100, 1)]
    assert found[0] == found[1] and {r[:2] for r in found[0]} == {(1, "a"), (1, "c"), (2, "a"), (2, "b"), (3, "a"), (3, "b"), (4, "b"), (5, "a"), (5, "b")}


def test_section_vectors_are_summed_without_a_shuffle_by_section(spark, tmp_path):
    docs = [(i, f"alpha beta{i}\n...\n\ngamma gamma delta {i}", "en", "src1") for i in range(20)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got, want = both(spark, tmp_path, "section_vectors", "documents")
    assert got == want and len(got) == 40
    df = plans.load()["section_vectors"].build(Tables(spark, str(tmp_path)))
    assert "hashpartitioning(section_id" not in df._jdf.queryExecution().executedPlan().toString()


def test_metric_values_are_rounded_as_in_sql(spark):
    from palimpsest.plans.operations import flat

    sizes = (3, 7, 128, 640, 1280)
    df = spark.sql(f"select 'm' as name, map('b', cast(b as string), 'a', cast(a as string)) as labels, a / b as value "
                   f"from (select explode(array{sizes}) as b) lateral view explode(sequence(0, b)) as a")
    got = {tuple(r) for r in flat(df).select("labels", "value").collect()}
    want = duckdb.sql(f"select 'a=' || a || ',b=' || b, round(a / b, 6) from (select unnest([{','.join(map(str, sizes))}]) as b), range(0, 1281) t(a) where a <= b")
    assert got == set(want.fetchall()) and ("a=41,b=640", 0.064062) in got
    ends = spark.sql("select 'm' as name, map('a', 'b') as labels, explode(array(double('inf'), null)) as value")
    assert {r.value for r in flat(ends).collect()} == {float("inf"), None}


def test_repairs_of_every_kind_keep_to_the_sql(spark, tmp_path):
    rng = random.Random(7)
    at = lambda: datetime(1996, 1, 1) + timedelta(days=rng.randrange(900))
    save = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    save("part", [(i, "Brand#1", "SMALL", i % 50) for i in range(600)], "p_partkey bigint, p_brand string, p_type string, p_size int")
    save("orders", [(i, i % 40, rng.choice("FFOP"), 100.0 + i, at(), "3-MEDIUM") for i in range(200)],
         "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string")
    lines = [(rng.randrange(200), rng.randrange(rng.choice((60, 600))), rng.randrange(3), n, float(rng.randrange(1, 30)), rng.randrange(11) / 100, rng.randrange(9) / 100,
              rng.choice("NAR"), rng.choice("FOOOO"), at()) for n in range(900)]
    save("lineitem", lines, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_discount double, l_tax double, "
         "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz")
    got, want = both(spark, tmp_path, "repair_plan", "part", "orders", "lineitem")
    assert got == want
    assert {r[1] for r in got} == {"fetch_candidate", "manual_review", "extract_artifact", "ocr_artifact", "project_knowledge"}


def test_coverage_counts_artifacts_of_candidates_that_are_not_listed(spark, tmp_path):
    at = datetime(2001, 7, 30)
    save = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    save([(i, f"c{i}", i, 100.0 * i, "BUILDING") for i in range(3)], "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string", "customer")
    save([(i, i % 3, "F", 1000.0 + i, at + timedelta(hours=i), "2-HIGH") for i in range(9)],
         "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string", "orders")
    save([(1, "p1", "Brand#1", "SMALL", 5, 10.0)], "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double", "part")
    save([(i, p, 1, p, 20.0, 10.0, 0.08, 0.02 * p, "A", "F", at) for i in range(9) for p in (1, 2)],  # part 2 is missing
         "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
         "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz", "lineitem")
    save([(i, at + timedelta(minutes=i), i % 3, "error", 20.0, "{}") for i in range(9)],
         "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string", "events")
    for name in ("stage_coverage", "source_metrics"):
        got, want = both(spark, tmp_path, name, "customer", "orders", "part", "lineitem", "events")
        assert got == want and got
    assert {r.artifact_ready for r in plans.load()["stage_coverage"].build(Tables(spark, str(tmp_path))).collect()} == {2}
