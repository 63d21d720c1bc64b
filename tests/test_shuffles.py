"""What the registered queries read and shuffle at size, apart from their rows."""

from palimpsest import plans
from palimpsest.operators import impacts
from palimpsest.plans.registry import Tables

SMALL = "/root/testdata/sf0.001"


def test_runs_are_judged_from_tables_cut_to_the_latest_ones(spark):
    registry = plans.load()
    for name in ("static_admission", "admission_rollup", "source_confidence", "metric_exposition", "firing_alerts", "metric_panels"):
        read = registry[name].build(Tables(spark, SMALL)).inputFiles()
        assert not [f for f in read if f.endswith("lineitem.parquet")], name


def test_generated_candidates_are_judged_in_their_rows(spark):
    schema = ("candidate_id string, expected_item_id int, item_id int, expected_anchor_ids array<string>, citation_ids array<string>, "
              "targets array<struct<dimension:string,code:string>>")
    row = lambda targets: ("same", 1, 1, ["x"], ["x"], targets)
    known, other, blank = ("sector", "digital"), ("sector", "nowhere"), ("sector", None)
    candidates = spark.createDataFrame([row([known]), row([known, other]), row([blank]), row([]), row(None)], schema)
    out = impacts.impact_output_rejection(candidates, spark.createDataFrame([known, blank], "dimension string, code string"))
    assert [r.reason for r in out.collect()] == [None, "unknown_term", "unknown_term", None, None]
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_quality_needs_no_python_process(spark):
    registry = plans.load()
    for name in ("quality_outcomes", "document_quality", "document_reports"):
        plan = registry[name].build(Tables(spark, SMALL))._jdf.queryExecution().executedPlan().toString()
        assert "EvalPython" not in plan, name


def test_repair_reads_the_lines_once_for_each_kind_of_log(spark):
    plan = plans.load()["repair_plan"].build(Tables(spark, SMALL))._jdf.queryExecution()
    assert plan.optimizedPlan().toString().count("Relation [") <= 20
    assert plan.executedPlan().toString().count("Exchange") <= 30
