"""Histories cut by rank: the result of one window per key, and even tasks where one key holds nearly all rows."""
import re
from statistics import median

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.operators.history import History


def skewed(spark, n):
    """Nine tenths of the rows belong to one key and to one hour."""
    key = F.when(F.col("id") % 10 == 0, F.col("id") % 37).otherwise(F.lit(5))
    return spark.range(n).select(
        key.alias("k"), (F.pmod(F.xxhash64("id"), F.lit(3600))).alias("at"), "id",
        F.when(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(4)) == 0, F.col("id")).alias("v"))


def test_ranges_give_what_one_window_gives(spark):
    rows = skewed(spark, 5000)
    got = (History(rows, ["k"], ["at", "id"]).previous(before="id").carried("last", F.col("v"), inclusive=False)
           .running("total", F.lit(2)).numbered("n").result())
    w = Window.partitionBy("k").orderBy("at", "id")
    upto = w.rowsBetween(Window.unboundedPreceding, -1)
    want = rows.select("*", F.lag("id").over(w).alias("before"), F.last("v", ignorenulls=True).over(upto).alias("last"),
                       (2 * F.row_number().over(w)).cast("bigint").alias("total"), F.row_number().over(w).cast("bigint").alias("n"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert History(rows.where("false"), ["k"], ["at", "id"]).numbered("n").result().count() == 0


def test_a_hot_key_is_spread_evenly(spark):
    plan = History(skewed(spark, 20000), ["k"], ["at", "id"]).numbered("n")
    rows, open_ = plan._ranges()
    sizes = sorted(r["count"] for r in rows.groupBy("_chunk").count().collect())
    assert len(sizes) > 2 and sizes[-1] <= 2 * median(sizes)
    text = plan.result()._jdf.queryExecution().executedPlan().toString()
    shuffles = re.findall(r"Exchange \w+\([^)]*", text)
    assert sum("rangepartitioning(_chunk" in x for x in shuffles) == 1  # the rows
    assert sum("hashpartitioning(k" in x and "_chunk" in x for x in shuffles) <= 1, shuffles  # the summaries
