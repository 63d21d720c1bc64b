"""Distributed selection against sorting each group."""
import math
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators.selection import quantiles

QS = (0.0, 0.05, 0.5, 0.95, 1.0)


def sorted_quantiles(rows):
    groups = {}
    for g, v in rows:
        groups.setdefault(g, []).append(v)
    out = {}
    for g, values in groups.items():
        known = sorted((v for v in values if v is not None), key=lambda v: (math.isnan(v), v))
        out[g] = (len(known), *[known[max(1, math.ceil(q * len(known))) - 1] if known else None for q in QS])
    return out


def compare(spark, rows, kind, **limits):
    frame = spark.createDataFrame(rows, f"g string, v {kind}").repartition(5)
    got = {r["g"]: tuple(r)[1:] for r in quantiles(frame, "v", ["g"], QS, **limits).collect()}
    assert repr(sorted(got.items(), key=str)) == repr(sorted(sorted_quantiles(rows).items(), key=str))


@pytest.mark.parametrize("few", [3, 100_000])
def test_quantiles_of_ties_nulls_ends_and_a_hot_group(spark, few):
    rng = random.Random(1)
    rows = [("hot", rng.gauss(0, 1)) for _ in range(900)] + [("hot", 0.25)] * 300 + [("hot", 1e300), ("hot", -1e300), ("hot", None)]
    rows += [(None, rng.choice([1.0, 2.0, 2.5])) for _ in range(50)] + [("null", None)] * 3 + [("one", -0.5)]
    rows += [("ends", v) for v in (float("inf"), float("-inf"), float("nan"), 1.0, 2.0, 3.0, 4.0, 5.0, 6.0)]
    compare(spark, rows, "double", ranges=16, few=few)


def test_quantiles_of_longs_that_doubles_cannot_tell_apart(spark):
    base = 2 ** 62
    compare(spark, [("a", base + i) for i in range(40)] + [("a", 5)], "long", ranges=4, few=2)


def test_quantiles_without_groups_and_without_rows(spark):
    frame = spark.range(1, 1001).select(F.col("id").cast("double").alias("v"))
    assert [tuple(r) for r in quantiles(frame, "v", few=10, ranges=8).collect()] == [(1000, 500.0, 950.0)]
    assert quantiles(frame.where("v < 0"), "v").count() == 0
