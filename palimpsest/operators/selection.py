"""Exact order statistics of groups of any size, without sorting a group in one task.

The range of a group's values is cut into equal parts and counted, which combines before the shuffle. The counts say
which part holds the wanted rank, and only its rows are looked at again. A part with few rows is ranked."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.session import scratch, stage

RANGES, FEW = 1024, 100_000  # parts of a range; rows of a part that one task may rank


def quantiles(df: DataFrame, value: str, groups: Sequence[str] = (), qs: Sequence[float] = (0.5, 0.95),
              ranges: int = RANGES, few: int = FEW) -> DataFrame:
    """Exact nearest-rank quantiles per group, as columns q50, q95, ..., and the number ``n`` of values.

    The q-quantile is the least value whose rank is at least q times n, as in ``percentile_disc``. Values are
    numbers; nulls don't count, a group of nulls alone has n = 0 and null quantiles; NaN and infinities are
    ordered as Spark orders them. Every round reads the rows in the part that holds a rank and cuts it into
    ``ranges`` parts; parts of up to ``few`` rows are ranked at once, so small groups need no round. Values that
    all lie in one part of every range, far from outliers, take one round for each such narrowing."""
    spark = df.sparkSession
    with scratch(spark):
        group = F.struct(*[F.col(c) for c in groups], F.lit(0).alias("__one"))
        rows = stage(df.select(group.alias("g"), F.col(value).alias("v")), "selection-rows")
        kind = rows.schema["v"].dataType.simpleString()
        sizes = stage(rows.groupBy("g").agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")), "selection-sizes")
        q = F.explode(F.array(*[F.lit(float(x)) for x in qs])).alias("q")
        targets = sizes.where("n > 0").select("g", "n", "lo", "hi", q)
        targets = stage(targets.select("g", "q", F.greatest(F.lit(1), F.ceil(F.col("q") * F.col("n"))).cast("long").alias("k"), "lo", "hi", F.col("n").alias("size")), "selection-targets")
        done = []
        while True:
            done.append(targets.where("lo = hi").select("g", "q", F.col("lo").alias("found")))
            small = targets.where((F.col("lo") != F.col("hi")) & (F.col("size") <= few))
            rank = F.row_number().over(Window.partitionBy("g", "q").orderBy("v"))
            done.append(_inside(rows, small).withColumn("rank", rank).where("rank = k").select("g", "q", F.col("v").alias("found")))
            large = targets.where((F.col("lo") != F.col("hi")) & (F.col("size") > few))
            if not large.limit(1).count():
                break
            targets = stage(_narrowed(rows, large, ranges), "selection-targets")
        found = done[0]
        for d in done[1:]:
            found = found.unionByName(d)
        columns = [F.max(F.when(F.col("q") == float(x), F.col("found"))).cast(kind).alias(f"q{round(x * 100)}") for x in qs]
        out = sizes.select("g", "n").join(found.groupBy("g").agg(*columns), "g", "left")
        names = [f"q{round(x * 100)}" for x in qs]
        return stage(out.select(*[F.col(f"g.`{c}`").alias(c) for c in groups], "n", *names), "selection", keep=True)


def _inside(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """The rows of each target's range."""
    return rows.join(targets, "g").where((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))


def _narrowed(rows: DataFrame, targets: DataFrame, ranges: int) -> DataFrame:
    """Each target with the part of its range that holds its rank, and the rank within that part.

    Parts follow the order of the values whatever the rounding, so counts of parts add up to ranks. A value
    at infinity or NaN is a part of its own; while there are such ends the finite middle is one part."""
    x, lo, hi = (F.col(c).cast("double") for c in ("v", "lo", "hi"))
    end = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    place = F.least(F.floor((x / 2 - lo / 2) / (hi / 2 - lo / 2) * ranges), F.lit(ranges - 1))
    part = (F.when(F.isnan(x), ranges + 2).when(x == float("inf"), ranges + 1).when(x == float("-inf"), -1)
            .when(end(lo) | end(hi), 0).otherwise(place))
    # equal doubles may differ as longs or decimals: where a range is one double its ends are told apart instead
    part = F.when(lo == hi, F.when(F.col("v") == F.col("lo"), 0).when(F.col("v") == F.col("hi"), 2).otherwise(1)).otherwise(part)
    counts = (_inside(rows, targets).withColumn("part", part.cast("int")).groupBy("g", "q", "k", "part")
              .agg(F.count("*").alias("size"), F.min("v").alias("lo"), F.max("v").alias("hi")))
    upto = F.sum("size").over(Window.partitionBy("g", "q").orderBy("part"))  # at most ``ranges`` rows, whatever the data
    return (counts.withColumn("upto", upto).where("upto >= k and upto - size < k")
            .select("g", "q", (F.col("k") - F.col("upto") + F.col("size")).alias("k"), "lo", "hi", "size"))
