"""Ordered histories per key: latest rows, top-n, previous row, carry-forward, running sums.

Two rules keep these safe when one key holds a large share of all rows:

* "latest" is an aggregate (``max_by``), so it combines on the map side and needs no sort;
  "top n" is ``row_number() <= n``, which Spark prunes before the shuffle.
* "previous", "carried" and "running" never put a whole key into one task. A history is cut into
  chunks of the order column (an hour of time, a range of ids, ...); each chunk is windowed on its
  own, one summary row per chunk is windowed over the chunks, and the carry is joined back. Without a
  chunk the history is cut by rank: ranges of (key, order) of about equal size, however the rows are spread
  over keys and times.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.session import stage


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the one that is last in ``order``. Same columns as the input."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"_r.`{c}`").alias(c) for c in df.columns])


def first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the one that is first in ``order``."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"_r.`{c}`").alias(c) for c in df.columns])


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
          rank: str = "rank") -> DataFrame:
    """The first ``n`` rows per key in ``order``, with their 1-based rank."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def hour_chunk(column: str) -> Column:
    """Chunk of a timestamp column: its hour."""
    return F.date_trunc("hour", F.col(column))


def range_chunk(column: str, width: int) -> Column:
    """Chunk of a numeric column: its range of ``width`` values."""
    return F.floor(F.col(column) / F.lit(width))


class History:
    """Builder for chunked per-key windows.

    ``History(df, keys, order, chunk)`` then any of ``previous``, ``carried``, ``running``, then
    ``result()``. ``chunk`` must be non-decreasing in the first order column; keys and chunk must
    not be null. ``order`` must tell the rows of a key apart.

    Without ``chunk`` the rows are written once in ranges of (key, order), one for each shuffle partition.
    Only a key at the border of two ranges needs a carry, so there are at most two summary rows for each range.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column | None = None):
        self.df, self.keys, self.order = df, list(keys), list(order)
        self.chunk = chunk
        self._inner: dict[str, Column] = {}
        self._tail: dict[str, Column] = {}
        self._carry: dict[str, Column] = {}
        self._out: dict[str, Column] = {}
        self._chunk_w = W.partitionBy(*self.keys, "_chunk").orderBy(*self.order)
        self._key_w = W.partitionBy(*self.keys).orderBy("_chunk")
        self._at = F.struct(*self.order)

    def previous(self, **columns: str) -> "History":
        """``out=source``: the source column's value in the row before (null in the first row)."""
        inner, tail = f"_pi{len(self._inner)}", f"_pt{len(self._inner)}"
        value = F.struct(*[F.col(src).alias(out) for out, src in columns.items()])
        self._inner[inner] = F.lag(value).over(self._chunk_w)
        self._tail[tail] = F.max_by(value, self._at)
        self._carry[tail] = F.lag(tail).over(self._key_w)
        for out in columns:
            self._out[out] = F.when(F.col(inner).isNotNull(), F.col(f"{inner}.{out}")).otherwise(
                F.col(f"{tail}.{out}"))
        return self

    def carried(self, out: str, value: Column, inclusive: bool = True) -> "History":
        """Last non-null ``value`` up to this row (or strictly before it)."""
        inner, tail = f"_ci{len(self._inner)}", f"_ct{len(self._inner)}"
        frame = self._chunk_w.rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
        self._inner[inner] = F.last(value, ignorenulls=True).over(frame)
        self._tail[tail] = F.max_by(value, F.when(value.isNotNull(), self._at))
        self._carry[tail] = F.last(F.col(tail), ignorenulls=True).over(
            self._key_w.rowsBetween(W.unboundedPreceding, -1))
        self._out[out] = F.coalesce(F.col(inner), F.col(tail))
        return self

    def running(self, out: str, value: Column, inclusive: bool = True) -> "History":
        """Running sum of a non-null ``value`` up to this row (or strictly before it)."""
        inner, tail = f"_ri{len(self._inner)}", f"_rt{len(self._inner)}"
        frame = self._chunk_w.rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
        self._inner[inner] = F.coalesce(F.sum(value).over(frame), F.lit(0))
        self._tail[tail] = F.sum(value)
        self._carry[tail] = F.coalesce(
            F.sum(F.col(tail)).over(self._key_w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        self._out[out] = F.col(inner) + F.coalesce(F.col(tail), F.lit(0))
        return self

    def numbered(self, out: str) -> "History":
        """1-based row number within the key."""
        return self.running(out, F.lit(1).cast("bigint"))

    def _ranges(self) -> tuple[DataFrame, DataFrame]:
        """The rows with their range as ``_chunk``, and those of them whose key lies in several ranges."""
        parts = int(self.df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = self.df.repartitionByRange(parts, *self.keys, *self.order)
        rows = stage(dealt.withColumn("_chunk", F.spark_partition_id()), "history")
        key = F.struct(*self.keys)
        ends = rows.groupBy("_chunk").agg(F.min(key).alias("low"), F.max(key).alias("high"))
        at = ends.select("_chunk", F.explode(F.array("low", "high")).alias("_key")).distinct()
        cut = at.groupBy("_key").agg(F.count("*").alias("_n")).where("_n > 1").select("_key.*")
        cut = F.broadcast(cut)  # at most one row for each range
        # The order of ranges clusters (keys, _chunk), so the windows need no other shuffle.
        return rows.repartitionByRange(parts, "_chunk"), rows.join(cut, self.keys, "left_semi")

    def result(self) -> DataFrame:
        if self.chunk is None:
            rows, open_ = self._ranges()
        else:
            rows = open_ = self.df.withColumn("_chunk", self.chunk)
        tails = open_.groupBy(*self.keys, "_chunk").agg(*[e.alias(n) for n, e in self._tail.items()])
        heads = tails.select(*self.keys, "_chunk", *[e.alias(n) for n, e in self._carry.items()])
        inner = rows.select("*", *[e.alias(n) for n, e in self._inner.items()])
        # Plain equality on the columns the window is already partitioned and sorted by: the rows
        # are shuffled once, only the small summaries move again.
        joined = inner.join(F.broadcast(heads) if self.chunk is None else heads, [*self.keys, "_chunk"], "left")
        return joined.select(*self.df.columns, *[e.alias(n) for n, e in self._out.items()])


def with_changes(observations: DataFrame, key: str = "resource_id", at: str = "checked_at",
                 row_id: str = "observation_id", digest: str = "content_sha256") -> DataFrame:
    """``content_changed``: the digest differs from the previous observation's of the key (the
    first one counts as changed)."""
    out = History(observations, [key], [at, row_id], hour_chunk(at)).previous(
        previous_observation_id=row_id, _previous=digest).result()
    changed = F.col("previous_observation_id").isNull() | ~F.col(digest).eqNullSafe(F.col("_previous"))
    return out.withColumn("content_changed", changed).drop("_previous")


def with_carried_validators(observations: DataFrame, key: str = "resource_id",
                            at: str = "checked_at", row_id: str = "observation_id",
                            carried: Sequence[str] = ("etag", "last_modified", "content_sha256"),
                            ) -> DataFrame:
    """Link each observation to the one before it; on a 304 response keep the last known
    validators and hash."""
    h = History(observations, [key], [at, row_id], hour_chunk(at)).previous(
        previous_observation_id=row_id)
    for c in carried:
        h = h.carried(f"_carried_{c}", F.when(F.col("response_status") != 304, F.col(c)),
                      inclusive=False)
    out = h.result()
    not_modified = F.col("response_status") == 304
    for c in carried:
        out = out.withColumn(c, F.when(not_modified, F.col(f"_carried_{c}")).otherwise(F.col(c)))
    outcome = F.when(not_modified, "not_modified").when(
        F.col("previous_observation_id").isNull(), "first_seen").otherwise("fetched")
    return out.withColumn("outcome", outcome).drop(*[f"_carried_{c}" for c in carried])


def failure_streaks(runs: DataFrame, key: str = "endpoint_id", at: str = "finished_at",
                    row_id: str = "run_id", unhealthy_at: int = 3) -> DataFrame:
    """Consecutive failures after each run and the health state they imply."""
    failed = F.when(F.col("status") == "failed", 1).otherwise(0).cast("bigint")
    h = History(runs, [key], [at, row_id], hour_chunk(at)).running("_failures", failed).result()
    # Failures counted up to the last success are subtracted: gaps and islands in two passes.
    h2 = History(h, [key], [at, row_id], hour_chunk(at)).carried(
        "_base", F.when(F.col("status") != "failed", F.col("_failures"))).result()
    streak = F.col("_failures") - F.coalesce(F.col("_base"), F.lit(0))
    health = (F.when(streak == 0, "healthy").when(streak >= unhealthy_at, "unhealthy")
              .otherwise("degraded"))
    return (h2.withColumn("consecutive_failures", streak).withColumn("health_state", health)
            .drop("_failures", "_base"))


def status_signals(assessments: DataFrame, key: str = "endpoint_id", at: str = "assessed_at",
                   row_id: str = "assessment_id") -> DataFrame:
    """``alert`` on entering warning or critical, ``recovered`` on a return to healthy where the
    last status other than processing was warning or critical; other rows are dropped."""
    out = (History(assessments, [key], [at, row_id], hour_chunk(at))
           .previous(previous_status="status")
           .carried("previous_signal",
                    F.when(F.col("status") != "processing", F.col("status")), inclusive=False)
           .result())
    bad = ("warning", "critical")
    signal = (
        F.when(F.col("status").isin(*bad)
               & ~F.col("status").eqNullSafe(F.col("previous_status")), "alert")
        .when((F.col("status") == "healthy") & F.col("previous_signal").isin(*bad), "recovered")
    )
    return out.withColumn("signal", signal).filter(F.col("signal").isNotNull())


def review_chain(reviews: DataFrame, key: str = "item_id", at: str = "created_at",
                 row_id: str = "review_id", chunk: Column | None = None) -> DataFrame:
    """Each review with the id of the review it follows and its number in the chain."""
    return (History(reviews, [key], [at, row_id], chunk)
            .previous(previous_review_id=row_id).numbered("review_number").result())


def attempt_numbers(attempts: DataFrame, keys: Sequence[str], at: str, row_id: str) -> DataFrame:
    return (History(attempts, keys, [at, row_id], F.date_trunc("day", F.col(at)))
            .numbered("attempt_number").result())


def as_of_before(left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: str,
                 right_at: str, left_id: str, right_id: str, value: str, out: str) -> DataFrame:
    """Attach to each left row the right row's ``value`` with the greatest time strictly before
    it: both sides are stacked and the last non-null value is carried, range by range."""
    lt = left.select(*keys, F.col(left_at).alias("_at"), F.lit(0).alias("_side"),
                     F.col(left_id).cast("string").alias("_id"), F.col(left_id).alias("_left"),
                     F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    rt = right.select(*keys, F.col(right_at).alias("_at"), F.lit(1).alias("_side"),
                      F.col(right_id).cast("string").alias("_id"),
                      F.lit(None).cast(left.schema[left_id].dataType).alias("_left"),
                      F.col(value).alias("_v"))
    # Left rows sort first among equal times, so only strictly earlier right rows are carried.
    stacked = History(lt.unionByName(rt), keys, ["_at", "_side", "_id"]).carried(
        out, F.col("_v")).result()
    found = stacked.filter(F.col("_side") == 0).select(F.col("_left").alias(left_id), out)
    return left.join(found, left_id, "left")


def interleaved_top_n(df: DataFrame, group: str, order: Sequence[Column], per_group: int,
                      limit: int) -> DataFrame:
    """Up to ``per_group`` first rows of each group, taken in turns across groups, at most
    ``limit`` rows in all (both bounds are the feature)."""
    picked = top_n(df, [group], order, per_group, "turn")
    return picked.orderBy("turn", group).limit(limit)


def over_cap(df: DataFrame, key: str, order: Sequence[str], cap: int, chunk: Column | None = None) -> DataFrame:
    """Every row with ``disposition``: accepted within the first ``cap`` rows of its key, else
    over_cap."""
    out = History(df, [key], order, chunk).numbered("position").result()
    return out.withColumn("disposition", F.when(F.col("position") <= cap, "accepted")
                          .otherwise("over_cap"))


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` (1-based) of ``size`` rows in a total order."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)
