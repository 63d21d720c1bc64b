"""Chat formatting with cumulative-snapshot collapse. Native operations only.

Logs often hold a conversation many times, each time with more turns. Turns get rolling prefix hashes: the
sum of position-bound hashes of all turns so far. A conversation whose full hash is a proper prefix hash of a
longer one is a snapshot of it and is dropped by an anti-join, as are later copies of the same conversation.
What is left is rendered.

Positions and running sums are taken in range partitions of (conversation, turn) and carried from one to the
next, so a conversation that holds a large share of all rows is spread over many tasks. Rendered text comes
in pieces of about ``piece`` characters, numbered from 0: nearly always one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.session import stage

PIECE = 1_000_000
ROWS = 50_000  # turns to a range partition, about
SUMS = ("s0", "s1", "s2", "s3")


def _hash(*parts: Column) -> list[Column]:
    """Four 32-bit numbers of two independent 64-bit hashes; nulls are told from empty texts."""
    marked = [x for p in parts for x in (p.isNull(), p)]
    two = [F.xxhash64(F.lit(salt), *marked) for salt in ("a", "b")]
    return [x for h in two for x in (h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32))]


def turns(log: DataFrame) -> DataFrame:
    """Distinct turns without their text: conversation, turn, role, hash of the text, rendered length."""
    return log.select("conv_id", "turn", "role", *_text_key(), F.length(rendered()).cast("long").alias("size")).dropDuplicates(["conv_id", "turn", "role", "t0", "t1"])


def _text_key() -> list[Column]:
    return [F.xxhash64(F.col("text").isNull(), F.col("text")).alias("t0"), F.xxhash64(F.lit("2"), F.col("text")).alias("t1")]


def rendered() -> Column:
    """One turn in the training format."""
    return F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("\n<|end|>\n"))


def prefixes(log: DataFrame) -> DataFrame:
    """Every turn with ``position`` (from 1), its conversation's prefix hash up to it (four sums), and
    ``before``, the rendered characters before it."""
    own = turns(log)
    order = [F.col(c) for c in ("conv_id", "turn", "role", "t0", "t1")]
    parts = max(int(log.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-own.count() // ROWS))
    ranged = stage(own.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "chat-turns")
    inside = Window.partitionBy("part", "conv_id").orderBy(*order[1:])
    placed = ranged.withColumn("n", F.row_number().over(inside))
    ahead = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)

    def carried(df: DataFrame, sums: dict[str, Column]) -> DataFrame:
        """Running totals of each column up to and with the row, across the conversation's parts."""
        totals = df.groupBy("part", "conv_id").agg(*[F.sum(c).alias(f"of_{n}") for n, c in sums.items()])
        start = totals.select("part", "conv_id", *[F.coalesce(F.sum(f"of_{n}").over(ahead), F.lit(0)).alias(f"from_{n}") for n in sums])
        run = inside.rowsBetween(Window.unboundedPreceding, 0)
        local = df.select("*", *[F.sum(c).over(run).alias(f"in_{n}") for n, c in sums.items()])
        s = start.select(F.col("part").alias("s_part"), F.col("conv_id").alias("s_conv"), *[f"from_{n}" for n in sums])
        joined = local.join(s, (F.col("part") == F.col("s_part")) & F.col("conv_id").eqNullSafe(F.col("s_conv")))
        return joined.select(*df.columns, *[(F.col(f"from_{n}") + F.col(f"in_{n}")).alias(n) for n in sums])

    counted = carried(placed.drop("n"), {"position": F.lit(1), "upto": F.col("size")})
    keyed = counted.select("*", *[h.alias(f"h{i}") for i, h in enumerate(_hash(F.col("position"), F.col("role"), F.col("t0"), F.col("t1")))])
    summed = carried(keyed, {s: F.col(f"h{i}") for i, s in enumerate(SUMS)})
    return summed.withColumn("before", F.col("upto") - F.col("size")).drop("part", "upto", "h0", "h1", "h2", "h3")


def maximal(steps: DataFrame) -> DataFrame:
    """``conv_id`` of the conversations to keep: no copy of one with a smaller id, no prefix of a longer one."""
    at = ["position", *SUMS]
    ends = steps.groupBy("conv_id").agg(F.max(F.struct(*at)).alias("end")).select("conv_id", "end.*")
    firsts = ends.groupBy(*at).agg(F.min("conv_id").alias("conv_id"))
    inner = (steps.alias("s").join(ends.select(F.col("conv_id").alias("e_conv"), F.col("position").alias("length")), F.col("conv_id").eqNullSafe(F.col("e_conv")))
             .where("position < length").select(*at).distinct())
    return firsts.join(inner, at, "left_anti").select("conv_id")


def render(log: DataFrame, piece: int = PIECE) -> DataFrame:
    """``conv_id, piece, n_turns, text`` of the maximal conversations of ``(conv_id, turn, role, text)``.

    Turns go by turn number (null first), ties by role, then by a hash of the text; a repeated row counts
    once. Nulls in role or text render as empty; null is a conversation id like any other. An empty log
    gives no rows. Each turn is in the piece in which its first character lies."""
    log = log.select("conv_id", "turn", "role", "text")
    steps = stage(prefixes(log), "chat-prefixes")
    kept = steps.alias("s").join(maximal(steps).select(F.col("conv_id").alias("k_conv")), F.col("conv_id").eqNullSafe(F.col("k_conv")), "left_semi")
    place = kept.select(*[F.col(c).alias("p_" + c) for c in ("conv_id", "turn", "role", "t0", "t1")], "position", F.floor(F.col("before") / piece).cast("int").alias("piece"))
    whole = log.select("*", *_text_key())
    same = [F.col(c).eqNullSafe(F.col("p_" + c)) for c in ("conv_id", "turn", "role", "t0", "t1")]
    parts = whole.join(place, same).groupBy("conv_id", "piece").agg(F.collect_set(F.struct("position", rendered().alias("text"))).alias("turns"))
    ordered = F.transform(F.array_sort("turns"), lambda t: t["text"])
    return parts.select("conv_id", "piece", F.size("turns").cast("long").alias("n_turns"), F.array_join(ordered, "").alias("text"))


SQL = """
with t as (select distinct conv_id, turn, role, text from conversations),
c as (
  select conv_id, list({'r': role, 't': text} order by turn, role, text) turns from t group by conv_id),
firsts as (select min(conv_id) conv_id, turns from c group by turns),
kept as (
  select * from firsts a
  where not exists (select 1 from firsts b where len(b.turns) > len(a.turns) and b.turns[1:len(a.turns)] = a.turns))
select conv_id, cast(0 as int) piece, len(turns) n_turns,
       list_aggregate(list_transform(turns, lambda x: '<|' || coalesce(x.r, '') || '|>' || chr(10) || coalesce(x.t, '') || chr(10) || '<|end|>' || chr(10)), 'string_agg', '') as text
from kept
"""
