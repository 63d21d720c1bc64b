"""Running batch operators over micro-batches, in event-time order and without losing a row.

Keyed histories are not put into per-key state functions: a key with a large share of the stream would then
be one task. Instead a micro-batch releases the rows that are older than the newest time seen less an
allowance; the batch operator runs over them and the few rows per key that later rows depend on (in its
skew-safe form). Younger rows wait in a pending table, so rows that come out of order within the allowance,
and rows of equal time in different batches, get the place they have in a batch run. A row that comes after
its time was released is written to a table of late rows.

Everything is written under the batch id, and a commit row last: a batch that is repeated after a failure
finds its input and overwrites its output, and a stream that is started again on its folder goes on.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.session import shared_folder

ALLOWANCE = 3600  # seconds
COMMIT = "batch_id bigint, seen timestamp, released timestamp, n_late bigint"

Step = Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]  # (state, rows) -> (output, new state)


def events(spark: SparkSession, folder: str, name: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """Stream of the parquet files ``name`` under a folder, with ``ts`` as a timestamp."""
    raw = (spark.readStream.schema(schema).option("pathGlobFilter", name)
           .option("maxFilesPerTrigger", files_per_trigger).parquet(folder))
    return raw.withColumn("ts", raw["ts"].cast("timestamp"))


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder for a stream that will not be started again; others name their own."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], folder: str) -> None:
    """Feed every available micro-batch to ``each(batch, batch_id)`` and stop."""
    query = (stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/checkpoint")
             .trigger(availableNow=True).start())
    query.awaitTermination()


def run_append(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Write an append-mode stream to parquet until the input is used up; return what it wrote. The number of
    rows behind the watermark, which the engine leaves out, goes to ``<folder>/late``."""
    query = (stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint")
             .option("path", f"{folder}/out").trigger(availableNow=True).start())
    query.awaitTermination()
    late = sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)
    spark = stream.sparkSession
    spark.createDataFrame([(str(query.runId), late)], "run_id string, n_late bigint").write.mode("append").parquet(f"{folder}/late")
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


class Tables:
    """The tables of one stream: state and pending rows in two slots each, output and late rows by batch, and
    the commit rows."""

    def __init__(self, spark: SparkSession, folder: str, schemas: dict):
        self.spark, self.folder, self.schemas = spark, folder, schemas

    def last(self, before: int | None = None):
        """The newest commit row (before a batch), or None."""
        try:
            rows = self.spark.read.schema(COMMIT).parquet(f"{self.folder}/commits")
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return None
        return rows.filter(F.lit(True) if before is None else F.col("batch_id") < before).orderBy(F.desc("batch_id")).first()

    def read(self, name: str, batch_id: int | None) -> DataFrame:
        if batch_id is None:
            return self.spark.createDataFrame([], self.schemas[name])
        return self.spark.read.schema(self.schemas[name]).parquet(f"{self.folder}/{name}/slot={batch_id % 2}")

    def write(self, name: str, df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}/slot={batch_id % 2}")

    def write_batch(self, name: str, df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={batch_id}")

    def commit(self, batch_id: int, seen, released, n_late: int) -> None:
        row = self.spark.createDataFrame([(batch_id, seen, released, n_late)], COMMIT)
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/commits/of={batch_id}")


def replay(stream: DataFrame, step: Step, state_schema, name: str, at: str, folder: str | None = None,
           allowance: int = ALLOWANCE) -> DataFrame:
    """Run ``step`` over a stream in event-time order; the rows equal a batch run over all rows that were not
    late. Rows still within the allowance are worked off for the result without being released, so that a
    later start on the same folder may still put others before them. Late rows: ``<folder>/late``."""
    spark = stream.sparkSession
    folder = folder or new_folder(spark, name)
    tables = Tables(spark, folder, {"state": state_schema, "pending": stream.schema})

    def each(batch: DataFrame, batch_id: int) -> None:
        own = Tables(batch.sparkSession, folder, tables.schemas)
        last = own.last(batch_id)
        known = last.batch_id if last else None
        released = last.released if last else None
        newest = batch.agg(F.max(at)).first()[0]
        seen = max([t for t in (newest, last and last.seen) if t is not None], default=None)
        on_time = F.lit(True) if released is None else F.col(at) > F.lit(released)
        late = batch.filter(~on_time | F.col(at).isNull())
        own.write_batch("late", late, batch_id)
        rows = own.read("pending", known).unionByName(batch.filter(on_time & F.col(at).isNotNull()))
        line = F.lit(seen) - F.make_dt_interval(secs=F.lit(allowance))
        out, state = step(own.read("state", known), rows.filter(F.col(at) <= line))
        own.write_batch("out", out, batch_id)
        own.write("state", state, batch_id)
        own.write("pending", rows.filter(F.col(at) > line), batch_id)
        limit = batch.sparkSession.range(1).select(line).first()[0] if seen is not None else None
        own.commit(batch_id, seen, max([t for t in (limit, released) if t is not None], default=None),
                   own.spark.read.schema(stream.schema).parquet(f"{folder}/late/batch={batch_id}").count())

    run_batches(stream, each, folder)
    last = tables.last()
    known = last.batch_id if last else None
    waiting, _ = step(tables.read("state", known), tables.read("pending", known))
    if known is None:
        return waiting
    return spark.read.schema(waiting.schema).parquet(*[f"{folder}/out/batch={i}" for i in range(known + 1)]).unionByName(waiting)
