"""Session-level helpers: where intermediate tables live."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``). Where it is unset, a session on one machine
    (as in tests) gets a temporary folder; a cluster gets an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_SCRATCH: list[str] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is staged inside goes to a folder of its own, which is deleted at the end; results are staged
    with ``keep``."""
    _SCRATCH.append(f"{shared_folder(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}")
    try:
        yield
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write an intermediate table once to the shared folder and read it back, so that later steps
    neither recompute it nor depend on the executors that made it. With ``keep`` it outlives an open
    ``scratch``."""
    spark = df.sparkSession
    folder = _SCRATCH[-1] if _SCRATCH and not keep else shared_folder(spark).rstrip("/")
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def files(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern, sorted; none where nothing does."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(str(s.getPath().toString()) for s in found or [])


def input_state(spark: SparkSession, *paths: str) -> str:
    """A digest of the names, sizes and times of the files of parquet tables: the same as long as no file is
    added or changed. Reads no column."""
    files = None
    for path in paths:
        seen = spark.read.parquet(path).select(F.xxhash64("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").alias("h")).distinct()
        files = seen if files is None else files.unionByName(seen)
    row = files.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s")).first()
    return f"{row['n']}-{abs(int(row['s'] or 0)):x}"


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash rows over the configured number of shuffle partitions. Unlike an implicit shuffle this
    one is not merged into few tasks at run time, which suits CPU-heavy Python steps on rows that
    are small in bytes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
