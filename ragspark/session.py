"""Session helpers: settings the jobs rely on, and cutting of lineage."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def tune(spark: SparkSession) -> SparkSession:
    """Runtime settings every job assumes; safe to call on a caller's session."""
    for key, value in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # Split hot join partitions even when it costs one more exchange.
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        # Rows here are whole texts: small batches bound what a Python worker holds.
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
        "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
    }.items():
        spark.conf.set(key, value)
    _ship()
    return spark


def _ship() -> None:
    """Let task closures carry this package's code, so executors need no installation."""
    cloudpickle.register_pickle_by_value(sys.modules["ragspark"])


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only for a local master."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder:
        return folder
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="ragspark-")
    sc.setCheckpointDir(folder)
    return folder


def materialise(df: DataFrame) -> DataFrame:
    """Write a frame once to the shared folder and read it back.

    Used where a costly stage feeds several branches. The table is columnar, so
    each branch reads only its own columns, and it outlives lost executors.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/ragspark/{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def written(df: DataFrame, **options) -> Iterator[DataFrame]:
    """A frame written as by :func:`materialise` for the length of a block, then deleted. ``options`` go to the writer.

    Nothing that is read after the block may depend on it: write what is derived from it first.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/ragspark/{uuid.uuid4().hex}"
    try:
        df.write.mode("error").options(**options).parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written_and_freed(df: DataFrame) -> DataFrame:
    """As :func:`materialise`; the shuffle files of that one job go when it ends, not when the driver collects its garbage."""
    spark = df.sparkSession
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        return materialise(df)
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def spread(df: DataFrame) -> DataFrame:
    """Spread rows over more tasks before a CPU-heavy stage, if the session asks for it.

    ``ragspark.spreadPartitions`` names the number of partitions; 0 leaves the
    scan as it is, which suits tables of many files and is the default on a
    cluster. A local session, whose tables are single small files, uses its cores.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    default = sc.defaultParallelism if sc.master.startswith("local") else 0
    wanted = int(spark.conf.get("ragspark.spreadPartitions", str(default)))
    return df.repartition(wanted) if wanted > 0 else df
