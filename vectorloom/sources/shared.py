"""The folder that all executors share, and tables written to it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Only where none is set, as on
    a single machine in tests, a temporary folder serves."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if told is None:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        told = known.get() if known.isDefined() else "file://" + tempfile.mkdtemp(prefix="vectorloom-")
        if not known.isDefined():
            spark.sparkContext.setCheckpointDir(told)
    return told


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder, read back: the lineage ends
    there, and the loss of an executor loses nothing."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """The rows on all cores where they come from fewer files than there are
    cores and are less than a scan task's worth for each: such a file often is one row group, which one task
    reads. Larger inputs are left alone, so nothing large is shuffled for this."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores or df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() > cores * (128 << 20):
        return df
    return df.repartition(cores)
