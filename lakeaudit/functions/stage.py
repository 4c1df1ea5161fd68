"""Cutting a plan: results that several later steps read are written once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors can reach: spark.checkpoint.dir. Only a local session, which shares this machine's disk, may leave it unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "/tmp/checkpoints"
    return where.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back; the files go when the application ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of input that are worth a core.
SHARE = 1 << 24


def spread(df: DataFrame) -> DataFrame:
    """df over as many tasks as the session has cores, where its input is too small for so many splits.

    A pass in Python keeps one core busy for each task. Large inputs have enough splits and stay as they are.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * SHARE else df
