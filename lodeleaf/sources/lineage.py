"""Cutting a plan: small results that are used several times are written to the cluster's shared folder."""

from __future__ import annotations

import gc
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; on a single machine a temporary one where none is set.

    On a cluster a folder of one machine would lose data with it, so without the setting there is an error."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not where:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a shared folder")
        where = Path(tempfile.mkdtemp(prefix="checkpoint-")).as_uri()
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(where)
    return str(where)


def cut(df: DataFrame) -> DataFrame:
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored_once(df: DataFrame, name: str) -> DataFrame:
    """The rows in compressed columns in the shared folder, until the session's end."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    root.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(root)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """At least as many partitions as there are cores, for costly work on a few small files; larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def release(spark: SparkSession) -> None:
    """Lets go of the shuffle files of steps whose results are written: Spark deletes them when the driver's memory
    is collected, which may be long after a step."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
