"""Shared scratch space: where tables are written on the way, and how small scans are dealt out."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder that the driver and all executors share: below spark.checkpoint.dir, or on a single machine below /tmp."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = "/tmp/checkpoints"
    return f"{shared}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Written to the checkpoint folder and read from there: nothing is worked out twice, and a lost executor costs no recomputation.

    Spark removes what is no longer referred to if spark.cleaner.referenceTracking.cleanCheckpoints is true.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or scratch(df.sparkSession))
    return df.checkpoint()


def tidy(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop shuffles and tables that nothing refers to any more: it waits for a collection of the driver's garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def released(df: DataFrame) -> DataFrame:
    """cut(), after which the shuffles and tables that only this one needed are dropped, unless the caller still holds df."""
    spark, done = df.sparkSession, cut(df)
    del df  # its plan holds its shuffles
    tidy(spark)
    return done


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer splits than there are cores is dealt out anew: a single row group can't be split, but what follows can."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df
