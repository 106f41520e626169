"""Written intermediate tables, in the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SET = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder of this application under spark.checkpoint.dir, which every executor reaches.

    Where the setting is missing, a temporary folder serves a local master; with any other master that is an error, as each executor
    would write to a disk of its own.
    """
    at = spark.conf.get(_SET, None)
    if not at:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError(f"{_SET} must name a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='jobweave-')}"
        spark.conf.set(_SET, at)
    return f"{at.rstrip('/')}/jobweave-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: its lineage ends here, and no executor's loss touches it.

    What is written stays until `dropped` or `release`, as the result may be read at any later time.
    """
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of the path, and its class of paths."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark._jsc.hadoopConfiguration()), at


def dropped(*settled: DataFrame) -> None:
    """Removes the written tables behind the given ones, which nothing reads any more."""
    for df in settled:
        for p in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            fs, at = file_system(df.sparkSession, p)
            fs.delete(at(p), True)


def release(spark: SparkSession) -> None:
    """Removes all that this application has written to the shared folder; for the end of a run, when its results are read or written elsewhere."""
    fs, at = file_system(spark, shared_dir(spark))
    fs.delete(at(shared_dir(spark)), True)


def even(df: DataFrame) -> DataFrame:
    """Even partitions for Python work, where the input alone gives fewer than there are cores (as one small file does)."""
    sc = df.sparkSession.sparkContext
    if df.rdd.getNumPartitions() >= sc.defaultParallelism:
        return df
    return df.repartition(max(sc.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def small(df: DataFrame, most: int = 20_000) -> list:
    """All rows of a table that must be small (rules, vocabularies); refused, not cut, when it isn't."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows where a short list is expected")
    return rows
