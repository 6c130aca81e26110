"""Where intermediate tables go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Only a local session, as in tests, gets a
    temporary folder of its own when none is named."""
    named = spark.conf.get(CHECKPOINT_CONF, None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="threadlens-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Used where several later steps read the same costly result: they scan the
    written columns they need, and a lost executor costs a re-read, not a re-run.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_folders(df: DataFrame, name: str, column: str) -> DataFrame:
    """``materialise`` with a folder for each value of a column; whoever filters by it reads no others."""
    path = new_path(df.sparkSession, name)
    last = [*[c for c in df.columns if c != column], column]
    df.repartition(column).write.partitionBy(column).parquet(path)
    return df.sparkSession.read.schema(df.select(last).schema).parquet(path)


def spread(scan: DataFrame, key: str) -> DataFrame:
    """Give a table just read at least one partition per core.

    A small file can hold all of its rows in one row group and so in one task; text
    work on it would then use one core. A table with enough splits is returned as
    it is, so nothing is shuffled where data is large.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() >= cores:
        return scan
    return scan.repartition(cores, key)
