"""Session-level helpers shared by every operator."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it in spark.checkpoint.dir.

    Where the setting is absent a temporary folder takes its place, but only if driver and executors are one
    process (tests on one machine); on a cluster the absence is an error, since executors would not share it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir names no folder that the executors share")
    if not named:
        named = "file://" + tempfile.mkdtemp(prefix="fakturnik-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Ends the lineage there: a lost executor costs a re-read, not a recomputation, and the plan that
    follows starts from known sizes. The computation runs once (unlike ``checkpoint()``).
    """
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def size_in_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate; exact for a table that was just written by ``cut``."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame) -> DataFrame:
    """The frame over at least as many partitions as there are cores.

    A small table in one file is one task; work that costs far more per row than moving the row is
    then spread. A table that is read in more splits than cores (any large one) is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
