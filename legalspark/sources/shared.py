"""Folders that driver and executors share, and tables written there."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder below the one in spark.checkpoint.dir. Where that is unset, a local session gets a temporary one; on a
    cluster it would not be shared, so it is an error."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df written to a shared folder and read back: computed once, whatever reads it, and safe from lost executors."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that one partition of a shuffle gets, about.
ROWS = 1_000_000


def partitions(spark: SparkSession, rows: int) -> int:
    """For so many rows; at least as many as the session's option says."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / ROWS))


@contextmanager
def dealt(spark: SparkSession, rows: int) -> Iterator[None]:
    """What runs within has partitions for so many rows in its shuffles (at least as many as the session's option says), so that
    the memory of a task does not grow with the table; adaptive execution joins those that turn out small."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(partitions(spark, rows)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def removed(df: DataFrame) -> None:
    """Takes the files of a written table away again."""
    spark = df.sparkSession
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
