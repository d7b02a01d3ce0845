"""Helpers shared by the corpus operators: shared storage, bounded Arrow batches, skew-safe joins, bit filters."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import itertools
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A side of a join is broadcast only when it was counted and has at most this many (narrow) rows.
BROADCAST_ROWS = 1_000_000
#: A group with more than 1/HOT_SHARE of all rows is hot; there are fewer than HOT_SHARE such groups, whatever the data.
HOT_SHARE = 1_000


#: Options of a session that keep Arrow batches small in rows and bytes, so that long texts cannot fill a Python worker.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}
#: Folders of the tables that the running operator has written for itself; all that were handed out under keeping().
_SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch", default=None)
_KEPT: ContextVar[list[str] | None] = ContextVar("kept", default=None)


@contextlib.contextmanager
def keeping():
    """Within it, the list has every folder that shared_dir hands out."""
    token = _KEPT.set([])
    try:
        yield _KEPT.get()
    finally:
        _KEPT.reset(token)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """names, each with as many underscores behind it as it takes to be no column of df."""
    known = {c.lower() for c in df.columns}
    return [next(n for k in itertools.count() if (n := name + "_" * k).lower() not in known) for name in names]


def shared_dir(spark: SparkSession, scratch: bool = False) -> str:
    """A new folder below the one in spark.checkpoint.dir; a scratch one goes when the running operator ends.

    Where the setting is absent, a local session gets a temporary folder; on a cluster that would not be shared, so it is
    an error.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    if scratch and _SCRATCH.get() is not None:
        _SCRATCH.get().append(path)
    if _KEPT.get() is not None:
        _KEPT.get().append(path)
    return path


def dealt(rows: DataFrame) -> DataFrame:
    """Few written rows that are much work, such as paths of files: one task reads them and deals them out in turn, to a number of
    partitions that Spark keeps."""
    spark = rows.sparkSession
    most = 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return rows.coalesce(1).sortWithinPartitions(rows.columns[0]).repartition(min(max(1, rows.count()), most))


def materialise(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, and survives the loss of executors."""
    path = shared_dir(df.sparkSession, scratch=True)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def operator(work):
    """For functions whose first argument is a DataFrame and that return one or several.

    The work runs at once, with small Arrow batches; its results are written, the tables on the way to them removed, and
    the options of the session put back. Within another operator it is a plain call.
    """

    @functools.wraps(work)
    def run(first: DataFrame, *args, **named):
        if _SCRATCH.get() is not None:
            return work(first, *args, **named)
        spark, scratch = first.sparkSession, []
        before, token = {k: spark.conf.get(k, None) for k in BATCHES}, _SCRATCH.set(scratch)
        try:
            for k, v in BATCHES.items():
                spark.conf.set(k, v)
            out = work(first, *args, **named)
            tables = out if isinstance(out, tuple) else (out,)
            _SCRATCH.set(None)
            kept = tuple(materialise(t) for t in tables)
            return kept if isinstance(out, tuple) else kept[0]
        finally:
            _SCRATCH.reset(token)
            for k, v in before.items():
                spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
            for path in scratch:
                remove(spark, path)

    return run


def tidy() -> None:
    """At the end of a task, give freed memory back to the system: Python workers live on into later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def groups_of(texts: list[str], size: int = 1 << 19) -> Iterator[list[str]]:
    """Consecutive texts of about size characters together."""
    block, n = [], 0
    for t in texts:
        block.append(t)
        n += len(t)
        if n >= size:
            yield block
            block, n = [], 0
    if block:
        yield block


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """rows left join groups on key, where few keys may hold most rows.

    groups has one row per key, with the number of its rows in the column size. Groups above a fixed share
    of all rows are fewer than HOT_SHARE and are broadcast; the others are joined by a shuffle in which no
    key has more than that share. Both inputs should be materialised.
    """
    hot = F.broadcast(groups.where(F.col(size) > total / HOT_SHARE))
    rest = groups.where(F.col(size) <= total / HOT_SHARE)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(rest, key, "left"))


def hashed_sample(rows: DataFrame, by: str, key: str, n: int) -> DataFrame:
    """The n rows of each value of `by` with the smallest hashes of key (all, if there are fewer).

    Rows that repeat count once. Values are counted first, and rows whose hash is far from the smallest go in the scan, so
    that little more than n rows of a value meet in one task, however many it has.
    """
    rows = rows.distinct()
    hashed = F.pmod(F.xxhash64(key), F.lit(1 << 31))
    counts = materialise(rows.groupBy(by).agg(F.count("*").alias("own_count")))
    near = rows.join(F.broadcast(counts) if counts.count() <= BROADCAST_ROWS else counts, by)
    near = near.where(hashed < F.least(F.lit(1.0), F.lit(n + 6.0 * n**0.5 + 10) / F.col("own_count")) * (1 << 31)).drop("own_count")
    place = F.row_number().over(Window.partitionBy(by).orderBy(hashed, key))
    return near.withColumn("own_place", place).where(F.col("own_place") <= n).drop("own_place")


class BitFilter:
    """Which 64-bit keys may be among a set of keys; a Bloom filter with two probes.

    Its bitmaps are gathered by Spark's own bitmap aggregate, so what reaches the driver and the workers is at most
    bits / 8 bytes, whatever the number of keys; with more keys it only lets more rows through, which later exact steps
    remove.
    """

    def __init__(self, keys: DataFrame, key: str, bits: int = 1 << 26):
        self.bits = bits
        places = keys.select(F.explode(F.array(*self.probes(F.col(key)))).alias("p"))
        maps = places.groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m"))
        table = np.zeros(bits // 8, np.uint8)
        for row in maps.toLocalIterator():
            table[(row["b"] - 1) * 4096 : row["b"] * 4096] = np.frombuffer(row["m"], np.uint8)
        self.table = keys.sparkSession.sparkContext.broadcast(table)

    def probes(self, c: Column) -> list[Column]:
        """Two places for a key; those of bitmap functions start at 1."""
        return [F.pmod(F.xxhash64(c, F.lit(i)), F.lit(self.bits)) + 1 for i in (0, 1)]

    def holds(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """For places of keys, inside a task."""
        bit = lambda p: self.table.value[p >> 3] >> (p & 7) & 1
        return (bit(first - 1) & bit(second - 1)).astype(bool)

    def column(self, c: Column) -> Column:
        """The same as a boolean column. Only the places go to Python."""

        @F.pandas_udf("boolean")
        def known(first: pd.Series, second: pd.Series) -> pd.Series:
            return pd.Series(self.holds(first.to_numpy(), second.to_numpy()))

        return known(*self.probes(c))


def _split(docs: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows whose key may be in ids, those whose key is not, ids). Long lists go through a filter of bounded size first, so that
    the join sees, and shuffles, only the rows that it lets through."""
    maybe = F.coalesce(BitFilter(ids.where(F.col(key).isNotNull()), key).column(F.col(key)), F.lit(False)) & F.col(key).isNotNull()
    return docs.where(maybe), docs.where(~maybe), ids


def drop_ids(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs without the rows whose key is in ids (one materialised column); a null key stays.

    A counted, small list is broadcast, so that texts are not shuffled; of a longer one only rows that a bit filter lets
    through are joined by a shuffle.
    """
    if ids.count() <= BROADCAST_ROWS:
        return docs.join(F.broadcast(ids), key, "left_anti")
    some, rest, ids = _split(docs, ids, key)
    return rest.unionByName(some.join(ids, key, "left_anti").select(docs.columns))


def keep_ids(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs with only the rows whose key is in ids, in the same way."""
    if ids.count() <= BROADCAST_ROWS:
        return docs.join(F.broadcast(ids), key, "left_semi")
    some, _, ids = _split(docs, ids, key)
    return some.join(ids, key, "left_semi").select(docs.columns)
