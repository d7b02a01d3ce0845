"""Listings as a stream: new files are normalised, classified and upserted, each file read once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import court_of_file
from ..operators.filters import classify_listing
from ..operators.structure import normalise_cases
from ..sources import schemas
from ..values import COURTS


def stream_cases(spark: SparkSession, source: str, table: str, checkpoint: str, classify: bool = True) -> StreamingQuery:
    """Read the listing files that have come to a folder since the last run, and append their cases to a parquet table.

    The checkpoint remembers files, so each is read once. Of the records of an id in a batch the last one, by file name and place
    in the file, stays, so that a repeated batch writes the same. A batch writes its own cases only, below `table` as v=<batch>; one
    that is repeated after a failure rewrites the same folder. read_stream_table takes the latest row of each id, and
    compact keeps the number of folders small.
    """
    record = T.StructType.fromDDL(schemas.CASE)
    both = T.StructType([*[T.StructField(k, T.ArrayType(record)) for k in schemas.WRAPPERS], *record.fields])
    files = spark.readStream.schema(both).option("multiLine", True).option("pathGlobFilter", "*.json").json(source).withColumn("path", F.input_file_name())
    array = F.coalesce(*schemas.WRAPPERS, F.array(F.struct(*record.names)))
    rows = files.select("path", F.posexplode(array).alias("place", "c")).select("path", "place", "c.*").withColumn("court", court_of_file("path"))

    def save(batch: DataFrame, version: int) -> None:
        kept = classify_listing(batch, F.concat_ws(" ", "case_title", "writ_petition", "case_number", "matter", "remarks", "excerpt")) if classify else batch
        order = ["path", "place"]
        new = normalise_cases(kept, list(COURTS.values()), order)
        last = F.max_by(F.struct(*[c for c in new.columns if c not in ("id", *order)]), F.struct(*order)).alias("r")
        new.groupBy("id").agg(last).select("id", "r.*").write.mode("overwrite").parquet(f"{table}/v={version}")

    return rows.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def versions(spark: SparkSession, table: str, kind: str = "v") -> list[int]:
    """The complete batches (v) or snapshots (s), in their order."""
    fs, Path = _files(spark, table)
    names = [s.getPath().getName() for s in fs.listStatus(Path(table))] if fs.exists(Path(table)) else []
    return sorted(v for v in (int(n[2:]) for n in names if n.startswith(f"{kind}=")) if fs.exists(Path(f"{table}/{kind}={v}/_SUCCESS")))


def _files(spark: SparkSession, table: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path(table).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def read_stream_table(spark: SparkSession, table: str) -> DataFrame | None:
    """The latest row of each id, from the last snapshot and the batches after it; None before the first batch. Several
    folders take one shuffle on the id."""
    at = max(versions(spark, table, "s"), default=-1)
    later = [v for v in versions(spark, table) if v > at]
    old = spark.read.parquet(f"{table}/s={at}").withColumn("v", F.lit(at)) if at >= 0 else None
    new = spark.read.option("basePath", table).parquet(*[f"{table}/v={v}" for v in later]) if later else None
    both = old.unionByName(new) if old is not None and new is not None else old if new is None else new
    if both is None or (old is not None) + len(later) == 1:
        return both if both is None else both.drop("v")
    rest = [c for c in both.columns if c not in ("id", "v")]
    last = both.groupBy("id").agg(F.max_by(F.struct(*rest), "v").alias("_r")).select("id", "_r.*")
    return last.select(*[c for c in both.columns if c != "v"])


def compact(spark: SparkSession, table: str) -> None:
    """Write the table as it stands as a snapshot s=<last batch>, from which later reads start, and remove the folders that
    it stands for. It is not for times when others read the table; a run that was cut off loses nothing."""
    done, kept = versions(spark, table), versions(spark, table, "s")
    if not done or done[-1] <= max(kept, default=-1):
        return
    read_stream_table(spark, table).write.mode("overwrite").parquet(f"{table}/s={done[-1]}")
    fs, Path = _files(spark, table)
    for folder in [f"s={v}" for v in kept] + [f"v={v}" for v in done]:
        fs.delete(Path(f"{table}/{folder}"), True)
