"""Stored tables of hash buckets with a manifest: changes rewrite only the buckets that they touch.

A table is a folder with data below `data` and manifests below `manifest`, one JSON file a version. A manifest names the keys, the
number of buckets and, for each bucket, its folder. A change writes the new folders of the buckets it touches and then a
new manifest; readers take the newest manifest, so a lost job leaves the old state, and files of untouched buckets are never
written again. Two writers of one version can't both win: the second finds the manifest there.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET = "_bucket"


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


@dataclass(frozen=True)
class Version:
    """One state of a table: keys, column by whose hash rows are dealt, schema, and the folders of buckets that have rows."""

    path: str
    number: int
    keys: list[str]
    by: str
    buckets: int
    schema: str
    folders: dict[int, str]


def bucket_of(by: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(by) if isinstance(by, str) else by), F.lit(buckets)).cast("int")


def current(spark: SparkSession, path: str) -> Version:
    at, fs = _fs(spark, f"{path}/manifest")
    numbers = [int(s.getPath().getName()) for s in fs.listStatus(at) if s.getPath().getName().isdigit()]
    (row,) = spark.read.text(f"{path}/manifest/{max(numbers)}", wholetext=True).collect()
    said = json.loads(row[0])
    return Version(path, max(numbers), said["keys"], said["by"], said["buckets"], said["schema"], {int(k): v for k, v in said["folders"].items()})


def _publish(spark: SparkSession, v: Version) -> Version:
    """The manifest appears under its name at once or not at all."""
    said = json.dumps({"keys": v.keys, "by": v.by, "buckets": v.buckets, "schema": v.schema, "folders": v.folders})
    draft, fs = _fs(spark, f"{v.path}/manifest/.{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(bytearray(said.encode()))
    out.close()
    target = _fs(spark, f"{v.path}/manifest/{v.number}")[0]
    if fs.exists(target) or not fs.rename(draft, target):
        fs.delete(draft, False)
        raise RuntimeError(f"another job has written version {v.number} of {v.path}")
    return v


def _write(rows: DataFrame, v: Version) -> dict[int, str]:
    """The folders of the buckets of rows (with a bucket column), all their rows."""
    name = uuid.uuid4().hex
    # by buckets, of which adaptive execution splits the large ones and joins the small ones
    rows.hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{v.path}/data/{name}")
    at, fs = _fs(rows.sparkSession, f"{v.path}/data/{name}")
    found = [s.getPath().getName() for s in fs.listStatus(at)]
    return {int(n.partition("=")[2]): f"{name}/{n}" for n in found if n.startswith(f"{BUCKET}=")}


def create(df: DataFrame, path: str, keys: str | Sequence[str], buckets: int = 64, by: str | None = None) -> Version:
    """A new table of df, whose rows have different keys. by (default: the first key) is the column whose hash deals the rows; with
    the owner of a row, such as a document, a change of one owner touches one bucket."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    by = by or keys[0]
    v = Version(path, 0, keys, by, buckets, df.schema.json(), {})
    folders = _write(df.withColumn(BUCKET, bucket_of(by, buckets)), v)
    return _publish(df.sparkSession, Version(path, 0, keys, by, buckets, df.schema.json(), folders))


def read(spark: SparkSession, table: Version | str, buckets: Sequence[int] | None = None) -> DataFrame:
    """The rows of a table's newest version (or of one given), of all buckets or of some."""
    from pyspark.sql.types import StructType

    v = current(spark, table) if isinstance(table, str) else table
    schema = StructType.fromJson(json.loads(v.schema))
    folders = [f"{v.path}/data/{f}" for b, f in sorted(v.folders.items()) if buckets is None or b in buckets]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def _touched(rows: DataFrame, v: Version) -> list[int]:
    """Buckets of the column `by` of rows: at most as many as the table has."""
    return sorted(r[0] for r in rows.select(bucket_of(v.by, v.buckets)).distinct().collect())


def _replace(spark: SparkSession, v: Version, touched: list[int], rows: DataFrame) -> Version:
    """The next version, in which the touched buckets have just these rows."""
    new = _write(rows.withColumn(BUCKET, bucket_of(v.by, v.buckets)), v) if touched else {}
    kept = {b: f for b, f in v.folders.items() if b not in touched}
    return _publish(spark, Version(v.path, v.number + 1, v.keys, v.by, v.buckets, v.schema, kept | new))


def merge(spark: SparkSession, path: str, new: DataFrame, order: str | None = None) -> Version:
    """Rows with known keys take the values of new, others are added (tables.upsert); only the buckets of new are read and
    written. The column `by` must be one of the keys, or not change."""
    from .shared import dealt, written
    from .tables import upserted

    v = current(spark, path)
    new = written(new)
    touched = _touched(new, v)
    names, old = read(spark, v, []).columns, read(spark, v, touched)
    with dealt(spark, old.count() + new.count()):
        return _replace(spark, v, touched, upserted(old, new, v.keys, order).select(*names))


def delete(spark: SparkSession, path: str, gone: DataFrame, column: str) -> Version:
    """Without the rows whose column is in gone (one column). If the rows are dealt by this column only its buckets are read;
    else the buckets that have such rows are found first, and only those are written."""
    v = current(spark, path)
    gone = gone.toDF("_gone").distinct()
    if column == v.by:
        touched = [b for b in sorted(r[0] for r in gone.select(bucket_of("_gone", v.buckets)).distinct().collect()) if b in v.folders]
    else:
        touched = _touched(read(spark, v).join(gone, F.col(column) == F.col("_gone"), "left_semi"), v)
    left = read(spark, v, touched).join(gone, F.col(column) == F.col("_gone"), "left_anti")
    return _replace(spark, v, touched, left)


def replace(df: DataFrame, path: str) -> Version:
    """A version with just the rows of df, dealt as before."""
    spark = df.sparkSession
    v = current(spark, path)
    rows = df.select(*read(spark, v, []).columns)
    return _replace(spark, v, list(range(v.buckets)), rows)


def delete_document(spark: SparkSession, folder: str, title: str, tables: Sequence[str]) -> dict[str, Version]:
    """Cascade in stored tables (documents, articles, clauses, subclauses, edges) of a folder, as tables.delete_document does it;
    tables that have nothing of the document get no new version. Edges go first and the document last, so that a job that was
    lost on the way is ended by another run. A title that no document has is an error."""
    from .shared import written
    from .tables import EDGE_ENDS

    at = {n: f"{folder}/{n}" for n in tables}
    if read(spark, at["documents"]).where(F.col("title") == title).isEmpty():
        raise KeyError(title)
    named = spark.createDataFrame([(title,)], "title string")
    articles = written(read(spark, at["articles"]).where(F.col("document_title") == title).select("id"))
    steps = [(n, articles, c) for n, ends in EDGE_ENDS.items() if n in at for c in ends]
    if "clauses" in at:
        if "subclauses" in at:
            clauses = written(read(spark, at["clauses"]).join(articles.toDF("article_id"), "article_id", "left_semi").select("id"))
            steps.append(("subclauses", clauses, "clause_id"))
        steps.append(("clauses", articles, "article_id"))
    steps += [("articles", named, "document_title"), ("documents", named, "title")]
    return {n: delete(spark, at[n], gone, column) for n, gone, column in steps}
