"""Reading and writing of tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import court_of_file, text
from . import schemas
from .shared import dealt, written


def read_statutes(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """One row per readable file: path, title, year, source_file, articles (the file's articles or sections)."""
    return _readable(_statutes(spark, paths))


def _readable(rows: DataFrame) -> DataFrame:
    return rows.where("document is not null").select("path", "document.title", "document.year", "document.source_file", F.coalesce("document.articles", "document.sections").alias("articles"))


def _statutes(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    raw = spark.read.schema(schemas.STATUTE).json(paths if isinstance(paths, str) else list(paths), multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")
    return raw.withColumn("path", F.input_file_name())


def read_manifest(spark: SparkSession, manifest: str) -> tuple[DataFrame, DataFrame]:
    """(good, bad) of the files that a JSON manifest lists (an array of paths, or an object with them as values or in a
    list): statutes as read_statutes gives them, and path and reason of those that cannot be read."""
    lines = spark.read.text(manifest, wholetext=True)
    listed = F.from_json("value", "array<string>")
    named = F.map_values(F.from_json("value", "map<string,string>"))  # lists among the values stay JSON and are read in turn
    every = F.flatten(F.transform(named, lambda v: F.coalesce(F.from_json(v, "array<string>"), F.array(v))))
    found = lines.select(F.explode(F.when(F.ltrim("value").startswith("["), listed).otherwise(every)).alias("p")).where("p is not null and p <> ''").distinct()
    paths = sorted(r["p"] for r in found.collect())  # names of files, which Spark's list of the files to read holds as well
    there = _existing(spark, paths)
    missing = spark.createDataFrame([(p, "not found") for p in paths if p not in there], "path string, reason string")
    if not there:
        return read_statutes(spark, manifest).limit(0), missing
    rows = written(_statutes(spark, [p for p in paths if p in there]))  # the files are listed and read once, for good and bad
    return _readable(rows), rows.where("document is null").select("path", F.lit("not a statute").alias("reason")).union(missing)


#: Files of a folder that are asked for one by one; with more, Spark lists the folder.
ASKED = 1_000


def _existing(spark: SparkSession, paths: Sequence[str]) -> set[str]:
    """Those of the paths that exist. To ask the file system for each takes the driver a millisecond or more; of many in a folder
    only those that its list of files lacks are asked for (there are folders, and names that are not written plainly)."""
    conf, path = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    exists = lambda p: path(p).getFileSystem(conf).exists(path(p))
    folders: dict[str, list[str]] = {}
    for p in paths:
        folders.setdefault(p.rpartition("/")[0], []).append(p)
    there: set[str] = set()
    for at, inside in folders.items():
        names: set[str] = set()
        if at and len(inside) > ASKED:
            if not exists(at):
                continue
            own = path(at).getFileSystem(conf).makeQualified(path(at)).toString() + "/"
            files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(at).select("path").where(F.col("path").startswith(own))
            names = {r["path"][len(own) :] for r in files.collect()}
        there.update(p for p in inside if p.rpartition("/")[2] in names or exists(p))
    return there


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """The case records of all *.json below a folder (or of one file), bare arrays or wrapped, with path and court."""
    record = T.StructType.fromDDL(schemas.CASE)
    both = T.StructType([*[T.StructField(k, T.ArrayType(record)) for k in schemas.WRAPPERS], *record.fields])
    raw = spark.read.schema(both).option("pathGlobFilter", "*.json").json(path, multiLine=True).withColumn("path", F.input_file_name())
    array = F.coalesce(*schemas.WRAPPERS, F.array(F.struct(*record.names)))
    return with_court(raw.select("path", F.explode(array).alias("c")).select("path", "c.*"))


def with_court(df: DataFrame, path: str = "path") -> DataFrame:
    """court from the file's name, unless the record names one."""
    own = F.nullif(text("court"), F.lit("")) if "court" in df.columns else F.lit(None).cast("string")
    return df.withColumn("court", F.coalesce(own, court_of_file(path)))


def upsert(existing: DataFrame, new: DataFrame, keys: str | Sequence[str], order: str | None = None) -> DataFrame:
    """existing with the rows of new: equal keys take the new row, others are added. Of new rows with equal keys the last
    in order stays (any one, if there is no order). One shuffle of each side, on the keys. Runs at once, in partitions by the rows
    of both sides."""
    with dealt(existing.sparkSession, existing.count() + new.count()):
        return written(upserted(existing, new, keys, order))


def upserted(existing: DataFrame, new: DataFrame, keys: str | Sequence[str], order: str | None = None) -> DataFrame:
    """upsert as a plan, for callers that write it themselves."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    if order:
        rest = [c for c in new.columns if c not in keys]
        last = new.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*").select(*new.columns)
    else:
        last = new.dropDuplicates(keys)
    return existing.join(last.select(*keys), keys, "left_anti").unionByName(last, allowMissingColumns=True)


def replace_cases(existing: DataFrame, new: DataFrame, keep: bool = False) -> DataFrame:
    """Only the new cases, or with keep an upsert on id."""
    return upsert(existing, new, "id") if keep else new.dropDuplicates(["id"])


#: The ends of edges at which an article may stand.
EDGE_ENDS = {"cites": ("src", "dst"), "similar_to": ("id1", "id2"), "related_through": ("id1", "id2"), "relates_to": ("article_id",), "case_cites": ("article_id",)}


def delete_document(tables: dict[str, DataFrame], title: str) -> dict[str, DataFrame]:
    """tables without a document, its articles, clauses, sub-clauses, and all edges that touch its articles.

    Tables: documents, articles, clauses, subclauses, cites, similar_to, related_through, relates_to, case_cites; those that
    are not there are left out. A title that no document has is an error.
    """
    if tables["documents"].where(F.col("title") == title).isEmpty():
        raise KeyError(title)
    out = dict(tables) | {"documents": tables["documents"].where(~F.col("title").eqNullSafe(title))}
    gone = tables["articles"].where(F.col("document_title") == title).select(F.col("id").alias("_gone"))
    out["articles"] = tables["articles"].where(~F.col("document_title").eqNullSafe(title))
    anti = lambda df, c, ids: df.join(ids, df[c] == ids["_gone"], "left_anti")
    if "clauses" in tables:
        clauses = tables["clauses"].join(gone, F.col("article_id") == gone["_gone"]).select(F.col("id").alias("_gone"))
        out["clauses"] = anti(tables["clauses"], "article_id", gone)
        if "subclauses" in tables:
            out["subclauses"] = anti(tables["subclauses"], "clause_id", clauses)
    for name, columns in EDGE_ENDS.items():
        if name in tables:
            for c in columns:
                out[name] = anti(out[name], c, gone)
    return out


def delete_edges(edges: DataFrame, articles: DataFrame, title: str | None = None, ends: Sequence[str] = ("src", "dst")) -> DataFrame:
    """No edge at all, or without those that touch an article of one document at any of the ends."""
    if title is None:
        return edges.limit(0)
    gone = articles.where(F.col("document_title") == title).select(F.col("id").alias("_gone"))
    for c in ends:
        edges = edges.join(gone, edges[c] == gone["_gone"], "left_anti")
    return edges


def pending(rows: DataFrame, done: DataFrame, key: str, retry_errors: bool = False, result: str = "pdf_data") -> DataFrame:
    """rows that are not done yet; with retry_errors those whose result is an error marker count as not done."""
    if retry_errors:
        done = done.where(~F.startswith(F.coalesce(F.col(result), F.lit("")), F.lit("[ERROR")))
    return rows.join(done.select(key).distinct(), key, "left_anti")


def write_table(df: DataFrame, path: str, partition: str | None = None, form: str = "parquet", mode: str = "overwrite") -> None:
    """Persist a table, as parquet or JSON lines, in folders by a column of few values (court, edge type) if one is given."""
    writer = df.write.mode(mode)
    writer = writer.partitionBy(partition) if partition else writer
    writer.format(form).save(path)


def write_listing(df: DataFrame, path: str, profile: str, seen: Column | None = None) -> None:
    """A listing as JSON lines below `records`, and its counts below `metadata`."""
    write_table(df, f"{path}/records", form="json")
    counts = df.agg(F.lit(profile).alias("filter_profile"), F.count("*").alias("kept"), (seen if seen is not None else F.count("*")).alias("seen"))
    write_table(counts, f"{path}/metadata", form="json")
