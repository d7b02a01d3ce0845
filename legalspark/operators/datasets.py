"""Fine-tuning and benchmark datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapsed, input_key, text, usable
from ..sources.shared import written

SYSTEM = "You are a legal assistant."


def case_key(court: str = "court", case_no: str = "case_no") -> Column:
    """Trimmed court and white-space-collapsed number."""
    return F.struct(text(court).alias("court"), collapsed(case_no).alias("case_no"))


def remaining_under_cap(cases: DataFrame, existing: DataFrame, cap: int = 2) -> DataFrame:
    """Cases with usable text that have fewer than cap examples (existing has _metadata); adds prior."""
    done = existing.groupBy(case_key("_metadata.source_court", "_metadata.source_case_no").alias("_key")).agg(F.count("*").alias("prior"))
    rows = cases.where(usable("pdf_data")).withColumn("_key", case_key())
    return rows.join(done, "_key", "left").withColumn("prior", F.coalesce("prior", F.lit(0))).where(F.col("prior") < cap).drop("_key")


def sample_cases(df: DataFrame, key: str, seed: int = 42, limit: int | None = None) -> DataFrame:
    """A seeded sample without replacement, or a seeded shuffle (limit None): rows in the order of the MD5 of key:seed, with
    place, from 0. The same rows come whatever the partitions are. A sample is a top-k, which sorts only what each task keeps."""
    order = [F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), F.col(key)]
    return _numbered(df if limit is None else df.orderBy(*order).limit(limit), *order, name="place")


def _numbered(df: DataFrame, *order: Column | str, name: str = "n") -> DataFrame:
    """Consecutive numbers from 0 in a global order, without putting all rows in one task.

    Rows are dealt by ranges of the order, sorted within them and written once with the range and their place in it, so that
    the sizes of the ranges and the rows are of the same dealing. Only the sizes, a row for each range, meet in one task.
    """
    ranged = df.withColumn("_o", F.struct(*order)).repartitionByRange("_o").sortWithinPartitions("_o").drop("_o")
    own = written(ranged.withColumn("_i", F.monotonically_increasing_id()))  # partition << 33, and the place in it
    rows = own.withColumns({"_p": F.shiftright("_i", 33), "_own": F.col("_i").bitwiseAND(F.lit((1 << 33) - 1))})
    before = rows.groupBy("_p").agg(F.count("*").alias("_c")).withColumn("_before", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    return rows.join(F.broadcast(before), "_p").withColumn(name, F.col("_before") + F.col("_own")).drop("_i", "_p", "_own", "_before")


def assign_batches(df: DataFrame, order: str, size: int = 5) -> DataFrame:
    """df with batch, consecutive in order."""
    return _numbered(df, order, name="_n").withColumn("batch", F.floor(F.col("_n") / size)).drop("_n")


def accepted_batches(inputs: DataFrame, results: DataFrame) -> DataFrame:
    """results of the batches whose number of results is that of their inputs."""
    a = inputs.groupBy("batch").agg(F.count("*").alias("_in"))
    b = results.groupBy("batch").agg(F.count("*").alias("_out"))
    good = a.join(b, "batch").where(F.col("_in") == F.col("_out")).select("batch")
    return results.join(good, "batch", "left_semi")


def append_examples(existing: DataFrame, new: DataFrame, dedupe: bool = True, order: str = "order") -> DataFrame:
    """Rows to append: new examples whose input neither existing nor an earlier new one has, each stamped with
    variation_index, one more than the examples its case has by then."""
    rows = new.withColumn("_input", input_key("input"))
    if dedupe:
        rows = rows.join(existing.select(input_key("input").alias("_input")).distinct(), "_input", "left_anti")
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_input").orderBy(order))).where("_n = 1").drop("_n")
    rows = rows.withColumn("_key", case_key("_metadata.source_court", "_metadata.source_case_no"))
    done = existing.groupBy(case_key("_metadata.source_court", "_metadata.source_case_no").alias("_key")).agg(F.count("*").alias("_prior"))
    place = F.row_number().over(Window.partitionBy("_key").orderBy(order))
    index = (F.coalesce("_prior", F.lit(0)) + place).cast("int")
    out = rows.join(done, "_key", "left").withColumn("_i", index)
    meta = F.struct(F.col("_metadata.source_case_no").alias("source_case_no"), F.col("_metadata.source_court").alias("source_court"), F.col("_i").alias("variation_index"))
    return out.withColumn("_metadata", meta).drop("_input", "_key", "_prior", "_i")


def sft_rows(df: DataFrame) -> DataFrame:
    return df.where(text("output") != "").select("instruction", F.coalesce("input", F.lit("")).alias("input"), "output")


def split(df: DataFrame, share: float = 0.95, seed: int = 42) -> DataFrame:
    """df with split, train or test: the first share of a seeded order, one row at least, is train."""
    key = F.xxhash64(*[F.col(c) for c in df.columns], F.lit(seed))
    n = df.count()
    return _numbered(df, key, *df.columns, name="_n").withColumn("split", F.when(F.col("_n") < max(1, int(n * share)), "train").otherwise("test")).drop("_n")


def to_messages(df: DataFrame, system: str = SYSTEM) -> DataFrame:
    """messages: array of (role, content) for system, user (instruction and input) and assistant."""
    user = F.concat_ws("\n\n", F.nullif(text("instruction"), F.lit("")), F.nullif(text("input"), F.lit("")))
    part = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return df.withColumn("messages", F.array(part("system", F.lit(system)), part("user", user), part("assistant", F.col("output"))))


def statute_projection(articles: DataFrame) -> DataFrame:
    return articles.select("document_title", F.struct(F.col("article_number").alias("section"), "title", "content", "clauses").alias("section"))


def trim_case(cases: DataFrame, n: int = 0) -> DataFrame:
    """pdf_data cut to n characters; 0 cuts nothing."""
    return cases.withColumn("pdf_data", F.substring("pdf_data", 1, n)) if n > 0 else cases
