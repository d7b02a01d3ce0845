"""From raw documents to token ids: language, exact copies, near copies, benchmark passages, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the docs of
the next. All but the last keep the columns of documents. Stages decide by doc_id: a list of ids to drop is counted and
broadcast when it is short, so that texts are not shuffled. Where a doc_id is null or repeated, rows get keys of their own
in the order of doc_id first (nulls before others), so that each row has its own fate.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from legalspark.llm import langid
from legalspark.llm.bpe import bpe
from legalspark.llm.common import drop_ids, fresh, keeping, materialise, remove, shared_dir
from legalspark.llm.decontaminate import decontaminate
from legalspark.llm.exact_dedup import exact_dedup
from legalspark.llm.minhash import near_duplicates
from legalspark.llm.queries import table, tokenizer

#: Share of a document's grams that must be learned pieces of languages which the network finds likely where they stand. It
#: does not depend on the number of languages, and documents in several of them, which are clean, have as much as others.
LEAST_FAMILIAR = 0.7


def _dropped(docs: DataFrame, found: DataFrame, condition) -> DataFrame:
    """docs without the rows whose doc_id has the condition in found, an operator's written result, which goes."""
    ids = materialise(found.where(condition).select("doc_id").distinct())
    for path in {f.rpartition("/")[0] for f in found.inputFiles()}:
        remove(docs.sparkSession, path)
    return drop_ids(docs, ids)


def by_row(stage):
    """For stages that drop rows by doc_id: gives rows keys of their own where it does not tell them apart."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        rows, ids = docs.select(F.count("*"), F.count_distinct("doc_id")).first()
        if rows == ids:
            return stage(spark, docs, sf_dir)
        (kept,) = fresh(docs, "kept_doc_id")
        order = ["doc_id", F.xxhash64("text")]
        own = docs.withColumn(kept, F.col("doc_id")).repartitionByRange(*order).sortWithinPartitions(*order)
        keyed = materialise(own.withColumn("doc_id", F.monotonically_increasing_id()))
        return stage(spark, keyed, sf_dir).withColumn("doc_id", F.col(kept)).select(docs.columns)

    return run


#: What the stages do with odd rows: a null text is an empty one; texts of any length are read whole; of an empty table nothing
#: is left; columns other than doc_id, text and (for learning) lang are carried along whatever their names; a doc_id that is null or
#: that several rows have decides nothing, since each row then has its own key.


@by_row
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters go, and so do those in no learned language: of which less than LEAST_FAMILIAR is made of pieces of
    the languages that the network finds likely, segment by segment. Null and empty texts have no letters. Where no row has
    a lang to learn from, all documents go."""
    found = langid.identify(docs, with_familiar=True)
    return _dropped(docs, found, (F.col("lang_pred") == langid.UNKNOWN) | (F.col("familiar") < LEAST_FAMILIAR))


@by_row
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays; a null text equals an empty one."""
    return _dropped(docs, exact_dedup(docs), ~F.col("kept"))


@by_row
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: five-word shingles, similarity of 0.8 or more. Documents without words are in
    no group and stay."""
    return _dropped(docs, near_duplicates(docs, percent=80), ~F.col("kept"))


@by_row
def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go; those without words, and all where the benchmark is empty, stay."""
    return _dropped(docs, decontaminate(docs, table(spark, sf_dir, "benchmark")), F.col("contaminated"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, ids_sha256, decoded_sha256 of every document that is left; an empty text has no ids. Rows that
    share a doc_id, or have none, have a row each."""
    return bpe(docs, tokenizer(), ("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES = [("language", language), ("exact_dedup", exact), ("near_dedup", near), ("decontaminate", clean), ("bpe", tokens)]
#: SQL cannot express the first stage; tests compare the pipeline with a plain one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for the documents of sf_dir. Of what the stages write, only these are left in the shared folder."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with keeping() as paths:
            docs = stage(spark, docs, sf_dir)
            if name != STAGES[-1][0]:
                path = shared_dir(spark)
                docs.write.parquet(path)
                docs = spark.read.schema(docs.schema).parquet(path)
        wanted = {f.rpartition("/")[0].rpartition("/")[2] for f in docs.inputFiles()}
        for path in [*paths, *([before] if before else [])]:
            if path.rpartition("/")[2] not in wanted and (name == STAGES[-1][0] or path != paths[-1]):
                remove(spark, path)
        before = paths[-1] if name != STAGES[-1][0] else None
    return docs
