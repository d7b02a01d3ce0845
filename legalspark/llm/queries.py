"""The registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql
from .bpe import bpe
from .common import text_of
from .conversations import damage, repair, reported
from .decontaminate import decontaminate
from .exact_dedup import exact_dedup
from .langid import identify
from .line_dedup import line_dedup
from .minhash import near_duplicates
from .mixing import mix, taken
from .pii import find as find_pii
from .quality import quality
from .sstable import tokens_to_shards
from .warc import archive
from .whitening import whiten


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), carry={"text_sha256": F.sha2(text_of(), 256)})


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe(table(spark, sf_dir, "documents"), tokenizer(), ("n_tokens", "ids_sha256", "decoded_sha256"))


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens_to_shards(table(spark, sf_dir, "documents"), tokenizer())[1]


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", "removed", F.sha2(text_of(), 256).alias("text_sha256"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(table(spark, sf_dir, "pages"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(mix(table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return reported(conversations, *repair(damage(conversations)))


QUERIES = {
    "op13_conversations": op13_conversations,
    "op11_whitening": op11_whitening,
    "op12_mixing": op12_mixing,
    "op9_warc": op9_warc,
    "op4_line_dedup": op4_line_dedup,
    "op8_pii": op8_pii,
    "op2_language": op2_language,
    "op7_quality": op7_quality,
    "op1_bpe": op1_bpe,
    "op3_token_shards": op3_token_shards,
    "op5_decontaminate": op5_decontaminate,
    "op6_near_duplicates": op6_near_duplicates,
    "op10_exact_dedup": op10_exact_dedup,
}
ORACLE_SQL = {"op4_line_dedup": sql.LINE_DEDUP, "op5_decontaminate": sql.DECONTAMINATE, "op10_exact_dedup": sql.EXACT_DEDUP, "op12_mixing": sql.MIXING}
