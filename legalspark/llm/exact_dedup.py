"""Exact de-duplication by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BitFilter, attach, materialise, operator, text_of

#: Characters of the prefix that the second level hashes.
PREFIX = 128
#: Salts over which the rows of one length are dealt.
SALTS = 32


@operator
def exact_dedup(docs: DataFrame, carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, and the columns in carry.

    Texts are equal when their bytes are; a null text counts as empty. Of equal texts the largest doc_id stays
    (keep_id). Rows that repeat a doc_id within a group count in group_size and share its flag; a null doc_id
    stays only where a group has no other. Other columns are not read, so their names do not matter.

    1. One pass takes the byte length and the hash of a prefix. Lengths that occur once are done.
    2. Of the rest, pairs of length and prefix hash that occur once are done.
    3. A second pass hashes the full text of what is left; a filter of bounded size, made from the
       surviving pairs, says which rows these can be, so that no text is shuffled.
    """
    text = text_of()
    pair = [F.octet_length(text).alias("length"), F.xxhash64(F.substring(text, 1, PREFIX)).alias("prefix")]
    rows = materialise(docs.select("doc_id", *pair))
    lengths = rows.groupBy("length").count().where("count > 1").select("length", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "prefix"), F.lit(SALTS)).cast("int"))
    alike = salted.join(lengths, ["length", "salt"], "left_semi").groupBy("length", "prefix").count().where("count > 1")
    maybe = BitFilter(alike.select(F.xxhash64("length", "prefix").alias("pair")), "pair")

    again = docs.select("doc_id", *pair, text.alias("text"), *[c.alias(f"carry_{n}") for n, c in (carry or {}).items()])
    full = F.when(maybe.column(F.xxhash64("length", "prefix")), F.unhex(F.sha2("text", 256)))
    hashed = materialise(again.select("doc_id", full.alias("full"), *[f"carry_{n}" for n in carry or {}]))
    groups = materialise(hashed.where("full is not null").groupBy("full").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1"))
    found = attach(hashed.where("full is not null"), groups, "full", "group_size", hashed.count())
    alone = hashed.where("full is null").withColumns({"keep_id": F.lit(None).cast(hashed.schema["doc_id"].dataType), "group_size": F.lit(None).cast("long")})
    out = found.unionByName(alone)
    one = F.col("group_size").isNull()
    return out.select(
        "doc_id", F.when(one, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (one | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), *[F.col(f"carry_{n}").alias(n) for n in carry or {}],
    )
