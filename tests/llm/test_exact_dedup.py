"""Exact copies against a plain version: hot groups, nulls, ties, equal lengths and prefixes."""

import random

from pyspark.sql import functions as F

from legalspark.llm import common
from legalspark.llm.exact_dedup import PREFIX, exact_dedup


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted(((i, best[t or ""] if len(groups[t or ""]) > 1 else i, len(groups[t or ""]), i == best[t or ""] or len(groups[t or ""]) == 1) for i, t in rows), key=str)


def test_against_a_plain_version(spark, monkeypatch):
    rng = random.Random(1)
    texts = ["hot"] * 300 + [None, "", "", None] + ["x" * PREFIX + str(k % 5) for k in range(20)] + ["é", "é", "A", "a", "a "] + [str(rng.randint(0, 60)) for _ in range(150)] + ["long " * 40000] * 2
    rows = list(enumerate(texts)) + [(7, "hot"), (7, "hot"), (None, "hot"), (None, "only here")]
    monkeypatch.setattr(common, "HOT_SHARE", 5)
    docs = spark.createDataFrame([(i, t, 1, "y") for i, t in rows], "doc_id long, text string, length int, prefix string").repartition(6)
    found = exact_dedup(docs, carry={"size": F.length("text")}).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in found), key=str) == brute(rows)
    assert next(r["size"] for r in found if r["doc_id"] == 0) == 3


def test_an_empty_table(spark):
    assert exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_filter_holds_all_its_keys(spark):
    keys = spark.range(0, 5000, 7)
    known = common.BitFilter(keys, "id", bits=1 << 16)
    found = spark.range(5000).where(known.column(F.col("id")))
    assert found.where("id % 7 = 0").count() == keys.count() and found.count() < 1500


def test_hashed_samples_are_the_smallest_hashes(spark):
    rows = spark.range(20000).withColumn("by", F.when(F.col("id") < 5, "few").otherwise("many"))
    got = common.hashed_sample(rows, "by", "id", 50)
    h = F.pmod(F.xxhash64("id"), F.lit(1 << 31))
    want = {r["id"] for r in rows.where("by = 'many'").orderBy(h, "id").limit(50).collect()} | set(range(5))
    assert {r["id"] for r in got.repartition(3).collect()} == want


def test_long_lists_of_ids_shuffle_few_rows(spark, monkeypatch):
    """Beyond the bound for a broadcast, only rows that a filter lets through meet the list."""
    from legalspark.llm import common

    monkeypatch.setattr(common, "BROADCAST_ROWS", 10)
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat('x', 50) AS text").union(spark.createDataFrame([(None, "n")], "doc_id long, text string"))
    ids = spark.range(0, 3000, 30).selectExpr("id AS doc_id")
    left = common.drop_ids(docs, ids)
    assert sorted((r["doc_id"] for r in left.collect()), key=str) == sorted([None, *(k for k in range(3000) if k % 30)], key=str)
    assert sorted(r["doc_id"] for r in common.keep_ids(docs, ids).collect()) == list(range(0, 3000, 30))
    some, rest, _ = common._split(docs, ids, "doc_id")
    assert some.count() == 100 and rest.count() == 2901
