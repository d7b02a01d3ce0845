"""Counts, listings and evaluation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import text


def document_stats(documents: DataFrame, articles: DataFrame) -> DataFrame:
    """title, year, type, articles: number of articles of each document, 0 included."""
    n = articles.groupBy(F.col("document_title").alias("title")).agg(F.count("*").alias("articles"))
    return documents.select("title", "year", "type").join(n, "title", "left").withColumn("articles", F.coalesce("articles", F.lit(0)))


def graph_stats(nodes: dict[str, DataFrame], edges: dict[str, DataFrame]) -> DataFrame:
    """name, n: rows of each node and edge table, and total_edges. One row for each table reaches the last step."""
    one = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    counted = [one(k, v) for k, v in {**nodes, **edges}.items()]
    every = reduce(DataFrame.union, [one(k, v) for k, v in edges.items()]).agg(F.sum("n").alias("n")).select(F.lit("total_edges").alias("name"), "n")
    return reduce(DataFrame.union, [*counted, every])


def top_concepts(relates_to: DataFrame, n: int = 50) -> DataFrame:
    return relates_to.groupBy("concept").agg(F.count("*").alias("articles")).orderBy(F.desc("articles"), "concept").limit(n)


def cases_by_court(cases: DataFrame) -> DataFrame:
    """court, cases; the row `ALL` is the total."""
    rolled = cases.withColumn("court", F.coalesce("court", F.lit("Unknown Court"))).rollup("court").agg(F.count("*").alias("cases"), F.grouping("court").alias("g"))
    return rolled.select(F.when(F.col("g") == 1, "ALL").otherwise(F.col("court")).alias("court"), "cases")


def document_breakdown(articles: DataFrame, clauses: DataFrame, subclauses: DataFrame) -> DataFrame:
    """document_title, articles, clauses, subclauses; each level is counted under its own key first, so that joins do not
    multiply rows."""
    subs = subclauses.groupBy("clause_id").agg(F.count_distinct("id").alias("s"))
    per = clauses.select("id", "article_id").distinct().join(subs, F.col("id") == subs["clause_id"], "left").groupBy("article_id").agg(F.count("*").alias("c"), F.sum("s").alias("s"))
    rows = articles.select("id", "document_title").distinct().join(per, F.col("id") == per["article_id"], "left")
    zero = F.lit(0)
    return rows.groupBy("document_title").agg(F.count("*").alias("articles"), F.coalesce(F.sum("c"), zero).alias("clauses"), F.coalesce(F.sum("s"), zero).alias("subclauses"))


def ingest_summary(cases: DataFrame, case_cites: DataFrame, case_similar: DataFrame) -> DataFrame:
    """One row: cases, linked_articles, links, similarities, average links of a case."""
    a = cases.agg(F.count("*").alias("cases"))
    b = case_cites.agg(F.count("*").alias("links"), F.count_distinct("article_id").alias("linked_articles"))
    c = case_similar.agg(F.count("*").alias("similarities"))
    return a.join(F.broadcast(b)).join(F.broadcast(c)).withColumn("average_links", F.when(F.col("cases") > 0, F.round(F.col("links") / F.col("cases"), 6)))  # one row each


def list_cases(cases: DataFrame, limit: int = 100, date_order: str = "string") -> DataFrame:
    """The latest cases. Dates are compared as text by default, as they are stored; date_order="parsed" reads them."""
    date = F.col("date") if date_order == "string" else F.coalesce(*[F.try_to_date("date", F.lit(f)) for f in ("dd-MM-yyyy", "yyyy-MM-dd", "dd/MM/yyyy")])
    return cases.orderBy(date.desc_nulls_last(), "id").limit(limit)


def citation_sample(cites: DataFrame, articles: DataFrame, n: int = 10) -> DataFrame:
    """The first n edges with document and number of both ends, null where there is no such article; edges are cut before they
    meet the articles."""
    few = cites.select("src", "dst").orderBy("src", "dst").limit(n)
    side = lambda k: articles.select(F.col("id").alias(k), F.col("document_title").alias(f"{k}_document"), F.col("article_number").alias(f"{k}_number"))
    return few.join(side("src"), "src", "left").join(side("dst"), "dst", "left").orderBy("src", "dst")


def recall_at_k(retrieved: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """query_id, expected, hits, recall. retrieved: query_id, section, rank; gold: query_id, sections (array). Each expected
    section counts, repeated ones too; a question without any has recall 1."""
    expected = gold.select("query_id", F.explode("sections").alias("section"))
    seen = retrieved.where(F.col("rank") <= k).select("query_id", F.lower(text("section")).alias("section")).distinct().withColumn("hit", F.lit(1))
    hits = expected.join(seen, ["query_id", "section"], "left").groupBy("query_id").agg(F.count("*").alias("expected"), F.count("hit").alias("hits"))
    out = gold.select("query_id").join(hits, "query_id", "left").select("query_id", F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("hits", F.lit(0)).alias("hits"))
    return out.withColumn("recall", F.when(F.col("expected") > 0, F.col("hits") / F.col("expected")).otherwise(1.0))


def mean_recall(per_query: DataFrame) -> DataFrame:
    return per_query.agg(F.count("*").alias("questions"), F.avg("recall").alias("recall"))


def answer_accuracy(preds: DataFrame) -> DataFrame:
    """questions, correct, failed, accuracy: a label is right if it is the expected one and generation did not fail."""
    right = (F.lower(text("predicted_label")) == F.lower(text("expected_answer"))) & ~F.coalesce("generation_failed", F.lit(False))
    return preds.agg(F.count("*").alias("questions"), F.count_if(right).alias("correct"), F.count_if(F.coalesce("generation_failed", F.lit(False))).alias("failed")).withColumn("accuracy", F.try_divide("correct", "questions"))


def union_courts(*courts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), courts)


def dedupe_first(df: DataFrame, key: str | Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key, in order."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def enrichment_summary(rows: DataFrame, group: str = "court") -> DataFrame:
    """group, total, text_ok, skipped, errors, http_errors, updated; the row `ALL` is the total. rows: status, updated."""
    rolled = rows.withColumn(group, F.coalesce(group, F.lit("Unknown Court"))).rollup(group).agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "ok").alias("text_ok"), F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.count_if(F.startswith("status", F.lit("error"))).alias("errors"), F.count_if(F.startswith("status", F.lit("error:http"))).alias("http_errors"), F.count_if("updated").alias("updated"), F.grouping(group).alias("g"),
    )
    return rolled.withColumn(group, F.when(F.col("g") == 1, "ALL").otherwise(F.col(group))).drop("g")
