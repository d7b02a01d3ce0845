"""Retrieval for whole batches of questions: search, expansion, fusion, ranking, context (Q1 to Q14).

Ranked tables have query_id and id. Texts are left out until the ranks are settled, and joined back to the few that stay.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import text, usable, words
from ..sources.shared import written
from . import fulltext
from .datasets import _numbered

#: Parts to which the blocks of a question and kind are dealt before they meet in one context.
PARTS = 64


def _rank(df: DataFrame, order: Sequence[Column | str], k: int | None, by: str = "query_id", name: str = "rank") -> DataFrame:
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return out if k is None else out.where(F.col(name) <= k)


def keyword_search(queries: DataFrame, corpus: DataFrame | fulltext.Index, columns: Sequence[str] = ("content",), k: int = 10, column: str = "text", digits: int | None = None) -> DataFrame:
    """query_id, id, score, rank: the k best by BM25 for each question, from a stored index (see fulltext.search), or from one
    that is made here of the columns of corpus."""
    index = corpus if isinstance(corpus, fulltext.Index) else fulltext.build_index(corpus, columns)
    return fulltext.search(queries, index, k, column, digits)


#: Neighbours in a part of a node's stored list.
PART = 32


def build_adjacency(edges: DataFrame) -> DataFrame:
    """src, part, dsts: the distinct neighbours of each node in order, PART in a part, written once for all later questions.

    A hub has many parts, which no task holds together: edges are numbered over all ranges, and a place in a node's list is the
    distance from its first number.
    """
    own = _numbered(edges.select("src", "dst").where("src is not null and dst is not null").distinct(), "src", "dst", name="_n")
    first = own.groupBy("src").agg(F.min("_n").alias("_first"))
    parts = own.join(first, "src").withColumn("part", F.floor((F.col("_n") - F.col("_first")) / PART))
    return written(parts.groupBy("src", "part").agg(F.sort_array(F.collect_list("dst")).alias("dsts")))


def related_articles(starts: DataFrame, edges: DataFrame, depth: int = 2, limit: int | None = 15) -> DataFrame:
    """query_id, id, distance (and rank): distinct (node, distance) over directed paths of 1 to depth edges (src, dst), the nearest
    first and then by id, at most limit of them. edges may be a stored adjacency.

    A path does not use an edge twice, but may come back to a start. Levels are expanded one after another, and a question stops
    as soon as limit rows are known. Of a node only the parts with its first neighbours are read: if it has more than
    limit, its question stops at this level, and the smallest ids are among them. So a level has at most limit nodes of
    a question to expand, each to about as many, whatever hubs there are. Without a limit all paths are followed.
    """
    steps = edges if "dsts" in edges.columns else build_adjacency(edges)
    if limit is not None:
        steps = steps.where(F.col("part") * PART < limit + depth)
    frontier = starts.select("query_id", F.col("id").alias("start"), F.col("id").alias("at"), F.array().cast("array<string>").alias("used")).distinct()
    found = None
    for d in range(1, depth + 1):
        edge = F.concat_ws(">", F.col("at").cast("string"), F.col("next").cast("string"))
        moved = frontier.join(steps, F.col("at") == F.col("src")).select("query_id", "start", "at", "used", F.explode("dsts").alias("next")).where(~F.array_contains("used", edge))
        moved = moved.select("query_id", "start", F.col("next").alias("at"), (F.array_append("used", edge) if d < depth else F.array().cast("array<string>")).alias("used")).distinct()
        moved = written(moved) if d < depth else moved
        level = moved.select("query_id", F.col("at").alias("id")).distinct().withColumn("distance", F.lit(d))
        found = level if found is None else found.union(level)
        if d < depth:
            frontier = moved if limit is None else moved.join(found.groupBy("query_id").count().where(F.col("count") >= limit).select("query_id"), "query_id", "left_anti")
    return _rank(found, ["distance", "id"], limit)


def cases_citing(articles: DataFrame, case_cites: DataFrame, cases: DataFrame, k: int = 2, date_order: str = "string", by: str = "id") -> DataFrame:
    """The latest k cases that cite each article: (query_id if there is one,) article_id, id, date, rank."""
    key = ["query_id"] if "query_id" in articles.columns else []
    met = articles.select(*key, F.col(by).alias("article_id")).distinct().join(case_cites.select("case_id", "article_id").distinct(), "article_id")
    rows = met.join(cases.select(F.col("id").alias("case_id"), "date"), "case_id").withColumnRenamed("case_id", "id")
    date = F.col("date") if date_order == "string" else F.coalesce(*[F.try_to_date("date", F.lit(f)) for f in ("dd-MM-yyyy", "yyyy-MM-dd", "dd/MM/yyyy")])
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*key, "article_id").orderBy(date.desc_nulls_last(), "id"))).where(F.col("rank") <= k)


#: Weights of semantic, keyword and graph (articles) or case (cases) scores; blend with the scorer; least final score.
TUNED = {"article": (0.45, 0.35, 0.20), "case": (0.4, 0.2, 0.4), "blend": (0.5, 0.5), "threshold": 0.10}
UNTUNED = {"article": (0.5, 0.3, 0.2), "case": (0.4, 0.2, 0.4), "blend": (0.3, 0.7), "threshold": 0.20}


def multi_stage(
    semantic_articles: DataFrame, keyword_articles: DataFrame, semantic_cases: DataFrame, keyword_cases: DataFrame, edges: DataFrame, case_cites: DataFrame, cases: DataFrame,
    anchors: DataFrame | None = None, texts: DataFrame | None = None, queries: DataFrame | None = None, scorer: Callable | None = None, top_k: int = 10, tuned: bool = True,
) -> DataFrame:
    """query_id, id, type, semantic, keyword, third, combined, final, anchored, rank.

    Recall: 15 semantic and 10 keyword articles, 5 and 3 cases, articles reached from the first five (first ten of them),
    two citing cases for each of the first three. Channels are united and reduced by one aggregation on (query_id, type,
    id). The 30 best by weight are re-ranked if there is a scorer (texts has id, type, text), and cut at the threshold;
    anchors that are not among them go first. A node is reached at two distances at most, so the first 20 reached have the first ten nodes.
    """
    p = TUNED if tuned else UNTUNED
    cut = lambda df, n, c: _rank(df, ["rank"], n, name="_r").select("query_id", "id", F.col(c).alias("score"), F.col("_r").alias("place"))
    sa, ka = cut(semantic_articles, 15, "similarity"), cut(keyword_articles, 10, "score")
    sc, kc = cut(semantic_cases, 5, "similarity"), cut(keyword_cases, 3, "score")
    merged = sa.withColumn("c", F.lit(0)).union(ka.withColumn("c", F.lit(1))).groupBy("query_id", "id").agg(F.min(F.struct("c", "place")).alias("first"))
    leading = _rank(merged, ["first", "id"], 5)
    near = related_articles(leading, edges, 2, 20).groupBy("query_id", "id").agg(F.min("distance").alias("distance"))
    graph = _rank(near, ["distance", "id"], 10).select("query_id", "id", (1 / (F.col("distance") + 1)).alias("score"))
    citing = cases_citing(leading.where("rank <= 3"), case_cites, cases, 2).select("query_id", "id").distinct()

    channel = lambda df, kind, name: df.select("query_id", "id", F.lit(kind).alias("type"), F.lit(name).alias("channel"), "score")
    rows = channel(sa, "article", "semantic").union(channel(ka, "article", "keyword")).union(channel(sc, "case", "semantic")).union(channel(kc, "case", "keyword"))
    rows = rows.union(channel(graph, "article", "graph")).union(channel(citing.withColumn("score", F.lit(0.7)), "case", "citing"))
    best = lambda name: F.max(F.when(F.col("channel") == name, F.col("score")))
    fused = rows.groupBy("query_id", "type", "id").agg(best("semantic").alias("s"), best("keyword").alias("k"), best("graph").alias("g"))
    article = F.col("type") == "article"
    third = F.when(article, F.coalesce("g", F.lit(0.0))).when(F.col("s").isNotNull(), 0.9).when(F.col("k").isNotNull(), 0.8).otherwise(0.7)
    fused = fused.select("query_id", "type", "id", F.coalesce("s", F.lit(0.0)).alias("semantic"), F.coalesce("k", F.lit(0.0)).alias("keyword"), third.alias("third"))
    weigh = lambda w: w[0] * F.col("semantic") + w[1] * F.col("keyword") + w[2] * F.col("third")
    fused = fused.withColumn("combined", F.when(article, weigh(p["article"])).otherwise(weigh(p["case"])))
    thirty = _rank(fused, [F.desc("combined"), "type", "id"], 30)
    if scorer is None:
        final = thirty.withColumn("final", F.col("combined"))
    else:
        scored = _scored(thirty, queries, texts, scorer)
        final = scored.withColumn("final", p["blend"][0] * F.col("combined") + p["blend"][1] * F.col("relevance")).where(F.col("final") >= p["threshold"]).drop("relevance")
    final = final.drop("rank").withColumn("anchored", F.lit(False)).withColumn("position", F.lit(1 << 30))
    if anchors is not None:
        new = anchors.join(final.where("type = 'article'").select("query_id", "id"), ["query_id", "id"], "left_anti")
        zero = F.lit(0.0)
        final = final.unionByName(new.select("query_id", F.lit("article").alias("type"), "id", zero.alias("semantic"), zero.alias("keyword"), zero.alias("third"), F.lit(1.0).alias("combined"), F.lit(1.0).alias("final"), F.lit(True).alias("anchored"), F.col("position").cast("int").alias("position")))
    return _rank(final, ["position", F.desc("final"), "type", "id"], top_k).drop("position")


def _scored(candidates: DataFrame, queries: DataFrame, texts: DataFrame, scorer: Callable) -> DataFrame:
    """candidates with relevance = sigmoid(scorer(questions, texts of at most 1500 characters)).

    candidates are few per question, so they are the small side; texts are met once.
    """
    key = ["id", "type"] if "type" in texts.columns and "type" in candidates.columns else ["id"]

    @F.pandas_udf("double")
    def score(q: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series(scorer(q.tolist(), t.tolist()), dtype=float)

    met = candidates.join(texts.select(*key, F.substring(F.coalesce("text", F.lit("")), 1, 1500).alias("_t")), key, "left").join(queries.select("query_id", F.col("text").alias("_q")), "query_id")
    return met.withColumn("relevance", 1 / (1 + F.exp(-score("_q", F.coalesce("_t", F.lit("")))))).drop("_q", "_t")


def rerank(candidates: DataFrame, k: int = 5, threshold: float = 0.2, scorer: Callable | None = None, queries: DataFrame | None = None, texts: DataFrame | None = None, digits: int | None = None) -> DataFrame:
    """candidates (current, rank) with final, the best k: 0.3 of the current score and 0.7 of the scorer's, not below the
    threshold; digits rounds it before it is ranked. Without a scorer the first k stay as they are."""
    if scorer is None:
        return _rank(candidates, ["rank"], k, name="_r").withColumn("final", F.col("current")).withColumn("rank", F.col("_r")).drop("_r")
    out = _scored(candidates, queries, texts, scorer).withColumn("final", 0.3 * F.col("current") + 0.7 * F.col("relevance")).where(F.col("final") >= threshold)
    out = out if digits is None else out.withColumn("final", F.round("final", digits))
    return _rank(out.drop("rank", "relevance"), [F.desc("final"), "id"], k)


def retrieve_statutes(semantic: DataFrame, keyword: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, id, similarity, score, rank: both channels merged; one in both has 0.5 more; one found by words only
    counts as 0. top_k + 5 stay (top_k is 10 for complex questions, else 5)."""
    limits = queries.select("query_id", (F.when(F.col("complexity") == "complex", 10).otherwise(5)).alias("top_k"))
    best = semantic.select("query_id", "id", "similarity", F.col("rank").alias("rs")).join(limits, "query_id").where("rs <= top_k").drop("top_k")
    words_ = keyword.select("query_id", "id", "score", F.col("rank").alias("rk")).join(limits, "query_id").where("rk <= top_k").drop("top_k")
    both = best.join(words_, ["query_id", "id"], "full_outer")
    both = both.withColumn("similarity", F.when(F.col("similarity").isNotNull() & F.col("score").isNotNull(), F.col("similarity") + 0.5).otherwise(F.col("similarity")))
    ranked = _rank(both, [F.coalesce("similarity", F.lit(0.0)).desc(), F.col("rs").asc_nulls_last(), F.col("rk").asc_nulls_last(), "id"], None)
    return ranked.join(limits, "query_id").where(F.col("rank") <= F.col("top_k") + 5).select("query_id", "id", "similarity", "score", "rank")


def retrieve_cases(semantic: DataFrame, keyword: DataFrame) -> DataFrame:
    """query_id, id, similarity, score, rank: 5 semantic cases, then those of 3 keyword cases that are not among them."""
    s = semantic.where("rank <= 5").select("query_id", "id", "similarity", F.lit(None).cast("double").alias("score"), F.lit(0).alias("channel"), F.col("rank").alias("r"))
    k = keyword.where("rank <= 3").select("query_id", "id", F.lit(None).cast("double").alias("similarity"), "score", F.lit(1).alias("channel"), F.col("rank").alias("r"))
    one = s.union(k).withColumn("n", F.row_number().over(Window.partitionBy("query_id", "id").orderBy("channel", "r"))).where("n = 1")
    return _rank(one, ["channel", "r"], None).drop("n", "channel", "r")


def grade_and_combine(statutes: DataFrame, cases: DataFrame, backfill: DataFrame | None = None, k: int = 5, **scoring) -> DataFrame:
    """query_id, id, type, final, rank, fallback: each side re-ranked to k; a side that the threshold empties keeps its raw
    order; questions without statutes take those of backfill (query_id, id, combined, rank). Statutes come before cases.
    """
    derived = F.when(F.col("score") > 0, 1 - F.exp(-F.col("score") / 8)).otherwise(0.0)

    def side(df: DataFrame, kind: str) -> DataFrame:
        has = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("double")
        raw = df.select("query_id", "id", "rank", has("similarity").alias("similarity"), has("combined").alias("combined"), has("score").alias("score"))
        raw = raw.withColumn("current", F.coalesce("combined", "similarity", F.lit(0.0))).withColumn("type", F.lit(kind))
        good = rerank(raw, k, **scoring).select("query_id", "id", "type", "final", "rank", F.lit(False).alias("fallback"))
        left = raw.join(good.select("query_id").distinct(), "query_id", "left_anti")
        order = F.coalesce("similarity", "combined", "score", F.lit(0.0)) if kind == "article" else F.coalesce("similarity", "score", F.lit(0.0))
        kept = _rank(left.drop("rank"), [order.desc(), "id"], k).select("query_id", "id", "type", F.coalesce("similarity", "combined", derived).alias("final"), "rank", F.lit(True).alias("fallback"))
        return good.union(kept)

    articles, found = side(statutes, "article"), side(cases, "case")
    if backfill is not None:
        more = backfill.join(statutes.select("query_id").distinct(), "query_id", "left_anti").where(F.col("rank") <= k)
        articles = articles.union(more.select("query_id", "id", F.lit("article"), F.col("combined"), F.col("rank"), F.lit(True)))
    return _rank(articles.union(found).withColumnRenamed("rank", "r"), ["type", "r", "id"], None).drop("r")


def hybrid_search(semantic: DataFrame, keyword: DataFrame, edges: DataFrame, k: int = 10) -> DataFrame:
    """query_id, id, combined, rank: 10 semantic and 8 keyword articles and what is within two steps of them; 0.15 and 0.15 of
    these scores and 0.70 of 1 / distance. A neighbour keeps the distance from the first hit that reaches it, keyword
    hits first; one that is a hit itself has no distance."""
    s, w = semantic.where("rank <= 10"), keyword.where("rank <= 8")
    hits = w.select("query_id", "id", F.struct(F.lit(0).alias("c"), "rank").alias("place")).union(s.select("query_id", "id", F.struct(F.lit(1).alias("c"), "rank").alias("place")))
    starts = hits.groupBy("query_id", "id").agg(F.min("place").alias("place"))
    keyed = starts.select(F.struct("query_id", F.col("id").alias("from"), "place").alias("query_id"), "id")
    near = related_articles(keyed, edges, 2, 15).select("query_id.query_id", F.col("query_id.place").alias("place"), "id", "distance")
    near = near.join(hits.select("query_id", "id").distinct(), ["query_id", "id"], "left_anti").groupBy("query_id", "id").agg(F.min_by("distance", F.struct("place", "distance")).alias("distance"))
    none = F.lit(None).cast("double")
    rows = s.select("query_id", "id", F.col("similarity").alias("s"), none.alias("k"), none.alias("g")).union(w.select("query_id", "id", none, "score", none)).union(near.select("query_id", "id", none, none, 1 / F.col("distance")))
    zero = F.lit(0.0)
    out = rows.groupBy("query_id", "id").agg((0.15 * F.coalesce(F.max("s"), zero) + 0.15 * F.coalesce(F.max("k"), zero) + 0.70 * F.coalesce(F.max("g"), zero)).alias("combined"))
    return _rank(out, [F.desc("combined"), "id"], k)


def merge_subqueries(results: DataFrame, k: int = 12, threshold: float = -1.0, keep: int = 5) -> DataFrame:
    """query_id, id, final, rank: over the sub-queries of a question the best row of each id; not below the threshold unless
    that leaves none (then the best `keep`); the first k."""
    best = results.groupBy("query_id", "id").agg(F.max("final").alias("final"))
    w = Window.partitionBy("query_id")
    ranked = _rank(best, [F.desc("final"), "id"], None).withColumn("_any", F.max(F.col("final") >= threshold).over(w))
    return ranked.where(((F.col("final") >= threshold) | (~F.col("_any") & (F.col("rank") <= keep))) & (F.col("rank") <= k)).drop("_any")


def context_blocks(ranked: DataFrame, articles: DataFrame, cases: DataFrame, relevant: DataFrame | None = None, n: int = 3) -> DataFrame:
    """query_id, type, rank, header, content for build_context, from ranked rows (query_id, type, id, rank).

    An id of a question and type counts once, where it is first; rank becomes its place among the statutes or cases. At clause
    level, with relevant (query_id, article_id, text, rank: vectors.relevant_clauses), a statute's content is its n nearest
    clauses; one without clauses or content keeps its content. Articles: id, document_title, article_number, title, content;
    cases: id, citation, court, date, title, pdf_data, summary, pdf_link.
    """
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("N/A"))
    one = ranked.groupBy("query_id", "type", "id").agg(F.min("rank").alias("rank"))
    one = one.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "type").orderBy("rank", "id")))
    law = one.where("type = 'article'").join(articles.select("id", "document_title", "article_number", F.col("title").alias("_t"), F.col("content").alias("_c")), "id")
    whole = F.concat(F.lit("Content: "), named("_c"))
    if relevant is not None:
        best = relevant.where((F.col("rank") <= n) & (F.col("text") != "")).groupBy("query_id", F.col("article_id").alias("id"))
        lines = best.agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "text"))), lambda x: F.concat(F.lit("- "), x["text"])).alias("_l"))
        law = law.join(lines, ["query_id", "id"], "left")
        whole = F.when(F.col("_l").isNotNull() & (F.coalesce("_c", F.lit("")) != ""), F.concat(F.lit("Relevant Clauses:\n"), F.array_join("_l", "\n"))).otherwise(whole)
    head = F.concat(F.lit("[Statutory Law "), F.col("rank"), F.lit("]\nDocument: "), named("document_title"), F.lit("\nArticle "), named("article_number"), F.lit(": "), named("_t"))
    law = law.select("query_id", "type", "rank", head.alias("header"), whole.alias("content"))
    case = one.where("type = 'case'").join(cases.select("id", "citation", "court", "date", "title", "pdf_data", "summary", "pdf_link"), "id")
    head = F.concat(F.lit("[Case Law "), F.col("rank"), *[x for c in ("citation", "court", "date", "title") for x in (F.lit(("]" if c == "citation" else "") + f"\n{c.capitalize()}: "), named(c))])
    body = F.when(usable("pdf_data"), F.concat(F.lit("Judgment Text:\n"), F.substring("pdf_data", 1, 1500))).otherwise(F.concat(F.lit("Summary: "), named("summary")))
    link = F.when(F.coalesce("pdf_link", F.lit("")) != "", F.concat(F.lit("\nFull Judgment: "), "pdf_link")).otherwise("")
    return law.union(case.select("query_id", "type", "rank", head.alias("header"), F.concat(body, link).alias("content")))


def build_context(ranked: DataFrame, max_words: int | str = 1500) -> DataFrame:
    """query_id, context from rows of query_id, type, rank, header, content, within a budget of words.

    Statutes come first, then cases. A block that would pass the budget is cut to what is left, with `...`, if its header
    fits; the rest of its kind is dropped, and the cut block does not count against the cases.

    A question may have any number of blocks: they are dealt to PARTS parts, texts cut to the budget, and a block before
    which its own part alone passes the budget goes. What is left to order as a whole is bounded by PARTS and the budget.
    """
    budget = F.col(max_words) if isinstance(max_words, str) else F.lit(max_words)
    n = lambda c: F.size(words(F.coalesce(F.col(c), F.lit(""))))
    rows = ranked.withColumns({"_b": budget, "_h": n("header"), "_w": n("header") + n("content")})
    within = F.array_join(F.slice(words("content"), 1, F.greatest(F.col("_b"), F.lit(1))), " ")
    rows = rows.withColumn("content", F.when(F.col("_w") - F.col("_h") > F.col("_b"), within).otherwise(F.col("content")))
    part = Window.partitionBy("query_id", "type", F.pmod(F.xxhash64("rank"), F.lit(PARTS))).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_before", F.sum("_w").over(part) - F.col("_w")).where("_before <= _b").drop("_before")
    order = Window.partitionBy("query_id", "type").orderBy("rank")
    rows = rows.withColumn("_to", F.sum("_w").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    w = Window.partitionBy("query_id")
    used = F.max(F.when((F.col("type") == "article") & (F.col("_to") <= F.col("_b")), F.col("_to"))).over(w)
    rows = rows.withColumn("_base", F.when(F.col("type") == "article", F.lit(0)).otherwise(F.coalesce(used, F.lit(0)))).withColumn("_all", F.col("_base") + F.col("_to"))
    before = F.col("_all") - F.col("_w")
    fits, first_over = F.col("_all") <= F.col("_b"), (F.col("_all") > F.col("_b")) & (before <= F.col("_b"))
    left = F.col("_b") - before - F.col("_h")
    cut = F.concat(F.col("header"), F.lit("\n"), F.array_join(F.slice(words("content"), 1, F.greatest(left, F.lit(1))), " "), F.lit("..."))
    block = F.when(fits, F.concat_ws("\n", "header", "content")).when(first_over & (left > 0), cut)
    # nothing of a kind follows its first block that does not fit: running sums only grow
    rows = rows.withColumn("_block", block).where(F.col("_block").isNotNull())
    parts = F.transform(F.sort_array(F.collect_list(F.struct("type", "rank", "_block"))), lambda x: x["_block"])
    return rows.groupBy("query_id").agg(F.array_join(parts, "\n\n").alias("context"))


def merge_laws(rows: DataFrame, group: str, order: Sequence[str], limit: int | None = None) -> DataFrame:
    """The first row for each (document, article) of a group, in order; the first `limit` if given."""
    one = rows.withColumn("_n", F.row_number().over(Window.partitionBy(group, "document", "article").orderBy(*order))).where("_n = 1").drop("_n")
    return _rank(one, list(order) + ["document", "article"], limit, by=group, name="place")


def prompt_context(ranked: DataFrame, n: int = 5) -> DataFrame:
    """query_id, context: `Article number: content` of the first n, joined by blank lines."""
    line = F.concat(F.lit("Article "), F.coalesce(F.col("article_number").cast("string"), F.lit("None")), F.lit(": "), F.coalesce("content", F.lit("")))
    rows = _rank(ranked, ["rank"], n, name="_n").select("query_id", "_n", line.alias("line"))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", "line"))), lambda x: x["line"]), "\n\n").alias("context"))


def draft_context(narratives: DataFrame, laws: DataFrame, cases: DataFrame, strict: bool = False) -> DataFrame:
    """id, context: the narrative, then its first five laws and first four cases as lines. Nulls are left out; with strict they are
    so as in SQL: a line with a null is none, though it has its place, and without a narrative, laws or cases there is no context."""
    words = (lambda *c: F.concat(*[x for k in c for x in (F.lit(" "), F.col(k))][1:])) if strict else (lambda *c: F.concat_ws(" ", *c))
    lines = lambda df, n, body: _rank(df, ["rank"], n, by="id", name="_n").select("id", "_n", F.concat(F.lit("- "), body).alias("line"))
    joined = lambda df, name: df.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", "line"))), lambda x: x["line"]), "\n").alias(name))
    a = joined(lines(laws, 5, words("document", "article", "title")), "laws")
    b = joined(lines(cases, 4, words("citation", "title")), "cases")
    met = narratives.join(a, "id", "left").join(b, "id", "left")
    if strict:
        return met.select("id", F.concat("narrative", F.lit("\n\n"), F.nullif("laws", F.lit("")), F.lit("\n\n"), F.nullif("cases", F.lit(""))).alias("context"))
    return met.select("id", F.concat_ws("\n\n", "narrative", "laws", "cases").alias("context"))


def analyse_narratives(narratives: DataFrame, retrieved: DataFrame) -> DataFrame:
    """id, laws, cases, checklist, merit, reasons for each narrative, from its retrieved rows (query_id = id)."""
    from .scorers import case_merit, evidence_checklist

    rows = F.transform(F.sort_array(F.collect_list(F.struct("rank", F.col("id").alias("ref")))), lambda x: x["ref"])
    sides = lambda kind, name: retrieved.where(F.col("type") == kind).groupBy("query_id").agg(rows.alias(name))
    out = narratives.join(sides("article", "laws").withColumnRenamed("query_id", "id"), "id", "left").join(sides("case", "cases").withColumnRenamed("query_id", "id"), "id", "left")
    none = F.array().cast(retrieved.select(F.array("id")).schema[0].dataType)
    out = out.withColumns({"laws": F.coalesce("laws", none), "cases": F.coalesce("cases", none), "checklist": evidence_checklist("narrative", "ocr_text", "incident_date")})
    out = out.withColumn("merit", case_merit("checklist", F.size("cases"), F.size("laws")))
    missing = F.transform(F.filter("checklist", lambda c: c["status"] == "missing"), lambda c: F.concat(F.lit("Missing: "), c["label"]))
    return out.withColumn("reasons", missing).select("id", "laws", "cases", "checklist", "merit", "reasons")


def case_text() -> Column:
    """What a scorer reads of a case: title, and usable text or summary."""
    return F.concat_ws(" ", text("title"), F.when(usable("pdf_data"), F.substring("pdf_data", 1, 1500)).otherwise(F.col("summary")))
