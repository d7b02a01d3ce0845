"""Operators on hand-made rows, by meaning."""

import json
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from legalspark.functions import text as tx
from legalspark.operators import datasets, filters, graph, reports, retrieval, scorers, structure, vectors
from legalspark.plans import table_queries
from legalspark.sources import html, tables
from legalspark.streaming import cases as case_stream
from legalspark.streaming import history


FIXTURES = f"file://{Path(__file__).parent}/fixtures"


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


# --- filters and labels ---


def test_listing_reasons(spark):
    df = spark.createDataFrame([(1, "Cyber  Crime Wing of the FIA"), (2, "by FIA only"), (3, "magnificial")], "id int, t string")
    got = {r["id"]: r for r in filters.classify_listing(df, "t").collect()}
    assert set(got) == {1, 2}
    assert [(x["kind"], x["matched"]) for x in got[1]["triggers"]] == [("phrase", "cyber crime"), ("phrase", "cyber crime wing"), ("word_token", "fia")]
    assert got[1]["reason"].endswith("Additional triggers: phrase:'cyber crime wing', word_token:'fia'.")
    assert got[2]["reason"] == 'Listing text contains token "fia" as a whole word (word-boundary match; profile cyber_law_v1).'


def test_relevance_thresholds(spark):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate((3.5, -2.1, -4.7, 0.8))], "query_id int, id int, score double")
    assert filters.filter_relevant(df, 0.0).count() == 2
    assert rows(filters.filter_relevant(df, 10.0), "id") == [(0,), (1,), (3,)]


def test_greetings(spark):
    df = spark.createDataFrame([("Hi!",), ("hello bail",), ("What is the law of bail here",), ("",), ("hey you",)], "t string")
    assert [r["g"] for r in df.select(filters.is_greeting("t").alias("g")).collect()] == [True, False, False, False, True]


def test_winners(spark):
    texts = ["this writ petition is allowed", "the bail petition is dismissed", "appeal partly allowed", "granted bail but stands dismissed; petition is allowed", "nothing", "", "[ERROR: 404]"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, pdf_data string").withColumn("winner", F.lit(None).cast("string"))
    assert [r["winner"] for r in scorers.infer_winner(df).orderBy("id").collect()] == ["petitioner", "respondent", "mixed", "mixed", "unknown", "unknown", "unknown"]
    filled = scorers.fill_winner(df.withColumn("winner", F.when(F.col("id") == 0, "respondent")), winner_only=True)
    assert [(r["winner"], r["updated"]) for r in filled.orderBy("id").collect()][:2] == [("respondent", False), ("respondent", True)]


def test_query_classes(spark):
    asked = {
        "What is Section 497?": "simple", "Can I get bail?": "simple", "Tell me about anticipatory bail": "simple", "What is the difference between Section 302 and Section 304 PPC?": "simple",
        "What is the punishment for theft?": "moderate", "What if I am sued? What then?": "complex", "": "simple",
    }
    df = scorers.classify_query(spark.createDataFrame([(q,) for q in asked], "text string"))
    assert {r["text"]: r["complexity"] for r in df.collect()} == asked


def test_merit(spark):
    full = "legal notice of 2024-05-01 in Lahore, cnic, harm, witness"
    df = spark.createDataFrame([(1, full, 5, 6), (2, "nothing", 0, 0)], "id int, t string, c int, s int").withColumn("k", scorers.evidence_checklist("t"))
    got = {r["id"]: r["m"] for r in df.select("id", scorers.case_merit("k", "c", "s").alias("m")).collect()}
    assert (got[1]["score"], got[1]["label"], got[2]["score"], got[2]["evidence_weight"]) == (92, "High Merit", 25, "Weak")


def test_facts(spark):
    got = spark.createDataFrame([("One line\n\n Two Karachi Karachi\n",)], "t string").select(scorers.extract_facts("t").alias("f")).first()["f"]
    assert got["facts"] == ["One line", "Two Karachi Karachi"] and got["entities"] == ["One", "Two", "Karachi"] and got["confidence"] == 0.55


def test_facts_of_all_documents(spark, tmp_path):
    texts = ["Plain Karachi text\nSecond Line", "Élan Paris Müller Straße\n\nÉric à Paris Zürich NaÏf", "日本 Tokyo Tokyo年 Osaka", "", None, "Ñandú Abc " + "é" * 260]
    spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").write.parquet(str(tmp_path / "documents.parquet"))
    expected = []
    for k, t in enumerate(texts):
        t = (t or "").strip()
        names = list(dict.fromkeys(re.findall(r"\b[A-Z][a-zA-Z]{2,}\b", t)))[:12]
        expected.append((k, "|".join([x.strip() for x in t.split("\n") if x.strip()][:8]), 0.2 if not t else 0.75 if len(t) > 250 else 0.55, len(names)))
    assert rows(table_queries.r7_extract_facts(spark, str(tmp_path)), "doc_id", "facts", "confidence", "n_entities") == expected


def test_titles_and_files(spark):
    titles = spark.createDataFrame([("Pakistan Penal Code",), ("Telecom licensing framework",), ("Pakistan something",)], "title string")
    files = spark.createDataFrame([("Pakistan Penal Code-Cleaned.pdf",), ("Pakistan Penal Code.pdf",), ("licensing framework 2020.pdf",)], "file string")
    assert rows(scorers.match_titles_to_files(titles, files), "title", "file") == sorted([("Pakistan Penal Code", "Pakistan Penal Code-Cleaned.pdf"), ("Telecom licensing framework", "licensing framework 2020.pdf"), ("Pakistan something", None)], key=str)


# --- graph ---

ARTICLES = [("A:20", "A", "20"), ("A:302", "A", "302"), ("B:20", "B", "20"), ("B:7", "B", "7"), ("C:302", "C", "302")]


def articles(spark):
    return spark.createDataFrame(ARTICLES, "id string, document_title string, article_number string")


def test_references_and_resolution(spark):
    text = "see Section 20 and article 7; clause (b) of section 302a. Order XIV, order made"
    refs = graph.extract_references(spark.createDataFrame([("B:9", "B", text), ("A:20", "A", None)], "id string, document_title string, content string"))
    assert [(r["type"], r["number"]) for r in refs.orderBy("ref_order").collect()] == [("section", "20"), ("section", "302a"), ("article", "7"), ("clause", "b"), ("order", "XIV"), ("order", "m")]
    same = graph.resolve_citations(refs, articles(spark))
    assert rows(same, "number", "dst") == [("20", "B:20"), ("7", "B:7")]
    base = graph.resolve_citations(refs, articles(spark), "base_number")
    assert rows(base, "number", "dst") == [("20", "B:20"), ("302a", "A:302"), ("7", "B:7")]
    assert rows(graph.merge_cites(same), "src", "dst", "reference_type") == [("B:9", "B:20", "section"), ("B:9", "B:7", "article")]


def test_co_citation(spark):
    edges = spark.createDataFrame([(s, t) for t in (1, 2, 3) for s in range(10, 14)] + [(10, 1), (99, 1), (50, 7)], "src int, dst int")
    got = rows(graph.related_through(edges), "id1", "id2", "shared_citations")
    assert got == [(a, b, 3) for a in range(10, 14) for b in range(a + 1, 14)]
    assert graph.related_through(edges, max_hub=4).count() == 6


def test_concepts(spark):
    df = spark.createDataFrame([("x", "D", "Bail and custody; the bailiff", [("entity", " FIA "), ("phrase", "the court"), ("phrase", "legal aid")])], "id string, document_title string, content string, extra array<struct<kind:string,text:string>>")
    got = graph.extract_concepts(df, ["bail", "custody", "murder"], "extra")
    assert got.first()["concepts"] == ["bail", "custody", "fia", "legal aid"]
    names, edges = graph.build_concepts(got, "add", spark.createDataFrame([("x", "bail"), ("y", "old")], "article_id string, concept string"))
    assert edges.count() == 5 and names.count() == 5
    assert graph.build_concepts(got, "replace", edges, "D")[1].count() == 5


def test_provisions(spark):
    cases = spark.createDataFrame([("c1", "State v X", "1", "", "u/s 420 PPC and Sec. 20 of it, S. 7", "")], "id string, title string, case_no string, summary string, pdf_data string, discussed_laws string")
    found = graph.extract_case_citations(cases)
    assert rows(found, "provision") == [("20",), ("420",), ("7",)]
    linked = graph.link_cases(found, articles(spark))
    assert rows(linked, "case_id", "article_id", "provision") == [("c1", "A:20", "20"), ("c1", "B:7", "7")]
    two = spark.createDataFrame([("c1", "2"), ("c1", "02")], "case_id string, provision string")
    assert rows(graph.link_cases(two, articles(spark)), "article_id", "provision") == [("A:20", "2"), ("A:302", "02")]


def test_query_citations(spark):
    asked = [
        (1, "Sections 20, 21(1), and 24(1) of PECA 2016-2025"), (2, "Section 171-G of PPC"), (3, "Under the PPC, what does it say? " + "x" * 20 + " Section 9"), (4, "Section 5 of nothing"), (5, None),
    ]
    got = graph.extract_query_citations(spark.createDataFrame(asked, "query_id int, text string"))
    assert rows(got, "query_id", "position", "number", "fragment") == [(1, 0, "20", "electronic crimes"), (1, 1, "21", "electronic crimes"), (1, 2, "24", "electronic crimes"), (2, 0, "171-g", "penal code"), (3, 0, "9", "penal code")]


def test_questions_that_share_an_id(spark):
    """Different texts of one id are questions of their own: each numbers its citations from 0, and an anchor has the least."""
    asked = [(7, "Are Sections 1 and 2 of the PPC in force?"), (7, "Are Sections 3 and 1 of the PPC in force?"), (7, "Are Sections 3 and 1 of the PPC in force?")]
    got = graph.extract_query_citations(spark.createDataFrame(asked, "query_id int, text string"))
    assert rows(got, "position", "number") == [(0, "1"), (0, "3"), (1, "1"), (1, "2")]
    articles = spark.createDataFrame([(k, "Penal Code", str(k)) for k in (1, 2, 3)], "id int, document_title string, article_number string")
    assert rows(graph.anchor_articles(got, articles), "query_id", "id", "position") == [(7, 1, 0), (7, 2, 1), (7, 3, 0)]


def test_anchors_of_articles_that_share_number_and_title(spark, tmp_path):
    """Each article that a question names is linked, also if others have its number and title: by its class, which has all of them."""
    from legalspark.plans import graph_queries

    parts = [(5, "Brand#3"), (155, "Brand#3"), (305, "Brand#6"), (455, "Brand#4"), (6, "Brand#3")]  # penal code: those of Brand#3 and 6
    spark.createDataFrame([(k, "x", b, 1) for k, b in parts], "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    lines = [(5, 6, 3), (5, 6, 3), (155, 7, 6), (5, 6, 4), (9, 9, 2)]  # sections 5 and 6 of the penal code; 5 and 7 of it; 5 and 6 of electronic crimes
    spark.createDataFrame(lines, "l_partkey long, l_suppkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = graph_queries.g12_anchor_articles(spark, str(tmp_path)).collect()
    members = [(r["class_id"], r["id"]) for r in got if r["query_id"] is None]
    links = sorted((r["query_id"], i, r["position"]) for r in got if r["id"] is None for c, i in members if c == r["class_id"])
    assert sorted(members) == [(5, 5), (5, 155), (5, 305), (6, 6), (455, 455)]
    assert links == [(5063, 5, 0), (5063, 6, 1), (5063, 155, 0), (5063, 305, 0), (5064, 455, 0), (155076, 5, 0), (155076, 155, 0), (155076, 305, 0)]
    assert {r["score"] for r in got} == {1.0, None} and len(got) == 9


def test_anchors_by_classes_are_those_one_by_one(spark, monkeypatch):
    """Titles with several fragments, numbers in other case, questions that share a text or an id, questions without citations."""
    titles = ["Penal Code", "THE PENAL CODE of the Constitution", "Constitution", "Electronic Crimes Act", None]
    articles = spark.createDataFrame([(k, titles[k % 5], [str(k % 3), "9A", None][k % 7 % 3]) for k in range(60)], "id long, document_title string, article_number string")
    asked = ["Sections 1 and 9a of the PPC, then section 1 of the Constitution", "Section 9A of the constitution and sections 2, 1 of the ppc", "none", None, "Section 0 of PECA"]
    asked = spark.createDataFrame([(k % 11, asked[k % 5]) for k in range(40)], "query_id long, text string")
    cited = graph.extract_query_citations(asked)
    a = articles.withColumn("number", F.lower("article_number"))
    plain = cited.join(a, "number").where(F.contains(F.lower("document_title"), F.col("fragment"))).groupBy("query_id", "id").agg(F.min("position").alias("position"))
    wanted = rows(plain, "query_id", "id", "position")
    assert len(wanted) > 100 and rows(graph.anchor_articles(cited, articles), "query_id", "id", "position") == wanted
    for small in (graph.SMALL, 0):
        monkeypatch.setattr(graph, "SMALL", small)
        anchors, members = graph.anchor_questions(asked, articles)
        assert members.select("id").distinct().count() == members.count()
        assert rows(anchors.join(members, "class_id"), "query_id", "id", "position") == wanted


def test_advanced_links_of_many_provisions(spark):
    """A case may name more provisions than the reference's 25, and its text may be longer than 10 000 characters."""
    articles = spark.createDataFrame([(k, str(k)) for k in range(100, 130)], "id int, article_number string")
    body = " ; ".join(f"under Section {k} " + "x" * 400 for k in range(100, 130))
    cases = spark.createDataFrame([(1, None, None, body, None)], "id int, title string, case_no string, summary string, discussed_laws string")
    known = spark.createDataFrame([(1, 101)], "case_id int, article_id int")
    got = graph.link_cases_advanced(cases, articles, known, most=None, chars=None)
    assert sorted(r["article_id"] for r in got.collect()) == [100, *range(102, 130)]
    assert graph.link_cases_advanced(cases, articles, known, chars=None).count() == 24


def test_drafts_order_equal_places_alike(spark, tmp_path):
    """Rows of one order and line: whatever their order in the file, a draft is the same, in its laws and in its cases."""
    from legalspark.plans import graph_queries

    lines = [(1, 1, 9, "R", "O"), (1, 1, 8, "A", "F"), (1, 1, 7, "N", "O"), (0, 1, 5, "A", "F")]
    found = []
    for k, data in enumerate((lines, lines[::-1])):
        spark.createDataFrame([(4, *r) for r in data], "l_partkey long, l_orderkey long, l_linenumber int, l_suppkey long, l_returnflag string, l_linestatus string").coalesce(1).write.parquet(f"{tmp_path}/{k}/lineitem.parquet")
        spark.createDataFrame([(4, "part")], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/{k}/part.parquet")
        found.append(graph_queries.q14_draft_context(spark, f"{tmp_path}/{k}").first()["context"])
    assert found == ["part\n\n- 5 0 A\n- 7 1 N\n- 8 1 A\n- 9 1 R\n\n- 0 F\n- 1 O\n- 1 F\n- 1 O"] * 2


def test_drafts_have_nulls_as_in_sql(spark, tmp_path):
    """Null order and line come last, a line with a null keeps its place but is not shown, and without a part there is no context."""
    from legalspark.plans import graph_queries

    lines = [(1, 3, None, 7, "N", "O"), (1, 3, 2, 8, "A", "F"), (1, None, 1, 9, "R", "O"), (1, 2, 1, None, "R", "F"), (2, 1, 1, 5, "A", "F"), (3, 1, 1, None, "A", "F"), (4, 1, 1, 5, "A", None)]
    lines += [(5, k, 1, 5 if k > 1 else None, "A", "F") for k in range(7)]
    spark.createDataFrame(lines, "l_partkey long, l_orderkey long, l_linenumber int, l_suppkey long, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "a"), (2, None), (3, "c"), (4, "d"), (5, "e"), (6, "f")], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    got = {r["id"]: r["context"] for r in graph_queries.q14_draft_context(spark, str(tmp_path)).collect()}
    assert got == {1: "a\n\n- 8 3 A\n- 7 3 N\n\n- 2 F\n- 3 F\n- 3 O", 2: None, 3: None, 4: None, 5: "e\n\n- 5 2 A\n- 5 3 A\n- 5 4 A\n\n- 0 F\n- 1 F\n- 2 F\n- 3 F"}


# --- vectors and retrieval ---


def test_expansion_stops_at_hubs(spark, monkeypatch):
    """Nodes with very many neighbours: a level has a bounded number of rows, and the first ones are those of all paths."""
    edges = [(1, 2), (1, 3), (2, 1), (3, 3), (5, 2)] + [(2, 10 + k) for k in range(5000)] + [(3, 7000 - k) for k in range(50)]
    df = spark.createDataFrame(edges, "src int, dst int").repartition(3)
    adjacency = retrieval.build_adjacency(df)
    assert adjacency.where("src = 2").count() == -(-5001 // retrieval.PART) and adjacency.agg(F.max(F.size("dsts"))).first()[0] == retrieval.PART
    sizes = []
    plain = retrieval.written
    monkeypatch.setattr(retrieval, "written", lambda x: sizes.append((out := plain(x)).count()) or out)
    starts = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, 99), (5, 1), (5, 5)], "query_id int, id int")
    out = {}
    for q in (1, 2, 3, 5):
        rows_ = set()
        for s in {1: [1], 2: [2], 3: [3], 5: [1, 5]}[q]:
            rows_ |= {(1, b) for a, b in edges if a == s} | {(2, c) for a, b in edges if a == s for x, c in edges if x == b and (a, b) != (x, c)}
        out[q] = sorted(rows_)[:15]
    got = {}
    for r in retrieval.related_articles(starts, adjacency).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["distance"], r["id"]))
    assert {q: [(d, i) for _, d, i in sorted(v)] for q, v in got.items()} == out
    assert max(sizes) < 200
    every = retrieval.related_articles(starts, df, 2, None).groupBy("query_id").count().collect()
    assert {r["query_id"]: r["count"] for r in every}[1] == 2 + 5001 + 51


def test_concepts_of_a_dictionary(spark):
    """A table of 5000 terms finds what the list finds, whatever stands at the terms' edges, and its plan does not grow."""
    terms = ["bail", "of the", "Código Penal", "c++", "(a) rule", "section 12-a", "new  line", "ab", "x" * 51, "u.s.", "été", "a_b"] + [f"term {k}" for k in range(5000)]
    texts = ["Bail of the court; Of  the", "código penal", "c++ c++x", "1(a) rule", "see (a) rule, Section 12-A.", "new  line new line ab", None, "", "u.s.a u.s. us", "l'été étés", "a_b a_bc term 77, term 4999.", "éte", "of the"]
    df = spark.createDataFrame([(k, "D", t) for k, t in enumerate(texts)], "id int, document_title string, content string")
    small = lambda n: spark.createDataFrame([(t,) for t in terms[:n]], "term string")
    want = {r["id"]: r["concepts"] for r in graph.extract_concepts(df, terms[:12] + ["term 77", "term 4999"]).collect()}
    out = graph.extract_concepts(df, small(len(terms)))
    assert {r["id"]: r["concepts"] for r in out.collect()} == want and want[10] == ["a_b", "term 4999", "term 77"]
    size = lambda x: len(x._jdf.queryExecution().optimizedPlan().toString())
    assert abs(size(out) - size(graph.extract_concepts(df, small(4)))) < 200
    assert [r["concepts"] for r in graph.extract_concepts(df, small(0)).collect()] == [[]] * len(texts)


def test_similar_pairs_in_many_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    data = rng.standard_normal((60, 8))
    df = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(data)] + [(100, None), (101, [0.0] * 8)], "id int, embedding array<float>")
    unit = data.astype("f4") / np.linalg.norm(data.astype("f4"), axis=1, keepdims=True)
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if unit[i] @ unit[j] >= 0.5}
    for blocks in (1, 4):
        assert set(rows(vectors.similar_pairs(df, 0.5, blocks=blocks), "id1", "id2")) == want


def test_embed_and_search(spark):
    docs = vectors.embed(spark.createDataFrame([(1, "bail law"), (2, "murder trial"), (3, None)], "id int, text string"), "text")
    asked = vectors.embed(spark.createDataFrame([(7, "law of bail")], "query_id int, text string"), "text")
    got = vectors.vector_search(asked, docs, 2).orderBy("rank").collect()
    assert got[0]["id"] == 1 and len(got) == 2
    clauses = spark.createDataFrame([("k", 1, "1", "bail law here")], "id string, article_id int, clause_number string, text string")
    subs = spark.createDataFrame([("s", "k", "a", "and more")], "id string, clause_id string, sub_clause_number string, text string")
    wanted = spark.createDataFrame([(7, 1, "content one"), (7, 2, "murder trial")], "query_id int, id int, content string")
    found = vectors.relevant_clauses(wanted, clauses, subs, asked)
    assert rows(found, "article_id", "text") == [(1, "bail law here and more"), (2, "murder trial")]


def test_paths(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (2, 1), (3, 4)], "src int, dst int")
    got = retrieval.related_articles(spark.createDataFrame([(9, 1)], "query_id int, id int"), edges)
    assert rows(got, "id", "distance") == [(1, 2), (2, 1), (3, 2)]


def test_rerank_and_fallback(spark):
    texts = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "bad")], "id int, text string")
    queries = spark.createDataFrame([(1, "q"), (2, "q")], "query_id int, text string")
    scorer = lambda q, t: [5.0 if x == "good" else -9.0 for x in t]
    statutes = spark.createDataFrame([(1, 1, 0.5, 1), (1, 2, 0.4, 2), (2, 2, 0.1, 1), (2, 3, 0.3, 2)], "query_id int, id int, similarity double, rank int")
    cases = spark.createDataFrame([], "query_id int, id int, similarity double, rank int")
    got = retrieval.grade_and_combine(statutes, cases, scorer=scorer, queries=queries, texts=texts)
    assert rows(got, "query_id", "id", "fallback") == [(1, 1, False), (2, 2, True), (2, 3, True)]
    assert [r["id"] for r in got.where("query_id = 2").orderBy("rank").collect()] == [3, 2]


def test_anchors_come_first(spark):
    none = spark.createDataFrame([], "query_id int, id int, similarity double, rank int")
    sem = spark.createDataFrame([(1, 5, 0.9, 1)], "query_id int, id int, similarity double, rank int")
    kw = spark.createDataFrame([], "query_id int, id int, score double, rank int")
    edges, cites, cases = (spark.createDataFrame([], s) for s in ("src int, dst int", "case_id int, article_id int", "id int, date string"))
    anchors = spark.createDataFrame([(1, 8, 0, 1.0), (1, 5, 1, 1.0)], "query_id int, id int, position int, score double")
    got = retrieval.multi_stage(sem, kw, none, kw, edges, cites, cases, anchors).orderBy("rank").collect()
    assert [(r["id"], r["anchored"]) for r in got] == [(8, True), (5, False)]


def test_context_budget(spark):
    ranked = spark.createDataFrame([(1, "article", 1, "H", "a b c"), (1, "article", 2, "H", "d e f g"), (1, "article", 3, "H", "z"), (1, "case", 1, "C", "x"), (1, "case", 2, "C", "y " * 9)], "query_id int, type string, rank int, header string, content string")
    assert retrieval.build_context(ranked, 8).first()["context"] == "H\na b c\n\nH\nd e f...\n\nC\nx\n\nC\ny..."


def test_context_of_many_blocks(spark):
    """Against a plain walk over the blocks in order: more blocks than any part holds, and words beyond the budget."""
    kinds = {"article": [(k * 7) % 11 for k in range(400)] + [90], "case": [0, 50, 3] + [1] * 300}
    data = [(q, kind, k, f"H{k}", " ".join(f"w{k}.{i}" for i in range(n)) or None) for q in (1, None) for kind, ns in kinds.items() for k, n in enumerate(ns)]
    ranked = spark.createDataFrame(data, "query_id int, type string, rank int, header string, content string").repartition(7)
    for budget in (0, 1, 40, 95):
        blocks, base = [], 0
        for kind in kinds:
            used = base
            for k, n in enumerate(kinds[kind]):
                text = [f"w{k}.{i}" for i in range(n)]
                if used + n + 1 > budget:
                    if budget - used - 1 > 0:
                        blocks.append(f"H{k}\n" + " ".join(text[: budget - used - 1]) + "...")
                    break
                blocks.append("\n".join([f"H{k}", *([" ".join(text)] if n else [])]))
                used += n + 1
            base = used if kind == "article" else base
        got = {r["query_id"]: r["context"] for r in retrieval.build_context(ranked, budget).collect()}
        assert got == ({1: "\n\n".join(blocks), None: "\n\n".join(blocks)} if blocks else {})


def test_narratives(spark):
    n = spark.createDataFrame([(1, "cnic and witness", None, "2024-01-01")], "id int, narrative string, ocr_text string, incident_date string")
    got = retrieval.analyse_narratives(n, spark.createDataFrame([(1, "article", 1, 11), (1, "case", 2, 22)], "query_id int, type string, rank int, id int")).first()
    assert got["laws"] == [11] and got["cases"] == [22] and len(got["reasons"]) == 3
    laws = spark.createDataFrame([(1, k, "D", str(k), "t") for k in range(1, 8)], "id int, rank int, document string, article string, title string")
    cases = spark.createDataFrame([(1, 1, "cit", "case")], "id int, rank int, citation string, title string")
    assert retrieval.draft_context(n, laws, cases).first()["context"].count("- ") == 6


# --- structure ---


def test_nested_statutes(spark, tmp_path):
    art = {"article_number": "20", "title": " T ", "content": "c", "clauses": [{"id": "1", "text": "x", "sub_clauses": [{"id": "a", "text": "y"}]}]}
    (tmp_path / "a.json").write_text(json.dumps({"document": {"title": "T", "year": 2016, "articles": [art]}}))
    (tmp_path / "b.json").write_text(json.dumps({"document": {"title": "U", "sections": [{"section_number": "3", "page_number": 4}]}}))
    (tmp_path / "c.json").write_text(json.dumps({"document": {"title": "V"}}))
    (tmp_path / "d.json").write_text("{broken")
    (tmp_path / "list.json").write_text(json.dumps([str(tmp_path / f"{x}.json") for x in "abcde"]))
    good, bad = tables.read_manifest(spark, str(tmp_path / "list.json"))
    assert good.count() == 3 and bad.count() == 2
    a = structure.normalise_articles(good)
    assert rows(a, "id", "article_number", "title", "page_number") == [("T:Article:20", "20", "T", None), ("U:Article:3", "3", "", 4)]
    clauses, subs = structure.explode_clauses(a)
    assert rows(clauses, "id") == [("T:Article:20:Clause:1",)] and rows(subs, "id") == [("T:Article:20:Clause:1:SubClause:a",)]


def test_layout_to_sections(spark):
    def line(page, no, text, size=10.0, bold=""):
        return ("d", page, no, float(no * 10), text, size, bold, 0.0)

    lines = [
        line(1, 1, "1. Contents here"), line(2, 1, "CHAPTER I"), line(2, 2, "Preliminary"), line(2, 3, "1. Short title.— This Act may be called X.", bold="1. Short title."), line(2, 4, "(1) First part of it."), line(2, 90, "footnote"),
        line(3, 1, "continued text"), line(3, 2, "2A. Next.— (a) alpha"), line(3, 3, "tiny", 4.0),
    ]
    df = spark.createDataFrame(lines, "doc_id string, page int, line_no int, top double, text string, avg_size double, bold_text string, bold_ratio double")
    rules = spark.createDataFrame([("d", 2, 800.0, 800.5, 400.0, 0.5, "line")], "doc_id string, page int, y0 double, y1 double, width double, height double, kind string")
    pages = spark.createDataFrame([("d", p, 600.0, 1000.0) for p in (1, 2, 3)], "doc_id string, page int, width double, height double")
    body = structure.filter_body_lines(df, rules, pages)
    assert "footnote" not in {r["text"] for r in body.collect()} and "tiny" not in {r["text"] for r in body.collect()}
    got = structure.slice_sections(structure.detect_sections(body, first_page=2)).orderBy("section").collect()
    assert [(r["section_number"], r["title"], r["chapter"], r["page_number"]) for r in got] == [("1", "Short title.", "CHAPTER I Preliminary", 2), ("2A", "Next.", "CHAPTER I Preliminary", 3)]
    assert [c["id"] for c in got[0]["clauses"]] == ["1"] and "continued text" in got[0]["clauses"][0]["text"]


def test_split_heads_and_characters(spark):
    lines = spark.createDataFrame([("d", 1, 1, "225-"), ("d", 1, 2, "A. Escape of prisoners")], "doc_id string, page int, line_no int, text string").withColumn("bold_text", F.lit(""))
    assert rows(structure.detect_sections(lines, "penal_code"), "section_number", "title") == [("225-A", "Escape of prisoners")]
    chars = spark.createDataFrame([("d", 1, 10.01, float(k), c, 9.0, "Bold" if k < 2 else "Roman") for k, c in reversed(list(enumerate("Hello")))], "doc_id string, page int, top double, x0 double, text string, size double, fontname string")
    r = structure.lines_from_chars(chars).first()
    assert (r["text"], r["bold_text"], r["bold_ratio"], r["line_no"]) == ("Hello", "He", 0.4, 1)


PENAL = [
    (1, 1, 10, "CHAPTER XI", 0.0), (1, 2, 20, "False Evidence", 1.0), (1, 3, 30, "[ 191. Whoever lies. More.", 0.0), (1, 4, 40, "sold in Pakistan. 237. Import or export. x", 0.0), (1, 5, 50, "225- Rescue", 0.0),
    (1, 6, 60, "B. of a person. And", 0.0), (1, 7, 70, "The following was omitted by Act I", 0.0), (1, 8, 80, "300. Not in force", 0.0), (1, 9, 90, "PART II", 0.0), (1, 10, 100, "512. Beyond", 0.0), (1, 11, 110, "511. (Last) attempt", 0.0),
    (2, 1, 10, "Heading Of Page", 1.0), (2, 2, 20, "LOUD LINE", 1.0), (2, 3, 30, "(Parliament)", 0.0), (2, 4, 40, "12. text here.", 0.0), (2, 5, 50, None, 0.0), (2, 6, 60, "Far Title", 1.0), (2, 7, 160, "13. next", 0.0),
]


def test_penal_code_and_titles_above(spark):
    lines = spark.createDataFrame([("d", p, n, float(y), t, 9.0, t if r else "", r) for p, n, y, t, r in PENAL], "doc_id string, page int, line_no int, top double, text string, avg_size double, bold_text string, bold_ratio double")
    heads = lambda profile, rows_: structure.detect_sections(rows_, profile).where("is_head").orderBy("page", "line_no").select("section_number", "title")
    got = [tuple(r) for r in heads("penal_code", lines).collect()]
    assert got == [("191", "False Evidence"), ("237", "Import or export"), ("225-B", "Rescue of a person"), ("511", "(Last) attempt"), ("12", "Heading Of Page (Parliament)"), ("13", "next")]
    assert [tuple(r) for r in heads("constitution", lines.where("page = 2")).collect()] == [("12", "Heading Of Page LOUD LINE (Parliament)"), ("13", "next")]
    assert heads("penal_code", lines.limit(0)).collect() == []
    cut = structure.slice_sections(structure.detect_sections(lines, "penal_code"), "penal_code").orderBy("section").collect()
    assert [r["section_number"] for r in cut] == ["191", "237", "225-B", "511", "12", "13"] and cut[0]["cleaned"].endswith("sold in Pakistan.") and cut[1]["cleaned"] == "Import or export. x"


def test_amendments_and_validation(spark):
    a = spark.createDataFrame([("41", 0, [("1", "x")]), ("41", 1, None), ("63a", 2, None)], "article_number string, position int, clauses array<struct<id:string,text:string>>")
    m = spark.createDataFrame([("63A", 1, " new "), ("41", 2, "b"), ("41", 1, "a"), ("99", 0, "z")], "article_number string, position int, content string")
    got = {r["article_number"]: [(c["id"], c["text"]) for c in r["clauses"]] for r in structure.apply_amendments(a, m).collect()}
    assert got == {"41": [("1", "x"), ("schedule-amendment-1", "a"), ("schedule-amendment-2", "b")], "63a": [("schedule-amendment-1", "new")]}
    v = structure.validate_structure(a, 40, 43).first()
    assert (v["articles"], v["lowest"], v["highest"], v["missing"]) == (3, 41, 63, [40, 42, 43])
    assert [r["article_number"] for r in structure.order_articles(a.select("article_number").distinct()).collect()] == ["41", "63a"]


COURTS = {
    "Lahore High Court": ({"case_title": " A v B ", "writ_petition": "W.P 1", "cyber_law_match": {"filter_profile": "p", "triggers": [{"kind": "phrase", "matched": "x"}]}}, "LHC_W_P_1", "A v B. W.P 1"),
    "Islamabad High Court": ({"case_title": "C", "case_no": "7/2020", "description": "d", "discussed_laws": "l"}, "IHC_7_2020", "d l"),
    "Peshawar High Court": ({"case_title": "D", "other_citation": "2020 PHC 1", "remarks": "r"}, "PHC_2020_PHC_1", "r"),
    "Sindh High Court": ({"parties": "E", "record_id": "99", "excerpt": "e" * 600}, "SHC_99", "e" * 500),
}


@pytest.mark.parametrize("court", COURTS)
def test_courts(spark, tmp_path, court):
    record, case_id, summary = COURTS[court]
    name = court.lower().replace(" ", "-")
    (tmp_path / f"{name}.json").write_text(json.dumps({"judgments": [record]} if court.startswith("L") else [record]))
    raw = tables.read_cases(spark, str(tmp_path))
    got = structure.normalise_case(raw, court).first()
    assert raw.first()["court"] == court and (got["id"], got["summary"], got["court"]) == (case_id, summary, court)
    if court.startswith("L"):
        assert json.loads(got["cyber_law_triggers_json"]) == [{"kind": "phrase", "matched": "x"}] and got["cyber_law_filter_profile"] == "p"


def test_ids_of_underscores(spark):
    got = structure.normalise_case(spark.createDataFrame([("؟", "؟")], "lhc_citation string, case_title string"), "Lahore High Court").first()["id"]
    assert got.startswith("case_")


# --- tables, datasets, sessions ---


def test_deletes(spark):
    a = spark.createDataFrame([("a1", "A"), ("b1", "B")], "id string, document_title string")
    t = {"documents": spark.createDataFrame([("A",), ("B",)], "title string"), "articles": a, "clauses": spark.createDataFrame([("k", "a1"), ("m", "b1")], "id string, article_id string"),
         "subclauses": spark.createDataFrame([("s", "k")], "id string, clause_id string"), "cites": spark.createDataFrame([("a1", "b1"), ("b1", "b1")], "src string, dst string")}
    left = tables.delete_document(t, "A")
    assert {k: v.count() for k, v in left.items()} == {"documents": 1, "articles": 1, "clauses": 1, "subclauses": 0, "cites": 1}
    with pytest.raises(KeyError):
        tables.delete_document(t, "Z")
    assert tables.delete_edges(t["cites"], a).count() == 0


def test_html_listing(spark):
    page = "<table id='x'><tr><td>no</td></tr></table><table id='list'><tr><td>1</td><td> A &amp;\n B </td><td><a href='/y'>y</a><a href='/z.pdf'>z</a></td></tr><tr><td>2</td><td>C</td><td>none</td></tr><tr><td>short</td></tr></table>"
    got = html.parse_listing_html(spark.createDataFrame([(5, page), (6, None)], "page_id long, html string"), {"no": 0, "title": 1}, 3, "list", link_contains=".pdf")
    assert rows(got, "page_id", "no", "title", "link") == [(5, "1", "A & B", "/z.pdf"), (5, "2", "C", "")]


def test_write_and_upsert_are_idempotent(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string")
    b = spark.createDataFrame([(2, "z"), (3, "w")], "id int, v string")
    once = tables.upsert(a, b, "id")
    assert rows(once, "id", "v") == rows(tables.upsert(once, b, "id"), "id", "v") == [(1, "x"), (2, "z"), (3, "w")]
    tables.write_table(once, str(tmp_path / "t"), "v")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3
    tables.write_listing(once, str(tmp_path / "l"), "p")
    assert spark.read.json(str(tmp_path / "l/metadata")).first()["kept"] == 3


def test_numbering_of_wide_rows(spark):
    """Many ranges that adaptive execution coalesces: each number comes once, and no row is lost."""
    n = 120_000
    df = spark.range(n).select(F.xxhash64("id").alias("k"), "id", F.repeat(F.sha2(F.col("id").cast("string"), 512), 4).alias("wide"))
    before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    spark.conf.set("spark.sql.shuffle.partitions", 16)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4m")
    try:
        got = datasets._numbered(df, "k", "id", name="n").select("id", "n", "wide").agg(F.count("*"), F.count_distinct("n"), F.min("n"), F.max("n"), F.count_distinct("id"), F.min(F.length("wide"))).first()
        assert tuple(got) == (n, n, 0, n - 1, n, 512)
        train = datasets.split(df).groupBy("split").count().collect()
        assert {r["split"]: r["count"] for r in train} == {"train": int(n * 0.95), "test": n - int(n * 0.95)}
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def test_hubs_are_split(spark, monkeypatch):
    monkeypatch.setattr(graph, "HUB", 5)
    edges = [(k, 1000) for k in range(40)] + [(k, 1001) for k in range(0, 40, 2)] + [(k, 1002 + k % 3) for k in range(40)] + [(7, 1000), (None, 1000), (7, None)]
    cites = spark.createDataFrame(edges, "src int, dst int")
    targets = {}
    for s, d in set(edges):
        if s is not None and d is not None:
            targets.setdefault(s, set()).add(d)
    want = sorted((a, b, len(targets[a] & targets[b])) for a in targets for b in targets if a < b and len(targets[a] & targets[b]) >= 2)
    for prefix in (None, False, True):
        out = graph.related_through(cites, prefix=prefix)
        assert sorted(tuple(r) for r in out.collect()) == want
        assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    for least in (1, 3, 4):
        want = sorted((a, b, len(targets[a] & targets[b])) for a in targets for b in targets if a < b and len(targets[a] & targets[b]) >= least)
        assert sorted(tuple(r) for r in graph.related_through(cites, least, prefix=True).collect()) == want


def test_a_hub_makes_no_pairs(spark, monkeypatch):
    """20 000 sources of one hub: its 200 million pairs are not made."""
    edges = spark.range(20_000).selectExpr("id AS src", "explode(array(-1L, id div 2)) AS dst")
    made = []
    paired = graph._paired
    monkeypatch.setattr(graph, "_paired", lambda kept, hub: made.append(kept) or paired(kept, hub))
    out = graph.related_through(edges)
    assert out.count() == 10_000 and out.where("shared_citations <> 2 or id2 <> id1 + 1").count() == 0
    (kept,) = made
    assert kept.where("dst = -1").count() == 0


def test_similar_pairs_in_scopes(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 7)
    monkeypatch.setattr(vectors, "STRIP", 3)
    data = [(k, [float(k % 5), 1.0, float(k % 3)], ("a", "b", None)[k % 3] if k < 40 else "c") for k in range(60)]
    out = vectors.similar_pairs(spark.createDataFrame(data, "id int, embedding array<float>, s string"), 0.9, scope="s")
    cosine = lambda x, y: sum(a * b for a, b in zip(x, y, strict=True)) / (sum(a * a for a in x) * sum(b * b for b in y)) ** 0.5
    want = {(i, j) for i, x, s in data for j, y, u in data if i < j and s == u and s is not None and cosine(x, y) >= 0.9}
    assert set(rows(out, "id1", "id2")) == want


def test_match_spans_of_many_matches(spark):
    text = "".join(f"é{k} " for k in range(60_000))
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "12"), (5, "no")], "id int, t string")
    got = {r["id"]: r["s"] for r in df.select("id", tx.match_spans("t", r"(\d)\d*", 1).alias("s")).collect()}
    assert [(m["start"], m["end"], m["value"]) for m in got[1]] == [(m.start(), m.end(), m[1]) for m in re.finditer(r"(\d)\d*", text)]
    assert [tuple(m) for m in got[4]] == [(0, 2, "1")] and not got[2] and not got[3] and not got[5]


def test_manifests_with_lists_and_escapes(spark, tmp_path):
    (tmp_path / 'odd "name".txt').write_text('{"document": {"title": "T", "articles": [{"article_number": "1", "title": "x"}]}}')
    path = str(tmp_path / 'odd "name".txt')
    for n, form in enumerate(([path, "/none"], {"a": path, "b": "/none"}, {"all": [path], "more": ["/none", "/none"]})):
        (tmp_path / f"m{n}").write_text(json.dumps(form))
        good, bad = tables.read_manifest(spark, str(tmp_path / f"m{n}"))
        assert rows(good, "title") == [("T",)] and rows(bad, "path", "reason") == [("/none", "not found")]


def test_numbering_and_samples(spark):
    df = spark.range(103).withColumn("k", F.col("id") * 7 % 103).repartition(7)
    assert rows(datasets.assign_batches(df, "k", 5), "k", "batch") == sorted([(k, k // 5) for k in range(103)], key=str)
    first = [r["id"] for r in datasets.sample_cases(df, "id", 1, 10).collect()]
    assert first == [r["id"] for r in datasets.sample_cases(df.repartition(3), "id", 1, 10).collect()] and len(set(first)) == 10
    assert first != [r["id"] for r in datasets.sample_cases(df, "id", 2, 10).collect()]
    assert [r["place"] for r in datasets.sample_cases(df, "id", 1, 10).orderBy("place").collect()] == list(range(10))
    assert rows(datasets.sample_cases(df, "id", 1).where("place < 10"), "id") == rows(datasets.sample_cases(df, "id", 1, 10), "id")
    n = datasets.split(df.select("id"))
    assert n.where("split = 'train'").count() == 97
    done = spark.createDataFrame([(0,)] * 5 + [(1,)] * 4, "batch int")
    assert datasets.accepted_batches(datasets.assign_batches(df, "k", 5), done).count() == 5


def test_trims(spark):
    df = spark.createDataFrame([("abcdef", "A", "1", "t", "c", None)], "pdf_data string, document_title string, article_number string, title string, content string, clauses string")
    assert datasets.trim_case(df, 3).first()["pdf_data"] == "abc" and datasets.trim_case(df).first()["pdf_data"] == "abcdef"
    assert datasets.statute_projection(df).first()["section"]["section"] == "1"


def test_stream_of_cases_runs_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    put = lambda name, case: (source / name).write_text(json.dumps([case]))
    put("lhc_1.json", {"case_title": "cyber crime case", "lhc_citation": "2020 LHC 1"})
    run = lambda: case_stream.stream_cases(spark, str(source), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    run()
    run()
    put("lhc_2.json", {"case_title": "cyber crime again", "lhc_citation": "2020 LHC 1"})
    put("shc_2.json", {"parties": "tax case", "record_id": "5"})
    run()
    got = case_stream.read_stream_table(spark, str(tmp_path / "out"))
    assert rows(got, "id", "title") == [("2020_LHC_1", "cyber crime again")]
    case_stream.compact(spark, str(tmp_path / "out"))
    case_stream.compact(spark, str(tmp_path / "out"))
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["s=1"]
    assert rows(case_stream.read_stream_table(spark, str(tmp_path / "out")), "id", "title") == [("2020_LHC_1", "cyber crime again")]
    put("lhc_3.json", {"case_title": "cyber crime, third", "lhc_citation": "2020 LHC 1"})
    put("lhc_4.json", {"case_title": "cyber crime, other", "lhc_citation": "2020 LHC 2"})
    run()
    got = case_stream.read_stream_table(spark, str(tmp_path / "out"))
    assert rows(got, "id", "title") == [("2020_LHC_1", "cyber crime, third"), ("2020_LHC_2", "cyber crime, other")]


def test_stream_table_without_batches(spark, tmp_path):
    assert case_stream.read_stream_table(spark, str(tmp_path / "none")) is None
    case_stream.compact(spark, str(tmp_path / "none"))


def test_stream_of_turns(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = "session_id string, question string, answer string, ts timestamp, duration double"
    spark.createDataFrame([("a", "q2", "x", 2), ("a", "q1", "x", 1), ("b", "q", "y", 1)], "session_id string, question string, answer string, t int").withColumn("ts", F.timestamp_seconds("t")).withColumn("duration", F.lit(1.0)).drop("t").write.mode("append").parquet(str(tmp_path / "in"))
    for _ in range(2):
        history.stream_history(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    turns = history.read_turns(spark, str(tmp_path / "out"))
    assert [h["question"] for h in history.read_session(turns, "a").first()["history"]] == ["q1", "q2"]
    assert history.delete_session(turns, "a").count() == 1


def test_sessions(spark):
    a = spark.createDataFrame([("s", "2024-01-01", "a"), (None, "2025-01-01", "x")], "id string, createdAt string, v string")
    b = spark.createDataFrame([("s", "2024-01-01", "b"), ("t", "2024-02-01", "c")], "id string, createdAt string, v string")
    assert [(r["id"], r["v"]) for r in history.merge_sessions(a, b).collect()] == [("t", "c"), ("s", "b")]
    assert history.put_session(b, a.where("id = 's'")).count() == 2 and history.remove_session(b, "s").count() == 1


def test_evaluation(spark):
    gold = spark.createDataFrame([(1, ["20", "21", "9"]), (2, []), (3, ["5", "5"])], "query_id int, sections array<string>")
    got = spark.createDataFrame([(1, " 20 ", 1), (1, "21", 2), (1, "9", 11), (3, "5", 1)], "query_id int, section string, rank int")
    assert rows(reports.recall_at_k(got, gold), "query_id", "recall") == [(1, 2 / 3), (2, 1.0), (3, 1.0)]
    preds = spark.createDataFrame([("yes", "Yes", False), ("no", "yes", False), ("yes", "yes", True)], "predicted_label string, expected_answer string, generation_failed boolean")
    assert reports.answer_accuracy(preds).first()["correct"] == 1 and reports.answer_accuracy(preds.limit(0)).first()["accuracy"] is None


def test_stored_evaluation(spark):
    """A stored run of 30 questions: mean recall 0.8405..., accuracy 0.9."""
    run = spark.read.schema("expected_sections array<string>, retrieved_sections array<string>, expected_answer string, predicted_label string, generation_failed boolean").json(f"{FIXTURES}/evaluation.json")
    run = run.coalesce(1).withColumn("query_id", F.monotonically_increasing_id())
    retrieved = run.select("query_id", F.posexplode("retrieved_sections").alias("pos", "section")).withColumn("rank", F.col("pos") + 1)
    per = reports.recall_at_k(retrieved, run.select("query_id", F.col("expected_sections").alias("sections")))
    assert abs(reports.mean_recall(per).first()["recall"] - 0.8405555555555555) < 1e-12
    assert reports.answer_accuracy(run).first()["accuracy"] == 0.9


def test_stored_listing(spark):
    """Six stored rows give the reasons and triggers stored with them."""
    rows_ = spark.read.schema("case_title string, writ_petition string, hon_judge string, lhc_citation string, reason string, triggers array<array<string>>").json(f"{FIXTURES}/listing.json")
    want = rows_.withColumnRenamed("reason", "stored").withColumnRenamed("triggers", "stored_triggers")
    got = filters.classify_listing(want, filters.listing_blob("Lahore High Court")).collect()
    assert len(got) == 6
    for r in got:
        assert r["reason"] == r["stored"] and [[x["kind"], x["matched"]] for x in r["triggers"]] == r["stored_triggers"]
