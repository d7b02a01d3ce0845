"""Registered queries: tables, texts, filters, labels, reports, datasets, sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import values
from ..functions import text as tx
from ..operators import datasets, filters, reports, retrieval, scorers, structure
from ..sources import buckets, shared, tables
from ..streaming import history, workspace
from . import testdata as t
from .registry import query
from .testdata import table, with_views


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


# --- sources and sinks ---

_FILE = "CASE o_orderkey % 6 WHEN 0 THEN 'lhc_' WHEN 1 THEN 'IHC-' WHEN 2 THEN 'phc' WHEN 3 THEN 'shc_cases_' WHEN 4 THEN 'lahore-high-court-' ELSE 'other_' END || o_orderkey || '.json'"


@query(f"SELECT id, CASE WHEN f LIKE 'lhc%' OR f LIKE 'lahore%' THEN 'Lahore High Court' WHEN f LIKE 'IHC%' THEN 'Islamabad High Court' WHEN f LIKE 'phc%' THEN 'Peshawar High Court' WHEN f LIKE 'shc%' THEN 'Sindh High Court' ELSE 'Unknown Court' END AS court FROM (SELECT o_orderkey AS id, {_FILE} AS f FROM orders)")
def s4_with_court(spark, d):
    prefix = F.element_at(F.array(*[F.lit(x) for x in ("lhc_", "IHC-", "phc", "shc_cases_", "lahore-high-court-", "other_")]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    files = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("/data/in/"), prefix, F.col("o_orderkey"), F.lit(".json")).alias("path"))
    return tables.with_court(files).select("id", "court")


_UPDATES = "(SELECT l_orderkey AS id, max(l_linestatus) AS status FROM lineitem GROUP BY 1)"


@query(f"SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT id, status FROM {_UPDATES}")
def s5_upsert(spark, d):
    old = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    return tables.upsert(old, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linestatus").alias("status")), "id", "status")


@query(f"SELECT id, status FROM {_UPDATES}")
def s6_replace_cases(spark, d):
    old = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    return tables.replace_cases(old, table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.max("l_linestatus").alias("status")))


@query(with_views("statutes", "articles", "cites", "case_cites") + """, gone AS (SELECT id FROM articles WHERE document_title = 'Brand#2')
SELECT 'documents' AS name, count(*) AS n FROM statutes WHERE title <> 'Brand#2' UNION ALL SELECT 'articles', count(*) FROM articles WHERE document_title <> 'Brand#2'
UNION ALL SELECT 'cites', count(*) FROM cites WHERE src NOT IN (FROM gone) AND dst NOT IN (FROM gone) UNION ALL SELECT 'case_cites', count(*) FROM case_cites WHERE article_id NOT IN (FROM gone)""")  # fmt: skip
def s7_delete_document(spark, d):
    left = tables.delete_document({"documents": t.statutes(spark, d), "articles": t.articles(spark, d), "cites": t.cites(spark, d), "case_cites": t.case_cites(spark, d)}, "Brand#2")
    return reports.graph_stats({k: left[k] for k in ("documents", "articles")}, {k: left[k] for k in ("cites", "case_cites")}).where("name <> 'total_edges'")


@query(with_views("articles", "cites") + ", gone AS (SELECT id FROM articles WHERE document_title = 'Brand#2') SELECT src, dst FROM cites WHERE src NOT IN (FROM gone) AND dst NOT IN (FROM gone)")
def s8_delete_edges(spark, d):
    return tables.delete_edges(t.cites(spark, d), t.articles(spark, d), "Brand#2")


@query(f"SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT id, status FROM {_UPDATES}")
def s5_stored_merge(spark, d):
    """The upsert into a stored table, in two batches of changes."""
    path = shared.folder(spark)
    buckets.create(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")), path, "id", 16)
    changes = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linestatus").alias("status"), (F.col("l_orderkey") % 5 == 0).alias("late"))
    for late in (False, True):
        buckets.merge(spark, path, changes.where(F.col("late") == late).drop("late"), "status")
    return buckets.read(spark, path)


@query(f"SELECT id, status FROM {_UPDATES}")
def s6_stored_replace(spark, d):
    path = shared.folder(spark)
    buckets.create(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")), path, "id", 16)
    buckets.replace(table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.max("l_linestatus").alias("status")), path)
    return buckets.read(spark, path)


@query(with_views("statutes", "articles", "cites", "case_cites") + """, gone AS (SELECT id FROM articles WHERE document_title = 'Brand#2')
SELECT 'documents' AS name, title AS a, NULL AS b FROM statutes WHERE title <> 'Brand#2' UNION ALL SELECT 'articles', document_title, id::VARCHAR FROM articles WHERE document_title <> 'Brand#2'
UNION ALL SELECT 'cites', src::VARCHAR, dst::VARCHAR FROM cites WHERE src NOT IN (FROM gone) AND dst NOT IN (FROM gone) UNION ALL SELECT 'case_cites', case_id::VARCHAR, article_id::VARCHAR FROM case_cites WHERE article_id NOT IN (FROM gone)""")  # fmt: skip
def s7_stored_delete(spark, d):
    """A cascade through stored tables, with all rows that are left."""
    folder = shared.folder(spark)
    stored = {"documents": (t.statutes(spark, d), "title", "title"), "articles": (t.articles(spark, d), "id", "document_title"), "cites": (t.cites(spark, d), ["src", "dst"], "src"), "case_cites": (t.case_cites(spark, d), ["case_id", "article_id"], "article_id")}
    for name, (rows, keys, by) in stored.items():
        buckets.create(rows, f"{folder}/{name}", keys, 16, by)
    buckets.delete_document(spark, folder, "Brand#2", list(stored))
    column = {"documents": ("title", None), "articles": ("document_title", "id"), "cites": ("src", "dst"), "case_cites": ("case_id", "article_id")}
    parts = [buckets.read(spark, f"{folder}/{n}").select(F.lit(n).alias("name"), F.col(a).cast("string").alias("a"), (F.col(b) if b else F.lit(None)).cast("string").alias("b")) for n, (a, b) in column.items()]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag <> 'R')")
def s9_pending(spark, d):
    marked = F.when(F.col("l_returnflag") == "R", "[ERROR: again]").otherwise("text")
    done = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), marked.alias("pdf_data"))
    return tables.pending(table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), done, "id", retry_errors=True)


# --- structure ---


def _nested(spark, d):
    """Documents named by brands, of up to 500 part keys each: parts as articles, the suppliers of a part as its clauses."""
    lines = table(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), F.col("l_suppkey").cast("string").alias("s"), "l_returnflag").distinct()
    subs = lines.groupBy("k", "s").agg(F.transform(F.sort_array(F.collect_list("l_returnflag")), lambda r: F.struct(r.alias("id"), r.alias("text"))).alias("sub_clauses"))
    none = F.lit(None).cast("array<struct<id:string,text:string>>")
    clauses = subs.groupBy("k").agg(F.collect_list(F.struct(F.col("s").alias("id"), F.col("s").alias("text"), none.alias("clauses"), "sub_clauses")).alias("clauses"))
    a = table(spark, d, "part").join(clauses, F.col("p_partkey") == F.col("k"), "left")
    null = F.lit(None).cast("string")
    article = F.struct(null.alias("article_number"), F.col("p_partkey").cast("string").alias("section_number"), F.col("p_name").alias("title"), null.alias("content"), F.col("p_size").alias("page_number"), null.alias("part"), null.alias("chapter"), "clauses", F.col("clauses").alias("subsections"))
    return a.groupBy(F.col("p_brand").alias("title"), F.floor(F.col("p_partkey") / 500)).agg(F.collect_list(article).alias("articles")).select("title", "articles")


@query("SELECT p_brand || ':Article:' || p_partkey AS id, p_brand AS document_title, CAST(p_partkey AS VARCHAR) AS article_number, trim(p_name) AS title, '' AS content, p_size AS page_number FROM part")
def p1_normalise_articles(spark, d):
    return structure.normalise_articles(_nested(spark, d)).select("id", "document_title", "article_number", "title", "content", "page_number")


@query("SELECT DISTINCT p_brand || ':Article:' || p_partkey || ':Clause:' || l_suppkey AS id, CAST(l_suppkey AS VARCHAR) AS clause_number FROM lineitem JOIN part ON p_partkey = l_partkey")
def p3_clauses(spark, d):
    return structure.explode_clauses(structure.normalise_articles(_nested(spark, d)))[0].select("id", "clause_number")


@query("SELECT DISTINCT p_brand || ':Article:' || p_partkey || ':Clause:' || l_suppkey || ':SubClause:' || l_returnflag AS id, l_returnflag AS text FROM lineitem JOIN part ON p_partkey = l_partkey")
def p3_subclauses(spark, d):
    return structure.explode_clauses(structure.normalise_articles(_nested(spark, d)))[1].select("id", "text")


_TITLE = "CASE p_partkey % 5 WHEN 0 THEN 'Pakistan Penal Code ' WHEN 1 THEN 'The Constitution ' WHEN 2 THEN 'Prevention of Electronic Crimes ' WHEN 3 THEN 'Telecommunication Rules ' ELSE '' END || p_name"


def _titles(spark, d):
    start = F.element_at(F.array(*[F.lit(x) for x in ("Pakistan Penal Code ", "The Constitution ", "Prevention of Electronic Crimes ", "Telecommunication Rules ", "")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(start, "p_name").alias("title"))


@query(f"""WITH x AS (SELECT p_partkey AS id, {_TITLE} AS title, list_filter(string_split(p_name, ' '), lambda w: len(w) > 3)[1] AS w FROM part)
SELECT id, CASE WHEN title LIKE '%Penal Code%' THEN 'Penal Code' WHEN title LIKE '%Constitution%' THEN 'Constitution' WHEN title LIKE '%Electronic Crimes%' THEN 'Cyber Law' WHEN title LIKE '%Telecommunication Rules%' THEN 'Rules' ELSE coalesce(upper(w[1]) || lower(w[2:]), 'Unknown') END AS type FROM x""")  # fmt: skip
def p2_doc_type(spark, d):
    return _titles(spark, d).select("id", tx.doc_type("title").alias("type"))


@query(f"""WITH x AS (SELECT p_partkey AS id, {_TITLE} AS title FROM part)
SELECT id, CASE WHEN title LIKE '%Constitution%' THEN 'Constitution' WHEN title LIKE '%Penal Code%' THEN 'PPC' WHEN title LIKE '%Electronic Crimes%' THEN 'PECA 2016' WHEN title LIKE '%Telecommunication Rules%' THEN 'Telecom Rules' ELSE array_to_string(string_split(title, ' ')[1:3], ' ') || CASE WHEN len(string_split(title, ' ')) > 3 THEN '...' ELSE '' END END AS label FROM x""")  # fmt: skip
def p22_short_label(spark, d):
    return _titles(spark, d).select("id", tx.short_label("title").alias("label"))


@query("SELECT o_orderkey AS n, 'SHC_' || o_orderkey AS id, c_name AS title, left('in the matter of ' || c_name || repeat(' x', 300), 500) AS summary, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderstatus END AS winner FROM orders JOIN customer ON c_custkey = o_custkey")
def p4_normalise_case(spark, d):
    raw = t.cases(spark, d).select(F.col("id").cast("string").alias("record_id"), F.concat(F.lit(" "), "title").alias("parties"), F.concat(F.lit("in the matter of "), "title", F.repeat(F.lit(" x"), 300)).alias("excerpt"), F.when(F.col("status") != "O", F.col("status")).alias("winner"))
    return structure.normalise_case(raw, "Sindh High Court").select(F.regexp_extract("id", r"(\d+)$", 1).cast("long").alias("n"), "id", "title", "summary", "winner")


_FORMS = r"""WITH c AS (SELECT o_orderkey AS k, c_name AS name, strftime(o_orderdate, '%d-%m-%Y') AS date, o_orderpriority AS p, o_orderstatus AS s, o_orderkey % 3 AS m FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT 'Lahore High Court' AS court, CASE WHEN m = 0 THEN '' ELSE k || ' LHC' END AS citation, CASE WHEN m = 0 THEN 'LHC_W_P_' || k ELSE k || '_LHC' END AS id, name AS title, 'W.P ' || k AS case_no, date, CASE WHEN m = 1 THEN p ELSE name || '. W.P ' || k END AS summary FROM c
UNION ALL SELECT 'Islamabad High Court', '', 'IHC_' || CASE WHEN m = 0 THEN left(regexp_replace(name, '[^A-Za-z0-9_\-]', '_', 'g'), 40) ELSE k || '_2020' END, name, CASE WHEN m = 0 THEN '' ELSE k || '/2020' END, date, CASE WHEN m = 1 THEN name ELSE p || ' ' || s END FROM c
UNION ALL SELECT 'Peshawar High Court', CASE WHEN m = 0 THEN k || ' PHC' WHEN m = 1 THEN 'other ' || k ELSE '' END, 'PHC_' || CASE WHEN m = 0 THEN k || '_PHC' WHEN m = 1 THEN 'other_' || k ELSE '' || k END, name, '', date, CASE WHEN m = 2 THEN left(p || repeat(' r', 400), 500) ELSE name END FROM c
UNION ALL SELECT p, CASE WHEN m = 0 THEN '' ELSE k || ' C' END, CASE WHEN m = 0 THEN regexp_replace(name, '[^A-Za-z0-9_\-]', '_', 'g') ELSE k || '_C' END, CASE WHEN m = 1 THEN k || ' C' ELSE name END, '', date, s FROM c"""


@query(_FORMS)
def p4_court_forms(spark, d):
    """The other forms of listings, each with fields that are absent from some records."""
    c = t.cases(spark, d).withColumn("m", F.col("id") % 3)
    key, m, none = F.col("id").cast("string"), F.col("m"), F.lit(None).cast("string")
    lahore = c.select(F.concat(F.lit(" "), "title").alias("case_title"), F.concat(F.lit("W.P "), key).alias("writ_petition"), F.when(m != 0, F.concat(key, F.lit(" LHC"))).alias("lhc_citation"), F.col("date").alias("order_date"), F.when(m == 1, F.col("court")).alias("matter"))
    islamabad = c.select(F.col("title").alias("case_title"), F.when(m != 0, F.concat(key, F.lit("/2020"))).alias("case_no"), none.alias("s_no"), F.col("date").alias("order_date"), F.when(m != 1, F.col("court")).alias("description"), F.when(m != 1, F.col("status")).otherwise(" ").alias("discussed_laws"))
    peshawar = c.select(F.col("title").alias("case_title"), F.when(m == 0, F.concat(key, F.lit(" PHC"))).alias("phc_neutral_citation"), F.when(m == 1, F.concat(F.lit("other "), key)).alias("other_citation"), key.alias("s_no"), F.col("date").alias("decision_date"), F.when(m == 2, F.concat("court", F.repeat(F.lit(" r"), 400))).otherwise("").alias("remarks"))
    combined = c.select(F.when(m != 0, F.concat(key, F.lit(" C"))).alias("citation"), F.when(m != 1, F.col("title")).alias("parties"), "date", "court", F.col("status").alias("excerpt"))
    parts = [structure.normalise_case(rows, court) for rows, court in ((lahore, "Lahore High Court"), (islamabad, "Islamabad High Court"), (peshawar, "Peshawar High Court"))]
    parts.append(structure.normalise_combined(combined))
    columns = ["court", "citation", "id", "title", "case_no", "date", "summary"]
    return parts[0].select(columns).union(parts[1].select(columns)).union(parts[2].select(columns)).union(parts[3].select(columns))


@query("SELECT c_custkey AS n, left(regexp_replace(c_name || ' / ' || c_mktsegment, '[^A-Za-z0-9_\\-]', '_', 'g'), 120) AS id FROM customer")
def p5_make_id(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("n"), tx.make_id(F.concat(F.lit(" "), "c_name", F.lit(" / "), "c_mktsegment")).alias("id"))


_BODY = "CASE WHEN trim(text, ' ' || chr(10) || chr(9) || chr(13)) <> '' AND text NOT LIKE '[ERROR%' THEN left(text, {n}) ELSE coalesce(source, '') END"


@query(f"SELECT doc_id, md5('Title ' || {_BODY.format(n=3000)}) AS embedding_text, md5('Title  ' || {_BODY.format(n=5000)} || ' ') AS citation_text FROM documents")
def p6_case_texts(spark, d):
    """The source plays the summary, which stands in for a text that is null, blank or an error marker."""
    title, none = F.lit("Title"), F.lit(None).cast("string")
    cited = tx.citation_text(title, none, "text", "source", none)
    return table(spark, d, "documents").select("doc_id", F.md5(tx.embedding_text(title, "text", "source")).alias("embedding_text"), F.md5(cited).alias("citation_text"))


@query("SELECT page_id, 'https' || substr(regexp_replace(url, '^https?', ''), 1) AS link FROM pages")
def p7_resolve_link(spark, d):
    return table(spark, d, "pages").select("page_id", tx.resolve_link(F.lit(" "), "url").alias("link"))


@query("SELECT doc_id, CASE WHEN trim(text, ' ' || chr(10) || chr(9) || chr(13)) = '' THEN '[ERROR: empty]' ELSE md5(left(trim(text, ' ' || chr(10) || chr(9) || chr(13)), 200000) || CASE WHEN length(trim(text, ' ' || chr(10) || chr(9) || chr(13))) > 200000 THEN chr(10) || '[TRUNCATED]' ELSE '' END) END AS text FROM documents")
def p8_trim_text(spark, d):
    cut = tx.trimmed("text")
    return table(spark, d, "documents").select("doc_id", F.when(F.startswith(cut, F.lit("[ERROR")), cut).otherwise(F.md5(cut)).alias("text"))


@query(with_views("articles") + " SELECT id, CAST(article_number AS INTEGER) AS n, row_number() OVER (PARTITION BY document_title ORDER BY CAST(article_number AS INTEGER), id) AS place FROM articles")
def p17_order_articles(spark, d):
    from pyspark.sql import Window

    rows = t.articles(spark, d).withColumn("k", structure.order_key("article_number"))
    return rows.select("id", F.col("k.n").alias("n"), F.row_number().over(Window.partitionBy("document_title").orderBy("k", "id")).alias("place"))


@query("WITH f AS (SELECT p_partkey // 2 AS k, min(p_partkey) AS id FROM part GROUP BY 1), a AS (SELECT l_partkey // 2 AS k, count(*) AS m FROM lineitem GROUP BY 1) SELECT id, coalesce(m, 0) AS amendments FROM f LEFT JOIN a USING (k)")
def p18_apply_amendments(spark, d):
    """Two parts share an article number, and the first of them takes the amendments of both; the numbers grow with the table."""
    number = lambda c: F.floor(F.col(c) / 2).cast("string")
    a = t.articles(spark, d).withColumns({"article_number": number("id"), "position": F.col("id"), "clauses": F.array().cast("array<struct<id:string,text:string>>")})
    lines = table(spark, d, "lineitem").select(number("l_partkey").alias("article_number"), F.struct("l_orderkey", "l_linenumber").alias("position"), F.concat(F.lit("amended by "), "l_suppkey").alias("content"))
    return structure.apply_amendments(a, lines).select("id", F.size("clauses").cast("long").alias("amendments"))


@query("""SELECT e.event_id AS id, c.label AS chapter FROM (SELECT * FROM events WHERE event_type <> 'view') e ASOF LEFT JOIN (SELECT user_id, event_id AS at, 'C' || event_id AS label FROM events WHERE event_type = 'view') c ON e.user_id = c.user_id AND e.event_id >= c.at""")
def p19_section_context(spark, d):
    e = table(spark, d, "events")
    place = [F.col("user_id").alias("doc_id"), F.lit(1).alias("page"), F.col("event_id").alias("y")]
    markers = e.where("event_type = 'view'").select(*place, F.lit("chapter").alias("kind"), F.concat(F.lit("C"), "event_id").alias("label"))
    return structure.section_context(e.where("event_type <> 'view'").select(*place, F.col("event_id").alias("id")), markers).select("id", "chapter")


@query(with_views("articles") + ", m AS (SELECT document_title, min(page_number) AS p FROM articles WHERE article_number = '7' GROUP BY 1) SELECT id FROM articles LEFT JOIN m USING (document_title) WHERE p IS NULL OR page_number <= p")
def p21_drop_after_marker(spark, d):
    return structure.drop_after_marker(t.articles(spark, d), "7").select("id")


# --- filters ---

#: Phrases and tokens that the given texts have.
PHRASES, TOKENS = ("licensed under", "all rights reserved", "token = ", "of the", "released under"), ("example", "idiot", "copyright", "mit")
_BLOB = "lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))"
_TRIGGERS = "list_filter([" + ", ".join([f"CASE WHEN contains(b, {_quoted(p)}) THEN 'phrase:{p}' END" for p in PHRASES] + [f"CASE WHEN regexp_matches(b, '(^|[^\\p{{L}}\\p{{N}}_]){w}([^\\p{{L}}\\p{{N}}_]|$)') THEN 'word_token:{w}' END" for w in TOKENS]) + "], lambda x: x IS NOT NULL)"


@query(f"SELECT doc_id, array_to_string({_TRIGGERS}, '|') AS triggers FROM (SELECT doc_id, {_BLOB} AS b FROM documents)")
def f1_topic_triggers(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.lower(tx.collapsed("text")).alias("b"))
    return rows.select("doc_id", F.array_join(F.transform(filters.topic_triggers("b", PHRASES, TOKENS), lambda x: F.concat_ws(":", x["kind"], x["matched"])), "|").alias("triggers"))


@query(f"""WITH x AS (SELECT doc_id, {_TRIGGERS} AS g FROM (SELECT doc_id, {_BLOB} AS b FROM documents)), y AS (SELECT *, string_split(g[1], ':')[1] AS kind, substr(g[1], instr(g[1], ':') + 1) AS v FROM x WHERE len(g) > 0)
SELECT doc_id, 'cyber_law_v1' AS filter_profile, CASE WHEN kind = 'phrase' THEN 'Listing text contains phrase "' || v || '" (substring match in combined fields; profile cyber_law_v1).' ELSE 'Listing text contains token "' || v || '" as a whole word (word-boundary match; profile cyber_law_v1).' END
|| CASE WHEN len(g) > 1 THEN ' Additional triggers: ' || array_to_string(list_transform(g[2:], lambda t: substr(t, 1, instr(t, ':')) || '''' || substr(t, instr(t, ':') + 1) || ''''), ', ') || '.' ELSE '' END AS reason FROM y""")  # fmt: skip
def f2_classify_listing(spark, d):
    return filters.classify_listing(table(spark, d, "documents").select("doc_id", "text"), "text", PHRASES, TOKENS).select("doc_id", "filter_profile", "reason")


@query("SELECT o_orderkey AS id, c_name || ' ' || o_orderstatus AS blob FROM orders JOIN customer ON o_custkey = c_custkey")
def f3_listing_blob(spark, d):
    rows = t.cases(spark, d).select("id", F.col("title").alias("case_title"), F.lit("").alias("writ_petition"), F.lit(None).cast("string").alias("hon_judge"), F.col("status").alias("lhc_citation"))
    return rows.select("id", filters.listing_blob("Lahore High Court").alias("blob"))


@query("SELECT doc_id FROM documents WHERE " + " OR ".join(f"contains(lower(source || ' ' || text), {_quoted(p)})" for p in PHRASES))
def f4_strict_filter(spark, d):
    return filters.strict_filter(table(spark, d, "documents"), "source", "text", PHRASES).select("doc_id")


_LOW_AT = "instr(lower(text), m[1]) - 1"


@query("WITH x AS (SELECT doc_id, text, list_filter([" + ", ".join(f"CASE WHEN contains(lower(text), {_quoted(p)}) THEN {_quoted(p)} END" for p in PHRASES) + f"], lambda x: x IS NOT NULL) AS m FROM documents), y AS (SELECT *, {_LOW_AT} AS p FROM x WHERE len(m) > 0) "
       "SELECT doc_id, array_to_string(m, '|') AS matched, '...' || trim(substr(text, greatest(0, p - 175) + 1, p + 175 - greatest(0, p - 175)), ' ' || chr(10) || chr(9) || chr(13)) || '...' AS excerpt FROM y")  # fmt: skip
def f5_scan_fulltext(spark, d):
    return filters.scan_fulltext(table(spark, d, "documents").select("doc_id", "text"), "text", PHRASES).select("doc_id", F.array_join("matched", "|").alias("matched"), "excerpt")


@query("SELECT doc_id FROM documents WHERE trim(text, ' ' || chr(10) || chr(9) || chr(13)) <> '' AND text NOT LIKE '[ERROR%'")
def f6_usable_text(spark, d):
    return filters.usable_text(table(spark, d, "documents"), "text").select("doc_id")


@query(with_views("cases") + " SELECT id FROM cases WHERE contains(lower(title), 'urgent') OR contains(lower(citation), 'urgent') OR contains(lower(court), 'urgent')")
def f7_search_cases(spark, d):
    return filters.search_cases(t.cases(spark, d).withColumn("judge", F.lit(None).cast("string")), " URGENT ").select("id")


@query("SELECT p_partkey AS id FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_type), 'ring')")
def f7_search_documents(spark, d):
    return filters.search_documents(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("category")), "Ring").select("id")


@query("SELECT o_orderkey AS id FROM orders WHERE year(o_orderdate) IN (1996, 1998)")
def f8_filter_years(spark, d):
    return filters.filter_years(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("year")), [1996, 1998]).select("id")


@query("""WITH r AS (SELECT l_orderkey AS query_id, l_partkey AS id, max(l_discount) AS score FROM lineitem GROUP BY 1, 2), w AS (SELECT *, max(score >= 0.05) OVER (PARTITION BY query_id) AS some_, count(*) OVER (PARTITION BY query_id) AS n_before, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS n FROM r),
k AS (SELECT * FROM w WHERE score >= 0.05 OR (NOT some_ AND n <= 3)) SELECT query_id, id, n_before, count(*) OVER (PARTITION BY query_id) AS n_after, n_before - count(*) OVER (PARTITION BY query_id) AS n_removed FROM k""")  # fmt: skip
def f9_filter_relevant(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("id")).agg(F.max("l_discount").alias("score"))
    return filters.filter_relevant(rows, 0.05).select("query_id", "id", "n_before", "n_after", "n_removed")


@query("SELECT o_orderpriority AS court, count(*) AS seen, count(*) FILTER (WHERE o_orderstatus = 'F') AS kept FROM orders GROUP BY 1")
def f10_filter_funnel(spark, d):
    return filters.filter_funnel(t.cases(spark, d), "court", F.col("status") == "F")


_CLEAN = "rtrim(trim(lower(text), ' ' || chr(10) || chr(9) || chr(13)), '?!.')"


@query(f"SELECT conv_id, turn, text <> '' AND ({_CLEAN} IN ({', '.join(map(_quoted, values.GREETINGS))}) OR (len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) <= 3 AND ({' OR '.join(f'contains({_CLEAN}, {_quoted(g)})' for g in values.GREETINGS)}) AND NOT ({' OR '.join(f'contains({_CLEAN}, {_quoted(b)})' for b in values.GREETING_BLOCKERS)}))) AS greeting FROM conversations")
def f11_is_greeting(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", filters.is_greeting("text").alias("greeting"))


# --- labels and scores ---

_OUTCOME = "CASE o_orderstatus WHEN 'F' THEN 'Accordingly, this writ petition is allowed.' WHEN 'O' THEN 'The bail petition of the accused is dismissed.' ELSE 'The appeal is partly allowed.' END || CASE o_orderkey % 4 WHEN 0 THEN ' It stands dismissed in limine.' WHEN 1 THEN ' He was granted bail.' ELSE '' END"


def _weighed(patterns) -> str:
    return " + ".join(f"CASE WHEN regexp_matches(low, {_quoted(p)}) THEN {w} ELSE 0 END" for p, w in patterns)


def _judged(spark, d):
    o = table(spark, d, "orders")
    first = F.when(F.col("o_orderstatus") == "F", "Accordingly, this writ petition is allowed.").when(F.col("o_orderstatus") == "O", "The bail petition of the accused is dismissed.").otherwise("The appeal is partly allowed.")
    rest = F.when(F.col("o_orderkey") % 4 == 0, " It stands dismissed in limine.").when(F.col("o_orderkey") % 4 == 1, " He was granted bail.").otherwise("")
    return o.select(F.col("o_orderkey").alias("id"), F.concat(first, rest).alias("pdf_data"), F.when(F.col("o_orderkey") % 3 == 0, "unknown").alias("winner"))


_WINNER = f"""WITH x AS (SELECT o_orderkey AS id, lower({_OUTCOME}) AS low FROM orders), y AS (SELECT id, {_weighed(values.OUTCOME_MIXED)} AS m, {_weighed(values.OUTCOME_POSITIVE)} AS p, {_weighed(values.OUTCOME_NEGATIVE)} AS n FROM x),
w AS (SELECT id, CASE WHEN m >= 4 THEN 'mixed' WHEN p = 0 AND n = 0 THEN 'unknown' WHEN m > 0 AND p > 0 AND n > 0 THEN 'mixed' WHEN p > n AND n > 0 THEN 'mixed' WHEN p > n THEN 'petitioner' WHEN n > p THEN 'respondent' ELSE 'unknown' END AS winner FROM y)"""


@query(_WINNER + " SELECT id, winner FROM w")
def r1_infer_winner(spark, d):
    return scorers.infer_winner(_judged(spark, d)).select("id", "winner")


@query(_WINNER + " SELECT id, CASE WHEN id % 3 = 0 THEN 'unknown' ELSE winner END AS winner, id % 3 <> 0 AS updated FROM w")
def r2_fill_winner(spark, d):
    return scorers.fill_winner(_judged(spark, d)).select("id", "winner", "updated")


_SPECIFIC = " OR ".join(f"regexp_matches(text, {_quoted('(?i)' + p)})" for p in values.SPECIFIC_REFERENCES)
_SCORE = " + ".join([f"CASE WHEN contains(lower(text), {_quoted(i)}) THEN 1 ELSE 0 END" for i in values.COMPLEXITY_INDICATORS] + ["CASE WHEN (len(lower(text)) - len(replace(lower(text), ' and ', ''))) / 5 >= 2 THEN 1 ELSE 0 END", "CASE WHEN " + " + ".join(f"CASE WHEN contains(' ' || lower(text) || ' ', ' {w} ') THEN 1 ELSE 0 END" for w in values.CONDITIONALS) + " >= 2 THEN 1 ELSE 0 END"])
_TERMS = " + ".join(f"CASE WHEN contains(lower(text), {_quoted(x)}) THEN 1 ELSE 0 END" for x in values.LEGAL_TERMS)
_CLASSES = f"""x AS (SELECT conv_id, turn, {_SPECIFIC} AS specific, {_SCORE} AS score, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS n, len(text) - len(replace(text, '?', '')) AS q, {_TERMS} AS terms FROM conversations),
c AS (SELECT *, CASE WHEN specific THEN 'simple' WHEN score >= 3 OR n > 20 OR q > 1 THEN 'complex' WHEN terms > 0 THEN CASE WHEN n > 12 OR score >= 1 THEN 'moderate' ELSE 'simple' END WHEN n <= 5 THEN 'simple' ELSE 'moderate' END AS complexity FROM x)"""


@query(f"WITH {_CLASSES} SELECT conv_id, turn, complexity FROM c")
def r3_classify_query(spark, d):
    return scorers.classify_query(table(spark, d, "conversations")).select("conv_id", "turn", "complexity")


@query(f"""WITH {_CLASSES} SELECT conv_id, turn, CASE complexity WHEN 'simple' THEN 5 WHEN 'moderate' THEN 10 ELSE 15 END AS top_k, CASE complexity WHEN 'simple' THEN 1000 WHEN 'moderate' THEN 1500 ELSE 2000 END AS max_words, complexity <> 'simple' AS use_multi_stage,
'Classified as ''' || complexity || ''' because: ' || coalesce(nullif(concat_ws(', ', CASE WHEN specific THEN 'references specific section/article' END, CASE WHEN score > 0 THEN 'has ' || score || ' complexity indicator(s)' END, CASE WHEN n > 20 THEN 'long question (' || n || ' words)' WHEN n <= 5 THEN 'short question (' || n || ' words)' END,
CASE WHEN q > 1 THEN 'multiple questions' END, CASE WHEN terms > 0 THEN 'contains ' || terms || ' legal term(s)' END), ''), 'general query pattern') AS reason FROM c""")  # fmt: skip
def r4_retrieval_strategy(spark, d):
    return scorers.explain(scorers.retrieval_strategy(scorers.classify_query(table(spark, d, "conversations")))).select("conv_id", "turn", "top_k", "max_words", "use_multi_stage", "reason")


_CHECKS = ", ".join("CASE WHEN " + " OR ".join(f"regexp_matches(low, {_quoted(p)})" for p in ps) + " THEN 'found' ELSE 'missing' END" for ps in values.CHECKLIST.values())
_NARRATED = "lower(text || ' ' || CASE doc_id % 4 WHEN 0 THEN 'legal notice of 2024-05-01 in Lahore' WHEN 1 THEN 'witness and harm, cnic 12345-1234567-1' WHEN 2 THEN 'damage on 3/4/24' ELSE '' END)"


def _narratives(spark, d):
    more = F.when(F.col("doc_id") % 4 == 0, "legal notice of 2024-05-01 in Lahore").when(F.col("doc_id") % 4 == 1, "witness and harm, cnic 12345-1234567-1").when(F.col("doc_id") % 4 == 2, "damage on 3/4/24").otherwise("")
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat_ws(" ", "text", more).alias("narrative"))


@query(f"SELECT doc_id AS id, array_to_string([{_CHECKS}], ',') AS checklist FROM (SELECT doc_id, {_NARRATED} AS low FROM documents)")
def r5_evidence_checklist(spark, d):
    return _narratives(spark, d).select("id", F.array_join(F.transform(scorers.evidence_checklist("narrative"), lambda c: c["status"]), ",").alias("checklist"))


_MERIT = f"""WITH c AS (SELECT doc_id AS id, len(list_filter([{_CHECKS}], lambda x: x = 'found')) / 6 AS complete FROM (SELECT doc_id, {_NARRATED} AS low FROM documents)),
s AS (SELECT *, least((id % 7) / 5.0::DOUBLE, 1.0::DOUBLE) AS sim, least((id % 9) / 6.0::DOUBLE, 1.0::DOUBLE) AS ground FROM c), m AS (SELECT *, greatest(25, least(92, CAST(trunc((0.45::DOUBLE * complete + 0.35::DOUBLE * sim + 0.20::DOUBLE * ground) * 100) AS INTEGER))) AS score FROM s)"""


@query(_MERIT + " SELECT id, score, CASE WHEN score >= 70 THEN 'High Merit' WHEN score >= 50 THEN 'Moderate Merit' ELSE 'Low Merit' END AS label, CASE WHEN complete >= 0.75 THEN 'Strong' WHEN complete >= 0.45 THEN 'Moderate' ELSE 'Weak' END AS evidence_weight FROM m")
def r6_case_merit(spark, d):
    rows = _narratives(spark, d).withColumn("c", scorers.evidence_checklist("narrative")).withColumn("m", scorers.case_merit("c", F.col("id") % 7, F.col("id") % 9))
    return rows.select("id", "m.score", "m.label", "m.evidence_weight")


_STRIPPED = "trim(text, ' ' || chr(10) || chr(9) || chr(13))"


_FACT_TEXT = "coalesce(trim(text, ' ' || chr(10) || chr(9) || chr(13)), '')"


@query(f"SELECT doc_id, array_to_string(list_filter(list_transform(string_split({_FACT_TEXT}, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '')[1:8], '|') AS facts, CASE WHEN {_FACT_TEXT} = '' THEN 0.2 WHEN length({_FACT_TEXT}) > 250 THEN 0.75 ELSE 0.55 END::DOUBLE AS confidence, least(12, len(list_distinct(list_filter(regexp_split_to_array({_FACT_TEXT}, '[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Nl}}\\p{{Pc}}]+'), lambda w: regexp_full_match(w, '[A-Z][a-zA-Z]{{2,}}'))))) AS n_entities FROM documents")
def r7_extract_facts(spark, d):
    """A capitalised word has word characters of any script on neither side; the SQL twin takes whole words apart instead."""
    rows = table(spark, d, "documents").select("doc_id", scorers.extract_facts("text").alias("f"))
    return rows.select("doc_id", F.array_join("f.facts", "|").alias("facts"), F.col("f.confidence").cast("double").alias("confidence"), F.size("f.entities").cast("long").alias("n_entities"))


_ANSWER = "CASE o_orderkey % 5 WHEN 0 THEN 'Answer yes because no ' WHEN 1 THEN 'No, yes ' WHEN 2 THEN 'notable yesterday ' WHEN 3 THEN '' ELSE ' It is YES. ' END || o_orderpriority"


def _answers(spark, d):
    start = F.element_at(F.array(*[F.lit(x) for x in ("Answer yes because no ", "No, yes ", "notable yesterday ", "", " It is YES. ")]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(start, "o_orderpriority").alias("answer"), "o_orderpriority")


@query(f"SELECT id, CASE WHEN regexp_matches(a, '^answer\\s+(yes|no)(\\s|$)') THEN regexp_extract(a, '^answer\\s+(yes|no)', 1) ELSE regexp_extract(a, '\\b(yes|no)\\b', 1) END AS label FROM (SELECT o_orderkey AS id, trim(lower({_ANSWER})) AS a FROM orders)")
def r8_parse_yes_no(spark, d):
    return _answers(spark, d).select("id", tx.parse_yes_no("answer").alias("label"))


@query(with_views("cited_lines") + " SELECT DISTINCT line, lower(regexp_extract(line, '(?i)section\\s+(\\w+)', 1)) AS section FROM cited_lines")
def r9_gold_section(spark, d):
    return t.cited_lines(spark, d).select("line").distinct().select("line", tx.gold_section("line").alias("section"))


@query("SELECT o_orderkey AS id, o_orderkey % 5 <> 3 AS satisfactory, CASE WHEN o_orderkey % 5 <> 3 THEN o_orderpriority END AS answer FROM orders")
def r10_parse_advice(spark, d):
    body = F.concat(F.lit('Sure: ```json {"directAnswer": "'), "o_orderpriority", F.lit('", "legalBasis": [{"citation": "a", "explanation": "b"}, {"citation": "c"}], "nextSteps": ["x"]}```'))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 5 != 3, body).otherwise(F.lit("no object here")).alias("raw"))
    return rows.select("id", tx.advice_satisfactory("raw").alias("satisfactory"), tx.parse_advice("raw")["directAnswer"].alias("answer"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'What is the rule of ' || o_orderpriority || '|How does ' || o_orderstatus || ' matter here' ELSE o_orderpriority END AS questions FROM orders")
def r11_subqueries(spark, d):
    listed = F.concat(F.lit("Here:\n- What is the rule of "), "o_orderpriority", F.lit("\n2. How does "), "o_orderstatus", F.lit(" matter here\n* short"))
    rows = table(spark, d, "orders").withColumn("listed", F.when(F.col("o_orderkey") % 2 == 0, listed).otherwise(F.lit("none")))
    return rows.select(F.col("o_orderkey").alias("id"), F.array_join(tx.subqueries("listed", "o_orderpriority"), "|").alias("questions"))


# --- reports ---


@query(with_views("statutes", "articles") + " SELECT s.title, s.year, s.type, count(a.id) AS articles FROM statutes s LEFT JOIN articles a ON a.document_title = s.title GROUP BY 1, 2, 3")
def a1_document_stats(spark, d):
    return reports.document_stats(t.statutes(spark, d), t.articles(spark, d))


@query(with_views("statutes", "articles", "cites", "case_cites") + """ SELECT 'documents' AS name, count(*) AS n FROM statutes UNION ALL SELECT 'articles', count(*) FROM articles UNION ALL SELECT 'cites', count(*) FROM cites UNION ALL SELECT 'case_cites', count(*) FROM case_cites
UNION ALL SELECT 'total_edges', (SELECT count(*) FROM cites) + (SELECT count(*) FROM case_cites)""")  # fmt: skip
def a2_graph_stats(spark, d):
    return reports.graph_stats({"documents": t.statutes(spark, d), "articles": t.articles(spark, d)}, {"cites": t.cites(spark, d), "case_cites": t.case_cites(spark, d)})


@query("SELECT l_suppkey AS concept, count(*) AS articles FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) GROUP BY 1 ORDER BY articles DESC, concept LIMIT 50")
def a3_top_concepts(spark, d):
    return reports.top_concepts(table(spark, d, "lineitem").select(F.col("l_partkey").alias("article_id"), F.col("l_suppkey").alias("concept")).distinct())


@query("SELECT coalesce(o_orderpriority, 'ALL') AS court, count(*) AS cases FROM orders GROUP BY ROLLUP (o_orderpriority)")
def a4_cases_by_court(spark, d):
    return reports.cases_by_court(t.cases(spark, d))


@query("""WITH c AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem), s AS (SELECT DISTINCT l_partkey, l_suppkey, l_returnflag FROM lineitem)
SELECT p_brand AS document_title, count(*) AS articles, coalesce(sum((SELECT count(*) FROM c WHERE c.l_partkey = p_partkey)), 0)::BIGINT AS clauses, coalesce(sum((SELECT count(*) FROM s WHERE s.l_partkey = p_partkey)), 0)::BIGINT AS subclauses FROM part GROUP BY 1""")  # fmt: skip
def a5_document_breakdown(spark, d):
    a = structure.normalise_articles(_nested(spark, d))
    return reports.document_breakdown(a, *structure.explode_clauses(a))


@query(with_views("case_cites") + " SELECT (SELECT count(*) FROM orders) AS cases, count(*) AS links, count(DISTINCT article_id) AS linked_articles, (SELECT count(*) FROM embeddings) AS similarities, round(count(*) / (SELECT count(*) FROM orders), 6) AS average_links FROM case_cites")
def a6_ingest_summary(spark, d):
    return reports.ingest_summary(t.cases(spark, d), t.case_cites(spark, d), table(spark, d, "embeddings"))


@query(with_views("cases") + " SELECT id, title, date FROM cases ORDER BY date DESC, id LIMIT 100")
def a7_list_cases(spark, d):
    return reports.list_cases(t.cases(spark, d)).select("id", "title", "date")


@query(with_views("cites", "articles") + " SELECT src, dst, a.document_title AS src_document, a.article_number AS src_number, b.document_title AS dst_document, b.article_number AS dst_number FROM (SELECT * FROM cites ORDER BY src, dst LIMIT 10) JOIN articles a ON a.id = src JOIN articles b ON b.id = dst")
def a8_citation_sample(spark, d):
    return reports.citation_sample(t.cites(spark, d), t.articles(spark, d))


_RECALL = """WITH g AS (SELECT l_orderkey AS query_id, CAST(l_partkey % 50 AS VARCHAR) AS s FROM lineitem), r AS (SELECT DISTINCT l_orderkey AS query_id, CAST(l_partkey % 50 AS VARCHAR) AS s FROM lineitem WHERE l_linenumber <= 3),
h AS (SELECT g.query_id, count(*) AS expected, count(r.s) AS hits FROM g LEFT JOIN r ON g.query_id = r.query_id AND g.s = r.s GROUP BY 1), q AS (SELECT o_orderkey AS query_id, coalesce(expected, 0) AS expected, coalesce(hits, 0) AS hits FROM orders LEFT JOIN h ON o_orderkey = query_id)"""


def _recall(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), (F.col("l_partkey") % 50).cast("string").alias("section"), F.col("l_linenumber").alias("rank"))
    gold = table(spark, d, "orders").select(F.col("o_orderkey").alias("query_id")).join(lines.groupBy("query_id").agg(F.collect_list("section").alias("sections")), "query_id", "left")
    return reports.recall_at_k(lines, gold, 3)


@query(_RECALL + " SELECT query_id, expected, hits, round(CASE WHEN expected > 0 THEN hits / expected ELSE 1 END, 6) AS recall FROM q")
def a9_recall_at_k(spark, d):
    return _recall(spark, d).withColumn("recall", F.round("recall", 6))


@query(_RECALL + " SELECT count(*) AS questions, round(avg(CASE WHEN expected > 0 THEN hits / expected ELSE 1 END), 6) AS recall FROM q")
def a9_mean_recall(spark, d):
    return reports.mean_recall(_recall(spark, d)).withColumn("recall", F.round("recall", 6))


@query("SELECT count(*) AS questions, count(*) FILTER (WHERE l_returnflag = l_linestatus AND l_linenumber <> 7) AS correct, count(*) FILTER (WHERE l_linenumber = 7) AS failed, count(*) FILTER (WHERE l_returnflag = l_linestatus AND l_linenumber <> 7) / count(*) AS accuracy FROM lineitem")
def a10_answer_accuracy(spark, d):
    return reports.answer_accuracy(table(spark, d, "lineitem").select(F.col("l_returnflag").alias("predicted_label"), F.col("l_linestatus").alias("expected_answer"), (F.col("l_linenumber") == 7).alias("generation_failed")))


@query("SELECT 'C_' || c_custkey AS id, c_name AS title FROM customer UNION ALL SELECT 'S_' || s_suppkey, s_name FROM supplier")
def a11_union_courts(spark, d):
    c = table(spark, d, "customer").select(F.concat(F.lit("C_"), "c_custkey").alias("id"), F.col("c_name").alias("title"))
    return reports.union_courts(c, table(spark, d, "supplier").select(F.col("s_name").alias("title"), F.concat(F.lit("S_"), "s_suppkey").alias("id")))


@query("SELECT l_orderkey, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1")
def a12_dedupe_first(spark, d):
    return reports.dedupe_first(table(spark, d, "lineitem").select("l_orderkey", "l_partkey"), "l_orderkey", ["l_partkey"])


@query("SELECT coalesce(l_returnflag, 'ALL') AS court, count(*) AS total, count(*) FILTER (WHERE l_linenumber < 4) AS text_ok, count(*) FILTER (WHERE l_linenumber = 4) AS skipped, count(*) FILTER (WHERE l_linenumber > 4) AS errors, count(*) FILTER (WHERE l_linenumber > 5) AS http_errors, count(*) FILTER (WHERE l_linestatus = 'F') AS updated FROM lineitem GROUP BY ROLLUP (l_returnflag)")
def a13_enrichment_summary(spark, d):
    status = F.when(F.col("l_linenumber") < 4, "ok").when(F.col("l_linenumber") == 4, "skipped").when(F.col("l_linenumber") == 5, "error:empty").otherwise("error:http 404")
    return reports.enrichment_summary(table(spark, d, "lineitem").select(F.col("l_returnflag").alias("court"), status.alias("status"), (F.col("l_linestatus") == "F").alias("updated")))


# --- datasets ---


@query("SELECT conv_id, turn, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS key FROM conversations")
def d1_input_key(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", tx.input_key("text").alias("key"))


@query("WITH n AS (SELECT l_orderkey, count(*) AS prior FROM lineitem GROUP BY 1) SELECT o_orderkey AS id, coalesce(prior, 0) AS prior FROM orders LEFT JOIN n ON l_orderkey = o_orderkey WHERE coalesce(prior, 0) < 2")
def d2_remaining_under_cap(spark, d):
    cases = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit(" court").alias("court"), F.col("o_orderkey").cast("string").alias("case_no"), F.lit("text").alias("pdf_data"))
    done = table(spark, d, "lineitem").select(F.struct(F.col("l_orderkey").cast("string").alias("source_case_no"), F.lit("court").alias("source_court")).alias("_metadata"))
    return datasets.remaining_under_cap(cases, done).select("id", "prior")


@query("SELECT o_orderkey AS id, (row_number() OVER (ORDER BY o_orderkey) - 1) // 5 AS batch FROM orders")
def d4_assign_batches(spark, d):
    return datasets.assign_batches(table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), "id")


@query("""WITH seen AS (SELECT DISTINCT lower(o_orderpriority) AS k FROM orders WHERE o_orderpriority = '1-URGENT'), new_ AS (SELECT c_custkey AS n, c_mktsegment AS input, c_nationkey AS c FROM customer UNION ALL SELECT 1000000 + o_orderkey, o_orderpriority, 0 FROM orders),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(input) ORDER BY n) AS r FROM new_ WHERE lower(input) NOT IN (FROM seen)) WHERE r = 1) SELECT n, input, row_number() OVER (PARTITION BY c ORDER BY n) AS variation_index FROM f""")  # fmt: skip
def d5_append_examples(spark, d):
    meta = lambda c: F.struct(c.cast("string").alias("source_case_no"), F.lit("x").alias("source_court"), F.lit(None).cast("int").alias("variation_index")).alias("_metadata")
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("order"), F.col("c_mktsegment").alias("input"), meta(F.col("c_nationkey")))
    b = table(spark, d, "orders").select((F.col("o_orderkey") + 1000000).alias("order"), F.col("o_orderpriority").alias("input"), meta(F.lit(0)))
    old = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.concat(F.lit(" "), F.lower("o_orderpriority")).alias("input"), meta(F.lit(-1)))
    return datasets.append_examples(old, a.union(b)).select(F.col("order").alias("n"), "input", F.col("_metadata.variation_index").cast("long").alias("variation_index"))


@query("WITH n AS (SELECT count(*) AS n FROM conversations WHERE trim(text, ' ' || chr(10)) <> '') SELECT 'train' AS split, greatest(1, floor(n * 0.95))::BIGINT AS rows FROM n UNION ALL SELECT 'test', (n - greatest(1, floor(n * 0.95)))::BIGINT FROM n")
def d6_split(spark, d):
    rows = table(spark, d, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("instruction"), F.lit(None).cast("string").alias("input"), F.col("text").alias("output"))
    return datasets.split(datasets.sft_rows(rows)).groupBy("split").agg(F.count("*").alias("rows"))


@query("SELECT conv_id, turn, 'system|user|assistant' AS roles, md5(trim(role) || chr(10) || chr(10) || 'in') AS user_content, md5(text) AS answer FROM conversations")
def d7_to_messages(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.col("role").alias("instruction"), F.lit("in").alias("input"), F.col("text").alias("output"))
    m = datasets.to_messages(rows)
    return m.select("conv_id", "turn", F.array_join(F.transform("messages", lambda x: x["role"]), "|").alias("roles"), F.md5(F.col("messages")[1]["content"]).alias("user_content"), F.md5(F.col("messages")[2]["content"]).alias("answer"))


# --- narratives, sessions ---


@query(f"SELECT doc_id AS id, n_laws, n_cases, score FROM (SELECT doc_id, {_NARRATED} AS low FROM documents) JOIN LATERAL (SELECT len(list_filter([{_CHECKS}], lambda x: x = 'found')) / 6 AS complete) ON true JOIN LATERAL (SELECT doc_id % 9 AS n_laws, doc_id % 7 AS n_cases) ON true JOIN LATERAL (SELECT greatest(25, least(92, CAST(trunc((0.45::DOUBLE * complete + 0.35::DOUBLE * least(n_cases / 5.0::DOUBLE, 1) + 0.20::DOUBLE * least(n_laws / 6.0::DOUBLE, 1)) * 100) AS INTEGER))) AS score) ON true")
def q13_analyse_narratives(spark, d):
    rows = _narratives(spark, d).withColumns({"ocr_text": F.lit(None).cast("string"), "incident_date": F.lit(None).cast("string")})
    some = lambda kind, n: rows.select(F.col("id").alias("query_id"), F.lit(kind).alias("type"), F.explode(F.sequence(F.lit(1).cast("long"), n)).alias("rank")).where("true")
    found = some("article", F.greatest(F.col("id") % 9, F.lit(1))).where("rank <= query_id % 9").union(some("case", F.greatest(F.col("id") % 7, F.lit(1))).where("rank <= query_id % 7")).withColumn("id", F.col("rank"))
    out = retrieval.analyse_narratives(rows, found)
    return out.select("id", F.size("laws").cast("long").alias("n_laws"), F.size("cases").cast("long").alias("n_cases"), "merit.score")


@query(f"""SELECT doc_id AS id, array_to_string(list_transform(range(1, doc_id % 9 + 1), lambda x: 'a' || x), ',') AS laws, array_to_string(list_transform(range(1, doc_id % 7 + 1), lambda x: 'c' || x), ',') AS cases, array_to_string(checks, ',') AS checklist,
array_to_string([y for x, y in zip_ if x = 'missing'], ';') AS reasons FROM (SELECT doc_id, checks, list_zip(checks, [{", ".join(_quoted("Missing: " + k) for k in values.CHECKLIST)}]) AS zipped FROM (SELECT doc_id, [{_CHECKS}] AS checks FROM (SELECT doc_id, {_NARRATED} AS low FROM documents)))""".replace("array_to_string([y for x, y in zip_ if x = 'missing'], ';')", "array_to_string(list_transform(list_filter(zipped, lambda z: z[1] = 'missing'), lambda z: z[2]), ';')"))  # fmt: skip
def q13_narrative_rows(spark, d):
    """What an analysis says of each narrative: its laws and cases in order, what was found and what is missing."""
    rows = _narratives(spark, d).withColumns({"ocr_text": F.lit(None).cast("string"), "incident_date": F.lit(None).cast("string")})
    some = lambda kind, letter, n: rows.select(F.col("id").alias("query_id"), F.lit(kind).alias("type"), F.explode(F.sequence(F.lit(0).cast("long"), n)).alias("rank")).where("rank > 0").withColumn("id", F.concat(F.lit(letter), "rank"))
    out = retrieval.analyse_narratives(rows, some("article", "a", F.col("id") % 9).union(some("case", "c", F.col("id") % 7)))
    checks = F.array_join(F.transform("checklist", lambda c: c["status"]), ",").alias("checklist")
    return out.select("id", F.array_join("laws", ",").alias("laws"), F.array_join("cases", ",").alias("cases"), checks, F.array_join("reasons", ";").alias("reasons"))


@query("SELECT CAST(conv_id AS VARCHAR) AS session_id, count(*) AS turns, md5(string_agg(text, '|' ORDER BY turn)) AS digest FROM conversations GROUP BY 1")
def t2_history(spark, d):
    turns = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), F.col("text").alias("question"), F.lit(None).cast("string").alias("answer"), F.timestamp_seconds("turn").alias("ts"), F.lit(0.0).alias("duration"))
    return history.history(turns).select("session_id", F.size("history").cast("long").alias("turns"), F.md5(F.array_join(F.transform("history", lambda h: h["question"]), "|")).alias("digest"))


_SIDE = "SELECT user_id AS id, max(ts) AS made, arg_max(event_type, (ts, event_id)) AS v, {0} AS l FROM events WHERE event_type {1} ('click', 'view') GROUP BY 1"


@query(f"SELECT id, v FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY made DESC, l DESC) AS n FROM ({_SIDE.format(0, 'IN')} UNION ALL {_SIDE.format(1, 'NOT IN')})) WHERE n = 1")
def t3_merge_sessions(spark, d):
    """Two lists of a user's last events: clicks and views, and all others."""
    e = table(spark, d, "events")
    last = F.max_by("event_type", F.struct("ts", "event_id")).alias("v")
    side = lambda rows: rows.groupBy(F.col("user_id").alias("id")).agg(F.max("ts").alias("createdAt"), last)
    seen = F.col("event_type").isin("click", "view")
    return history.merge_sessions(side(e.where(seen)), side(e.where(~seen))).select("id", "v")


@query("SELECT id, v, e FROM (SELECT user_id AS id, arg_max(event_type, (ts, event_id)) AS v, max_by(event_id, (ts, event_id)) AS e FROM events GROUP BY 1) WHERE v <> 'purchase'")
def t4_stream_workspace(spark, d):
    """The events as writes of a stream that is stopped and started again; a purchase deletes a user's workspace."""
    source, out, check = (shared.folder(spark) for _ in range(3))
    e = table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), (F.col("event_type") == "purchase").alias("deleted"), F.col("event_type").alias("v"))
    for late in (0, 1):
        e.where(F.col("seq") % 2 == late).write.mode("append").parquet(source)
        workspace.stream_writes(spark.readStream.schema(e.schema).parquet(source), out, check).awaitTermination()
    return workspace.read_writes(spark, out, "v string").select("id", "v", F.col("seq").alias("e"))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS last FROM events GROUP BY 1")
def t4_latest_workspace(spark, d):
    e = table(spark, d, "events").select("user_id", "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("last"), F.lit(None).cast("array<string>").alias("cases"))
    return history.latest_workspace(e).where("size(cases) = 0").select("user_id", "last")
