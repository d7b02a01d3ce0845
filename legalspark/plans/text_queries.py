"""Registered queries: layout, sections, clauses, shapes, encoders, files and streams derived from the given tables."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import datasets, retrieval, scorers, structure, vectors
from ..sources import html, shared, tables
from ..streaming import cases as stream
from ..streaming import history
from . import testdata as t
from .registry import query
from .testdata import table, with_views


# --- files and streams ---


def _one_per_file(df, path: str) -> str:
    """A JSON document in each file, as statutes and listings come. There are many small files, so tasks move their own into place
    (version 2); in version 1 the driver moves each."""
    df.write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", 2).json(path)
    return path


def _collected(df, keys: dict, record, name: str):
    """The records of each key as an array. Partitions are a fixed number at least: what a file costs is not its bytes, by which
    adaptive execution would leave all files to a few tasks."""
    rows = df.select(*[c.alias(k) for k, c in keys.items()], record.alias("_record"))
    dealt = rows.repartition(shared.partitions(df.sparkSession, df.count()), *keys)
    return dealt.groupBy(*keys).agg(F.collect_list("_record").alias(name))


def _listings(spark: SparkSession, d: str) -> str:
    """The cases as listing files of up to 500 records."""
    c = t.cases(spark, d)
    record = F.struct(F.col("citation").alias("lhc_citation"), F.concat(F.lit(" "), "title", F.lit(" on cyber crime")).alias("case_title"), F.col("date").alias("date_of_judgment"), F.col("court"), F.col("status").alias("winner"))
    return _one_per_file(_collected(c, {"file": F.floor(F.col("id") / 500)}, record, "judgments").drop("file"), shared.folder(spark))


@query("SELECT p_brand || ':Article:' || p_partkey AS id, p_brand AS document_title, CAST(p_partkey AS VARCHAR) AS article_number, p_name AS title, p_size AS page_number FROM part")
def s1_read_statutes(spark, d):
    """The parts of a brand as the sections of statute files, of up to 500 part keys each."""
    section = F.struct(F.col("p_partkey").cast("string").alias("section_number"), F.col("p_name").alias("title"), F.col("p_size").alias("page_number"))
    documents = _collected(table(spark, d, "part"), {"title": F.col("p_brand"), "n": F.floor(F.col("p_partkey") / 500)}, section, "sections").select(F.struct("title", "sections").alias("document"))
    got = structure.normalise_articles(tables.read_statutes(spark, _one_per_file(documents, shared.folder(spark))))
    return got.select("id", "document_title", "article_number", "title", "page_number")


_LISTED = with_views("cases") + " SELECT citation AS id, title || ' on cyber crime' AS title, date, court, status AS winner FROM cases"


@query(_LISTED)
def s3_read_cases(spark, d):
    raw = tables.read_cases(spark, _listings(spark, d))
    one = structure.normalise_case(raw, "Lahore High Court").select("id", "title", "date", "winner")
    return one.join(raw.select(F.col("lhc_citation").alias("id"), "court"), "id")


@query("SELECT p_brand AS title, count(*) AS articles FROM part GROUP BY p_brand UNION ALL SELECT 'not found', 1")
def s2_read_manifest(spark, d):
    """The statutes of a manifest, of up to 500 part keys each; it also names a file that is not there."""
    article = F.struct(F.col("p_partkey").cast("string").alias("article_number"), F.col("p_name").alias("title"))
    docs = _collected(table(spark, d, "part"), {"title": F.col("p_brand"), "n": F.floor(F.col("p_partkey") / 500)}, article, "articles")
    path, listed = _one_per_file(docs.select(F.struct("title", "articles").alias("document")), shared.folder(spark)), shared.folder(spark)
    names = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path).agg(F.sort_array(F.collect_list("path")).alias("statutes"))
    names.select(F.to_json(F.struct("statutes", F.lit(f"{path}/none.json").alias("appendix")))).write.text(listed)
    good, bad = tables.read_manifest(spark, listed)
    found = good.groupBy("title").agg(F.sum(F.size("articles")).alias("articles"))
    return found.union(bad.groupBy(F.col("reason").alias("title")).agg(F.count("*").alias("articles")))


@query(with_views("cases") + " SELECT citation AS id, title || ' on cyber crime' AS title, date, status AS winner FROM cases")
def t1_stream_cases(spark, d):
    """The listing files as a stream: classified, normalised, upserted."""
    out = shared.folder(spark)
    stream.stream_cases(spark, _listings(spark, d), out, shared.folder(spark)).awaitTermination()
    return stream.read_stream_table(spark, out).select("id", "title", "date", "winner")


@query("SELECT o_orderkey, o_orderpriority FROM orders")
def s10_write_table(spark, d):
    path = shared.folder(spark)
    tables.write_table(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), path, "o_orderpriority")
    return spark.read.parquet(path).select("o_orderkey", F.col("o_orderpriority").cast("string").alias("o_orderpriority"))


@query("SELECT o_orderkey AS page_id, CAST(o_custkey AS VARCHAR) AS no, o_orderpriority || ' & co' AS title, '/f/' || o_orderkey || '.pdf' AS link FROM orders")
def s11_parse_listing_html(spark, d):
    o = table(spark, d, "orders")
    page = F.concat(F.lit("<table id='list'><tr><th>No</th></tr><tr><td>short</td></tr><tr><td>"), "o_custkey", F.lit("</td><td> "), "o_orderpriority", F.lit("\n &amp; co</td><td><a href='/v'>v</a><a href='/f/"), "o_orderkey", F.lit(".pdf'>pdf</a></td></tr></table>"))
    got = html.parse_listing_html(o.select(F.col("o_orderkey").alias("page_id"), page.alias("html")), {"no": 0, "title": 1}, 3, "list", link_contains=".pdf")
    return got.select("page_id", "no", "title", "link")


@query("SELECT CAST(conv_id AS VARCHAR) AS session_id, count(*) AS turns, md5(string_agg(text, '|' ORDER BY turn)) AS digest FROM conversations GROUP BY 1")
def t2_stream_history(spark, d):
    """The conversations as a stream of files, appended by batches, and read as histories."""
    source, out = shared.folder(spark), shared.folder(spark)
    turns = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), F.col("text").alias("question"), F.lit(None).cast("string").alias("answer"), F.timestamp_seconds("turn").alias("ts"), F.lit(0.0).alias("duration"))
    turns.write.parquet(source)
    history.stream_history(spark.readStream.schema(turns.schema).parquet(source), out, shared.folder(spark)).awaitTermination()
    rows = history.history(history.read_turns(spark, out))
    return rows.select("session_id", F.size("history").cast("long").alias("turns"), F.md5(F.array_join(F.transform("history", lambda h: h["question"]), "|")).alias("digest"))


# --- layout and sections ---


@query("SELECT p_brand AS doc_id, p_size AS page, p_partkey / 10.0::DOUBLE AS top, p_name AS text FROM part")
def p9_lines_from_chars(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("doc_id"), F.col("p_size").alias("page"), (F.col("p_partkey") / 10).alias("top"), F.posexplode(F.split("p_name", "")).alias("x0", "text"))
    chars = p.where("text <> ''").withColumns({"x0": F.col("x0").cast("double"), "size": F.lit(9.0), "fontname": F.lit("Roman")})
    return structure.lines_from_chars(chars).select("doc_id", "page", "top", "text")


_LINES = "SELECT l_orderkey AS doc_id, l_linenumber AS page, l_partkey / 1.0::DOUBLE AS top, l_quantity AS avg_size, l_suppkey AS text FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_quantity, l_suppkey FROM lineitem)"


@query(f"""WITH l AS ({_LINES}), c AS (SELECT o_orderkey AS doc_id, min(150 + o_custkey % 40) + 1 AS cutoff FROM orders GROUP BY 1), b AS (SELECT doc_id, page, 0.85::DOUBLE * median(avg_size) AS least FROM l WHERE top < 0.7 * 200 GROUP BY 1, 2)
SELECT l.doc_id, l.page, l.top, l.text FROM l LEFT JOIN c ON c.doc_id = l.doc_id AND l.page = 1 LEFT JOIN b ON b.doc_id = l.doc_id AND b.page = l.page WHERE (cutoff IS NULL OR top < cutoff) AND NOT coalesce(avg_size > 0 AND avg_size < least, false)""")  # fmt: skip
def p10_filter_body_lines(spark, d):
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_suppkey").distinct()  # noqa: E741
    lines = l.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"), F.col("l_partkey").cast("double").alias("top"), F.col("l_quantity").alias("avg_size"), F.col("l_suppkey").alias("text"))
    y = (150 + F.col("o_custkey") % 40).cast("double")
    rules = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page"), y.alias("y0"), y.alias("y1"), F.lit(400.0).alias("width"), F.lit(0.5).alias("height"), F.lit("line").alias("kind"))
    pages = lines.select("doc_id", "page").union(rules.select("doc_id", "page")).distinct().withColumns({"width": F.lit(600.0), "height": F.lit(200.0)})
    return structure.filter_body_lines(lines, rules, pages).select("doc_id", "page", "top", "text")


_HEADED = "SELECT DISTINCT l_orderkey AS doc_id, l_linenumber AS line_no, CASE WHEN l_linenumber % 3 = 1 THEN l_linenumber || '. Title of ' || l_linenumber WHEN l_linenumber = 2 THEN 'CHAPTER ' || l_linenumber ELSE 'body text ' || l_linenumber END AS text FROM lineitem"


def _headed(spark, d):
    n = F.col("l_linenumber")
    line = F.when(n % 3 == 1, F.concat(n, F.lit(". Title of "), n)).when(n == 2, F.concat(F.lit("CHAPTER "), n)).otherwise(F.concat(F.lit("body text "), n))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), n.alias("line_no"), line.alias("text")).distinct().withColumn("bold_text", F.lit(""))


@query(f"""WITH h AS ({_HEADED}), x AS (SELECT *, lead(text) OVER w AS next FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
y AS (SELECT *, CASE WHEN text LIKE 'CHAPTER%' THEN CASE WHEN next IS NOT NULL AND next LIKE 'body%' THEN text || ' ' || next ELSE text END END AS c FROM x)
SELECT doc_id, line_no, text LIKE '%. Title%' AS is_head, CASE WHEN text LIKE '%. Title%' THEN 'Title of ' || line_no END AS title, last_value(c IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS chapter FROM y""")  # fmt: skip
def p11_detect_sections(spark, d):
    return structure.detect_sections(_headed(spark, d)).select("doc_id", "line_no", "is_head", "title", "chapter")


@query(f"""WITH h AS ({_HEADED}), s AS (SELECT *, sum((text LIKE '%. Title%')::INT) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS section FROM h)
SELECT doc_id, CAST(section AS BIGINT) AS section, CAST(min(line_no) AS VARCHAR) AS section_number, string_agg(CASE WHEN text LIKE '%. Title%' THEN 'Title of ' || line_no ELSE text END, chr(10) ORDER BY line_no) AS cleaned FROM s WHERE section > 0 GROUP BY 1, 2""")  # fmt: skip
def p12_slice_sections(spark, d):
    return structure.slice_sections(structure.detect_sections(_headed(spark, d))).select("doc_id", "section", "section_number", "cleaned")


_SPACES = "translate(text, chr(160) || chr(8239) || chr(8199) || chr(8201), '    ')"
_CLEANED = _SPACES
for _pattern, _to in ((r"(?mi)^\s*\d+\s*$", ""), (r"(?mi)^\s*Page\s+\d+\s+of\s+\d+\s*$", ""), (r"[ \t]+", " "), (r"[ \t]+\n", "\n"), (r"\n[ \t]+", "\n"), (r"\s*\*+\s*", " "), (r"\s+,", ","), (r"\s+\.", "."), (r"\s*\)\s*", ") "), (r"\s*\(\s*", " ("), (r"\n{3,}", "\n\n")):
    _CLEANED = f"regexp_replace({_CLEANED}, '{_pattern}', '{_to}', 'g')"


@query(f"SELECT doc_id, md5(regexp_replace({_CLEANED}, '^\\s+|\\s+$', '', 'g')) AS cleaned FROM documents")
def p13_clean_text(spark, d):
    """The given texts have no clause markers, so the steps that look around them change nothing in either form."""
    return table(spark, d, "documents").select("doc_id", F.md5(tx.clean_text("text")).alias("cleaned"))


def _penal(spark, d):
    """Lines of a penal code, one page per order: a head with its title above, a head within a line, one over two lines, a
    block that is no longer in force, and a number beyond the last section."""
    n, p = F.col("l_linenumber"), F.col("l_partkey").cast("string")
    said = {1: F.concat(F.lit("Title "), p), 2: F.concat(F.lit("[ 2"), F.lit(". Whoever "), p, F.lit(". More")), 3: F.concat(F.lit("ends here. 30. Within "), p), 4: F.concat(F.lit("40- Rescue "), p), 5: F.lit("B. of some"), 6: F.lit("The following was omitted"), 7: F.concat(F.lit("70. Gone "), p)}
    line = F.coalesce(*[F.when(n == k, v) for k, v in said.items()])
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))
    rows = rows.select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), n.alias("line_no"), line.alias("text"), (n * 10.0).alias("top"), F.lit(9.0).alias("avg_size"), (n == 1).cast("double").alias("bold_ratio"))
    return rows.withColumn("bold_text", F.when(F.col("line_no") == 1, F.col("text")).otherwise(""))


@query("""WITH l AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2), a AS (SELECT *, lead(n) OVER (PARTITION BY doc_id ORDER BY n) AS next, lag(n) OVER (PARTITION BY doc_id ORDER BY n) AS prev, lag(p) OVER (PARTITION BY doc_id ORDER BY n) AS above, max((n = 6)::INT) OVER (PARTITION BY doc_id) AS gone FROM l)
SELECT doc_id, CASE n WHEN 2 THEN '2' WHEN 3 THEN '30' WHEN 4 THEN '40-B' ELSE '70' END AS section_number, CASE WHEN prev = 1 AND n <> 3 THEN 'Title ' || above ELSE CASE n WHEN 2 THEN 'Whoever ' || p WHEN 3 THEN 'Within ' || p WHEN 4 THEN 'Rescue ' || p || ' of some' ELSE 'Gone ' || p END END AS title
FROM a WHERE n IN (2, 3) OR (n = 4 AND next = 5) OR (n = 7 AND gone = 0)""")  # fmt: skip
def p11_penal_code(spark, d):
    return structure.detect_sections(_penal(spark, d), "penal_code").where("is_head").select("doc_id", "section_number", "title")


@query("""SELECT DISTINCT l_partkey AS p, l_suppkey AS s, 'Main ' || l_partkey || '.' || chr(10) || '[ (1) ] Every ' || l_suppkey || ' person (a) one, two.' || chr(10) || chr(10) || 'Illustrations (b) three' AS cleaned FROM lineitem""")
def p13_penal_code(spark, d):
    text = F.concat(F.lit("Main "), "l_partkey", F.lit(" .  [(1)]  Every "), "l_suppkey", F.lit(" person ( a )one , two.\n 12 \nIllustrations\n(b) three"))
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), tx.clean_text(text, "penal_code").alias("cleaned")).distinct()


_MARKED = "l_shipdate::DATE || ' Main text. (1) First ' || l_quantity::INT || '; (2) second (a) alpha ' || l_suppkey || ' (b) beta'"


def _marked(spark, d):
    line = F.concat(F.to_date("l_shipdate").cast("string"), F.lit(" Main text. (1) First "), F.col("l_quantity").cast("int"), F.lit("; (2) second (a) alpha "), "l_suppkey", F.lit(" (b) beta"))
    return table(spark, d, "lineitem").select(line.alias("t")).distinct()


@query(f"SELECT DISTINCT {_MARKED} AS t, '1=First ' || l_quantity::INT || ';|2=second|a=alpha ' || l_suppkey || '|b=beta' AS clauses, '1=First ' || l_quantity::INT || ';|2=second (a) alpha ' || l_suppkey || ' (b) beta' AS numbered FROM lineitem")
def p14_extract_clauses(spark, d):
    said = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("=", x["id"], x["text"])), "|")
    return _marked(spark, d).select("t", said(tx.extract_clauses("t")).alias("clauses"), said(tx.extract_clauses("t", "number")).alias("numbered"))


@query(f"SELECT DISTINCT {_MARKED} AS t, '1=First ' || l_quantity::INT || ';:0|2=second:2' AS subsections, l_shipdate::DATE || ' Main text.' AS content FROM lineitem")
def p15_extract_subsections(spark, d):
    said = F.array_join(F.transform(tx.extract_subsections("t"), lambda x: F.concat(x["id"], F.lit("="), x["text"], F.lit(":"), F.size(x["clauses"]))), "|")
    return _marked(spark, d).select("t", said.alias("subsections"), tx.main_content("t").alias("content"))


@query(f"SELECT DISTINCT {_MARKED} AS t, 'Main text.' AS content FROM lineitem")
def p16_split_main_content(spark, d):
    return _marked(spark, d).select("t", tx.main_content("t", title=F.regexp_extract("t", r"^(\S+)", 1)).alias("content"))


@query(with_views("articles") + ", n AS (SELECT DISTINCT CAST(article_number AS INTEGER) AS n FROM articles) SELECT (SELECT count(*) FROM articles) AS articles, min(n) AS lowest, max(n) AS highest, 0::BIGINT AS with_clauses, 0::BIGINT AS clauses, (SELECT coalesce(string_agg(k::VARCHAR, ',' ORDER BY k), '') FROM range(0, 161) r(k) WHERE k NOT IN (FROM n)) AS missing FROM n")
def p20_validate_structure(spark, d):
    a = t.articles(spark, d).withColumn("clauses", F.array().cast("array<string>"))
    return structure.validate_structure(a, 0, 160).withColumn("missing", F.array_join("missing", ","))


# --- shapes ---


@query("SELECT p_partkey AS query_id, p_brand AS document, p_name AS title, CAST(p_partkey % 150 AS VARCHAR) AS article, '/api/pdf?file=' || p_brand || '.pdf#page=' || p_size || '&search=' || p_partkey % 150 AS pdf_link, round(p_retailprice / 7, 3) AS relevance_score FROM part")
def p23_shape_sources(spark, d):
    ranked = t.articles(spark, d).join(table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_retailprice") / 7).alias("final")), "id")
    none = F.lit(None).cast("string")
    ranked = ranked.withColumns({"query_id": F.col("id"), "rank": F.lit(1), "file": F.concat("document_title", F.lit(".pdf")), "chapter": none, "part": none})
    return structure.shape_sources(ranked).withColumn("relevance_score", F.round("relevance_score", 3)).select("query_id", "document", "title", "article", "pdf_link", "relevance_score")


@query(with_views("cases") + " SELECT id AS query_id, citation, title, court, date, left('About ' || title || repeat(' more', 60), 150) || '...' AS summary FROM cases")
def p23_shape_cases(spark, d):
    c = t.cases(spark, d).withColumns({"query_id": F.col("id"), "rank": F.lit(1), "summary": F.concat(F.lit("About "), "title", F.repeat(F.lit(" more"), 60)), "pdf_link": F.lit(None).cast("string"), "final": F.lit(None).cast("double")})
    return structure.shape_cases(c).select("query_id", "citation", "title", "court", "date", "summary")


@query("SELECT doc_id, md5(CASE WHEN text = '' THEN 'No answer generated.' ELSE trim(array_to_string(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13)) <> ''), chr(10)), ' ' || chr(9) || chr(10) || chr(13)) END) AS answer FROM documents")
def p24_format_answer(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(tx.format_answer("text")).alias("answer"))


@query("SELECT p_brand AS document, CAST(p_partkey AS VARCHAR) AS article, p_name AS title, round(p_retailprice / 7, 3) AS relevance_score, nullif(p_size, 0) AS page_number FROM part")
def p24_format_sources(spark, d):
    none = F.lit(" ")
    p = table(spark, d, "part").select(F.col("p_brand").alias("document"), F.col("p_partkey").cast("string").alias("article"), F.concat(F.lit(" "), "p_name").alias("title"), (F.col("p_retailprice") / 7).alias("relevance_score"), F.col("p_size").alias("page_number"), none.alias("pdf_link"), none.alias("source_file"))
    return structure.format_sources(p).select("document", "article", "title", "relevance_score", "page_number")


_NAMES = "SELECT DISTINCT lower(p_name) AS file FROM part"


@query(f"""WITH f AS ({_NAMES}), k AS (SELECT file, unnest(list_filter(list_distinct(regexp_extract_all(file, '[a-z0-9]+')), lambda x: len(x) > 1 AND x NOT IN ('the', 'of', 'and', 'an', 'for', 'to', 'in', 'on', 'act', 'rules', 'ordinance', 'code'))) AS token FROM f),
p AS (SELECT a.file AS title, b.file || '.pdf' AS file, count(*) AS n FROM k a JOIN k b USING (token) GROUP BY 1, 2 HAVING count(*) >= 2), r AS (SELECT title, arg_min(file, (-n, file)) AS file FROM p GROUP BY 1)
SELECT upper(f.file) AS title, r.file FROM f LEFT JOIN r ON r.title = f.file""")  # fmt: skip
def r12_match_titles_to_files(spark, d):
    p = table(spark, d, "part").select(F.lower("p_name").alias("n")).distinct()
    return scorers.match_titles_to_files(p.select(F.upper("n").alias("title")), p.select(F.concat("n", F.lit(".pdf")).alias("file")))


# --- encoders, scorers, samples ---


@query()
def v1_embed(spark, d):
    """A user's encoder over whole texts; its numbers are tested against the encoder itself."""
    rows = vectors.embed(table(spark, d, "documents").select("doc_id", "text"), "text")
    return rows.select("doc_id", F.size("embedding").alias("size"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x), 3).alias("norm"))


@query()
def v5_relevant_clauses(spark, d):
    """Clauses (the suppliers of a part) nearest to a question (the part's name); tested on hand-made rows."""
    part, lines = table(spark, d, "part"), table(spark, d, "lineitem")
    clauses = lines.select(F.concat_ws(":", "l_partkey", "l_suppkey").alias("id"), F.col("l_partkey").alias("article_id"), F.col("l_suppkey").cast("string").alias("clause_number"), F.concat_ws(" ", F.lit("supplier"), "l_suppkey", "l_returnflag").alias("text")).dropDuplicates(["id"])
    subs = lines.select(F.concat_ws(":", "l_partkey", "l_suppkey").alias("clause_id"), F.col("l_linestatus").alias("sub_clause_number"), F.col("l_linestatus").alias("text")).distinct()
    questions = part.select(F.col("p_partkey").alias("query_id"), F.concat_ws(" ", F.lit("supplier"), "p_partkey").alias("q"))
    asked = vectors.embed(questions.repartition(shared.partitions(spark, part.count()), "query_id"), "q")  # a file is few tasks
    return vectors.relevant_clauses(part.select(F.col("p_partkey").alias("query_id"), F.col("p_partkey").alias("id"), F.col("p_name").alias("content")), clauses, subs, asked).select("query_id", "article_id", "rank")


def vowels(texts):
    """An encoder that SQL can express: how often each vowel stands in a text, and its length."""
    import numpy as np

    return np.array([[t.count(c) for c in "aeiou"] + [len(t)] for t in texts], np.float32).reshape(-1, 6)


@query("SELECT doc_id, " + ", ".join(f"(length(text) - length(replace(text, '{c}', '')))::FLOAT AS {c}" for c in "aeiou") + ", length(text)::FLOAT AS size FROM documents")
def v1_embed_vowels(spark, d):
    """Every text's vector; equal texts are encoded once, by a model that a worker loads once."""
    rows = vectors.embed(table(spark, d, "documents").select("doc_id", "text"), "text", factory=lambda: vowels, once=True)
    return rows.select("doc_id", *[F.get("embedding", F.lit(k)).alias(c) for k, c in enumerate([*"aeiou", "size"])])


def numbers(texts):
    """An encoder that SQL can express: the direction of (1000, the first number of a text)."""
    import re

    import numpy as np

    return np.array([[1000.0, float(m[0]) if (m := re.search("[0-9]+", t)) else 0.0] for t in texts], np.float32).reshape(-1, 2)


_CLAUSES = """WITH c AS (SELECT DISTINCT l_partkey AS article_id, l_suppkey AS s, 'supplier ' || l_suppkey AS t, l_partkey || ':' || l_suppkey AS k FROM lineitem), u AS (SELECT k, string_agg(x, ' ' ORDER BY x) AS more FROM (SELECT DISTINCT l_partkey || ':' || l_suppkey AS k, l_linestatus AS x FROM lineitem) GROUP BY k),
f AS (SELECT p_partkey AS article_id, coalesce(s, 0) AS s, coalesce(t || ' ' || more, p_name) AS text FROM part LEFT JOIN c ON article_id = p_partkey LEFT JOIN u USING (k)),
scored AS (SELECT article_id, text, list_cosine_similarity([1000.0::DOUBLE, s], [1000.0::DOUBLE, article_id % 300]) AS similarity FROM f),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY round(similarity, 12) DESC, text) AS rank FROM scored) WHERE rank <= 3)"""


def _relevant(spark, d, by):
    """The clauses of each part (its suppliers) nearest to a question with the number of the part."""
    part, lines = table(spark, d, "part"), table(spark, d, "lineitem")
    key = F.concat_ws(":", "l_partkey", "l_suppkey")
    clauses = lines.select(key.alias("id"), F.col("l_partkey").alias("article_id"), F.col("l_suppkey").cast("string").alias("clause_number"), F.concat_ws(" ", F.lit("supplier"), "l_suppkey").alias("text")).distinct()
    subs = lines.select(key.alias("clause_id"), F.col("l_linestatus").alias("sub_clause_number"), F.col("l_linestatus").alias("text")).distinct()
    asked = part.select(by.alias("query_id"), F.array(F.lit(1000.0), (F.col("p_partkey") % 300).cast("double")).cast("array<float>").alias("embedding"))
    return vectors.relevant_clauses(part.select(by.alias("query_id"), F.col("p_partkey").alias("id"), F.col("p_name").alias("content")), clauses, subs, asked, encoder=numbers, digits=12)


@query(_CLAUSES + " SELECT article_id AS query_id, article_id, text, round(similarity, 6) AS similarity, rank FROM best")
def v5_numbered_clauses(spark, d):
    return _relevant(spark, d, F.col("p_partkey")).withColumn("similarity", F.round("similarity", 6))


@query(_CLAUSES + """, l AS (SELECT article_id, string_agg('- ' || text, chr(10) ORDER BY rank) AS lines FROM best GROUP BY article_id)
SELECT p_partkey AS query_id, '[Statutory Law 1]' || chr(10) || 'Document: ' || p_brand || chr(10) || 'Article ' || p_partkey % 150 || ': ' || p_name || chr(10) || 'Relevant Clauses:' || chr(10) || lines || chr(10) || chr(10) ||
  '[Case Law 1]' || chr(10) || 'Citation: ' || p_partkey || chr(10) || 'Court: ' || p_type || chr(10) || 'Date: N/A' || chr(10) || 'Title: ' || p_name || chr(10) || CASE WHEN p_size % 2 = 0 THEN 'Judgment Text:' || chr(10) || p_brand ELSE 'Summary: ' || p_type END || chr(10) || 'Full Judgment: /' || p_partkey || '.pdf' AS context
FROM part JOIN l ON article_id = p_partkey""")  # fmt: skip
def q11_clause_context(spark, d):
    """A statute by its nearest clauses and a case, for each part."""
    part = table(spark, d, "part")
    kinds = part.select(F.col("p_partkey").alias("query_id"), F.col("p_partkey").alias("id"), F.explode(F.array(F.lit("article"), F.lit("case"))).alias("type"), F.lit(1).alias("rank"))
    cases = part.select(F.col("p_partkey").alias("id"), F.col("p_partkey").cast("string").alias("citation"), F.col("p_type").alias("court"), F.lit(None).cast("string").alias("date"), F.col("p_name").alias("title"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise("[ERROR: none]").alias("pdf_data"), F.col("p_type").alias("summary"), F.concat(F.lit("/"), "p_partkey", F.lit(".pdf")).alias("pdf_link"))
    laws = t.articles(spark, d).withColumn("content", F.col("title"))
    return retrieval.build_context(retrieval.context_blocks(kinds, laws, cases, _relevant(spark, d, F.col("p_partkey"))))


@query("""WITH c AS (SELECT l_orderkey AS query_id, l_partkey AS id, max(l_discount) AS current FROM lineitem GROUP BY 1, 2), s AS (SELECT query_id, id, 0.3::DOUBLE * current + 0.7::DOUBLE * (1 / (1 + exp(-(len(p_name) % 5 - 2.0::DOUBLE)))) AS final FROM c JOIN part ON p_partkey = id)
SELECT query_id, id, round(final, 8) AS final, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(final, 8) DESC, id) AS rank FROM s WHERE final >= 0.2) WHERE rank <= 5""")  # fmt: skip
def q5_rerank(spark, d):
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("id")).agg(F.max("l_discount").alias("current")).withColumn("rank", F.lit(1))
    texts = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))
    asked = table(spark, d, "orders").select(F.col("o_orderkey").alias("query_id"), F.lit("?").alias("text"))
    return retrieval.rerank(rows, 5, scorer=lambda q, t: [len(x) % 5 - 2.0 for x in t], queries=asked, texts=texts, digits=8).select("query_id", "id", "final", "rank")


_SHUFFLED = "SELECT id, row_number() OVER (ORDER BY md5(id || ':42'), id) - 1 AS place FROM cases"


@query(with_views("cases") + _SHUFFLED)
def d3_sample_cases(spark, d):
    """A seeded shuffle of all cases with their places."""
    return datasets.sample_cases(t.cases(spark, d), "id").select("id", "place")


@query(with_views("cases") + f"SELECT * FROM ({_SHUFFLED}) WHERE place < 100")
def d3_sample_of_cases(spark, d):
    """The seeded sample of 100."""
    return datasets.sample_cases(t.cases(spark, d), "id", limit=100).select("id", "place")


@query("SELECT l_orderkey AS batch, l_linenumber AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, o_custkey HAVING count(*) = 1 + o_custkey % 7)")
def d4_accepted_batches(spark, d):
    """Orders as batches that ask for 1 to 7 results; those with another number of lines are rejected whole."""
    asked = table(spark, d, "orders").select(F.col("o_orderkey").alias("batch"), F.explode(F.sequence(F.lit(0), F.col("o_custkey") % 7)).alias("i"))
    return datasets.accepted_batches(asked, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("batch"), F.col("l_linenumber").alias("n")))


@query("SELECT p_brand AS document_title, CAST(p_partkey % 150 AS VARCHAR) AS number, p_name AS title FROM part")
def d8_statute_projection(spark, d):
    a = t.articles(spark, d).withColumns({"content": F.col("title"), "clauses": F.array().cast("array<string>")})
    return datasets.statute_projection(a).select("document_title", F.col("section.section").alias("number"), F.col("section.title").alias("title"))


@query("SELECT doc_id, md5(left(text, 1000)) AS text FROM documents")
def d8_trim_case(spark, d):
    return datasets.trim_case(table(spark, d, "documents").select("doc_id", F.col("text").alias("pdf_data")), 1000).select("doc_id", F.md5("pdf_data").alias("text"))
