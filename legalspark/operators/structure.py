"""Layout to lines, lines to sections, sections to articles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions.text import blank_to_null, clean_text, col, extract_clauses, extract_subsections, first_text, main_content, make_id, strip, text

# --- nested statutes to tables ---


def normalise_articles(docs: DataFrame, subsections_as_clauses: bool = False) -> DataFrame:
    """articles(id, document_title, article_number, title, content, page_number, part, chapter, clauses) from read_statutes."""
    a = docs.select(F.col("title").alias("document_title"), F.posexplode("articles").alias("position", "a"))
    clauses = F.coalesce("a.clauses", "a.subsections") if subsections_as_clauses else F.col("a.clauses")
    number = first_text("a.article_number", "a.section_number")
    return a.select(
        F.concat("document_title", F.lit(":Article:"), number).alias("id"), "document_title", number.alias("article_number"), text("a.title").alias("title"), text("a.content").alias("content"),
        "a.page_number", "a.part", "a.chapter", clauses.alias("clauses"), "position",
    )


def explode_clauses(articles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clauses(id, article_id, clause_number, text), subclauses(id, clause_id, sub_clause_number, text))."""
    c = articles.select(F.col("id").alias("article_id"), F.explode("clauses").alias("c"))
    c = c.select("article_id", F.coalesce("c.id", F.lit("")).alias("clause_number"), text("c.text").alias("text"), F.coalesce("c.clauses", "c.sub_clauses").alias("sub")).withColumn("id", F.concat("article_id", F.lit(":Clause:"), "clause_number"))
    s = c.select(F.col("id").alias("clause_id"), F.explode("sub").alias("s")).select("clause_id", F.coalesce("s.id", F.lit("")).alias("sub_clause_number"), text("s.text").alias("text"))
    return c.select("id", "article_id", "clause_number", "text"), s.select(F.concat("clause_id", F.lit(":SubClause:"), "sub_clause_number").alias("id"), "clause_id", "sub_clause_number", "text")


# --- listings to cases ---


def normalise_case(df: DataFrame, court: str, carried: Sequence[str] = ()) -> DataFrame:
    """One record per row of a court's listing; a court without a form of its own takes that of Lahore. Fields that df lacks
    are empty. case ids are made safe, and an id of underscores only becomes a hash of title and number. carried columns come last."""
    return df.select(*[c.alias(k) for k, c in _case_columns(df, court).items()], *carried)


def normalise_cases(df: DataFrame, courts: Sequence[str], carried: Sequence[str] = ()) -> DataFrame:
    """normalise_case for a table of several courts, each row by its column court (one that is not among courts is an Unknown
    Court's), in one pass over the rows."""
    out = _case_columns(df, "Unknown Court")
    for court in courts:
        own = _case_columns(df, court)
        out = {k: F.when(F.col("court") == court, own[k]).otherwise(c) for k, c in out.items()}
    return df.select(*[c.alias(k) for k, c in out.items()], *carried)


def _case_columns(df: DataFrame, court: str) -> dict[str, Column]:
    have = {f.name: f.dataType for f in df.schema.fields}
    f = lambda *names: first_text(*[n for n in names if n in have]) if any(n in have for n in names) else F.lit("")
    none, no_words = F.lit(None).cast("string"), F.array().cast("array<string>")
    title = f("parties") if court == "Sindh High Court" else f("case_title")
    out: dict[str, Column] = {"title": title, "case_no": F.lit(""), "judge": F.lit(""), "citation": F.lit(""), "discussed_laws": F.lit(""), "keywords": no_words, "reason": none, "profile": none, "triggers": none}
    short = F.substring(title, 1, 40)
    if court == "Islamabad High Court":
        number, laws = f("case_no"), f("discussed_laws")
        out |= {"case_no": number, "date": f("order_date"), "judge": f("before", "author"), "pdf_link": f("download_link", "judgment_link"), "discussed_laws": laws}
        out |= {"summary": first_text(F.concat_ws(" ", f("description"), laws), title), "raw": F.concat(F.lit("IHC_"), first_text(number, f("s_no"), short))}
    elif court == "Peshawar High Court":
        citation, remarks = f("phc_neutral_citation", "other_citation"), f("remarks")
        out |= {"date": f("decision_date"), "pdf_link": f("judgment_link"), "citation": citation, "summary": F.when(remarks != "", F.substring(remarks, 1, 500)).otherwise(title)}
        out |= {"raw": F.concat(F.lit("PHC_"), first_text(citation, f("s_no"), short))}
    elif court == "Sindh High Court":
        excerpt = f("excerpt")
        out |= {"case_no": f("case_no"), "date": f("date"), "pdf_link": f("pdf_link"), "citation": f("citation"), "summary": F.when(excerpt != "", F.substring(excerpt, 1, 500)).otherwise(title)}
        out |= {"keywords": F.coalesce("cyber_keywords_matched", no_words) if "cyber_keywords_matched" in have else no_words, "raw": F.concat(F.lit("SHC_"), f("record_id", "citation", "case_no", "sr_no"))}
    else:
        number, citation = f("writ_petition", "case_number"), f("lhc_citation")
        fallback = F.regexp_replace(F.concat(title, F.lit(". "), number), r"^[. ]+|[. ]+$", "")
        out |= {"case_no": number, "date": f("date_of_judgment", "order_date"), "judge": f("hon_judge", "judges"), "pdf_link": f("pdf_link"), "citation": citation, "summary": first_text(f("matter"), fallback)}
        out |= {"raw": first_text(citation, F.concat(F.lit("LHC_"), first_text(number, f("sr_no"), short)))}
        if "cyber_law_match" in have:
            t = F.col("cyber_law_match.triggers")
            out |= {"profile": F.col("cyber_law_match.filter_profile"), "triggers": F.when(F.size(t) > 0, F.to_json(t)), "keywords": F.coalesce(F.transform(t, lambda x: F.coalesce(x["matched"], F.lit(""))), no_words)}
        if "cyber_law_reason" in have:
            out["reason"] = F.col("cyber_law_reason")
    safe = make_id(out["raw"])
    case_id = F.when(F.regexp_replace(safe, "_", "") == "", F.concat(F.lit("case_"), F.abs(F.xxhash64(title, out["case_no"]) % F.lit(10**10)))).otherwise(safe)
    return {
        "id": case_id, "citation": out["citation"], "title": title, "case_no": out["case_no"], "date": out["date"], "judge": out["judge"], "court": F.lit(court),
        "pdf_link": out["pdf_link"], "summary": out["summary"], "pdf_data": f("pdf_data"), "discussed_laws": out["discussed_laws"],
        "cyber_keywords_json": F.when(F.size(out["keywords"]) > 0, F.to_json(out["keywords"])), "cyber_law_reason": out["reason"], "cyber_law_filter_profile": out["profile"],
        "cyber_law_triggers_json": out["triggers"], "winner": F.nullif(f("winner"), F.lit("")),
    }


def normalise_combined(df: DataFrame) -> DataFrame:
    """The combined file's shape: parties is the title, excerpt the summary, and the citation makes the id."""
    have = set(df.columns)
    f = lambda n: text(n) if n in have else F.lit("")
    return df.select(
        make_id(first_text(f("citation"), f("case_no"), f("parties"))).alias("id"), f("citation").alias("citation"), first_text(f("parties"), f("citation")).alias("title"), f("case_no").alias("case_no"),
        f("date").alias("date"), f("judge").alias("judge"), first_text(f("court"), F.lit("Unknown Court")).alias("court"), f("pdf_link").alias("pdf_link"), f("excerpt").alias("summary"), f("pdf_data").alias("pdf_data"),
    )


# --- layout ---


def lines_from_chars(chars: DataFrame) -> DataFrame:
    """lines(doc_id, page, line_no, top, text, avg_size, bold_text, bold_ratio): characters of a page with the same rounded
    top, from left to right. One shuffle; a group is one line."""
    rows = chars.withColumn("top", F.round("top", 1))
    ordered = F.sort_array(F.collect_list(F.struct("x0", "text", "bold")))
    bold = F.lower(F.coalesce("fontname", F.lit(""))).contains("bold")
    lines = rows.withColumn("bold", bold).groupBy("doc_id", "page", "top").agg(ordered.alias("c"), F.avg("size").alias("avg_size"))
    joined = lambda c: F.array_join(F.transform(c, lambda x: x["text"]), "")
    bolds = F.filter("c", lambda x: x["bold"])
    lines = lines.select("doc_id", "page", "top", strip(joined(F.col("c"))).alias("text"), "avg_size", strip(joined(bolds)).alias("bold_text"), (F.size(bolds) / F.size("c")).alias("bold_ratio"))
    return lines.withColumn("line_no", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("top")))


def filter_body_lines(lines: DataFrame, rules: DataFrame, pages: DataFrame) -> DataFrame:
    """lines without footnotes and small print: those at or below the topmost thin wide rule of the lower part of a page,
    and those smaller than 0.85 of the median size in its top 70 %."""
    thin = F.when(F.col("kind") == "rect", F.col("height") <= 1.2).otherwise(F.col("height") <= 1.0)
    r = rules.join(pages.select("doc_id", "page", F.col("width").alias("_w"), F.col("height").alias("_h")), ["doc_id", "page"]).where(thin & (F.col("width") >= F.col("_w") / 2) & (F.col("y0") > 0.55 * F.col("_h")))
    cut = r.groupBy("doc_id", "page").agg((F.min("y0") + 1).alias("cutoff"))
    body = lines.join(pages.select("doc_id", "page", F.col("height").alias("_h")), ["doc_id", "page"]).where(F.col("top") < 0.7 * F.col("_h")).groupBy("doc_id", "page").agg((0.85 * F.median("avg_size")).alias("least"))
    rows = lines.join(cut, ["doc_id", "page"], "left").join(body, ["doc_id", "page"], "left")
    small = (F.col("avg_size") > 0) & (F.col("avg_size") < F.col("least"))
    return rows.where((F.col("cutoff").isNull() | (F.col("top") < F.col("cutoff"))) & ~F.coalesce(small, F.lit(False))).drop("cutoff", "least")


#: Fixed: headers by profile. Group 1 is the number, group 2 the text behind it.
HEADERS = {
    "act": r"^\s*(\d+[A-Z]*)\.\s+(.+)$",
    "constitution": r"^\s*(\d+[A-Z]*)\.\s*(.*)$",
    "penal_code": r"^\s*(?:\[\s*){0,3}\(?\s*(\d+(?:-?[A-Z]+)?)\s*\.\s*(.*)$",
}
CHAPTER, PART = r"(?i)^\s*(CHAPTER[\s\-]+[A-Z0-9]+)\s*$", r"(?i)^\s*(PART\s+[IVXLC0-9]+)\b.*$"
#: Fixed: the penal code's last section, the start of a block of sections that are no longer in force, heads within lines.
LAST_SECTION, OMITTED, WITHIN = 511, r"(?i)following was omitted|following was repealed", r"(?<=[.!?])\s+(?=\d+\.)"
#: Fixed: lines looked at above a head, least share of bold for a title there and for a strong one, how much larger its
#: letters are, greatest distances to the head and to the next line, verbs that mark a sentence.
TITLE_LINES, BOLD, STRONG, LARGER, FAR, APART = 4, 0.18, 0.22, 1.08, 90, 35
VERBS = r"(?i)\b(shall|may|be|is|are|was|were|has|have|had|will)\b"


def join_split_heads(lines: DataFrame) -> DataFrame:
    """Lines where a header's number and letter stand apart (`225-`, or `225- Escape`, then `A. title`) as one line."""
    w = Window.partitionBy("doc_id").orderBy("page", "line_no")
    number, behind, letter = r"^\s*\[?(\d+)\s*-(?:\s+(.*))?$", r"^\s*([A-Z])\s*\.\s*(.*)$", F.lead("text").over(w)
    split = F.coalesce(F.col("text").rlike(number) & letter.rlike(behind) & (F.lead("page").over(w) == F.col("page")), F.lit(False))
    rows = lines.withColumns({"_split": split, "_next": letter, "_after": F.coalesce(F.lag(split).over(w), F.lit(False))})
    title = F.concat_ws(" ", *[F.nullif(strip(t), F.lit("")) for t in (F.regexp_extract("text", number, 2), F.regexp_extract("_next", behind, 2))])
    whole = F.concat(F.regexp_extract("text", number, 1), F.lit("-"), F.regexp_extract("_next", behind, 1), F.lit(". "), title)
    return rows.where(~F.col("_after")).withColumn("text", F.when(F.col("_split"), whole).otherwise(F.col("text"))).drop("_split", "_next", "_after")


def split_inner_heads(lines: DataFrame) -> DataFrame:
    """Lines with a head after the end of a sentence as two lines, the second of which starts with the head; line_no counts
    anew in each page. Both lines keep the other columns of the one."""
    within = ~F.col("text").rlike(HEADERS["penal_code"]) & F.col("text").rlike(r"\.\s+\d+\.\s")
    parts = F.when(within, F.split("text", WITHIN, 2)).otherwise(F.array("text"))
    rows = lines.select(*[c for c in lines.columns if c != "text"], F.posexplode(parts).alias("_part", "text"))
    w = Window.partitionBy("doc_id", "page").orderBy("line_no", "_part")
    return rows.withColumn("line_no", F.row_number().over(w)).select(lines.columns)


def title_above(page: WindowSpec, profile: str) -> Column:
    """Titles in up to four bold lines right above a line of the same page, empty if there are none.

    Short text in brackets passes without being bold. In a penal code lines in capitals are passed over, with what stands
    above them until the next title line.
    """
    t, penal = text("text"), profile == "penal_code"
    letters = lambda kind: F.length(F.regexp_replace(t, rf"\P{{{kind}}}", ""))
    caps = F.coalesce(letters("Lu") / F.nullif(letters("L"), F.lit(0)), F.lit(0.0))
    words = F.regexp_extract_all(t, F.lit("([A-Za-z][A-Za-z'-]*)"))
    named = F.filter(words, lambda x: x.rlike("^([A-Z][A-Z'-]*|[A-Z][a-z'-]*[a-z][a-z'-]*)$"))
    aside = (F.length(t) <= 60) & t.rlike(r"^\([^\d]*\)$")
    fits = F.length(t).between(3, 130) & ~t.rlike(r"^(PART |CHAPTER |[\[\-0-9])")
    bold = F.coalesce("bold_ratio", F.lit(0.0))
    strong = (bold >= STRONG) | (F.size(named) >= 0.6 * F.greatest(F.size(words), F.lit(1)))
    strong = strong if penal else strong | (caps >= 0.6)
    plain = F.size(words).between(2, 18) & ~t.rlike(r"[.!?;:]$") & ~t.rlike(VERBS)
    said = F.when(aside, t).otherwise(first_text("bold_text", t))
    line = F.struct(F.coalesce("top", F.lit(0.0)).cast("double").alias("top"), F.col("avg_size").alias("size"), (F.lit(penal) & (caps >= 0.85)).alias("caps"), aside.alias("aside"), (fits & (bold >= BOLD)).alias("fits"), (strong | plain).alias("good"), said.alias("said"))
    above = F.reverse(F.collect_list(line).over(page.rowsBetween(-TITLE_LINES, -1)))
    start = F.struct(F.lit(False).alias("done"), F.lit(False).alias("caps"), F.lit(None).cast("double").alias("top"), F.lit("").alias("said"))

    def step(s: Column, x: Column) -> Column:
        state = lambda done, caps, top, said: F.struct(done.alias("done"), caps.alias("caps"), top.alias("top"), said.alias("said"))
        titled = x["aside"] | (x["fits"] & (x["good"] | F.coalesce(x["size"] >= F.col("avg_size") * LARGER, F.lit(False))))
        far = (F.coalesce("top", F.lit(0.0)) - x["top"] > FAR) | F.coalesce(s["top"] - x["top"] > APART, F.lit(False))
        on = F.when(x["caps"], state(F.lit(False), F.lit(True), s["top"], s["said"])).when(~titled, state(~s["caps"], s["caps"], s["top"], s["said"]))
        on = on.when(far, state(F.lit(True), s["caps"], s["top"], s["said"])).otherwise(state(F.lit(False), F.lit(False), x["top"], F.concat_ws(" ", x["said"], F.nullif(s["said"], F.lit("")))))
        return F.when(s["done"], s).otherwise(on)

    return strip(F.regexp_replace(F.aggregate(above, start, step, lambda s: s["said"]), r"[\s\\]+", " "))


def detect_sections(lines: DataFrame, profile: str = "act", first_page: int = 1) -> DataFrame:
    """lines with is_head, section_number, title, and the current chapter and part. Headers on pages before first_page (the
    contents) do not count. Windows go by document, in the order of page and line.

    In an act the title is the bold part of the header's line, else the text before its dash. In the other profiles it is in
    the bold lines above, where lines have top, avg_size, bold_ratio and bold_text, else the first sentence behind the number.
    In a penal code, headers may stand within lines (line_no then counts anew), those after a note of omitted or repealed
    sections do not count until the page or part ends, nor do numbers beyond the last section.
    """
    penal = profile == "penal_code"
    lines = split_inner_heads(join_split_heads(lines)) if penal else lines
    w = Window.partitionBy("doc_id").orderBy("page", "line_no")
    t, head = F.coalesce("text", F.lit("")), HEADERS[profile]
    rows = lines.withColumns({"_t": t, "_following": F.lead("text").over(w)})
    chapter_id = F.nullif(F.regexp_extract("_t", CHAPTER, 1), F.lit(""))
    titled = ~F.col("_following").rlike(head) & ~F.col("_following").rlike(CHAPTER) & (text("_following") != "")
    named = F.when(titled, F.concat_ws(" ", chapter_id, strip("_following"))).otherwise(chapter_id)
    rows = rows.withColumns({"_c": F.when(chapter_id.isNotNull(), named), "_p": F.nullif(F.regexp_extract("_t", PART, 1), F.lit(""))})
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    page = Window.partitionBy("doc_id", "page").orderBy("line_no")
    is_head = F.col("_t").rlike(head) & (F.col("page") >= first_page)
    if penal:
        mark = F.when(F.col("_t").rlike(OMITTED), True).when(text("_t").startswith("PART "), False)
        digits = F.regexp_extract("_t", head, 1)
        is_head &= ~F.coalesce(F.last(mark, True).over(page.rowsBetween(Window.unboundedPreceding, 0)), F.lit(False))
        is_head &= ~F.coalesce(F.regexp_replace(digits, r"\D", "").try_cast("bigint") > LAST_SECTION, F.lit(False))
    behind = F.regexp_extract("_t", head, 2)
    if profile == "act":
        bold = F.regexp_replace(text("bold_text"), r"^\s*\[?\d+(?:-?[A-Z]+)?\.\s*", "") if "bold_text" in lines.columns else F.lit("")
        title = F.when(bold != "", strip(F.get(F.split(bold, "—"), F.lit(0)))).otherwise(strip(F.substring(F.get(F.split(behind, "—"), F.lit(0)), 1, 120)))
    else:
        sentence = strip(F.get(F.split(behind, r"\."), F.lit(0)))
        cut = F.when(F.length(sentence) > 100, F.concat(F.substring(sentence, 1, 100), F.lit("..."))).otherwise(sentence)
        above = title_above(page, profile) if {"top", "avg_size", "bold_ratio", "bold_text"} <= set(lines.columns) else F.lit("")
        title = first_text(above, F.when((F.length(sentence) < 200) & ~sentence.startswith("("), sentence).otherwise(cut))
    rows = rows.withColumns({"chapter": F.last("_c", True).over(running), "part": F.last("_p", True).over(running), "is_head": is_head, "_title": title})
    return rows.withColumns({"section_number": F.when(F.col("is_head"), F.regexp_extract("_t", head, 1)), "title": F.when(F.col("is_head"), F.col("_title"))}).drop("_t", "_following", "_c", "_p", "_title")


def slice_sections(detected: DataFrame, profile: str = "act") -> DataFrame:
    """One row per section: its lines up to the next header, over pages, cleaned, with clauses and main content."""
    w = Window.partitionBy("doc_id").orderBy("page", "line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = detected.withColumn("section", F.sum(F.col("is_head").cast("int")).over(w)).where("section > 0")
    piece = F.when(F.col("is_head"), F.regexp_extract("text", HEADERS[profile], 2)).otherwise(F.col("text"))
    first = lambda c: F.min_by(c, F.struct("page", "line_no"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "line_no", piece.alias("piece")))), lambda x: x["piece"]), "\n")
    out = rows.groupBy("doc_id", "section").agg(*[first(c).alias(c) for c in ("section_number", "title", "chapter", "part")], F.min("page").alias("page_number"), body.alias("raw"))
    variant = {"act": "flat", "constitution": "numeric", "penal_code": "mixed"}[profile]
    out = out.withColumn("cleaned", clean_text("raw", profile))
    return out.withColumns({"clauses": extract_clauses("cleaned", variant), "subsections": extract_subsections("cleaned"), "content": main_content("cleaned", variant, F.col("title"))}).drop("raw")


# --- articles ---


def order_key(number: Column | str) -> Column:
    """(digits as a number, letters)."""
    n = F.coalesce(col(number), F.lit(""))
    return F.struct(F.coalesce(F.regexp_extract(n, r"(\d+)", 1).try_cast("int"), F.lit(0)).alias("n"), F.upper(F.regexp_replace(n, "[^A-Za-z]", "")).alias("letters"))


def order_articles(df: DataFrame) -> DataFrame:
    return df.withColumn("_k", order_key("article_number")).orderBy("_k.n", "_k.letters", "article_number").drop("_k")


def article_key(number: Column | str) -> Column:
    return F.upper(F.regexp_replace(F.coalesce(col(number), F.lit("")), r"(?U)[^\p{L}\p{N}]", ""))


def apply_amendments(articles: DataFrame, amendments: DataFrame) -> DataFrame:
    """The first article of each key, with the amendments of its key as further clauses schedule-amendment-k, in order.

    articles: article_number, position, clauses(id, text); amendments: article_number, position, content.
    """
    first = articles.withColumn("_k", article_key("article_number")).where("_k <> ''").withColumn("_n", F.row_number().over(Window.partitionBy("_k").orderBy("position"))).where("_n = 1").drop("_n")
    new = amendments.select(article_key("article_number").alias("_k"), "position", text("content").alias("content")).where("content <> ''")
    new = new.groupBy("_k").agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "content"))), lambda x: x["content"]).alias("_new"))
    none = F.array().cast("array<struct<id:string,text:string>>")
    own = F.coalesce(F.transform("clauses", lambda c: F.struct(c["id"].alias("id"), c["text"].alias("text"))), none)
    before = F.size(F.filter(own, lambda c: F.startswith(c["id"], F.lit("schedule-amendment-"))))
    added = F.transform(F.coalesce("_new", F.array().cast("array<string>")), lambda c, i: F.struct(F.concat(F.lit("schedule-amendment-"), before + i + 1).alias("id"), c.alias("text")))
    return first.join(new, "_k", "left").withColumn("clauses", F.concat(own, added)).drop("_k", "_new")


def section_context(articles: DataFrame, markers: DataFrame) -> DataFrame:
    """As-of: the latest chapter and part marker before the (page, y) of each article. articles: doc_id, id, page, y;
    markers: doc_id, page, y, kind (chapter or part), label. One sort per document, no range join."""
    a = articles.select("doc_id", "page", "y", "id", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("label"), F.lit(1).alias("_o"))
    m = markers.select("doc_id", "page", "y", F.lit(None).cast(articles.schema["id"].dataType).alias("id"), "kind", "label", F.lit(0).alias("_o"))
    w = Window.partitionBy("doc_id").orderBy("page", "y", "_o").rowsBetween(Window.unboundedPreceding, 0)
    latest = lambda kind: F.last(F.when(F.col("kind") == kind, F.col("label")), True).over(w).alias(kind)
    return a.union(m).select("*", latest("chapter"), latest("part")).where("_o = 1").select("doc_id", "id", "page", "y", "chapter", "part")


def validate_structure(articles: DataFrame, lo: int, hi: int) -> DataFrame:
    """One row: articles, lowest, highest, with_clauses, clauses, missing (numbers from lo to hi that no article has)."""
    n = F.regexp_extract(F.coalesce("article_number", F.lit("")), r"(\d+)", 1).try_cast("int")
    size = F.coalesce(F.size("clauses"), F.lit(0))
    stats = articles.agg(F.count("*").alias("articles"), F.min(n).alias("lowest"), F.max(n).alias("highest"), F.count_if(size > 0).alias("with_clauses"), F.coalesce(F.sum(F.greatest(size, F.lit(0))), F.lit(0)).alias("clauses"))
    spark = articles.sparkSession
    gaps = spark.range(lo, hi + 1).select(F.col("id").cast("int").alias("number")).join(articles.select(n.alias("number")).distinct(), "number", "left_anti")
    missing = gaps.agg(F.sort_array(F.collect_list("number")).alias("missing"))  # hi - lo + 1 numbers at most
    return stats.join(F.broadcast(missing))


def drop_after_marker(articles: DataFrame, number: str) -> DataFrame:
    """articles without those on pages after the page of the article with this number, per document."""
    page = articles.where(F.col("article_number") == number).groupBy("document_title").agg(F.min("page_number").alias("_last"))
    return articles.join(page, "document_title", "left").where(F.col("_last").isNull() | F.col("page_number").isNull() | (F.col("page_number") <= F.col("_last"))).drop("_last")


# --- shapes of results ---


def shape_sources(ranked: DataFrame, base: str = "/api/pdf?file=") -> DataFrame:
    """Article rows as an interface shows them: document, title, article, relevance_score, link with page and search."""
    number = F.col("article_number")
    search = F.when((text("article_number") != "") & (F.lower(number) != "n/a"), F.concat(F.lit("&search="), number)).otherwise("")
    page = F.coalesce("page_number", F.lit(1))
    link = F.when(F.col("file").isNotNull(), F.concat(F.lit(base), "file", F.lit("#page="), page, search))
    return ranked.select("query_id", "rank", F.coalesce("document_title", F.lit("Unknown")).alias("document"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce(number, F.lit("N/A")).alias("article"),
                         F.coalesce("final", F.lit(0.0)).alias("relevance_score"), F.lit("article").alias("type"), link.alias("pdf_link"), page.alias("page_number"), "chapter", "part")


def shape_cases(ranked: DataFrame) -> DataFrame:
    """Case rows as an interface shows them; the summary is cut to 150 characters."""
    citation = F.coalesce("citation", F.lit("N/A"))
    return ranked.select("query_id", "rank", citation.alias("citation"), F.coalesce("title", "citation", F.lit("Unknown Case")).alias("title"), F.coalesce("court", F.lit("Unknown Court")).alias("court"), F.coalesce("date", F.lit("")).alias("date"),
                         F.concat(F.substring(F.coalesce("summary", F.lit("")), 1, 150), F.lit("...")).alias("summary"), "pdf_link", F.coalesce("final", F.lit(0.0)).alias("relevance_score"), F.lit("case").alias("type"))


def format_sources(df: DataFrame) -> DataFrame:
    """Source rows with defaults, the score to three places, and optional fields null unless they say something."""
    return df.select(F.coalesce("document", F.lit("Unknown")).alias("document"), F.coalesce("article", F.lit("N/A")).alias("article"), text("title").alias("title"), F.round(F.coalesce("relevance_score", F.lit(0.0)), 3).alias("relevance_score"),
                     F.nullif("page_number", F.lit(0)).alias("page_number"), blank_to_null("pdf_link").alias("pdf_link"), blank_to_null("source_file").alias("source_file"))


def derived_documents(docs: DataFrame) -> DataFrame:
    """documents(title, year, type, source_file)."""
    from ..functions.text import doc_type

    return docs.select("title", "year", doc_type("title").alias("type"), "source_file")


