"""Labels and scores of cases, questions and narratives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import values
from ..functions.text import any_of, blank_to_null, col, occurrences, strip, text, total, usable, words

# --- outcome of a case ---


def _weights(low: Column, patterns: tuple) -> Column:
    return total([F.when(low.rlike(p), w).otherwise(0) for p, w in patterns])


def infer_winner(df: DataFrame, out: str = "winner") -> DataFrame:
    """petitioner, respondent, mixed or unknown, from weighted patterns over the listing fields and the first 4000 and last
    12000 characters of the text. Columns that df lacks count as empty."""
    field = lambda c: blank_to_null(c) if c in df.columns else F.lit(None).cast("string")
    pdf = text("pdf_data")
    body = F.concat_ws("\n", *[field(c) for c in ("remarks", "matter", "description", "excerpt")], F.substring(pdf, 1, 4000), F.right(pdf, F.lit(12000)))
    rows = df.withColumn("_low", F.when(usable("pdf_data"), F.lower(body)))
    rows = rows.withColumns({"_mixed": _weights(F.col("_low"), values.OUTCOME_MIXED), "_pos": _weights(F.col("_low"), values.OUTCOME_POSITIVE), "_neg": _weights(F.col("_low"), values.OUTCOME_NEGATIVE)})
    mixed, pos, neg = F.col("_mixed"), F.col("_pos"), F.col("_neg")
    label = (
        F.when(F.col("_low").isNull(), "unknown").when(mixed >= 4, "mixed").when((pos == 0) & (neg == 0), "unknown")
        .when((mixed > 0) & (pos > 0) & (neg > 0), "mixed").when((pos > neg) & (neg > 0), "mixed").when(pos > neg, "petitioner").when(neg > pos, "respondent").otherwise("unknown")
    )
    return rows.withColumn(out, label).drop("_low", "_mixed", "_pos", "_neg")


def fill_winner(df: DataFrame, force: bool = False, winner_only: bool = False) -> DataFrame:
    """winner filled where it is blank, or everywhere with force; winner_only touches only rows with usable text. Adds
    updated, whether the row's label was set."""
    due = F.lit(True) if force else text("winner") == ""
    if winner_only:
        due = due & usable("pdf_data")
    rows = infer_winner(df, "_new").withColumn("updated", due)
    return rows.withColumn("winner", F.when(F.col("updated"), F.col("_new")).otherwise(F.col("winner"))).drop("_new")


# --- class of a question ---


def _indicators(low: Column) -> Column:
    several = F.when(occurrences(low, " and ") >= 2, 1).otherwise(0)
    spaced = F.concat(F.lit(" "), low, F.lit(" "))
    conditionals = total([F.when(spaced.contains(f" {w} "), 1).otherwise(0) for w in values.CONDITIONALS])
    return total([F.when(low.contains(i), 1).otherwise(0) for i in values.COMPLEXITY_INDICATORS]) + several + F.when(conditionals >= 2, 1).otherwise(0)


def classify_query(df: DataFrame, column: str = "text") -> DataFrame:
    """complexity: simple, moderate or complex; with the evidence columns that explain() uses."""
    rows = df.withColumns({"_raw": F.coalesce(F.col(column), F.lit("")), "_low": F.lower(F.coalesce(F.col(column), F.lit("")))})
    rows = rows.withColumns({
        "specific": any_of([F.col("_raw").rlike(f"(?iU){p}") for p in values.SPECIFIC_REFERENCES]), "indicators": _indicators(F.col("_low")), "n_words": F.size(words("_raw")),
        "n_questions": occurrences("_raw", "?"), "n_terms": total([F.when(F.col("_low").contains(t), 1).otherwise(0) for t in values.LEGAL_TERMS]),
    })
    score, n = F.col("indicators"), F.col("n_words")
    label = (
        F.when(F.col("specific"), "simple").when((score >= 3) | (n > 20) | (F.col("n_questions") > 1), "complex")
        .when(F.col("n_terms") > 0, F.when((n > 12) | (score >= 1), "moderate").otherwise("simple")).when(n <= 5, "simple").otherwise("moderate")
    )
    return rows.withColumn("complexity", label).drop("_raw", "_low")


def retrieval_strategy(df: DataFrame) -> DataFrame:
    """use_multi_stage, top_k, max_words and description by complexity."""
    pick = lambda k: F.coalesce(*[F.when(F.col("complexity") == c, F.lit(v[k])) for c, v in values.STRATEGIES.items()])
    return df.withColumns({name: pick(k) for k, name in enumerate(("use_multi_stage", "top_k", "max_words", "description"))})


def explain(df: DataFrame) -> DataFrame:
    """reason: why classify_query decided as it did."""
    n, score, terms = F.col("n_words"), F.col("indicators"), F.col("n_terms")
    said = F.concat_ws(
        ", ", F.when(F.col("specific"), "references specific section/article"), F.when(score > 0, F.concat(F.lit("has "), score, F.lit(" complexity indicator(s)"))),
        F.when(n > 20, F.concat(F.lit("long question ("), n, F.lit(" words)"))).when(n <= 5, F.concat(F.lit("short question ("), n, F.lit(" words)"))),
        F.when(F.col("n_questions") > 1, "multiple questions"), F.when(terms > 0, F.concat(F.lit("contains "), terms, F.lit(" legal term(s)"))),
    )
    return df.withColumn("reason", F.concat(F.lit("Classified as '"), F.col("complexity"), F.lit("' because: "), F.when(said == "", "general query pattern").otherwise(said)))


# --- narratives ---


def evidence_checklist(narrative: Column | str, ocr_text: Column | str | None = None, incident_date: Column | str | None = None) -> Column:
    """array<struct<label,status>> of the six checks; a given incident date counts as a date."""
    low = F.lower(F.concat_ws("\n", col(narrative), *([] if ocr_text is None else [col(ocr_text)])))
    dated = F.lit(False) if incident_date is None else text(incident_date) != ""
    found = {k: any_of([low.rlike(f"(?U){p}") for p in ps]) | (dated if k == "Date of Incident" else F.lit(False)) for k, ps in values.CHECKLIST.items()}
    return F.array(*[F.struct(F.lit(k).alias("label"), F.when(f, "found").otherwise("missing").alias("status")) for k, f in found.items()])


def case_merit(checklist: Column | str, case_count: Column | str, source_count: Column | str) -> Column:
    """struct<score,label,legal_grounds,evidence_weight,precedent_similarity>; the score is cut to whole numbers from 25 to 92."""
    check = col(checklist)
    complete = F.size(F.filter(check, lambda x: x["status"] == "found")) / F.greatest(F.size(check), F.lit(1))
    similar, grounding = F.least(col(case_count) / F.lit(5.0), F.lit(1.0)), F.least(col(source_count) / F.lit(6.0), F.lit(1.0))
    score = F.greatest(F.lit(25), F.least(F.lit(92), (((F.lit(0.45) * complete) + (F.lit(0.35) * similar) + (F.lit(0.20) * grounding)) * 100).cast("int")))
    band = lambda v: F.when(v >= 0.75, "Strong").when(v >= 0.45, "Moderate").otherwise("Weak")
    label = F.when(score >= 70, "High Merit").when(score >= 50, "Moderate Merit").otherwise("Low Merit")
    return F.struct(score.alias("score"), label.alias("label"), band(grounding).alias("legal_grounds"), band(complete).alias("evidence_weight"), band(similar).alias("precedent_similarity"))


def extract_facts(column: Column | str) -> Column:
    """struct<facts,entities,confidence,preview>: first eight lines, first twelve distinct capitalised words in order."""
    raw = text(column)
    facts = F.slice(F.filter(F.transform(F.split(raw, r"\r\n|\r|\n"), strip), lambda x: x != ""), 1, 8)
    entities = F.slice(F.array_distinct(F.regexp_extract_all(raw, F.lit(r"(?U)\b([A-Z][a-zA-Z]{2,})\b"), F.lit(1))), 1, 12)
    confidence = F.when(raw == "", 0.2).when(F.length(raw) > 250, 0.75).otherwise(0.55)
    return F.struct(facts.alias("facts"), entities.alias("entities"), confidence.alias("confidence"), F.substring(raw, 1, 5000).alias("preview"))


# --- titles and files ---


def _tokens(c: Column) -> Column:
    found = F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(list(values.TITLE_STOPWORDS))))


def match_titles_to_files(titles: DataFrame, files: DataFrame) -> DataFrame:
    """title, file for each distinct title (columns title, and source_file if there is one; files has file).

    In turn: the source file, the fixed map (titles that contain each other), the most shared words (two at least; ties
    go to the first name). Of a name its -Cleaned variant comes first. Words are joined as equal keys. The most common word of
    each title and file is left out of that join, since two names that share two words share another one, too: a word that
    very many names have pairs none by itself. Shared words are then counted on all words.
    """
    titles = titles.withColumn("source_file", F.col("source_file") if "source_file" in titles.columns else F.lit(None).cast("string")).select("title", "source_file").distinct()
    low = F.lower(F.col("title"))
    mapped = F.coalesce(*[F.when(low.contains(k.lower()) | (F.lit(k.lower()).contains(low) & (low != "")), F.lit(v)) for k, v in values.TITLE_FILES.items()])
    wanted = titles.withColumn("names", F.array(F.col("source_file"), mapped))
    names = wanted.select("title", F.posexplode("names").alias("step", "name")).where("name is not null")
    options = names.select("title", F.explode(F.array(F.struct((F.col("step") * 2).alias("rank"), F.replace("name", F.lit(".pdf"), F.lit("-Cleaned.pdf")).alias("file")), F.struct((F.col("step") * 2 + 1).alias("rank"), F.col("name").alias("file")))).alias("o")).select("title", "o.*")
    listed = options.join(files.select("file").distinct(), "file")
    left = titles.select("title", F.explode(_tokens(F.col("title"))).alias("token"))
    right = files.select("file", F.explode(_tokens(F.regexp_replace("file", r"\.[^.]*$", ""))).alias("token")).distinct()
    common = left.select("token").union(right.select("token")).groupBy("token").agg(F.count("*").alias("n"))

    def rarer(words: DataFrame, name: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(name).orderBy(F.desc("n"), "token"))
        return words.join(common, "token").withColumn("k", place).where("k > 1").select(name, "token")

    pairs = rarer(left, "title").join(rarer(right, "file"), "token").select("title", "file").distinct()
    shared = pairs.join(left, "title").join(right, ["file", "token"]).groupBy("title", "file").agg(F.count("*").alias("n")).where("n >= 2")
    best = shared.withColumn("k", F.row_number().over(Window.partitionBy("title").orderBy(F.desc("n"), "file"))).where("k = 1")
    all_options = listed.select("title", "rank", "file").unionByName(best.select("title", F.lit(9).alias("rank"), "file"))
    chosen = all_options.groupBy("title").agg(F.min_by("file", "rank").alias("file"))
    return titles.select("title").distinct().join(chosen, "title", "left")


