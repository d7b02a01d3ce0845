"""Topic filters, scans and searches over listings and texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import values
from ..functions.text import any_of, col, collapsed, once, text, whole_word

_TRIGGERS = "array<struct<kind:string,matched:string>>"


def topic_triggers(blob: Column | str, phrases: Sequence[str] = values.TOPIC_PHRASES, tokens: Sequence[str] = values.TOPIC_TOKENS) -> Column:
    """Matches as (kind, matched), phrases in their order and then whole-word tokens. blob must be normalised already;
    it is computed once, also where Spark moves the triggers into a filter and what they are made of with them."""
    hit = lambda kind, x: F.struct(F.lit(kind).alias("kind"), F.lit(x).alias("matched"))
    found = lambda b: [F.when(b.contains(p), hit("phrase", p)) for p in phrases] + [F.when(whole_word(b, t), hit("word_token", t)) for t in tokens]
    return once(col(blob), lambda b: F.array_compact(F.array(*found(b)))) if phrases or tokens else F.array().cast(_TRIGGERS)


def trigger_reason(triggers: Column | str, profile: str = values.FILTER_PROFILE) -> Column:
    """One line for reviewers: the first trigger, and the others if there are any."""
    t = col(triggers)
    first = F.get(t, F.lit(0))
    head = F.when(first["kind"] == "phrase", F.concat(F.lit('Listing text contains phrase "'), first["matched"], F.lit(f'" (substring match in combined fields; profile {profile}).'))).otherwise(
        F.concat(F.lit('Listing text contains token "'), first["matched"], F.lit(f'" as a whole word (word-boundary match; profile {profile}).'))
    )
    rest = F.array_join(F.transform(F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))), lambda x: F.concat(x["kind"], F.lit(":'"), x["matched"], F.lit("'"))), ", ")
    return F.when(F.size(t) > 1, F.concat(head, F.lit(" Additional triggers: "), rest, F.lit("."))).when(F.size(t) == 1, head)


#: Fields of a listing row that are searched, by court.
LISTING_FIELDS = {
    "Lahore High Court": ("case_title", "writ_petition", "hon_judge", "lhc_citation"),
    "Sindh High Court": ("case_title", "case_number", "matter", "location", "judges"),
}


def listing_blob(court: str) -> Column:
    """The court's non-empty listing fields, joined by a space."""
    return F.concat_ws(" ", *[F.nullif(F.col(c).cast("string"), F.lit("")) for c in LISTING_FIELDS[court]])


def classify_listing(df: DataFrame, blob: Column | str, phrases: Sequence[str] = values.TOPIC_PHRASES, tokens: Sequence[str] = values.TOPIC_TOKENS, profile: str = values.FILTER_PROFILE) -> DataFrame:
    """Rows with a trigger, with filter_profile, triggers and reason. Narrow: no shuffle."""
    rows = df.withColumn("_blob", F.lower(collapsed(blob))).withColumn("triggers", topic_triggers("_blob", phrases, tokens)).where(F.size("triggers") > 0)
    return rows.withColumns({"filter_profile": F.lit(profile), "reason": trigger_reason("triggers", profile)}).drop("_blob")


def strict_filter(df: DataFrame, title: str = "case_title", remarks: str = "remarks", phrases: Sequence[str] = values.STRICT_PHRASES) -> DataFrame:
    blob = F.lower(F.concat_ws(" ", text(title), text(remarks)))
    return df.withColumn("_blob", blob).where(any_of([F.col("_blob").contains(p) for p in phrases])).drop("_blob")


def scan_fulltext(df: DataFrame, column: str = "text", phrases: Sequence[str] = values.SCAN_PHRASES, window: int = 350) -> DataFrame:
    """Rows whose text has a phrase, with matched (list order) and an excerpt around the first place of the first one."""
    half = window // 2
    rows = df.withColumn("_low", F.lower(F.coalesce(F.col(column), F.lit(""))))
    rows = rows.withColumn("matched", F.array_compact(F.array(*[F.when(F.col("_low").contains(p), F.lit(p)) for p in phrases]))).where(F.size("matched") > 0)
    rows = rows.withColumn("_at", F.expr("locate(matched[0], _low)") - 1)
    start = F.greatest(F.lit(0), F.col("_at") - half)
    piece = F.substr(F.col(column), start + 1, F.col("_at") + half - start)
    return rows.withColumn("excerpt", F.concat(F.lit("..."), text(piece), F.lit("..."))).drop("_low", "_at")


def usable_text(df: DataFrame, column: str = "pdf_data") -> DataFrame:
    t = text(column)
    return df.where((t != "") & ~t.startswith("[ERROR"))


def search(df: DataFrame, needle: str, columns: Sequence[str]) -> DataFrame:
    """Rows with the needle, whatever its case, in any of the columns; a blank needle keeps all."""
    low = needle.strip().lower()
    return df if not low else df.where(any_of([F.lower(F.coalesce(F.col(c), F.lit(""))).contains(low) for c in columns]))


def search_cases(df: DataFrame, needle: str) -> DataFrame:
    return search(df, needle, ("title", "citation", "court", "judge"))


def search_documents(df: DataFrame, needle: str) -> DataFrame:
    return search(df, needle, ("name", "category"))


def filter_years(df: DataFrame, years: Sequence[int], column: str = "year") -> DataFrame:
    return df.where(F.col(column).isin(list(years)))


def filter_relevant(df: DataFrame, threshold: float = 0.0, keep: int = 3, query: str = "query_id", score: str = "score", tie: str = "id") -> DataFrame:
    """Per query the rows at or above the threshold; a query left without any keeps its `keep` best. Adds the counts
    n_before, n_after and n_removed. One shuffle on the query."""
    w = Window.partitionBy(query)
    good = F.coalesce(F.col(score), F.lit(0.0)) >= threshold
    rows = df.withColumns({"_good": good, "_any": F.max(good).over(w), "n_before": F.count("*").over(w), "_n": F.row_number().over(w.orderBy(F.desc(score), tie))})
    rows = rows.where(F.col("_good") | (~F.col("_any") & (F.col("_n") <= keep)))
    after = F.count("*").over(w)
    return rows.withColumn("n_after", after).withColumn("n_removed", F.col("n_before") - F.col("n_after")).drop("_good", "_any", "_n")


def filter_funnel(df: DataFrame, group: str, kept: Column) -> DataFrame:
    """Rows seen and kept per group."""
    return df.groupBy(group).agg(F.count("*").alias("seen"), F.count_if(kept).alias("kept"))


def is_greeting(column: Column | str) -> Column:
    """A greeting by itself, or up to three words that contain one and no legal word."""
    raw = F.coalesce(col(column), F.lit(""))
    clean = F.regexp_replace(F.lower(text(raw)), r"[?!.]+$", "")
    short = F.size(F.filter(F.split(raw, r"(?U)\s+"), lambda w: w != "")) <= 3
    holds = any_of([clean.contains(g) for g in values.GREETINGS]) & ~any_of([clean.contains(b) for b in values.GREETING_BLOCKERS])
    return (raw != "") & (clean.isin(list(values.GREETINGS)) | (short & holds))

