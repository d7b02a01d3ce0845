"""Removal of passages that repeat, by overlapping windows of three lines. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, attach, fresh, materialise, operator, text_of

#: Consecutive lines in a window.
LINES = 3


@operator
def removed_spans(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """doc_id, place (digest of the text) and spans (array of start, end line; end exclusive) of what repeats, for documents
    that lose lines.

    A window is the hash of three consecutive lines of a text, or of all lines of a shorter text, unless they are blank.
    Of a window that occurs more than once in the table, the place with the smallest doc_id and then line stays, and the
    lines of all later places are covered; covered lines that touch are merged. Lines of a place that stays are not
    removed, so each repeated passage is left once as a whole. Rows of the same doc_id and text are one place.
    """
    cut = docs.select("doc_id", text_of().alias("text")).select("doc_id", F.unhex(F.md5("text")).alias("place"), F.split("text", "\n", -1).alias("lines"))
    cut = cut.withColumn("size", F.least(F.size("lines"), F.lit(lines)))
    window = lambda i: F.array_join(F.slice("lines", i + 1, F.col("size")), "\n")
    keys = F.transform(F.sequence(F.lit(0), F.size("lines") - F.col("size")), lambda i: F.when(window(i).rlike(r"\S"), F.unhex(F.md5(window(i)))))
    rows = materialise(cut.select("doc_id", "place", "size", F.posexplode(keys).alias("line", "key")).where("key is not null"))
    at = F.struct("doc_id", "place", "line")
    first = rows.groupBy("key").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n")).where(~F.col("first").eqNullSafe(F.col("last"))).drop("last")
    met = attach(rows, materialise(first), "key", "n", rows.count()).where("n is not null")
    stays = at.eqNullSafe(F.col("first"))
    touched = met.select("doc_id", "place", stays.alias("stays"), F.explode(F.sequence(F.col("line"), F.col("line") + F.col("size") - 1)).alias("line"))
    covered = touched.groupBy("doc_id", "place", "line").agg(F.bool_or("stays").alias("stays")).where(~F.col("stays"))
    island = F.col("line") - F.row_number().over(Window.partitionBy("doc_id", "place").orderBy("line"))
    spans = covered.withColumn("island", island).groupBy("doc_id", "place", "island").agg(F.min("line").alias("start"), (F.max("line") + 1).alias("end"))
    return spans.groupBy("doc_id", "place").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))


def line_dedup(docs: DataFrame) -> DataFrame:
    """docs with text shortened by its removed_spans, and n_lines, n_removed and removed (start:end,...) after the columns.

    A null text stays null, with no lines. Rows that share doc_id (or lack it) and text are the same place, so a repeated row
    is never a later one of itself. Passages of fewer than three lines within longer texts are left. Extra columns pass
    through; the three added ones replace columns of the same name.
    """
    names = fresh(docs, "own_id", "own_place", "own_spans")
    spans = removed_spans(docs).select(*[F.col(c).alias(n) for c, n in zip(("doc_id", "place", "spans"), names, strict=True)])
    few = spans.agg(F.sum(F.size(names[2]))).first()[0] or 0
    here = docs["doc_id"].eqNullSafe(spans[names[0]]) & (F.unhex(F.md5(text_of())) == spans[names[1]])
    rows = docs.join(F.broadcast(spans) if few <= BROADCAST_ROWS else spans, here, "left")
    lines, own = F.split("text", "\n", -1), F.coalesce(names[2], F.array().cast("array<struct<start:int,end:int>>"))
    # the lines between one span and the next, in one walk over the spans; each array is made once
    between = lambda x: F.flatten(F.zip_with(F.concat(F.array(F.lit(0)), F.transform(x["own"], lambda s: s["end"])), F.concat(F.transform(x["own"], lambda s: s["start"]), F.array(F.size(x["lines"]))), lambda a, b: F.slice(x["lines"], a + 1, b - a)))
    kept = F.get(F.transform(F.array(F.struct(lines.alias("lines"), own.alias("own"))), between), F.lit(0))
    n_removed = F.aggregate(own, F.lit(0), lambda n, s: n + s["end"] - s["start"])
    out = rows.withColumns({"n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long"), "n_removed": n_removed.cast("long"),
                            "removed": F.array_join(F.transform(own, lambda s: F.concat_ws(":", s["start"], s["end"])), ","),
                            "text": F.when(F.size(own) == 0, F.col("text")).otherwise(F.array_join(kept, "\n"))})
    return out.drop(*names)
