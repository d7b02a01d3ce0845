"""Personal data: base patterns, then bootstrapped contextual extraction. DataFrame functions only.

Base spans of four kinds come from regular expressions. They are the seeds: the one or two words before an entity are
its lexical patterns. Patterns and the instances they precede form a graph; in each round a pattern's confidence is the
share of its distinct instances that are known to be of a kind, and an unknown identifier is taken into a kind when
confident patterns precede it. Taken identifiers are seeds of the next round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import once, running_total
from .common import BROADCAST_ROWS, attach, materialise, operator, text_of

#: Fixed patterns of the kinds, in their order. Possessive loops and \G match what the plain forms do, in linear time
#: and without deep recursion.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Something that every text with a match of the kind has; most texts are done after this.
GATES = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
#: What may be an unseen identifier: a token with a digit or @, of IDENTIFIER characters; other tokens are no candidates.
TOKEN, IDENTIFIER = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+", (6, 64)
#: Rounds at most (they end when nothing new is found); distinct known instances that a pattern needs, its least confidence,
#: and that of an instance.
ROUNDS, SUPPORT, CONFIDENT, ACCEPT = 3, 5, 0.9, 0.9

_SPAN = "struct<start:int,end:int,surface:string,before:string>"


def _found(text: Column, pattern: str) -> tuple[Column, Column]:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)


def _spans(matches: Column, gaps: Column) -> Column:
    """Spans in code points from the matches and the texts between them, each with the end of the text before it."""

    def placed(p: Column) -> Column:
        ends = running_total(F.transform(p, lambda x: F.length(x["gap"]) + F.length(x["match"])))
        return F.zip_with(p, ends, lambda x, end: F.struct((end - F.length(x["match"])).alias("start"), end.alias("end"), x["match"].alias("surface"), F.right(x["gap"], F.lit(60)).alias("before")))

    return once(F.zip_with(matches, F.slice(gaps, 1, F.size(matches)), lambda m, g: F.struct(m.alias("match"), g.alias("gap"))), placed)


def _valid(kind: str):
    """The test that a span of a kind must pass."""

    def test(span: Column) -> Column:
        digits = F.regexp_replace(span["surface"], "[^0-9]", "")
        if kind == "ip":
            return F.forall(F.split(span["surface"], r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.right(p, F.lit(3)).cast("int") <= 255))
        if kind == "card":
            return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
        return F.length(digits).between(8, 15) if kind == "phone" else F.lit(True)

    return test


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, length, email, ip, card, phone, other: arrays of (start, end, surface, before).

    For each kind the leftmost matches that do not overlap, without those that fail its test. other holds tokens that
    might be identifiers; some may touch base spans.
    """
    rows = docs.select("doc_id", text_of().alias("text"))
    gate = lambda k: F.contains("text", F.lit("@")) if k == "email" else F.col("text").rlike(GATES[k])
    rows = rows.withColumns({f"{k}_m": F.when(gate(k), _found(F.col("text"), p)[0]) for k, p in PATTERNS.items()} | {"other_m": F.when(F.col("text").rlike("[0-9@]"), _found(F.col("text"), TOKEN)[0])})
    rows = rows.withColumns({k: F.when(F.size(f"{k}_m") > 0, _spans(F.col(f"{k}_m"), _found(F.col("text"), p)[1])) for k, p in (PATTERNS | {"other": TOKEN}).items()})
    none = F.array().cast(f"array<{_SPAN}>")
    fits = lambda s: F.length(s["surface"]).between(*IDENTIFIER)
    return rows.select("doc_id", F.length("text").alias("length"), *[F.coalesce(F.filter(k, _valid(k)), none).alias(k) for k in PATTERNS], F.coalesce(F.filter("other", fits), none).alias("other"))


def discover(base: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """row, kind, start, end of identifiers that confident patterns find among the other tokens of base_spans that touch no
    base span. base has a column row, which tells its rows apart."""
    named = lambda k: lambda s: F.struct(F.lit(k).cast("string").alias("kind"), *[s[c].alias(c) for c in ("start", "end", "surface", "before")])
    spans = F.concat(*[F.transform(k, named(k)) for k in PATTERNS], F.transform("other", named(None)))
    rows = base.where(F.size(spans) > 0).select("row", F.explode(spans).alias("s")).select("row", "s.*")
    # the furthest end of base spans that start before a token's end, by one walk over the spans of a text
    place = F.when(F.col("kind").isNotNull(), F.col("start") * 2 + 1).otherwise(F.col("end") * 2)
    walk = Window.partitionBy("row").orderBy(place).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.max(F.when(F.col("kind").isNotNull(), F.col("end"))).over(walk)
    rows = rows.withColumn("reach", reach).where(F.col("kind").isNotNull() | ~F.coalesce(F.col("reach") > F.col("start"), F.lit(False))).drop("reach")
    before = F.lower(F.regexp_replace("before", "[0-9]", "0"))
    words = [F.regexp_extract(before, p, 1) for p in (r"(\S+)\s*$", r"(\S+\s+\S+)\s*$")]
    rows = materialise(rows.select("row", "kind", "start", "end", "surface", F.array_distinct(F.filter(F.array(*words), lambda w: w.rlike(r"\p{L}"))).alias("patterns")))
    edges = materialise(rows.select(F.explode("patterns").alias("pattern"), "surface", "kind").distinct())
    known = materialise(rows.where("kind is not null").select("surface", "kind").distinct())
    fresh, size = known.limit(0), edges.count()
    for _ in range(rounds):
        labelled = edges.select("pattern", "surface").distinct().join(known.withColumnRenamed("kind", "known"), "surface", "left")
        counts = labelled.groupBy("pattern", "known").agg(F.count("*").alias("n"))
        total = counts.groupBy("pattern").agg(F.sum("n").alias("total"))
        good = counts.where(F.col("known").isNotNull() & (F.col("n") >= SUPPORT)).join(total, "pattern").withColumn("confidence", F.col("n") / F.col("total")).where(F.col("confidence") >= CONFIDENT)
        unknown = edges.where("kind is null").join(known.select("surface"), "surface", "left_anti").select("pattern", "surface")
        # common words are patterns of very many instances; at this confidence a pattern is of one kind
        met = attach(materialise(unknown), materialise(good), "pattern", "total", size).where("confidence is not null")
        scored = met.groupBy("surface", F.col("known").alias("kind")).agg((1 - F.product(1 - F.col("confidence"))).alias("score"))
        taken = materialise(scored.where(F.col("score") >= ACCEPT).groupBy("surface").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind")))
        if taken.isEmpty():
            break
        known, fresh = materialise(known.union(taken)), materialise(fresh.union(taken))
    taken = fresh.count()
    return rows.where("kind is null").drop("kind").join(F.broadcast(fresh) if taken <= BROADCAST_ROWS // 10 else fresh, "surface").select("row", "kind", "start", "end").distinct()


@operator
def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for each row of docs.

    The counts and base_sha256 are of base spans; spans has all, as kind:start:end joined by commas, in the order of
    kinds and then of starts. A null text is empty and has none. Rows have keys of their own here, so those that share a
    doc_id, or have none, keep their spans apart. Other columns are not read.
    """
    base = materialise(base_spans(docs).withColumn("row", F.monotonically_increasing_id()))
    more = materialise(discover(base).groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("more")))
    rows = base.join(F.broadcast(more) if more.count() <= BROADCAST_ROWS // 10 else more, "row", "left")
    place = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))
    of = lambda k: lambda s: s["kind"] == k
    text = lambda k, spans: F.transform(spans, lambda s: F.concat_ws(":", F.lit(k), s["start"], s["end"]))
    extra = F.coalesce("more", F.array().cast("array<struct<kind:string,start:int,end:int>>"))
    own = {k: F.transform(k, place) for k in PATTERNS}
    found = {k: F.transform(F.filter(extra, of(k)), place) for k in PATTERNS}
    joined = lambda parts: F.array_join(F.concat(*parts), ",")
    return rows.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in PATTERNS], F.sha2(joined([text(k, own[k]) for k in PATTERNS]), 256).alias("base_sha256"),
        joined([text(k, F.array_sort(F.concat(own[k], found[k]))) for k in PATTERNS]).alias("spans"),
    )
