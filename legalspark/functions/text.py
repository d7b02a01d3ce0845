"""Column functions on text. All are built-in expressions, so they stay inside the JVM.

`(?U)` makes \\s, \\b, \\w and case folding follow Unicode.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import values

#: White space as Unicode has it ((?U)\\s), for trimming (trim() alone takes only spaces).
_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space at its ends. Only the ends are looked at; a pattern would try every place of the text."""
    return F.btrim(col(c), F.lit(_SPACE))


def text(c: Column | str) -> Column:
    """Trimmed, null as empty."""
    return F.coalesce(strip(c), F.lit(""))


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(strip(c), F.lit(""))


def first_text(*cs: Column | str) -> Column:
    """The first that is not blank, trimmed, else empty."""
    return F.coalesce(*[blank_to_null(c) for c in cs], F.lit(""))


def words(c: Column | str) -> Column:
    """Tokens between white space."""
    return F.filter(F.split(col(c), r"(?U)\s+"), lambda w: w != "")


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def total(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns, F.lit(0))


def occurrences(c: Column | str, needle: str) -> Column:
    """How often a string occurs, not overlapping."""
    c = col(c)
    return ((F.length(c) - F.length(F.replace(c, F.lit(needle), F.lit("")))) / len(needle)).cast("int")


def whole_word(c: Column, token: str) -> Column:
    return c.contains(token) & c.rlike(rf"(?U)\b{re.escape(token)}\b")


def once(c: Column, use) -> Column:
    """use(c), with c computed once however often it stands there, also in the functions of arrays."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def running_total(sizes: Column) -> Column:
    """array<int> of the sums of an array of int up to each element; of an empty or null array, empty.

    Arrays that grow by an element are copied each time, so the sums are taken in blocks of about the root of the length.
    """

    def sums(values: Column, start: Column) -> Column:
        step = lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"] + x)).alias("out"))
        return F.aggregate(values, F.struct(start.alias("at"), F.array().cast("array<int>").alias("out")), step, lambda s: s["out"])

    def blocked(v: Column) -> Column:
        side = F.ceil(F.sqrt(F.size(v))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / side).cast("int")), lambda b: F.slice(v, b * side + 1, side))
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda s, x: s + x))
        starts = once(totals, lambda t: F.zip_with(sums(t, F.lit(0)), t, lambda end, own: end - own))
        return F.flatten(F.zip_with(blocks, starts, sums))

    return once(sizes, lambda v: F.when(F.size(v) > 0, blocked(v)).otherwise(F.array().cast("array<int>")))


def match_spans(c: Column | str, pattern: str, group: int = 0) -> Column:
    """array<struct<start,end,value>> of the matches of a pattern, in order; offsets in characters, from 0.

    The offsets come from the texts between matches, so no Python is needed. value is the group asked for.
    """
    c = col(c)
    spans = "array<struct<start:int,end:int,value:string>>"

    def placed(p: Column) -> Column:
        """Ends are running totals of gaps and matches."""
        ends = running_total(F.zip_with(p["m"], F.slice(p["g"], 1, F.size(p["m"])), lambda m, g: F.length(g) + F.length(m)))
        rows = F.arrays_zip(ends.alias("end"), p["m"].alias("m"), p["v"].alias("v"))
        return F.transform(rows, lambda r: F.struct((r["end"] - F.length(r["m"])).alias("start"), r["end"].alias("end"), r["v"].alias("value")))

    parts = F.struct(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)).alias("m"), F.regexp_extract_all(c, F.lit(pattern), F.lit(group)).alias("v"), F.split(c, pattern, -1).alias("g"))
    # without a match nothing is walked
    return F.when(c.rlike(pattern), once(parts, placed)).otherwise(F.array().cast(spans))


# --- names and labels ---


def doc_type(title: Column | str) -> Column:
    """Type of a statute by its title, else its first word of more than three characters, else Unknown."""
    title = F.coalesce(col(title), F.lit(""))
    low = F.lower(title)
    out = F.initcap(F.get(F.filter(words(title), lambda w: F.length(w) > 3), F.lit(0)))
    for key, kind in reversed(values.DOCUMENT_TYPES.items()):
        out = F.when(low.contains(key), F.lit(kind)).otherwise(out)
    return F.coalesce(out, F.lit("Unknown"))


def short_label(title: Column | str) -> Column:
    title = F.coalesce(col(title), F.lit(""))
    low, tokens = F.lower(title), F.split(title, " ")
    out = F.concat(F.array_join(F.slice(tokens, 1, 3), " "), F.when(F.size(tokens) > 3, "...").otherwise(""))
    for key, label in reversed(values.SHORT_LABELS):
        value = F.when(low.contains("amendment") | low.contains("2025"), "PECA 2025").otherwise(label) if label == "PECA 2016" else F.lit(label)
        out = F.when(low.contains(key), value).otherwise(out)
    return out


def subtitle(title: Column | str, chapter: Column | str, part: Column | str) -> Column:
    return F.concat_ws(" · ", blank_to_null(part), blank_to_null(chapter), F.coalesce(blank_to_null(title), F.lit("Legal provision")))


def court_of_file(path: Column | str) -> Column:
    """Court from a file name: prefix first, then the descriptive form, else Unknown Court."""
    stem = F.lower(F.regexp_replace(F.element_at(F.split(col(path), "/"), -1), r"\.[^.]*$", ""))
    out = F.lit("Unknown Court")
    for name in reversed(values.COURTS.values()):
        out = F.when(stem.contains(name.lower().replace(" ", "-")), F.lit(name)).otherwise(out)
    for prefix, name in reversed(values.COURTS.items()):
        out = F.when(stem.startswith(prefix), F.lit(name)).otherwise(out)
    return out


def make_id(raw: Column | str) -> Column:
    return F.substring(F.regexp_replace(strip(raw), r"[^A-Za-z0-9_\-]", "_"), 1, 120)


# --- texts of cases ---


def usable(pdf: Column | str) -> Column:
    """True if there is text and it is no error marker."""
    t = text(pdf)
    return (t != "") & ~t.startswith("[ERROR")


def trimmed(c: Column | str, most: int = 200_000) -> Column:
    """Cut to most characters with a mark; blank text becomes an error marker."""
    t = text(c)
    return F.when(t == "", "[ERROR: empty]").when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit("\n[TRUNCATED]"))).otherwise(t)


def embedding_text(title: Column | str, pdf: Column | str, summary: Column | str) -> Column:
    return F.concat_ws(" ", F.coalesce(col(title), F.lit("")), F.when(usable(pdf), F.substring(col(pdf), 1, 3000)).otherwise(F.coalesce(col(summary), F.lit(""))))


def citation_text(title: Column | str, case_no: Column | str, pdf: Column | str, summary: Column | str, laws: Column | str) -> Column:
    body = F.when(usable(pdf), F.substring(col(pdf), 1, 5000)).otherwise(F.coalesce(col(summary), F.lit("")))
    return F.concat_ws(" ", *[F.coalesce(col(c), F.lit("")) for c in (title, case_no)], body, F.coalesce(col(laws), F.lit("")))


def resolve_link(*links: Column | str, key: str = "jgmnt") -> Column:
    """First link that is not blank; a viewer's address becomes the file that its parameter names; always https."""
    link = first_text(*links)
    inner = F.url_decode(F.regexp_extract(link, rf"[?&]{key}=([^&#]+)", 1))
    host = F.regexp_extract(link, r"^(https?://[^/]+)", 1)
    out = F.when(inner == "", link).when(inner.rlike(r"^https?://"), inner).otherwise(F.concat(host, F.lit("/"), F.regexp_replace(inner, "^/+", "")))
    return F.regexp_replace(out, "^http://", "https://")


# --- cleaning of statute text ---

#: Fixed: running headers by profile.
_HEADERS = {"act": r"Page\s+\d+\s+of\s+\d+", "constitution": "CONSTITUTION OF PAKISTAN", "penal_code": "CONSTITUTION OF PAKISTAN"}
#: Fixed: names of clauses in a penal code, and what clause markers get a line of their own after, by profile.
_NAMES = r"(?:\d+|[a-z]|i{1,4}v?|iv|v|vi{1,3}|ix|x)"
_BREAKS = {
    "act": [(r"(?<=[.!?:;])\s+(?=\(\s*\d+\s*\))", "\n"), (r"(?<=[.!?:;])\s+(?=\(\s*[a-z]\s*\))", "\n")],
    "constitution": [(r"(?<=[.!?:;])\s+(?=(?:\[\s*)?\(\s*\d+\s*\)\]?\s)", "\n")],
    "penal_code": [
        (rf"(?<=[.!?:;])\s+(?=(?:\[\s*)?\(\s*{_NAMES}\s*\)\]?\s)", "\n"), (rf"([A-Za-z])\s+(?=\(\s*{_NAMES}\s*\))", "$1\n"),
        (r"(Illustrations?|Examples?|Notes?)\s*\n?\s*(?=\([a-z0-9ivx]+\))", "$1\n"),
    ],
}


def clean_text(c: Column | str, profile: str = "act") -> Column:
    """Spaces, page numbers, running headers, clause markers and punctuation of extracted statute text."""
    out = F.translate(F.coalesce(col(c), F.lit("")), "    ", "    ")
    # fixed steps, in this order
    steps = [(r"(?mi)^\s*\d+\s*$", ""), (rf"(?mi)^\s*{_HEADERS[profile]}\s*$", ""), (r"[ \t]+", " "), *_BREAKS[profile]]
    steps += [(r"[ \t]+\n", "\n"), (r"\n[ \t]+", "\n"), (r"\s*\*+\s*" if profile == "act" else r"\s*(?:\*\s*){6}", " ")]
    steps += [(r"\s+,", ","), (r"\s+\.", "."), (r"\s*\)\s*", ") "), (r"\s*\(\s*", " ("), (r"\n{3,}", "\n\n")]
    for pattern, to in steps:
        out = F.regexp_replace(out, pattern, to)
    return strip(out)


#: Fixed: clause markers by variant; group 1 is the clause's name. A pattern starts with what it looks for, so that what must not
#: stand before it is only tested there and not at every place.
CLAUSE_MARKERS = {
    "flat": r"(?U)\((?<!\w\()\s*([0-9a-z]+)\s*\)\s+",
    "numeric": r"""(?U)(?<!\w)(?:\[\s*)?\(\s*(\d+)\s*\)\]?\s+(?=[A-Z"'])""",
    "mixed": r"(?i)\(\s*([0-9]+|[a-z]|i{1,4}|iv|v|vi{1,3}|ix|x)\s*\)\s*[A-Z]",
    "number": r"(?U)\((?<!\w\()\s*(\d+)\s*\)\s+",
    "letter": r"(?U)\((?<!\w\()\s*([a-z])\s*\)\s+",
}


def extract_clauses(c: Column | str, variant: str = "flat") -> Column:
    """array<struct<id,text>>: a clause reaches from behind its marker to the next marker.

    mixed also takes roman numbers, keeps texts of more than 15 characters, and leaves out markers that follow words
    such as `and` or `section`; as in the listing it serves, the first letter belongs to the marker.
    """
    c = F.coalesce(col(c), F.lit(""))
    marker = CLAUSE_MARKERS[variant]
    found = F.struct(F.split(c, marker, -1).alias("gaps"), F.regexp_extract_all(c, F.lit(marker), F.lit(1)).alias("ids"))

    def clauses(p: Column) -> Column:
        gaps = p["gaps"]
        after = F.slice(gaps, 2, F.size(gaps))
        if variant == "mixed":
            pairs = F.slice(F.arrays_zip(p["ids"].alias("id"), after.alias("text"), gaps.alias("before")), 1, F.size(gaps) - 1)
            pairs = F.transform(pairs, lambda x: F.struct(F.lower(x["id"]).alias("id"), strip(F.regexp_replace(x["text"], r"(?U)\s+", " ")).alias("text"), F.lower(F.right(x["before"], F.lit(20))).alias("before")))
            kept = F.filter(pairs, lambda x: (F.length(x["text"]) > 15) & ~x["before"].rlike(r"\b(and|or|to|sections?|clauses?)\s*$"))
            return F.transform(kept, lambda x: F.struct(x["id"].alias("id"), x["text"].alias("text")))
        pairs = F.zip_with(p["ids"], after, lambda k, body: F.struct(k.alias("id"), strip(body).alias("text")))
        return F.filter(pairs, lambda x: x["text"] != "")

    return once(found, clauses)


def before_first(c: Column | str, marker: str) -> Column:
    return strip(F.get(F.split(col(c), marker, 2), F.lit(0)))


def extract_subsections(c: Column | str) -> Column:
    """array<struct<id,text,clauses>>: numbered subsections with their lettered clauses; letters alone are promoted."""
    c = F.coalesce(col(c), F.lit(""))
    letters, none = CLAUSE_MARKERS["letter"], F.array().cast("array<struct<id:string,text:string>>")
    found = F.struct(F.split(c, CLAUSE_MARKERS["number"], -1).alias("gaps"), F.regexp_extract_all(c, F.lit(CLAUSE_MARKERS["number"]), F.lit(1)).alias("ids"))
    one = lambda k, body: F.struct(k.alias("id"), before_first(body, letters).alias("text"), extract_clauses(body, "letter").alias("clauses"))
    numbered = once(found, lambda p: F.zip_with(p["ids"], F.slice(p["gaps"], 2, F.size(p["gaps"])), one))
    promoted = F.transform(extract_clauses(c, "letter"), lambda p: F.struct(p["id"].alias("id"), p["text"].alias("text"), none.alias("clauses")))
    return F.when(c.rlike(CLAUSE_MARKERS["number"]), numbered).otherwise(promoted)


def main_content(c: Column | str, variant: str = "flat", title: Column | str | None = None) -> Column:
    """Text before the first clause marker, without a repeated title at its start, on one line."""
    body = before_first(F.coalesce(col(c), F.lit("")), CLAUSE_MARKERS[variant])
    if title is not None:
        t = text(title)
        body = F.when((t != "") & F.startswith(F.lower(body), F.lower(t)), F.regexp_replace(F.substr(body, F.length(t) + 1), r"^[\s.:—-]+", "")).otherwise(body)
    return strip(F.regexp_replace(body, r"(?U)\s*\n\s*", " "))


# --- model answers ---


def format_answer(c: Column | str) -> Column:
    kept = F.array_join(F.filter(F.split(col(c), "\n"), lambda x: strip(x) != ""), "\n")
    return F.when(F.coalesce(col(c), F.lit("")) == "", "No answer generated.").otherwise(strip(kept))


def parse_yes_no(c: Column | str, prefix: int = 500) -> Column:
    """yes, no or empty: `answer yes|no` at the start, then the first whole word of the two."""
    s = F.substring(F.lower(text(c)), 1, prefix)
    fixed = F.regexp_extract(s, r"(?U)^answer\s+(yes|no)(?:\s|$)", 1)
    return F.when(fixed != "", fixed).otherwise(F.regexp_extract(s, r"(?U)\b(yes|no)\b", 1))


def gold_section(c: Column | str) -> Column:
    c = F.coalesce(col(c), F.lit(""))
    found = F.regexp_extract(c, r"(?iU)Section\s+(\w+)", 1)
    return strip(F.lower(F.when(found != "", found).otherwise(c)))


def subqueries(answer: Column | str, query: Column | str) -> Column:
    """Up to four listed questions (- * • or a number in front, more than ten characters), else the query itself."""
    lines = F.filter(F.transform(F.split(F.coalesce(col(answer), F.lit("")), "\n"), strip), lambda x: x.rlike(r"^[-*•\d]"))
    after = lambda x, mark: F.when(F.contains(x, F.lit(mark)), F.regexp_extract(x, rf"(?s)^[^{mark}]*\{mark}(.*)$", 1)).otherwise(x)
    last = lambda x: F.element_at(F.split(x, r"\)", 2), -1)
    cleaned = F.transform(lines, lambda x: strip(F.when(x.rlike(r"^\d"), last(after(x, "."))).otherwise(F.substr(x, F.lit(2)))))
    good = F.slice(F.filter(cleaned, lambda x: F.length(x) > 10), 1, 4)
    return F.when(F.size(good) > 0, good).otherwise(F.array(col(query)))


ADVICE = "directAnswer string, legalBasis array<struct<citation:string,explanation:string>>, whatThisMeans string, nextSteps array<string>, disclaimer string"


def parse_advice(c: Column | str) -> Column:
    """Struct of a model's JSON advice, null if there is none; at most eight legal bases with both fields."""
    raw = text(c)
    fenced = strip(F.regexp_extract(raw, r"(?is)```(?:json)?\s*(.*?)```", 1))
    outer = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    got = F.from_json(F.when(fenced.startswith("{"), fenced).otherwise(outer), ADVICE, {"mode": "PERMISSIVE"})
    none = F.array().cast("array<struct<citation:string,explanation:string>>")
    basis = F.slice(F.filter(F.coalesce(got["legalBasis"], none), lambda b: b["citation"].isNotNull() & b["explanation"].isNotNull()), 1, 8)
    steps = F.filter(F.coalesce(got["nextSteps"], F.array().cast("array<string>")), lambda s: s.isNotNull())
    rest = {k: F.coalesce(got[k], F.lit("")) for k in ("whatThisMeans", "disclaimer")}
    full = F.struct(got["directAnswer"].alias("directAnswer"), basis.alias("legalBasis"), rest["whatThisMeans"].alias("whatThisMeans"), steps.alias("nextSteps"), rest["disclaimer"].alias("disclaimer"))
    return F.when(got["directAnswer"].isNotNull(), full)


def advice_satisfactory(c: Column | str) -> Column:
    """True if the advice can be read and answers directly."""
    return F.coalesce(text(parse_advice(c)["directAnswer"]) != "", F.lit(False))


# --- keys ---


def collapsed(c: Column | str) -> Column:
    return strip(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"(?U)\s+", " "))


def input_key(c: Column | str) -> Column:
    return F.lower(collapsed(c))
