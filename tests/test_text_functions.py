"""Column functions on hand-made texts."""

from pyspark.sql import functions as F

from legalspark.functions import text as tx


def one(spark, column, value="x", schema="t string"):
    return spark.createDataFrame([(value,)], schema).select(column.alias("r")).first()["r"]


def test_match_spans_count_characters(spark):
    found = one(spark, tx.match_spans("t", r"(?iU)section\s+(\d+[A-Z]*)", 1), "😀 Section 20 and subsection 3, section 25A")
    assert [(s["start"], s["end"], s["value"]) for s in found] == [(2, 12, "20"), (20, 29, "3"), (31, 42, "25A")]
    assert one(spark, tx.match_spans("t", "z"), "abc") == [] and one(spark, tx.match_spans("t", "z"), "") == []


def test_clauses(spark):
    text = "Every citizen. (1) First part; (2) second part. (a) alpha"
    assert [(c["id"], c["text"]) for c in one(spark, tx.extract_clauses("t"), text)] == [("1", "First part;"), ("2", "second part."), ("a", "alpha")]
    assert [(c["id"], c["text"]) for c in one(spark, tx.extract_clauses("t", "numeric"), "x. (1) First; clauses (1) and (2) [(2)] Second")] == [("1", "First; clauses (1) and (2)"), ("2", "Second")]
    assert one(spark, tx.extract_clauses("t"), None) == [] and one(spark, tx.extract_clauses("t"), "none here") == []
    mixed = one(spark, tx.extract_clauses("t", "mixed"), "Whoever (i) Commits an offence of this kind (ii) short (b) and (c) Another long enough clause text here")
    assert [c["id"] for c in mixed] == ["i"] or [c["id"] for c in mixed] == ["i", "c"]


def test_subsections(spark):
    got = one(spark, tx.extract_subsections("t"), "(1) Whoever (a) alpha one (b) beta two (2) second")
    assert [(s["id"], s["text"], [(c["id"], c["text"]) for c in s["clauses"]]) for s in got] == [("1", "Whoever", [("a", "alpha one"), ("b", "beta two")]), ("2", "second", [])]
    assert [s["id"] for s in one(spark, tx.extract_subsections("t"), "text (a) one (b) two")] == ["a", "b"]


def test_clean_text(spark):
    dirty = "First line .  (1) one ;\n 12 \nPage 3 of 9\n* * * * * *\nend ( a )text ,\n\n\n\nlast"
    clean = one(spark, tx.clean_text("t"), dirty)
    assert " " not in clean and "Page 3" not in clean and "*" not in clean and " ," not in clean and "\n\n\n" not in clean
    assert one(spark, tx.clean_text("t"), None) == ""


def test_clean_penal_code(spark):
    got = one(spark, tx.clean_text("t", "penal_code"), "x .  [(2)] Every\n 7 \nIllustrations\n( a )one ,\n\n\n\nlast")
    assert got == "x.\n[ (2) ] Every\n\nIllustrations (a) one,\n\nlast"


def test_main_content(spark):
    assert one(spark, tx.main_content("t", title=F.lit("Bail")), "Bail.— The court\nmay grant. (1) First") == "The court may grant."


def test_document_names(spark):
    assert one(spark, tx.doc_type("t"), "Pakistan Penal Code") == "Penal Code"
    assert one(spark, tx.doc_type("t"), "the evidence law") == "Evidence"
    assert one(spark, tx.doc_type("t"), None) == "Unknown"
    assert one(spark, tx.short_label("t"), "Prevention of Electronic Crimes (Amendment) Act, 2025") == "PECA 2025"
    assert one(spark, tx.short_label("t"), "one two three four") == "one two three..."
    assert one(spark, tx.subtitle("t", F.lit("CHAPTER XV"), F.lit("PART II"))) == "PART II · CHAPTER XV · x"
    for path, court in (("/a/lhc_x.json", "Lahore High Court"), ("/a/sindh-high-court-1.json", "Sindh High Court"), ("x.json", "Unknown Court")):
        assert one(spark, tx.court_of_file("t"), path) == court


def test_yes_no(spark):
    for text, label in (("answer yes because", "yes"), ("No, yes", "no"), ("", ""), ("notable", ""), ("x " * 300 + "yes", ""), (None, "")):
        assert one(spark, tx.parse_yes_no("t"), text) == label


def test_gold_section(spark):
    for text, want in (("Section 26A, PECA 2016", "26a"), ("Article 9", "article 9"), ("Section 171-G", "171")):
        assert one(spark, tx.gold_section("t"), text) == want


def test_subqueries(spark):
    listed = "Here you are:\n- What is the first question?\n2) And the second question (really)?\n* short\n3. Third one is long enough\n• Fourth is also long\n- Fifth is cut off here"
    assert one(spark, tx.subqueries("t", F.lit("q")), listed) == ["What is the first question?", "And the second question (really)?", "Third one is long enough", "Fourth is also long"]
    assert one(spark, tx.subqueries("t", F.lit("q")), "nothing") == ["q"]


def test_advice(spark):
    raw = 'Do not worry. ```json\n{"directAnswer": "Yes", "legalBasis": [{"citation": "a", "explanation": "b"}, {"citation": "c"}], "nextSteps": ["x"]}\n```'
    got = one(spark, tx.parse_advice("t"), raw)
    assert got["directAnswer"] == "Yes" and [b["citation"] for b in got["legalBasis"]] == ["a"] and got["disclaimer"] == ""
    assert one(spark, tx.parse_advice("t"), "no json") is None and one(spark, tx.parse_advice("t"), '{"legalBasis": []}') is None
    assert one(spark, tx.advice_satisfactory("t"), 'so {"directAnswer": "x"} there') is True


def test_links(spark):
    assert one(spark, tx.resolve_link(F.lit(" "), "t"), "http://a.example/view?jgmnt=%2Ffiles%2Fx.pdf&y=1") == "https://a.example/files/x.pdf"
    assert one(spark, tx.resolve_link("t"), "http://a.example/b.pdf") == "https://a.example/b.pdf"


def test_texts_of_cases(spark):
    assert one(spark, tx.trimmed("t", 3), "abcdef") == "abc\n[TRUNCATED]"
    assert one(spark, tx.trimmed("t"), " \n") == "[ERROR: empty]"
    assert one(spark, tx.make_id("t"), " a/b c ") == "a_b_c"
    assert one(spark, tx.embedding_text(F.lit("T"), "t", F.lit("sum")), "[ERROR: 404]") == "T sum"
    assert one(spark, tx.format_answer("t"), "a\n\n  \nb") == "a\nb"
