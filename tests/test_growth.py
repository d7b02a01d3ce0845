"""What must not grow with a table: patterns per row, rows of a partition."""

from pyspark.sql import functions as F

from legalspark import values
from legalspark.functions import text as tx
from legalspark.operators import filters, graph, structure, vectors
from legalspark.sources import shared


def test_markers_start_with_what_they_look_for():
    assert all(tx.CLAUSE_MARKERS[v].startswith(r"(?U)\(") for v in ("flat", "number", "letter"))


def test_strip_takes_unicode_space(spark):
    df = spark.createDataFrame([("\u3000 a\u00a0b \u2028\n",), (" ",), (None,)], "t string")
    assert [r[0] for r in df.select(tx.strip("t")).collect()] == ["a\u00a0b", "", None]


def test_partitions_by_rows(spark, monkeypatch):
    monkeypatch.setattr(shared, "ROWS", 10)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with shared.dealt(spark, 95):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "10"
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_pairs_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(shared, "ROWS", 10)
    sized = spark.createDataFrame([(k, 0) for k in range(20)], "src long, dst long").withColumn("_n", F.lit(20))
    got = graph._paired(sized, False)
    assert got.rdd.getNumPartitions() == 19 and got.count() == 190


def test_triggers_compute_their_text_once(spark):
    df = spark.createDataFrame([("A  Cyber\nCrime of the FIA",), ("fiat",), (None,)], "t string")
    got = filters.classify_listing(df, "t")
    assert [[tuple(x) for x in r["triggers"]] for r in got.collect()] == [[("phrase", "cyber crime"), ("word_token", "fia")]]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") <= 4


def test_cases_of_all_courts_in_one_pass(spark):
    fields = "court string, case_title string, parties string, case_no string, lhc_citation string, phc_neutral_citation string, record_id string, remarks string, winner string, s_no string"
    names = [*values.COURTS.values(), "Unknown Court", "Other"]
    mixed = spark.createDataFrame([(n, f"t{k} ", f"p{k}", f"n{k}" if k % 2 else "__", f"c{k}" if k % 3 else None, f"phc {k}", f"r{k}", f"m{k}", " " if k else "x", "7") for k, n in enumerate(names * 3)], fields)
    got = structure.normalise_cases(mixed, list(values.COURTS.values()), ["s_no"])
    parts = [structure.normalise_case(mixed.where(F.col("court") == c), c, ["s_no"]) for c in values.COURTS.values()]
    parts.append(structure.normalise_case(mixed.where(~F.col("court").isin(list(values.COURTS.values()))), "Unknown Court", ["s_no"]))
    assert got.columns == parts[0].columns and sorted(map(repr, got.collect())) == sorted(repr(r) for p in parts for r in p.collect())


def test_each_text_is_searched_once(spark):
    t = "See Section 12A read with article 7 and clause (b), Order XIV. "
    df = spark.createDataFrame([(k, f"d{k % 2}", [t, t * 30, None, "none", "  section 3"][k % 5]) for k in range(20)], "id long, document_title string, content string")
    plain, once = graph.extract_references(df), graph.extract_references(df, once=True)
    assert once.columns == plain.columns and once.count() == 4 * (4 + 120 + 1)
    assert sorted(map(repr, once.collect())) == sorted(map(repr, plain.collect()))
    plan = once._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [_text" in plan[plan.index("Generate explode") :]


def test_clauses_are_ranked_without_broadcasts(spark):
    wanted = spark.createDataFrame([(1, 5, "content"), (2, 6, "b b"), (3, 7, "")], "query_id long, id long, content string")
    clauses = spark.createDataFrame([(f"5:{k}", 5, str(k), f"a{k} b") for k in range(5)], "id string, article_id long, clause_number string, text string")
    subs = spark.createDataFrame([("5:1", "2", "b"), ("5:1", "1", "c")], "clause_id string, sub_clause_number string, text string")
    asked = vectors.embed(spark.createDataFrame([(k, q) for k, q in enumerate(("", "a3 b", "b", "x"))], "query_id long, q string"), "q")
    got = vectors.relevant_clauses(wanted, clauses, subs, asked)
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
    texts = {t: vectors.hashing_encoder([t])[0] for t in ["a0 b", "a1 b c b", "a2 b", "a3 b", "a4 b", "b b", ""]}
    found = {(r["query_id"], r["rank"]): (r["text"], r["similarity"]) for r in got.collect()}
    assert len(found) == 5 and found[1, 1][0] == "a3 b" and found[3, 1] == ("", None)
    q = dict(enumerate(vectors.hashing_encoder(["", "a3 b", "b", "x"])))
    assert all(abs(s - float(texts[t] @ q[k])) < 1e-6 for (k, _), (t, s) in found.items() if s is not None)
