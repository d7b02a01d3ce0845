"""Stored tables: changes write only what they touch, and a lost job changes nothing."""

import os

import pytest

from legalspark.sources import buckets, tables


def files(path):
    return {os.path.join(d, f) for d, _, fs in os.walk(f"{path}/data") for f in fs if f.endswith(".parquet")}


def named(spark, path):
    """Names of the files that a reader of the table opens."""
    return {f.rpartition("/data/")[2] for f in buckets.read(spark, path).inputFiles()}


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_merge_touches_few_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    old = spark.createDataFrame([(k, f"v{k}") for k in range(200)], "id int, v string")
    buckets.create(old, path, "id", 32)
    before, kept = named(spark, path), files(path)
    new = spark.createDataFrame([(3, "x"), (500, "y"), (3, "w")], "id int, v string")
    v = buckets.merge(spark, path, new, order="v")
    want = {k: f"v{k}" for k in range(200)} | {3: "x", 500: "y"}
    assert rows(buckets.read(spark, path)) == sorted(want.items())
    after = named(spark, path)
    touched = {f"{b}" for b in buckets._touched(new, v)}
    assert kept <= files(path) and len(touched) <= 2
    assert {f for f in before if f.split("_bucket=")[1].split("/")[0] not in touched} == {f for f in after if f.split("_bucket=")[1].split("/")[0] not in touched}
    assert rows(buckets.read(spark, path)) == rows(tables.upsert(old, new, "id", "v"))
    buckets.replace(spark.createDataFrame([(1, "only")], "id int, v string"), path)
    assert rows(buckets.read(spark, path)) == [(1, "only")]
    assert rows(buckets.read(spark, v)) == sorted(want.items())  # an older version is still whole
    buckets.merge(spark, path, new.limit(0))
    assert rows(buckets.read(spark, path)) == [(1, "only")]


def test_a_lost_job_leaves_the_old_state(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    buckets.create(spark.createDataFrame([(k, "a") for k in range(20)], "id int, v string"), path, "id", 4)
    old, seen = rows(buckets.read(spark, path)), buckets.current(spark, path)

    def lost(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(buckets, "_publish", lost)
        with pytest.raises(OSError):
            buckets.merge(spark, path, spark.createDataFrame([(1, "b")], "id int, v string"))
    assert rows(buckets.read(spark, path)) == old
    buckets.merge(spark, path, spark.createDataFrame([(1, "b")], "id int, v string"))
    with pytest.raises(RuntimeError):  # a writer that started from the old version comes too late
        buckets._replace(spark, seen, [], None)
    assert rows(buckets.read(spark, path))[1] == (1, "b")


def test_cascade(spark, tmp_path):
    make = lambda rows_, schema: spark.createDataFrame(rows_, schema)
    given = {
        "documents": make([("A",), ("B",), (None,)], "title string"), "articles": make([(f"{d}{k}", d) for d in "AB" for k in range(20)] + [("n", None)], "id string, document_title string"),
        "clauses": make([("k", "A1"), ("m", "B1")], "id string, article_id string"), "subclauses": make([("s", "k"), ("t", "m")], "id string, clause_id string"),
        "cites": make([("A1", "B1"), ("B1", "A2"), ("B1", "B2"), ("B3", "B4")], "src string, dst string"), "case_cites": make([("c", "A1"), ("c", "B1")], "case_id string, article_id string"),
    }
    by = {"documents": "title", "articles": "document_title", "clauses": "article_id", "subclauses": "clause_id", "cites": "src", "case_cites": "article_id"}
    for n, df in given.items():
        buckets.create(df, f"{tmp_path}/{n}", df.columns[:2] if n.endswith("cites") else df.columns[0], 8, by[n])
    kept = named(spark, f"{tmp_path}/cites")
    buckets.delete_document(spark, str(tmp_path), "A", list(given))
    want = tables.delete_document(given, "A")
    for n in given:
        key = lambda r: str(tuple(r))
        assert sorted(buckets.read(spark, f"{tmp_path}/{n}").collect(), key=key) == sorted(want[n].collect(), key=key), n
    assert named(spark, f"{tmp_path}/cites") != kept
    with pytest.raises(KeyError):
        buckets.delete_document(spark, str(tmp_path), "Z", list(given))
