"""Many small files: who writes them, who asks for them, how often they are read."""

import json

from pyspark.sql import functions as F

from legalspark.plans import text_queries
from legalspark.sources import tables


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_files_are_dealt_to_all_partitions(spark):
    rows = spark.range(200).select("id", (F.col("id") % 40).alias("k"))
    got = text_queries._collected(rows, {"k": F.col("k")}, F.struct("id"), "records")
    assert got.rdd.getNumPartitions() == 4 and sorted(len(r["records"]) for r in got.collect()) == [5] * 40


def test_manifest_lists_a_folder_once_and_reads_files_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "ASKED", 2)
    data = tmp_path / "in"
    for at in (data, data / "inner.json"):
        at.mkdir()
    names = ["a.json", "b c.json", "d%20.json", "é.json"]
    for n in names:
        (data / n).write_text(json.dumps({"document": {"title": n, "articles": [{"article_number": "1"}]}}))
    (data / "inner.json" / "own.json").write_text(json.dumps({"document": {"title": "inner", "articles": []}}))
    (data / "bad.json").write_text("{broken")
    listed = [f"{data}/{n}" for n in [*names, "bad.json", "own.json", "none.json", "inner.json"]] + [f"file://{data}/a.json"] + [f"{tmp_path}/no/{k}" for k in range(3)]
    assert tables._existing(spark, sorted(listed)) == {f"{data}/{n}" for n in [*names, "bad.json", "inner.json"]} | {f"file://{data}/a.json"}
    (tmp_path / "list.json").write_text(json.dumps(listed))
    good, bad = tables.read_manifest(spark, str(tmp_path / "list.json"))
    assert {r["title"] for r in good.collect()} == {*names, "inner"}
    assert sorted(r["reason"] for r in bad.collect()) == ["not a statute"] + ["not found"] * 5
    assert "FileScan json" not in _plan(good) and "FileScan json" not in _plan(bad)
