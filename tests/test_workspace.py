"""Last writes as streaming state: restarts, updates, late writes and deletions give what the batch gives."""

from pyspark.sql import functions as F

from legalspark.streaming import workspace

SCHEMA = "id string, ts timestamp, seq long, deleted boolean, note string, cases array<string>"


def test_stream_with_restarts(spark, tmp_path):
    at = lambda k: f"2024-01-01 00:00:{k:02d}"
    runs = [
        [("a", at(1), 0, None, "first", ["x"]), ("b", at(1), 1, False, "b1", None), ("b", at(1), 2, False, "b2", []), ("c", at(5), 0, False, "c", ["y"]), (None, at(1), 0, None, "no id", None)],
        [("a", at(3), 0, False, "second", ["x", "z"]), ("c", at(6), 0, True, None, None), ("d", at(2), None, None, "d", None), ("e", None, 0, None, "no time", None)],
        [("a", at(2), 9, False, "late", None), ("c", at(4), 0, False, "late, too", None), ("d", at(9), 0, True, None, None), ("d", at(10), 0, False, "again", ["q"])],
    ]
    make = lambda rows: spark.createDataFrame(rows, "id string, ts string, seq long, deleted boolean, note string, cases array<string>").withColumn("ts", F.to_timestamp("ts"))
    key = lambda r: str(tuple(r))
    seen = []
    for rows in runs:
        seen += rows
        make(rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        workspace.stream_writes(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(180)
        got = workspace.read_writes(spark, str(tmp_path / "out"), "note string, cases array<string>").select("id", "ts", "seq", "note", "cases").collect()
        want = workspace.last_writes(make(seen)).select("id", "ts", "seq", "note", "cases").collect()
        assert sorted(got, key=key) == sorted(want, key=key)
    assert {r["id"]: r["note"] for r in got} == {"a": "second", "b": "b2", "d": "again"}
    late = spark.read.parquet(str(tmp_path / "out")).where("record like '%late%'")
    assert late.count() == 0  # the state keeps them out of the table
