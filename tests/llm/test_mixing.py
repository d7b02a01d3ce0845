"""The mix against a plain version."""

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from legalspark.llm.mixing import SCHEDULES, mix, n_words, taken


def shares(sizes, weights):
    """Targets by name: shared by weight, the excess over three times a size shared again."""
    total, full = sum(sizes.values()), set()
    while True:
        rest = [s for s in sizes if s not in full]
        level = (total - sum(3 * sizes[s] for s in full)) / sum(weights[s] for s in rest) if rest else 0
        more = {s for s in rest if level * weights[s] > 3 * sizes[s]}
        if not more:
            return {s: 3 * sizes[s] if s in full else level * weights[s] for s in sizes}
        full |= more


def plain(rows):
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(count(t) for _, t, x in rows if x == s) for s in names}
    target = shares(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)})
    out = []
    for s in names:
        at = 0
        own = [r for r in rows if r[2] == s]
        for i, t, _ in sorted(own, key=lambda r: hashlib.md5(f"{'' if r[0] is None else r[0]} {r[1] or ''}".encode()).hexdigest()):
            size = count(t)
            got = sum(max(0, min(size, math.floor(target[s]) - at - e * sizes[s])) for e in range(3))
            at += size
            out.append((i, size, sizes[s], round(target[s], 6), got))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(5)
    sources = ["a", "b", None, "é", "zz", "", "big"]
    rows = [(k, " ".join("w" * rng.randint(1, 5) for _ in range(rng.randint(0, 40))), rng.choice(sources[:6]) if k % 3 else "big") for k in range(600)]
    rows += [(700, None, "a"), (701, "", "only empty"), (702, "\t \n", "only empty"), (703, "x\x0by\x0cz z", None), (704, "long " * 50_000, "b")]
    return rows + [(None, "no id", "a"), (None, "no id either", "a"), (3, rows[3][1], rows[3][2]), (3, "another text", "a")]


def test_against_a_plain_version(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, target int").repartition(6)
    stream = mix(docs)
    found = sorted(((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in taken(stream).collect()), key=str)
    assert found == plain(rows)
    for r in taken(stream).collect():
        assert r["taken"] <= 3 * r["size"]
    again = taken(mix(docs.repartition(2))).select("doc_id", "size", "taken", "first_position")
    key = lambda r: str(tuple(r))
    assert sorted(again.collect(), key=key) == sorted(taken(stream).select("doc_id", "size", "taken", "first_position").collect(), key=key)


def test_positions_follow_the_schedules(spark):
    """Of a source's words, the part before a time is the integral of its schedule up to then."""
    rows = [(k, "w " * 10, "abc"[k % 3]) for k in range(3000)]
    stream = [r for r in mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect() if r["words"]]
    positions = [r["position"] for r in stream]
    assert positions == sorted(positions) and 0 <= positions[0] and positions[-1] <= 1
    for name, (weight, knots) in zip("abc", SCHEDULES.items(), strict=True):
        own = [r for r in stream if r["source"] == name]
        total = sum(r["words"] for r in own)
        assert total == math.floor(own[0]["target"])
        for at in (0.1, 0.25, 0.5, 0.8, 1.0):
            area = sum((min(at, b[0]) - a[0]) * (a[1] + a[1] + (b[1] - a[1]) * (min(at, b[0]) - a[0]) / (b[0] - a[0])) / 2 for a, b in zip(knots, knots[1:]) if at > a[0])
            assert sum(r["words"] for r in own if r["position"] < at) / total == pytest.approx(area / weight, abs=0.006)


def test_own_schedules_and_an_empty_table(spark):
    docs = spark.createDataFrame([(k, "w w w", "ab"[k % 2]) for k in range(40)], "doc_id long, text string, source string")
    late = lambda sources: sources.withColumn("knots", F.when(F.col("source") == "a", F.expr("array(named_struct('at', 0.0D, 'weight', 0.0D), named_struct('at', 0.5D, 'weight', 0.0D), named_struct('at', 1.0D, 'weight', 2.0D))")))
    rows = mix(docs, late).collect()
    assert {r["source"] for r in rows if r["words"]} == {"a"} and sum(r["words"] for r in rows) == 120
    assert min(r["position"] for r in rows if r["words"]) >= 0.5
    assert mix(docs.limit(0)).count() == 0


def test_words(spark):
    texts = ["", " ", "a", " a  b\t\nc ", "\x1c\x1d", "a b c", "\x0b\x0c\r"]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "i int, text string").select("i", n_words(F.col("text")).alias("n")).collect()
    assert [r["n"] for r in sorted(got)] == [len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in texts]
