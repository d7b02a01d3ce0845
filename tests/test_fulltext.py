"""The stored index against BM25 in Python, with and without pruning."""

import math
import random
import re
from collections import Counter

import pytest

from legalspark.operators import fulltext, retrieval


def corpus(n=3000):
    """Texts on ten subjects with words of their own and common ones, in order of subject; some are empty."""
    rng = random.Random(3)
    rows = []
    for k in range(n):
        subject = k * 10 // n
        own, common = [f"s{subject}w{rng.randint(0, 60)}" for _ in range(rng.randint(0, 12))], [f"c{rng.randint(0, 8)}" for _ in range(rng.randint(0, 30))]
        rows.append((k, " ".join(own + common)))
    return [*rows, (n, None), (n + 1, ""), (n + 2, "été Straße c1"), (n + 3, "c1 " * 400)]


def plain(rows, questions, k, digits):
    words = {i: Counter(w for w in (t or "").lower().split() if w) for i, t in rows}
    mean, n = sum(sum(c.values()) for c in words.values()) / len(rows), len(rows)
    df = Counter(w for c in words.values() for w in c)
    out = []
    for q, t in questions:
        scores = {}
        for w in set((t or "").lower().split()):
            for i, c in words.items():
                if w in c:
                    length = sum(c.values())
                    scores[i] = scores.get(i, 0) + math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * length / mean))
        best = sorted((-round(s, digits), i) for i, s in scores.items())[:k]
        out += [(q, i, -s, r) for r, (s, i) in enumerate(best, 1)]
    return out


def test_ranks_and_skipped_blocks(spark, tmp_path):
    rows, rng = corpus(), random.Random(4)
    questions = [(q, " ".join([f"s{q % 10}w{rng.randint(0, 60)}" for _ in range(3)] + ["c1", "c2", "C3"])) for q in range(12)] + [(50, None), (51, "unknown"), (52, "c1 c1 c4"), (53, "ÉTÉ straße")]
    index = fulltext.build_index(spark.createDataFrame(rows, "id long, content string").coalesce(1), path=str(tmp_path / "index"))
    assert fulltext.open_index(spark, str(tmp_path / "index")) == index and index.n == len(rows)
    asked = spark.createDataFrame(questions, "query_id long, text string").repartition(3)
    want = plain(rows, questions, 5, 6)
    plainly = fulltext.search(asked, index, 5, digits=6)
    pruned, report = fulltext.search(asked, index, 5, digits=6, report=True)
    for found in (plainly, pruned):
        got = sorted(((r["query_id"], r["id"], r["score"], r["rank"]) for r in found.collect()), key=lambda r: (r[0], r[3]))
        assert [(q, i, r) for q, i, _, r in got] == [(q, i, r) for q, i, _, r in want]
        assert [s for *_, s, _ in got] == pytest.approx([s for *_, s, _ in want], abs=2e-6)
    read = {r["query_id"]: (r["blocks"], r["read"]) for r in report.collect()}
    assert sum(a for a, _ in read.values()) > 2 * sum(b for _, b in read.values()), read  # most blocks are skipped


def test_an_index_that_is_made_on_the_way_and_an_empty_corpus(spark):
    asked = spark.createDataFrame([(1, "bail law")], "query_id int, text string")
    docs = spark.createDataFrame([("x", "Bail", "law"), ("y", "other", None)], "id string, title string, summary string")
    assert [(r["id"], r["rank"]) for r in retrieval.keyword_search(asked, docs, ("title", "summary")).collect()] == [("x", 1)]
    assert retrieval.keyword_search(asked, docs.limit(0), ("title",)).count() == 0


def test_sums_by_document_shuffle_no_questions(spark, tmp_path, monkeypatch):
    """Many copies, ids as strings, few sums at once: the ranks are those of the joins, without rows of questions times documents."""
    rng = random.Random(5)
    rows = [(f"d{k:04}", f"c{k % 7} c{k % 3} " + ("x y y" if k % 2 else f"w{rng.randint(0, 99)}")) for k in range(900)] + [("e", None), ("", "c1 c2 x")]
    questions = [(q, f"c{q % 7} x y w{q} C1") for q in range(20)] + [(None, "c1"), (30, "nothing")]
    index = fulltext.build_index(spark.createDataFrame(rows, "id string, content string").repartition(5), path=str(tmp_path / "index"), bounds=False)
    asked = spark.createDataFrame(questions, "query_id int, text string")
    key = lambda df: sorted(((r["query_id"], r["rank"], r["id"], r["score"]) for r in df.collect()), key=str)
    monkeypatch.setattr(fulltext, "CELLS", 500)
    found = fulltext.search(asked, index, 5, digits=6)
    assert not re.search(r"hashpartitioning\(query_id#\w+, id#", found._jdf.queryExecution().toString())
    got = key(found)
    monkeypatch.setattr(fulltext, "ASKED", 0)
    monkeypatch.setattr(fulltext, "DIRECT", 0)
    assert got == key(fulltext.search(asked, index, 5, digits=6)) and len(got) > 90
