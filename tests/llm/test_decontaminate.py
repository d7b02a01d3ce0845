"""Wu-Manber search against a plain one, in one pass and in many."""

import hashlib
import random
import re

import pytest

from legalspark.llm.decontaminate import WuManber, decontaminate, search_tables, words_of

LOWER = {i: i + 32 for i in range(65, 91)}


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items):
    out = []
    for i, text in docs:
        words, hit, found = plain_words(text), set(), set()
        for item, t in items:
            w = plain_words(t)
            m = min(10, len(w))
            if not m:
                continue
            windows = {tuple(w[k : k + m]) for k in range(len(w) - m + 1)}
            for k in range(len(words) - m + 1):
                if tuple(words[k : k + m]) in windows:
                    hit.update(range(k, k + m))
                    found |= {str(item)} if item is not None else set()
        out.append((i, len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("per_pass", [1_000_000, 40])
def test_against_a_plain_search(spark, per_pass):
    rng = random.Random(per_pass)
    word = lambda: rng.choice(("The", "of", "and", "Straße", "x1", "don", "naïve", "zz"))
    text = lambda n: "".join(word() + rng.choice((" ", "-", "\n", "... ", "'")) for _ in range(n))
    items = [(k, text(rng.choice((1, 2, 3, 9, 10, 11, 40)))) for k in range(25)] + [(100, None), (101, " ?! "), (None, text(12)), (3, text(15)), (200, "DON")]
    docs = [(k, text(rng.randint(0, 60))) for k in range(150)] + [(500 + k, text(8) + items[k][1] + text(8)) for k in range(25)] + [(999, None), (998, ""), (0, text(5)), (997, "the " * 30_000)]
    got = decontaminate(spark.createDataFrame([(a, b, "s") for a, b in docs], "doc_id long, text string, spans string"), spark.createDataFrame(items, "item_id long, text string"), per_pass=per_pass)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, items)


def test_tables_skip():
    table = WuManber({b"a b c d e f g h i j": {"1"}})
    assert table.far == 9 and table.shift[b"i j"] == 0 and table.shift[b"a b"] == 8
    assert [t.size for t in search_tables([("one two", "1"), ("x x x", None)])] == [2, 3]
    assert words_of("Ab-C_9 é\x7fq") == [b"ab", b"c", b"9", "é".encode(), b"q"]


def test_an_item_without_id_is_hit(spark):
    docs = spark.createDataFrame([(1, "x one two three y"), (None, "one two three"), (2, "one two")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "One, two: three!")], "item_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], r["n_items"], r["contaminated"]) for r in decontaminate(docs, items).collect()}
    assert got == {1: (3, 0, True), None: (3, 0, True), 2: (0, 0, False)}


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(docs, items).first()["contaminated"] is False
    assert decontaminate(docs.limit(0), items).count() == 0
