"""Near-duplicate groups against a brute-force version: groups around the threshold, shared passages, awkward rows."""

import random
import re

import numpy as np
import pytest

from legalspark.llm import minhash
from legalspark.llm.components import connected_components
from legalspark.llm.minhash import near_duplicates

LOWER = {i: i + 32 for i in range(65, 91)}


def brute(rows, percent):
    sets, parent = {}, {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.setdefault(i, set()).add(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
        parent[i] = i

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if any(100 * len(a & b) >= percent * len(a | b) for a in sets[i] for b in sets[j] if a and b):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}, {i: len(next(iter(s))) for i, s in sets.items()}


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    text = lambda n: [word() for _ in range(n)]
    base, passage, rows = text(150), text(60), []
    for _ in range(120):  # a group of texts that differ, around the threshold
        t = list(base)
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(len(t))] = word()
        rows.append(" ".join(t))
    rows += [" ".join(text(rng.randint(5, 60)) + passage + text(rng.randint(5, 60))) for _ in range(80)]
    rows += [rows[0]] * 40 + [rows[130]] * 3
    rows += ["", None, " \n\t", "one", "one", "two words", "Two  WORDS", "a b c d", "a b c d e", "A b c d e f", " ".join(text(30_000))]
    rng.shuffle(rows)
    return [(k * 3 + 1, t) for k, t in enumerate(rows)]


@pytest.mark.parametrize(("percent", "block"), [(85, 1024), (80, 16)])
def test_groups_are_those_of_brute_force(spark, monkeypatch, percent, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = corpus(percent)
    component, size = brute(rows, percent)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, bands string, component long").repartition(5)
    found = near_duplicates(docs, percent).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (size[r["doc_id"]], component[r["doc_id"]], component[r["doc_id"]] == r["doc_id"]), r
    assert len({c for c in component.values()}) < len(rows) - 100


def test_repeated_rows_null_ids_and_an_empty_table(spark):
    schema = "doc_id long, text string"
    found = near_duplicates(spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (7, "a b c d e f")], schema), 85).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in found) == [(0, 0, True), (5, 5, True), (5, 5, True), (7, 5, False)]
    assert near_duplicates(spark.createDataFrame([], schema), 85).count() == 0


def test_bands_and_looks_keep_to_the_miss_probability():
    for similarity in (0.8, 0.85, 0.9):
        bands, rows = minhash.bands_for(similarity)
        assert (1 - similarity**rows) ** bands <= minhash.MISS and bands * rows <= minhash.HASHES
        assert all(0 < m < n for n, m in minhash.least_matches(similarity))


def test_minhashes_estimate_similarity():
    pool = minhash.mix(np.arange(3000, dtype=np.uint64))
    a, b = np.sort(pool[:2000]), np.sort(pool[500:2500])
    _, sketch = minhash.signatures([a, b], *minhash.bands_for(0.85))
    assert abs((sketch[0] == sketch[1]).mean() - 0.6) < 0.13


def test_long_texts_are_hashed_alike_in_pieces(monkeypatch):
    texts = [("Some words here " * 5000)[:-1], "", "x", " \n"]
    whole, sizes = minhash.word_hashes(texts)
    monkeypatch.setattr(minhash, "CHUNK", 1000)
    pieces, again = minhash.word_hashes(texts)
    assert (whole == pieces).all() and sizes == again == [15000, 0, 1, 0] and len(set(whole.tolist())) == 4


def test_words_that_collide_in_polynomial_hashes():
    row = "a"
    for _ in range(11):
        row += row.translate({97: 98, 98: 97})
    other = row.translate({97: 98, 98: 97})  # equal sums of powers of any odd base modulo 2**64
    a, b = minhash.shingle_sets([row, other])
    assert len(row) == 2048 and a[0] != b[0]


def test_one_id_with_several_texts(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(1, a), (5, a), (5, b), (9, b + " more"), (7, c), (8, c), (5, b), (None, c)]
    found = sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect())
    assert found == [(0, 0, True), (1, 1, True), (5, 1, False), (5, 1, False), (5, 1, False), (7, 7, True), (8, 7, False), (9, 1, False)]


def test_large_buckets_need_few_comparisons(spark, monkeypatch):
    """Near copies of two texts that share most words: further leaders settle them, and blocks stay few."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    dealt = []
    across = minhash._across
    monkeypatch.setattr(minhash, "_across", lambda buckets, *rest: dealt.append(buckets.count()) or across(buckets, *rest))
    rng = random.Random(4)
    base = [f"w{k}" for k in range(200)]
    other = base[:170] + [f"v{k}" for k in range(30)]
    rows = []
    for k in range(160):
        t = list(base if k % 2 else other)
        t[rng.randrange(200)] = f"x{k}"
        rows.append((k, " ".join(t)))
    component, _ = brute(rows, 85)
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == component


@pytest.mark.parametrize("few", [0, 1_000_000])
def test_components_of_a_long_chain_and_a_star(spark, monkeypatch, few):
    monkeypatch.setattr("legalspark.llm.components.FEW", few)
    edges = [(k, k + 1) for k in range(1, 60)] + [(1000, k) for k in range(1001, 1100)] + [(5000, 4999), (4999, 5000)]
    random.Random(3).shuffle(edges)
    found = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{k: 1 for k in range(1, 61)}, **{k: 1000 for k in range(1000, 1100)}, 4999: 4999, 5000: 4999}
