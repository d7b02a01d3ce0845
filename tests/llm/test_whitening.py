"""Whitening against exact arithmetic on whole tables."""

import math
import random

import numpy as np
import pytest

from legalspark.llm.whitening import products, whiten


def brute(rows):
    """n, the integers, deviations and the covariance, with Python's integers."""
    x = [[math.floor(1024 * c) + 100_000 for c in v] for v in rows]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    z = [[n * r[j] - s[j] for j in range(d)] for r in x]
    cov = np.array([[sum(r[i] * r[j] for r in z) / n**3 for j in range(d)] for i in range(d)])
    return n, z, [sum(c * c for c in r) for r in z], cov


def test_products_of_bit_planes():
    rng = np.random.default_rng(1)
    for low, high, n in ((0, 1, 5), (-7, 9, 64), (90_000, 110_000, 1000), (-(2**40), 2**40, 130), (5, 6, 3)):
        x = rng.integers(low, high, (n, 6))
        sums, cross = products(x)
        assert list(sums) == [sum(map(int, c)) for c in x.T]
        assert cross.tolist() == [[sum(int(a) * int(b) for a, b in zip(p, q, strict=True)) for q in x.T] for p in x.T]


def test_against_exact_arithmetic(spark):
    rng = random.Random(2)
    good = [[rng.gauss(0, 0.1 * (j + 1)) for j in range(12)] for _ in range(150)]
    good += [good[0]] * 300  # a hot vector
    rows = [(k, v, "x") for k, v in enumerate(good)]
    rows += [(900, None, "x"), (901, [], "x"), (902, [1.0, None] + [0.0] * 10, "x"), (903, [float("nan")] * 12, "x"), (904, [float("inf")] + [0.0] * 11, "x"), (905, [1.0, 2.0], "x")]
    rows += [(3, good[3], "x"), (None, good[4], "x")]
    good += [good[3], good[4]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, whitened string").repartition(5)
    found = whiten(table).collect()
    n, z, deviations, cov = brute(good)
    values, vectors = np.linalg.eigh(cov)
    assert len(found) == n * 8
    by = {}
    for r in found:
        by.setdefault(r["component"], []).append(r)
        assert r["n"] == n and r["identity_error"] < 1e-9 and r["explained"] == pytest.approx(values[-r["component"]] / np.trace(cov), rel=1e-9)
    for c in range(1, 9):
        want = (np.array(z, float) / n) @ vectors[:, -c] / np.sqrt(values[-c])
        of = {i: (float(w), d) for i, w, d in zip([r[0] for r in rows[:450]], want, deviations, strict=False)}
        own = {r["vec_id"]: r for r in by[c]}
        sign = 1 if own[7]["whitened"] * of[7][0] > 0 else -1
        for i, (w, d) in of.items():
            assert own[i]["whitened"] == pytest.approx(sign * w, rel=1e-6, abs=1e-9) and own[i]["deviation"] == d


def test_very_large_entries_and_few_rows(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert whiten(frame([])).count() == 0
    assert whiten(frame([(1, None), (2, [])])).count() == 0
    assert whiten(frame([(1, [1.0, 2.0])] * 5)).count() == 0  # no variance
    found = whiten(frame([(1, [1e30, 0.0]), (2, [0.0, 1.0]), (3, [-1e30, 1.0])])).collect()
    assert len(found) == 3 and all(r["deviation"] is None or r["deviation"] >= 0 for r in found) and any(r["deviation"] is None for r in found)
