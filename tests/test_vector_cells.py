"""Cells of vectors: exact results, and cells that are not met."""

import random
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from legalspark.operators import vectors


def clustered(n, d=12, centres=20, seed=1):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, d))
    return [(k, (c[k % centres] + rng.normal(scale=0.08, size=d)).tolist(), ("a", None, "b")[k % 7 % 3]) for k in range(n)]


def unit(rows):
    m = np.array([v for _, v, _ in rows])
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def test_pairs_of_clustered_vectors(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 60)
    rows = clustered(700) + [(900, None, "a"), (901, [0.0] * 12, "a")]
    table = spark.createDataFrame(rows, "id long, embedding array<double>, s string").repartition(4)
    m = unit(rows[:700])
    near = m @ m.T
    want = {(i, j) for i in range(700) for j in range(i + 1, 700) if near[i, j] >= 0.9}
    got = vectors.similar_pairs(table, 0.9).select("id1", "id2").collect()
    assert len(got) == len(set(got)) == len(want) and {tuple(r) for r in got} == want
    scoped = vectors.similar_pairs(table, 0.9, scope="s").select("id1", "id2").collect()
    assert sorted(map(tuple, scoped)) == sorted((i, j) for i, j in want if rows[i][2] is not None and rows[i][2] == rows[j][2])


def test_far_cells_are_not_visited(spark):
    rows = clustered(2000, centres=8, seed=3)
    own = spark.createDataFrame(rows, "id long, v array<double>, s string").select("id", "v", F.lit(0).alias("scope"))
    pivots = vectors._pivots(own, 2000)
    met = vectors._visits(vectors._nearest(own, pivots), pivots, 0.9).select("cell", F.explode("visits").alias("to"))
    cells, visited = met.select("cell").distinct().count(), met.distinct().count()
    assert cells > 8 and visited < 0.5 * cells * (cells + 1) / 2  # of all pairs of cells, most are skipped


def test_search_of_cells(spark, tmp_path):
    rows = clustered(900, centres=6, seed=2) + [(k, [0.5] * 12, "x") for k in range(950, 970)]
    asked = [(k, v) for k, v, _ in rows[::100]] + [(5000, [float(x) for x in np.random.default_rng(4).normal(size=12)]), (5001, None), (5002, [0.5] * 12)]
    random.Random(1).shuffle(rows)
    cells = vectors.build_cells(spark.createDataFrame(rows, "id long, embedding array<double>, s string").repartition(5), path=str(tmp_path / "cells"))
    queries = spark.createDataFrame(asked, "query_id long, embedding array<double>")
    found, read = vectors.search_cells(queries, cells, 5, report=True)
    m, ids = unit(rows), np.array([r[0] for r in rows])
    want = []
    for q, v in asked:
        if v:
            s = np.round(m @ (np.array(v) / np.linalg.norm(v)), 12)
            want += [(q, int(ids[k]), r) for r, k in enumerate(np.lexsort((ids, -s))[:5], 1)]
    assert sorted((r["query_id"], r["id"], r["rank"]) for r in found.collect()) == sorted(want)
    counts = {r["query_id"]: r["cells"] for r in read.collect()}
    assert sum(counts[k] for k, *_ in asked[:9]) < 0.5 * 9 * len(cells.sizes), (counts, len(cells.sizes))
    assert vectors.search_cells(queries, vectors.build_cells(spark.createDataFrame([], "id long, embedding array<double>")), 5).count() == 0


def test_a_search_holds_strips(spark):
    """The nearest of many questions among many vectors, without the whole matrix of similarities, and as from the whole one."""
    rng = np.random.default_rng(6)
    q, v = rng.integers(-9, 9, (1500, 8)).astype(float), np.repeat(rng.integers(-9, 9, (2000, 8)).astype(float), 4, axis=0)
    tracemalloc.start()
    best, found = vectors._best(q, v, 6)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    s = np.round(q @ v.T, 12)
    want = np.argsort(-s, axis=1, kind="stable")[:, :6]
    assert peak < s.nbytes / 2 and (best == want).all() and (found == np.take_along_axis(s, want, 1)).all()
    assert [x.shape for x in vectors._best(q[:2], v[:3], 6)] == [(2, 3), (2, 3)]
