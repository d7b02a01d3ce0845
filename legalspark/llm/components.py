"""Connected components of a link table by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Links (16 bytes each) up to which one task joins them; more take the steps until they are few or done.
FEW = 1_000_000


def _joined(edges: DataFrame) -> DataFrame:
    """id and component of few edges (u, v), by union and find in one task."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        above: dict = {}

        def root(x):
            while above[x] != x:
                above[x] = x = above[above[x]]
            return x

        for pdf in batches:
            for u, v in zip(pdf["u"].tolist(), pdf["v"].tolist(), strict=True):
                above.setdefault(u, u)
                above.setdefault(v, v)
                a, b = root(u), root(v)
                above[max(a, b)] = min(a, b)
        ids = list(above)
        yield pd.DataFrame({"id": ids, "component": [root(x) for x in ids]})

    kind = edges.schema["u"].dataType.simpleString()
    return materialise(edges.select("u", "v").repartition(1).mapInPandas(run, f"id {kind}, component {kind}"))


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id and component (the smallest id reachable) of each node of the undirected links.

    Each step is a minimum per node, combined before the shuffle, and a join of edges with these minima, whose
    large keys Spark can split; the number of edges never grows. Once at most FEW are left, one task ends the work, so
    that a small table does not take many small jobs. No link or component passes through the driver.
    """
    edges = materialise(links.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).where("u <> v").distinct())
    if edges.count() <= FEW:
        return _joined(edges)
    before = None
    while True:
        # large star: neighbours above u go to the smallest of u and its neighbours
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        edges = materialise(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        # small star: u and its neighbours below go to the smallest of them
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = materialise(moved.where("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    stars = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id")
    return materialise(stars.union(edges.select("v", "v").distinct().toDF("id", "component")))
