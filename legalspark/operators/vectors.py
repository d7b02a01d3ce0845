"""Vectors: encoding, similarity joins and search (V1 to V6).

The arithmetic is numpy on blocks inside tasks; Spark deals the blocks. No row meets every other one as rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import folder, written

#: Vectors in a block of a similarity join, and questions that a search keeps in each worker at once.
BLOCK, QUERIES = 8_000, 10_000
#: Vectors of a block that are multiplied with another block at once.
STRIP = 1_000


def hashing_encoder(texts: list[str], size: int = 64) -> np.ndarray:
    """A deterministic encoder for tests: signed hashed words, unit length."""
    import zlib

    out = np.zeros((len(texts), size))
    for k, t in enumerate(texts):
        for w in t.lower().split():
            h = zlib.crc32(w.encode())
            out[k, h % size] += 1 if h >> 31 else -1
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


#: Characters that an encoder gets at once, in texts of like length; models that this worker has loaded, by name.
TOGETHER = 1 << 16
_LOADED: dict[str, Callable[[list[str]], np.ndarray]] = {}


def _model(encoder: Callable | None, factory: Callable | None) -> Callable[[list[str]], np.ndarray]:
    """In a task: the encoder, or what the factory makes, once for each worker and not once for each task."""
    if factory is None:
        return encoder
    name = f"{factory.__module__}.{factory.__qualname__}"
    if name not in _LOADED:
        _LOADED[name] = factory()
    return _LOADED[name]


def _encoded(texts: list[str], model: Callable[[list[str]], np.ndarray]) -> list[np.ndarray]:
    """The vectors of texts, which go to the model in batches of like length, so that a padding model wastes little."""
    out: list = [None] * len(texts)
    order, at = sorted(range(len(texts)), key=lambda k: len(texts[k])), 0
    while at < len(order):
        to, size = at + 1, len(texts[order[at]])
        while to < len(order) and (to + 1 - at) * max(1, len(texts[order[to]])) <= TOGETHER:
            to += 1
        for k, v in zip(order[at:to], model([texts[k] for k in order[at:to]]), strict=True):
            out[k] = v
        at = to
    return out


def embed(df: DataFrame, column: str, encoder: Callable[[list[str]], np.ndarray] = hashing_encoder, out: str = "embedding", factory: Callable[[], Callable] | None = None, known: DataFrame | None = None, once: bool = False) -> DataFrame:
    """df with the vectors of a text column; a null text has none. encoder takes a list of texts and gives a matrix.

    With a factory the model is made in the worker, once for all its tasks, and never travels. With once, or with known, a table
    (digest, vector) of texts that have vectors, each different text is encoded once, known ones not at all; digest is
    the MD5 of the text. new_vectors gives the table for the next time.
    """
    if once or known is not None:
        every = new_vectors(df, column, encoder, factory, known).select("digest", "vector")
        every = every if known is None else every.unionByName(known.select("digest", "vector"))
        rows = df.withColumn("_digest", F.md5(F.col(column)))
        return rows.join(every.select(F.col("digest").alias("_digest"), F.col("vector").alias(out)), "_digest", "left").select(*[F.col(c) for c in df.columns if c != out], out)

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from legalspark.operators import vectors  # the module of the worker keeps what is loaded

        model = vectors._model(encoder, factory)
        for texts in batches:
            some = texts.dropna()
            found = dict(zip(some.index, vectors._encoded(some.tolist(), model), strict=True))
            yield pd.Series([found.get(k) for k in texts.index], index=texts.index, dtype=object)

    return df.withColumn(out, run(F.col(column)))


def new_vectors(df: DataFrame, column: str, encoder: Callable[[list[str]], np.ndarray] = hashing_encoder, factory: Callable[[], Callable] | None = None, known: DataFrame | None = None) -> DataFrame:
    """digest, vector of the different texts of a column that known lacks, written once."""
    texts = df.where(F.col(column).isNotNull()).select(F.md5(F.col(column)).alias("digest"), F.col(column).alias("text"))
    texts = texts if known is None else texts.join(known.select("digest"), "digest", "left_anti")
    return written(embed(texts.dropDuplicates(["digest"]), "text", encoder, "vector", factory).select("digest", "vector"))


def _unit(vectors: pd.Series) -> np.ndarray:
    m = np.stack([np.asarray(v, np.float64) for v in vectors])
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


#: Similarities that a search holds at once in a task.
HELD = 1 << 20


def _best(q: np.ndarray, v: np.ndarray, k: int, allowed: Callable[[slice], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places in v and similarities, to 12 digits, of the k nearest of each row of q, ties by place; q is taken in strips, so
    memory does not grow with questions times vectors. What allowed says no to has -inf."""
    step, n = max(1, HELD // max(1, len(v))), min(k, len(v))
    best, found = np.empty((len(q), n), np.int64), np.empty((len(q), n))
    for at in range(0, len(q), step):
        part = slice(at, at + step)
        s = np.round(q[part] @ v.T, 12)
        if allowed is not None:
            s[~allowed(part)] = -np.inf
        best[part] = np.argsort(-s, axis=1, kind="stable")[:, :n]
        found[part] = np.take_along_axis(s, best[part], 1)
    return best, found


#: Pivots at most, of which each vector belongs to the nearest; they are read from as many rows with the smallest hashes.
PIVOTS = 256
#: Angles are compared with this much room for rounding.
ROOM = 1e-6


def _angles(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ pivots.T, -1, 1))


def _pivots(rows: DataFrame, n: int) -> np.ndarray:
    """Unit vectors of a bounded sample of rows (id, v), about the root of n of them."""
    most = max(1, min(PIVOTS, round((n / 4) ** 0.5)))
    return _unit(pd.Series([r["v"] for r in rows.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(most).collect()]))


def _nearest(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """rows (id, v, ...) with cell, the nearest pivot, and the angle to it."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                a = _angles(_unit(pdf["v"]), shared.value)
                yield pdf.assign(cell=a.argmin(1).astype(np.int32), angle=a.min(1))

    return rows.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", cell int, angle double")


def _visits(own: DataFrame, pivots: np.ndarray, threshold: float) -> DataFrame:
    """own (id, v, scope, n, cell, angle) with visits: the cells of its scope, from its own on, in which a vector can have a partner.

    x and y of an angle of at most t: the angle of x to the pivot of y's cell is at most t and the cell's radius.
    """
    reach, count = float(np.arccos(min(1.0, max(-1.0, threshold)))), len(pivots)
    radius = own.groupBy("scope", "cell").agg(F.max("angle").alias("r"))
    radii = radius.groupBy(F.col("scope").alias("_s")).agg(F.map_from_entries(F.collect_list(F.struct("cell", "r"))).alias("radii"))  # at most PIVOTS entries
    shared = own.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            a = _angles(_unit(pdf["v"]), shared.value) if len(pdf) else None
            for k, (cell, radii) in enumerate(zip(pdf["cell"], pdf["radii"], strict=True)):
                r = np.full(count, -np.inf)
                for c, x in dict(radii).items():
                    r[c] = x
                can = a[k] <= reach + r + ROOM
                can[cell] = True
                out.append(np.flatnonzero(can[cell:]) + cell)
            yield pdf.drop(columns="radii").assign(visits=out)

    met = own.join(radii, own["scope"].eqNullSafe(radii["_s"])).drop("_s")
    return met.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema) + ", visits array<int>")


def similar_pairs(df: DataFrame, threshold: float = 0.7, scope: str | None = None, id_col: str = "id", vector: str = "embedding", scale: str = "raw", blocks: int | None = None) -> DataFrame:
    """id1 < id2, similarity of all pairs with a cosine of at least threshold; null and zero vectors have none.

    A scope (all rows, or those with the same value of a column such as a document; a null one equals none) of at most BLOCK
    vectors is one matrix product. In larger ones each vector belongs to the cell of its nearest pivot, and visits only the later
    cells in which the triangle inequality of angles allows a partner; a scope in which that would copy more vectors than blocks
    alone is dealt to blocks. The members of a cell and its visitors are dealt to
    blocks of about BLOCK vectors by the hash of their id, and each block of members meets the others in one task as a matrix product, in
    strips; only pairs above the threshold leave it. blocks deals each scope to so many blocks, without cells. scale="unit"
    gives (1 + cosine) / 2.
    """
    # a null scope equals none: without one, all are in scope 0
    rows = df.where(F.col(vector).isNotNull() & F.exists(vector, lambda x: x != 0)).select(F.col(id_col).alias("id"), F.col(vector).alias("v"), (F.col(scope) if scope else F.lit(0)).alias("scope"))
    rows = rows.where("scope is not null")
    sizes = rows.groupBy("scope").agg(F.count("*").alias("n"))
    one = F.lit(0)
    if blocks is not None:
        own, large = rows.withColumns({"cell": one, "home": one, "members": F.lit(blocks), "visitors": one}), 0
    else:
        sizes = written(sizes)
        large = sizes.where(F.col("n") > BLOCK).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        own = rows.join(sizes.where(F.col("n") <= BLOCK).select("scope"), "scope", "left_semi").withColumns({"cell": one, "home": one, "members": F.lit(1), "visitors": one})
    if large:
        crowd = rows.join(sizes.where(F.col("n") > BLOCK).select("scope"), "scope", "left_semi")
        pivots = _pivots(crowd, large)
        visited = written(_visits(written(_nearest(crowd, pivots)), pivots, threshold))
        # where cells leave out little, a vector would be copied to nearly all of them: such a scope is dealt to blocks alone
        some = visited.groupBy("scope").agg(F.sum(F.size("visits")).alias("copies"), F.ceil(F.count("*") / BLOCK).cast("int").alias("members"))
        plain = written(some.withColumn("plain", F.col("copies") > F.col("members") * (F.col("members") + 1) / 2 * BLOCK).select("scope", "members", "plain"))
        own = own.unionByName(crowd.join(plain.where("plain").drop("plain"), "scope").withColumns({"cell": one, "home": one, "visitors": one}))
        met = visited.join(plain.where("not plain").select("scope"), "scope", "left_semi").select("id", "v", "scope", F.col("cell").alias("home"), F.explode("visits").alias("cell"))
        part = lambda c: F.ceil(F.count_if(c) / BLOCK).cast("int")
        counts = met.groupBy("scope", "cell").agg(part(F.col("home") == F.col("cell")).alias("members"), part(F.col("home") != F.col("cell")).alias("visitors"))
        own = own.unionByName(met.join(counts, ["scope", "cell"]))
    # blocks of members come first, those of visitors after them; visitors don't meet each other
    member, key = F.col("home") == F.col("cell"), F.xxhash64("id")
    place = F.when(member, F.pmod(key, F.col("members"))).otherwise(F.col("members") + F.pmod(key, F.col("visitors")))
    others = F.when(member, F.col("members") + F.col("visitors")).otherwise(F.col("members"))
    own = own.withColumn("b", place.cast("int"))
    dealt = own.withColumn("o", F.explode(F.sequence(F.lit(0), others - 1))).withColumns({"i": F.least("b", "o"), "j": F.greatest("b", "o")}).select("scope", "cell", "i", "j", "b", "id", "v")
    kind = df.schema[id_col].dataType.simpleString()

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Of the rows only unit vectors and ids stay, and pairs leave strip by strip, so memory does not grow with the pairs."""
        ids, units = {True: [], False: []}, {True: [], False: []}
        for pdf in batches:
            if len(pdf):
                i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
                for first in (True, False):
                    some = pdf[pdf["b"] == (i if first else j)]
                    if len(some):
                        ids[first].append(some["id"].to_numpy())
                        units[first].append(_unit(some["v"]))
        if not units[True] or not units[False]:
            return
        (names, l), (others, r) = ((np.concatenate(ids[k]), np.concatenate(units[k])) for k in (True, False))  # noqa: E741
        step = max(1, min(STRIP, HELD // len(r)))
        for at in range(0, len(l), step):
            s = l[at : at + step] @ r.T
            a, b = np.nonzero(s >= threshold)
            x, y, s = names[a + at], others[b], s[a, b]
            good = x < y if i == j else x != y
            x, y, s = x[good], y[good], s[good]
            if len(x):
                yield pd.DataFrame({"id1": np.minimum(x, y), "id2": np.maximum(x, y), "similarity": s}) if x.dtype != object else pd.DataFrame({"id1": [min(p) for p in zip(x, y, strict=True)], "id2": [max(p) for p in zip(x, y, strict=True)], "similarity": s})

    out = dealt.groupBy("scope", "cell", "i", "j").applyInPandas(meet, f"id1 {kind}, id2 {kind}, similarity double")
    return out.withColumn("similarity", (1 + F.col("similarity")) / 2) if scale == "unit" else out


def similar_cases(cases: DataFrame, threshold: float = 0.7) -> DataFrame:
    """One undirected edge id1 < id2, score for each similar pair of cases."""
    return similar_pairs(cases, threshold).withColumnRenamed("similarity", "score")


@dataclass(frozen=True)
class Cells:
    """A stored inverted file: the vectors (id, v, angle) in a folder for each cell, the pivots, and by cell its radius and size."""

    path: str
    kind: str
    pivots: np.ndarray
    radii: dict[int, float]
    sizes: dict[int, int]

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(f"id {self.kind}, v array<double>, angle double, cell int").parquet(self.path)


def build_cells(corpus: DataFrame, corpus_id: str = "id", vector: str = "embedding", path: str | None = None) -> Cells:
    """Writes the vectors of corpus by cells, once for all later questions. Every row is in a cell but those without a vector."""
    path = path or folder(corpus.sparkSession)
    rows = corpus.where(F.col(vector).isNotNull()).select(F.col(corpus_id).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    n = rows.count()
    pivots, kind = _pivots(rows, n) if n else np.zeros((0, 0)), corpus.schema[corpus_id].dataType.simpleString()
    (_nearest(rows, pivots) if n else rows.withColumns({"angle": F.lit(0.0), "cell": F.lit(0)})).select("id", "v", "angle", "cell").write.partitionBy("cell").parquet(path)
    found = Cells(path, kind, pivots, {}, {})
    for r in found.table(corpus.sparkSession).groupBy("cell").agg(F.max("angle").alias("r"), F.count("*").alias("n")).collect():  # at most PIVOTS
        found.radii[r["cell"]], found.sizes[r["cell"]] = r["r"], r["n"]
    return found


def search_cells(queries: DataFrame, cells: Cells, k: int = 10, query_id: str = "query_id", vector: str = "embedding", report: bool = False):
    """query_id, id, similarity, rank as of vector_search, from stored cells; with report also query_id, cells: how many were read.

    A question reads its nearest cells, until they have k vectors; the k-th of these is at an angle t. Then it reads the cells
    that come nearer than t to it: whose pivot's angle less the radius is at most t, and of these the vectors whose own angle to the
    pivot allows it. No other vector can be among the k nearest, so the result is that of a full scan. Questions go to the workers in blocks of QUERIES.
    """
    spark, kind = queries.sparkSession, queries.schema[query_id].dataType.simpleString()
    every, parts, counts = sorted(cells.sizes), [], []
    schema = f"query_id {kind}, id {cells.kind}, similarity double"

    def read(names: list, asked: np.ndarray, wanted: dict[int, list[int]], near: np.ndarray, limit: np.ndarray) -> DataFrame:
        shared = spark.sparkContext.broadcast((np.array(names), asked, wanted, near, limit))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names, asked, wanted, near, limit = shared.value
            for pdf in batches:
                for cell, own in pdf.groupby("cell"):
                    qs = np.array(wanted[cell])
                    own = own.sort_values("id")
                    angle = own["angle"].to_numpy()
                    best, s = _best(asked[qs], _unit(own["v"]), k, lambda p, qs=qs, angle=angle: np.abs(near[qs[p], cell][:, None] - angle) <= limit[qs[p]][:, None] + ROOM)  # noqa: B023
                    out = pd.DataFrame({"query_id": np.repeat(names[qs], best.shape[1]), "id": own["id"].to_numpy()[best.ravel()], "similarity": s.ravel()})
                    yield out[out["similarity"] > -np.inf]

        return cells.table(spark).where(F.col("cell").isin(sorted(wanted))).mapInPandas(run, schema)

    def search(block: list) -> None:
        names, asked = [r[0] for r in block], _unit(pd.Series([r[1] for r in block]))
        near = _angles(asked, cells.pivots)
        first: dict[int, list[int]] = {}
        for q in range(len(block)):
            have = 0
            for c in sorted(every, key=lambda c: near[q, c]):
                if have >= k:
                    break
                first.setdefault(c, []).append(q)
                have += cells.sizes[c]
        some = written(read(names, asked, first, near, np.full(len(block), np.pi)))
        w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
        kth = {r[0]: r[1] for r in some.withColumn("rank", F.row_number().over(w)).where(F.col("rank") == k).select("query_id", "similarity").collect()}  # one for each of the block's questions
        limit = np.array([np.arccos(np.clip(kth.get(n, -1.0), -1, 1)) for n in names])
        seen = {(c, q) for c, qs in first.items() for q in qs}
        rest = {c: [q for q in range(len(block)) if (c, q) not in seen and near[q, c] - cells.radii[c] <= limit[q] + ROOM] for c in every}
        rest = {c: qs for c, qs in rest.items() if qs}
        parts.append(some.union(read(names, asked, rest, near, limit)) if rest else some)
        counts.extend((n, sum((c, q) in seen or q in rest.get(c, ()) for c in every)) for q, n in enumerate(names))

    block = []
    for row in queries.where(F.col(vector).isNotNull()).select(query_id, vector).toLocalIterator():
        block.append(row)
        if len(block) == QUERIES:
            search(block)
            block = []
    if block and every:
        search(block)
    out = parts[0] if parts else spark.createDataFrame([], schema)
    for p in parts[1:]:
        out = out.union(p)
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))).where(F.col("rank") <= k)
    return (out, spark.createDataFrame(counts, f"query_id {kind}, cells int")) if report else out


def vector_search(queries: DataFrame, corpus: DataFrame, k: int = 10, query_id: str = "query_id", corpus_id: str = "id", vector: str = "embedding", scale: str = "raw") -> DataFrame:
    """query_id, id, similarity, rank: the k nearest of the corpus for each question; ties go to the smaller id.

    Questions are taken to the workers in blocks of QUERIES; each batch of the corpus gives its own best k for each
    question, and only these are shuffled. The corpus is never sorted or collected.
    """
    spark, asked = corpus.sparkSession, queries.where(F.col(vector).isNotNull()).select(query_id, vector)
    kinds = queries.schema[query_id].dataType.simpleString(), corpus.schema[corpus_id].dataType.simpleString()
    rows, parts, block = corpus.where(F.col(vector).isNotNull()).select(corpus_id, vector), [], []

    def search(block: list) -> DataFrame:
        shared = spark.sparkContext.broadcast(([r[0] for r in block], _unit(pd.Series([r[1] for r in block]))))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names, q = shared.value
            for pdf in batches:
                if not len(pdf):
                    continue
                pdf = pdf.sort_values(corpus_id)
                best, s = _best(q, _unit(pdf[vector]), k)
                yield pd.DataFrame({"query_id": np.repeat(np.array(names), best.shape[1]), "id": pdf[corpus_id].to_numpy()[best.ravel()], "similarity": s.ravel()})

        return rows.mapInPandas(run, f"query_id {kinds[0]}, id {kinds[1]}, similarity double")

    for row in asked.toLocalIterator():
        block.append(row)
        if len(block) == QUERIES:
            parts.append(search(block))
            block = []
    if block or not parts:
        parts.append(search(block) if block else rows.where("false").select(F.lit(None).cast(kinds[0]).alias("query_id"), F.col(corpus_id).alias("id"), F.lit(0.0).alias("similarity")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    out = out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return out.withColumn("similarity", (1 + F.col("similarity")) / 2) if scale == "unit" else out


def _dot(a: str, b: str):
    """Scalar product of two array columns, in double, with built-in functions."""
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def relevant_clauses(articles: DataFrame, clauses: DataFrame, subclauses: DataFrame, queries: DataFrame, n: int = 3, encoder: Callable = hashing_encoder, digits: int | None = None) -> DataFrame:
    """query_id, article_id, text, similarity, rank of the n clauses (with their sub-clauses' texts) nearest to the question.

    articles has query_id and id: the candidates of each question. One without clauses stands in with its content. digits rounds
    similarities before they are ranked. Squares are summed once for each text and question; what remains for a pair is one product.
    Neither candidates nor vectors are broadcast, however small Spark takes their files to be. Writes the candidates once, since they are read twice.
    """
    subs = subclauses.groupBy("clause_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sub_clause_number", "text"))), lambda s: s["text"]), " ").alias("more"))
    full = clauses.join(subs, clauses["id"] == subs["clause_id"], "left").select("article_id", F.concat_ws(" ", "text", "more").alias("text"))
    wanted = articles.select("query_id", F.col("id").alias("article_id"), "content")
    met = written(wanted.join(full, "article_id", "left").select("query_id", "article_id", F.coalesce("text", "content").alias("text")))
    known = embed(met.select("text").distinct(), "text", encoder, "v").withColumn("vv", _dot("v", "v"))
    asked = queries.select("query_id", F.col("embedding").alias("q")).withColumn("qq", _dot("q", "q"))
    cosine = F.try_divide(_dot("v", "q"), F.sqrt(F.col("vv") * F.col("qq")))  # null for a zero vector
    scored = met.join(known.hint("merge"), "text").join(asked.hint("merge"), "query_id").withColumn("similarity", cosine if digits is None else F.round(cosine, digits))
    w = Window.partitionBy("query_id", "article_id").orderBy(F.desc("similarity"), "text")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("query_id", "article_id", "text", "similarity", "rank")


def top_similar_report(edges: DataFrame, items: DataFrame, labels: tuple[str, ...] = ("document_title", "article_number"), n: int = 5, score: str = "similarity") -> DataFrame:
    """The n best edges with the labels of both ends (document and number, or citation and court). The best are found
    first, so that the joins see n rows."""
    best = edges.select("id1", "id2", score).orderBy(F.desc(score), "id1", "id2").limit(n)
    side = lambda k: items.select(F.col("id").alias(f"id{k}"), *[F.col(c).alias(f"{c}{k}") for c in labels])
    return best.join(side(1), "id1", "left").join(side(2), "id2", "left").orderBy(F.desc(score), "id1", "id2")
