"""Whitening of embeddings from exact integer cross-products by bit slices.

Entries become integers. Of a pack of rows, each dimension is shifted to start at 0 and cut to bit planes, and a plane is
packed across the rows into 64-bit words. The product of two dimensions is the sum over pairs of their planes of the set bits of
the AND of the planes, weighted by the powers of two. Packs are summed as integers of any size, so the scatter is exact
whatever the number of rows; it is centred as integers, too, before the eigenvectors are taken from it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, operator, tidy

#: Fixed values of the integers: floor(SCALE * entry) + SHIFT. Scaled entries beyond LARGEST are held there.
SCALE, SHIFT, LARGEST = 1024, 100_000, 2**52
#: Components at most; entries in a pack of rows; limbs of 32 bits in which sums travel.
COMPONENTS, PACK, LIMBS = 8, 1 << 20, 6
#: Eigenvalues below this share of the trace are those of directions without variance.
FLAT = 1e-12


def integers(vectors: np.ndarray) -> np.ndarray:
    scaled = np.floor(SCALE * vectors.astype(np.float64))
    return np.clip(scaled, -LARGEST, LARGEST).astype(np.int64) + SHIFT


def planes(shifted: np.ndarray) -> np.ndarray:
    """Of integers from 0, rows by dimensions: bits, dimensions, words; bit r of the words of a dimension is that of row r."""
    width = max(1, int(shifted.max()).bit_length())
    rows = np.zeros((shifted.shape[1], -(-len(shifted) // 64) * 64), np.uint64)
    rows[:, : len(shifted)] = shifted.T
    return np.stack([np.packbits((rows >> np.uint64(b) & np.uint64(1)).astype(np.uint8), axis=1).view(np.uint64) for b in range(width)])


def products(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and cross-products of the columns of x, as Python's integers."""
    least = x.min(0)
    p, d = planes((x - least).astype(np.uint64)), x.shape[1]
    sums, cross = np.zeros(d, object), np.zeros((d, d), object)
    for a in range(len(p)):
        sums += np.bitwise_count(p[a]).sum(1, dtype=np.int64).astype(object) << a
        for b in range(a, len(p)):
            met = np.stack([np.bitwise_count(p[a, i] & p[b]).sum(1, dtype=np.int64) for i in range(d)])
            cross += (met if a == b else met + met.T).astype(object) << (a + b)
    least = least.astype(object)
    cross += np.outer(least, sums) + np.outer(sums, least) + len(x) * np.outer(least, least)
    return sums + len(x) * least, cross


def _limbs(v: int) -> list[int]:
    """v in limbs of 32 bits, the last with the sign; limbs of many numbers add up within a long."""
    out = [int(v) >> 32 * k & 0xFFFFFFFF for k in range(LIMBS - 1)]
    return [*out, int(v) >> 32 * (LIMBS - 1)]


def _batches(batches: Iterator[pa.RecordBatch], column: str, size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for b in batches:
        if b.num_rows:
            yield b, integers(b.column(column).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, size))


def scatter(rows: DataFrame, size: int) -> DataFrame:
    """i, j, limbs l0 to l5, least and most: sums over the packs of a task. (-1, -1) is the number of rows, (i, -1) the sum of
    a dimension with its range, and (i, j) with i >= j a cross-product: as many rows as the dimensions have pairs."""
    pack = max(64, PACK // size)
    schema = "i int, j int, " + ", ".join(f"l{k} long" for k in range(LIMBS)) + ", least long, most long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, cross, held, count = 0, np.zeros(size, object), np.zeros((size, size), object), [], 0
        least, most = np.full(size, 2**62), np.full(size, -(2**62))

        def add() -> None:
            nonlocal n, sums, cross, held, count, least, most
            x = np.concatenate(held)
            s, c = products(x)
            n, sums, cross, held, count = n + len(x), sums + s, cross + c, [], 0
            least, most = np.minimum(least, x.min(0)), np.maximum(most, x.max(0))

        for _, x in _batches(batches, "vector", size):
            held.append(x)
            count += len(x)
            if count >= pack:
                add()
        if held:
            add()
        if n:
            out = [(-1, -1, *_limbs(n), None, None)] + [(i, -1, *_limbs(sums[i]), int(least[i]), int(most[i])) for i in range(size)]
            out += [(i, j, *_limbs(cross[i, j]), None, None) for i in range(size) for j in range(i + 1)]
            types = [pa.int32()] * 2 + [pa.int64()] * (LIMBS + 2)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[f.split()[0] for f in schema.split(", ")])
        tidy()

    found = rows.select("vector").mapInArrow(run, schema)
    return found.groupBy("i", "j").agg(*[F.sum(f"l{k}").alias(f"l{k}") for k in range(LIMBS)], F.min("least").alias("least"), F.max("most").alias("most"))


@dataclass
class Whitening:
    """n, sums and ranges of the integer vectors, their covariance, and its eigenvalues and unit eigenvectors (columns), by
    falling eigenvalue. The largest entry of a vector is positive, so that reruns agree."""

    n: int
    sums: list[int]
    ranges: list[tuple[int, int]]
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray


def fit(rows: DataFrame, size: int, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of a table of vectors of one size; None without rows. Only size * size sums reach the driver."""
    n, sums, ranges, cross = 0, [0] * size, [(0, 0)] * size, {}
    for r in scatter(rows, size).toLocalIterator():
        v = sum(r[f"l{k}"] << 32 * k for k in range(LIMBS))
        if r["i"] < 0:
            n = v
        elif r["j"] < 0:
            sums[r["i"]], ranges[r["i"]] = v, (r["least"], r["most"])
        else:
            cross[r["i"], r["j"]] = v
    if not n:
        return None
    covariance = np.zeros((size, size))
    for (i, j), v in cross.items():
        covariance[i, j] = covariance[j, i] = (n * v - sums[i] * sums[j]) / (n * n)
    values, vectors = np.linalg.eigh(covariance)
    order = [k for k in np.argsort(-values, kind="stable") if values[k] > FLAT * max(np.trace(covariance), 0)][:components]
    vectors = vectors[:, order]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), range(len(order))] < 0, -1, 1)
    return Whitening(n, sums, ranges, covariance, values[order], vectors)


def project(rows: DataFrame, size: int, w: Whitening, kind: str) -> DataFrame:
    """vec_id, deviation, whitened (an array, by component) of each row. A deviation that no long holds is null."""
    far = sum(max(abs(w.n * a - s), abs(w.n * b - s)) ** 2 for (a, b), s in zip(w.ranges, w.sums, strict=True))
    short = far < 2**63
    base = w.vectors / np.sqrt(w.values)
    sums = np.array(w.sums, np.int64 if short else object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in _batches(batches, "vector", size):
            z = w.n * (x if short else x.astype(object)) - sums
            far = [int(v) if v < 2**63 else None for v in (z * z).sum(1)]
            out = (z / w.n).astype(np.float64) @ base
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * base.shape[1], pa.int32()), pa.array(out.ravel()))
            yield pa.record_batch([b.column("vec_id"), pa.array(far, pa.int64()), flat], names=["vec_id", "deviation", "whitened"])
        tidy()

    return rows.mapInArrow(run, f"vec_id {kind}, deviation long, whitened array<double>")


@operator
def whiten(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each row of vectors and component.

    Rows whose vector is null, or has null or non-finite entries, are dropped; so are those whose vector is not of the most
    common length (the longer one, if two are). Entries c become floor(1024 c) + 100000. The components are the eigenvectors of
    the covariance over all remaining rows (divisor n), numbered from 1 by falling eigenvalue; directions without variance are
    no components, so equal vectors give no rows, and an empty table has none. deviation is the exact sum over dimensions of
    (n x - S)**2, null where no long holds it; identity_error is that of the whitened rows' own covariance. Rows that share a
    key, or have none, stay apart. Other columns are not read.

    Four passes: lengths, packs, projections, their covariance. What a task gives is a matrix, never rows that meet.
    """
    kind = vectors.schema[key].dataType.simpleString()
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col(key).alias("vec_id"), F.col(column).cast("array<double>").alias("vector")).where(F.col("vector").isNotNull() & finite)
    common = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    size = common["size"] if common else 0
    rows = rows.where(F.size("vector") == size)
    w = fit(rows, size, components) if size else None
    empty = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if w is None or not len(w.values):
        return vectors.sparkSession.createDataFrame([], empty)
    found = materialise(project(rows, size, w, kind))
    k = len(w.values)
    mean = found.agg(*[F.avg(F.get("whitened", F.lit(a))).alias(f"m{a}") for a in range(k)]).first()
    own = [F.get("whitened", F.lit(a)) - F.lit(mean[a]) for a in range(k)]
    met = found.agg(*[F.avg(own[a] * own[b]).alias(f"c{a}_{b}") for a in range(k) for b in range(a + 1)]).first()
    error = max(abs(met[f"c{a}_{b}"] - (a == b)) for a in range(k) for b in range(a + 1))
    share = F.array(*[F.lit(float(v / np.trace(w.covariance))) for v in w.values])
    out = found.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return out.select("vec_id", (F.col("place") + 1).cast("int").alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("place")).alias("explained"), F.lit(float(error)).alias("identity_error"))
