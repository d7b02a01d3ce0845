"""Quality scores by Naive Bayes support vectors (Wang and Manning, 2012).

A text's features are indicators of words and pairs of words, and of n-grams over character classes: letters, capitals,
digits, spaces and line ends each become one symbol, runs of equal symbols one, and other signs stay, so that `|` tables,
decorated words and shouting show in any language. Indicators are scaled by the log-count ratio of the two classes, scaled
rows to unit length, and a linear hinge-loss model is fitted by dual coordinate descent.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed_sample, materialise, operator, text_of, tidy
from .langid import held_out
from .minhash import mix, word_hashes

#: Longest n-gram of classes, buckets that these and those that words are hashed to, bytes of text taken at once.
LONGEST, SHAPES, WORDS, CHUNK = 6, 1 << 18, 1 << 18, 1 << 20
BUCKETS = SHAPES + WORDS
#: Learned rows that a feature must have: most words are in few texts and say nothing.
SUPPORT = 5
#: The labelled rows learned from: those of each class with the smallest hashes of doc_id.
ROWS_PER_CLASS = 2_000
#: Weight of the loss, and passes of dual coordinate descent.
COST, PASSES = 1.0, 30

_CLASS = np.array([97 if 97 <= b <= 122 or b > 127 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else 10 if b in (10, 13) else 32 if b in (9, 32) else b for b in range(256)], np.uint8)
_MIX = np.random.default_rng(3).integers(1, 1 << 31, LONGEST + 1, np.int64) | 1


def features(text: str, seen: np.ndarray) -> np.ndarray:
    """Sorted buckets of the features of the whole text; seen is a scratch array of BUCKETS false values."""
    words, _ = word_hashes([text])
    seen[SHAPES + (words % np.uint64(WORDS)).astype(np.int64)] = True
    seen[SHAPES + (mix(words[:-1] * np.uint64(3) + words[1:]) % np.uint64(WORDS)).astype(np.int64)] = True
    data, tail = text.encode("utf-8", "surrogatepass"), np.zeros(0, np.uint8)
    for at in range(0, len(data), CHUNK):
        s = np.concatenate((tail, _CLASS[np.frombuffer(data, np.uint8, min(CHUNK, len(data) - at), at)]))
        s = s[np.concatenate(([True], s[1:] != s[:-1]))]
        gram = np.zeros(len(s), np.int64)
        for n in range(1, min(LONGEST, len(s)) + 1):
            gram = gram[: len(s) - n + 1] * 257 + s[n - 1 :]
            seen[(gram * _MIX[n] ^ gram * _MIX[n] >> 23) % SHAPES] = True
        tail = s[-LONGEST + 1 :]
    found = np.flatnonzero(seen)
    seen[found] = False
    return found


class NbSvm:
    """weights: one per bucket, already scaled by the ratios; bias; slope of the score."""

    def __init__(self, ratio: np.ndarray, weights: np.ndarray, bias: float, slope: float):
        self.ratio, self.weights, self.bias, self.slope = ratio, weights, bias, slope

    def margin(self, found: np.ndarray) -> float:
        x = self.ratio[found]
        return float(x @ self.weights[found]) / max(float(np.sqrt(x @ x)), 1e-9) + self.bias

    def score(self, found: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(found), -30, 30))))


def fit(rows: list[np.ndarray], y: np.ndarray) -> NbSvm:
    """y is 1 or 0. With one class only, or none, there is nothing to tell apart: all scores follow the bias."""
    if len(set(y.tolist())) < 2:
        return NbSvm(np.zeros(BUCKETS), np.zeros(BUCKETS), 1.0 if len(y) and y[0] == 1 else -1.0, 1.0)
    # sums over rows, without a table of all features of all rows
    plain = {c: np.zeros(BUCKETS) for c in (0, 1)}
    for r, v in zip(rows, y.tolist(), strict=True):
        plain[v][r] += 1
    ratio = np.log((1 + plain[1]) / (1 + plain[1]).sum()) - np.log((1 + plain[0]) / (1 + plain[0]).sum())
    ratio[plain[0] + plain[1] < SUPPORT] = 0
    rows = [r[ratio[r] != 0] for r in rows]
    x = []
    for r in rows:
        v = ratio[r].astype(np.float32)
        x.append(v / max(float(np.sqrt(v @ v)), 1e-9))
    sign, alpha, w, bias = np.where(y == 1, 1.0, -1.0), np.zeros(len(rows)), np.zeros(BUCKETS), 0.0
    cost = COST * np.where(y == 1, len(y) / (2 * (y == 1).sum()), len(y) / (2 * (y == 0).sum()))  # both classes weigh the same
    norm, rng = np.array([v @ v + 1 for v in x]), np.random.default_rng(5)
    for _ in range(PASSES):
        for i in rng.permutation(len(rows)):
            slack = sign[i] * (x[i] @ w[rows[i]] + bias) - 1
            new = min(max(alpha[i] - slack / norm[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                w[rows[i]] += step * x[i]
                bias += step
                alpha[i] = new
    margin, slope = np.array([v @ w[r] + bias for v, r in zip(x, rows, strict=True)]), 1.0
    for _ in range(20):  # the slope of the logistic curve through 0.5 at the hyperplane, by Newton steps
        p = 1 / (1 + np.exp(-np.clip(slope * margin, -30, 30)))
        slope += float(((y - p) * margin).sum() - 0.01 * slope) / float((p * (1 - p) * margin * margin).sum() + 0.01 + 1e-9)
        slope = min(max(slope, 0.1), 20.0)
    return NbSvm(ratio, w, bias, slope)


def train(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> NbSvm:
    """Learn from labelled rows. At most rows_per_class rows of each class are taken, by the hash of doc_id; their
    features come from whole texts and are found in Spark's tasks."""
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = materialise(hashed_sample(known, "quality", "doc_id", rows_per_class))
    texts = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = texts.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))  # one for each doc_id, however many repeat it

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BUCKETS, bool)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([features(t, seen).astype(np.int32).tobytes() for t in batch.column(2).to_pylist()], pa.binary())], ["doc_id", "quality", "features"])

    found = rows.select(F.col("doc_id").cast("long"), F.col("quality").cast("int"), "text").mapInArrow(run, "doc_id long, quality int, features binary")
    got = sorted(((r["doc_id"], r["quality"], np.frombuffer(r["features"], np.int32)) for r in found.toLocalIterator()), key=lambda r: r[:2])
    return fit([r[2] for r in got], np.array([r[1] for r in got]))


@operator
def score(docs: DataFrame, model: NbSvm) -> DataFrame:
    """doc_id, score, predicted for the whole text of each row of docs; a null text counts as empty, whose score is that
    of the bias. Repeated rows score alike; other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast((model.ratio, model.weights, model.bias, model.slope))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = NbSvm(*shared.value), np.zeros(BUCKETS, bool)
        for batch in batches:
            got = [own.score(features(t, seen)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pandas(pd.DataFrame({"score": got}), preserve_index=False).add_column(0, "doc_id", batch.column(0))
        tidy()

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@operator
def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; learned from labels of documents that are not held out."""
    model = train(docs, labels.where(~held_out(3, 1)))
    return score(docs, model).withColumn("held_out", held_out(3, 1)).select("doc_id", "held_out", "score", "predicted")
