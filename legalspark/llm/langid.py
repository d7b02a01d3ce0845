"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

Each byte position gets a distribution over languages from the states of both directions; a document's probabilities
are the mean over all its positions. Texts are cut into segments of SEGMENT bytes, each read with fresh states, so that
memory does not depend on their length. Training is backpropagation through time on a bounded sample of labelled rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed_sample, materialise, operator, text_of, tidy

#: Bytes in a segment; units in each direction; segments computed together.
SEGMENT, UNITS, TOGETHER = 128, 8, 4096
#: The sample: rows per language, whole texts.
ROWS_PER_LANGUAGE = 600
#: Training: updates, pieces in each (drawn evenly from the languages), bytes in a piece, largest rate.
UPDATES, STEP, PIECE, RATE = 240, 128, 64, 0.03
#: A gram is a piece of a language when it is at least one of so many in its sample; languages that bits tell apart.
RARE, BITS = 500_000, 64
#: A language is likely in a segment from this mean probability on.
LIKELY = 0.1
UNKNOWN = "und"
#: Bytes of a text as bytes beyond ASCII, ASCII letters, or spaces; bytes of a text looked up together.
LETTERS, CHUNK = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256)), 1 << 18
CODES = re.compile(rb"(?<![0-9a-z])[a-z]*+[0-9][0-9a-z]*+")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


class Gru:
    """Weights by name: x* (3 units, 256), u* (3 units, units), o* (languages, units) per direction f and b, and bias.

    Gates are stacked as update, reset, candidate; columns are segments.
    """

    def __init__(self, languages: list[str], seed: int = 7, weights: dict[str, np.ndarray] | None = None):
        rng, h, n = np.random.default_rng(seed), UNITS, len(languages)
        self.languages, self.seen = languages, np.zeros(1, np.uint8)
        normal = lambda scale, *shape: (scale * rng.standard_normal(shape)).astype(np.float32)
        self.w = weights or {k + d: normal(s, *shape) for d in "fb" for k, s, shape in (("x", 0.3, (3 * h, 256)), ("u", 0.3, (3 * h, h)), ("o", 0.3, (n, h)))} | {"bias": np.zeros((n, 1), np.float32)}

    def _run(self, way: str, x: np.ndarray, mask: np.ndarray | None):
        """(t, state before, update, reset, candidate, recurrent part of the candidate, state) in the order of a direction."""
        w, u, h = self.w["x" + way], self.w["u" + way], UNITS
        state = np.zeros((h, x.shape[1]), np.float32)
        for t in range(len(x)) if way == "f" else range(len(x) - 1, -1, -1):
            a, g = np.take(w, x[t], axis=1), u @ state
            a[: 2 * h] += g[: 2 * h]
            gate = _sigmoid(a[: 2 * h])
            c = a[2 * h :]
            c += gate[h:] * g[2 * h :]
            np.tanh(c, out=c)
            new = c - state
            new *= gate[:h]
            new += state
            if mask is not None:
                new *= mask[t]
            yield t, state, gate[:h], gate[h:], c, g[2 * h :], new
            state = new

    def probabilities(self, x: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
        """Sums over positions of the languages' probabilities at each position: (languages, segments)."""
        ahead = np.empty((len(x), len(self.languages), x.shape[1]), np.float32)
        for t, *_, state in self._run("f", x, mask):
            np.matmul(self.w["of"], state, out=ahead[t])
        total = np.zeros(ahead.shape[1:], np.float32)
        for t, *_, state in self._run("b", x, mask):
            p = self.w["ob"] @ state
            p += ahead[t]
            p += self.w["bias"]
            p -= p.max(0)
            np.exp(p, out=p)
            p /= p.sum(0)
            if mask is not None:
                p *= mask[t]
            total += p
        return total

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy over all positions, by backpropagation through time in both directions."""
        h, steps = UNITS, {way: list(self._run(way, x, mask)) for way in "fb"}
        state = {way: {s[0]: s[-1] for s in steps[way]} for way in "fb"}
        grad, n = {k: np.zeros_like(v) for k, v in self.w.items()}, mask.sum()
        error = {}
        for t in range(len(x)):
            logits = self.w["of"] @ state["f"][t] + self.w["ob"] @ state["b"][t] + self.w["bias"]
            p = np.exp(logits - logits.max(0))
            p /= p.sum(0)
            p[y, np.arange(len(y))] -= 1
            error[t] = p * (mask[t] / n)
            grad["bias"] += error[t].sum(1, keepdims=True)
        for way in "fb":
            u, out, carry = self.w["u" + way], self.w["o" + way], np.zeros((h, x.shape[1]), np.float32)
            seen, inputs = [], []
            for t, before, z, r, c, gc, after in reversed(steps[way]):
                grad["o" + way] += error[t] @ after.T
                d = (out.T @ error[t] + carry) * mask[t]
                da_c = d * z * (1 - c * c)
                da_z, da_r = d * (c - before) * z * (1 - z), da_c * gc * r * (1 - r)
                dg = np.concatenate((da_z, da_r, da_c * r))
                grad["u" + way] += dg @ before.T
                carry = d * (1 - z) + u.T @ dg
                seen.append(x[t])
                inputs.append(np.concatenate((da_z, da_r, da_c)))
            flat, weights = np.concatenate(seen), np.concatenate(inputs, 1)
            grad["x" + way] += np.array([np.bincount(flat, row, 256) for row in weights], np.float32)
        return grad

    def fit(self, texts: list[bytes], y: np.ndarray, updates: int = UPDATES, rate: float = RATE, seed: int = 11) -> Gru:
        """Adam, with a rate that falls to zero. An update takes pieces from anywhere in texts drawn evenly from the languages."""
        rng, m, v = np.random.default_rng(seed), {n: 0.0 for n in self.w}, {n: 0.0 for n in self.w}
        own = [np.flatnonzero(y == k) for k in range(len(self.languages))]
        for k in range(1, updates + 1):
            rows = np.array([own[c][rng.integers(len(own[c]))] for c in rng.integers(len(own), size=STEP)])
            at = (rng.random(STEP) * [max(1, len(texts[i]) - PIECE + 1) for i in rows]).astype(int)
            x, mask = padded([texts[i][a : a + PIECE] for i, a in zip(rows, at, strict=True)])
            now = rate * (1 - (k - 1) / updates)
            for n, g in self.gradients(x, mask, y[rows]).items():
                m[n], v[n] = 0.9 * m[n] + 0.1 * g, 0.99 * v[n] + 0.01 * g * g
                self.w[n] = (self.w[n] - now * (m[n] / (1 - 0.9**k)) / (np.sqrt(v[n] / (1 - 0.99**k)) + 1e-8)).astype(np.float32)
        return self

    def likely(self, sums: np.ndarray) -> np.ndarray:
        bits = np.zeros(len(sums), np.uint64)
        for k in range(len(self.languages)):
            bits |= np.where(sums[:, k] >= LIKELY * sums.sum(1), np.uint64(1 << k % BITS), np.uint64(0))
        return bits

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        return self.labelled(texts)[0]

    def labelled(self, texts: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Mean probabilities of each text, (texts, languages), zeros for an empty one; and of each of its segments the
        languages, as bits, that have at least LIKELY of its probability."""
        sums = np.zeros((len(texts), len(self.languages)))
        whole, owner, tails, tail_owner, labels, last = [], [], [], [], [], {}
        for k, t in enumerate(texts):
            n = len(t) // SEGMENT
            whole.append(t[: n * SEGMENT])
            owner.append(np.full(n, k))
            if len(t) % SEGMENT:
                tails.append(t[n * SEGMENT :])
                tail_owner.append(k)
        x, owner = np.frombuffer(b"".join(whole), np.uint8).reshape(-1, SEGMENT), np.concatenate(owner) if owner else np.zeros(0, int)
        for at in range(0, len(x), TOGETHER):
            part = np.ascontiguousarray(x[at : at + TOGETHER].T)
            found = self.probabilities(part, None).T
            np.add.at(sums, owner[at : at + TOGETHER], found)
            labels.append(self.likely(found))
        order = sorted(range(len(tails)), key=lambda k: len(tails[k]))
        for at in range(0, len(order), TOGETHER // 16):
            rows = order[at : at + TOGETHER // 16]
            part, mask = padded([tails[k] for k in rows])
            found = self.probabilities(part, mask).T
            np.add.at(sums, np.array([tail_owner[k] for k in rows]), found)
            last.update(zip((tail_owner[k] for k in rows), self.likely(found), strict=True))
        each = np.split(np.concatenate(labels) if labels else np.zeros(0, np.uint64), np.cumsum([len(t) // SEGMENT for t in texts])[:-1]) if texts else []
        return sums / np.maximum(1, np.array([len(t) for t in texts]))[:, None], [np.append(x, last[k]) if k in last else x for k, x in enumerate(each)]


def padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes as (positions, texts), and 1.0 where there is one."""
    size = np.array([len(t) for t in texts])
    width = max(1, int(size.max()))
    x = np.frombuffer(b"".join([t.ljust(width, b"\0") for t in texts]), np.uint8).reshape(len(texts), width)
    return np.ascontiguousarray(x.T), (np.arange(width)[:, None] < size).astype(np.float32)


def in_words(text: bytes) -> np.ndarray:
    return np.frombuffer(text.translate(LETTERS), np.uint8) != 32


def grams(text: bytes) -> np.ndarray:
    """Codes of all runs of three bytes whose middle is in a word; a space stands for what is between words."""
    b = np.frombuffer(b" " + text.translate(LETTERS) + b" ", np.uint8).astype(np.int32)
    return (b[:-2] << 16 | b[1:-1] << 8 | b[2:])[b[1:-1] != 32]


def lowered(text: str) -> bytes:
    """Lower case in UTF-8, with spaces for runs of ASCII letters and digits that have a digit: keys and numbers are no words."""
    return CODES.sub(lambda m: b" " * len(m[0]), text.lower().encode("utf-8", "surrogatepass"))


def familiar(text: bytes, size: int, labels: np.ndarray, seen: np.ndarray) -> float:
    """Share of the grams of a lowered text that are learned pieces of a language that the network finds likely in their segment;
    0.0 without any. size is that of the text itself, labels has its segments' languages, seen those of a code, as bits."""
    n = known = 0
    for at in range(0, len(text), CHUNK):
        part = text[at : at + CHUNK]
        codes, places = grams(part), np.flatnonzero(in_words(part))
        segment = np.minimum((at + places) * size // len(text) // SEGMENT, len(labels) - 1)
        n, known = n + len(codes), known + int(np.count_nonzero(seen[codes] & labels[segment].astype(seen.dtype)))
    return known / max(1, n)


def train(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> Gru:
    """Learn from rows of docs with text and lang. The sample is bounded in rows: for each language the whole texts of the
    rows with the smallest hashes of doc_id reach the driver, one for each doc_id.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}"))
    # ids only are ranked, so that no text is shuffled; the chosen ids are few by the bound
    ids = materialise(hashed_sample(usable.select("lang", "doc_id"), "lang", "doc_id", rows_per_language))
    chosen = usable.select("lang", "doc_id", "text").join(F.broadcast(ids), ["lang", "doc_id"]).groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    rows = sorted((r["lang"], r["doc_id"], r["text"].encode("utf-8", "surrogatepass")) for r in chosen.toLocalIterator())
    languages = sorted({r[0] for r in rows}) or [UNKNOWN]
    if not rows:
        return Gru(languages)
    model = Gru(languages).fit([r[2] for r in rows], np.array([languages.index(r[0]) for r in rows]))
    model.seen = np.zeros(1 << 24, np.min_scalar_type((1 << min(BITS, len(languages))) - 1))
    for k, language in enumerate(languages):
        counts = np.zeros(1 << 24, np.int32)
        for text in (t for name, _, t in rows if name == language):
            for at in range(0, len(text), CHUNK):
                np.add.at(counts, grams(lowered(text[at : at + CHUNK].decode("utf-8", "replace"))), 1)
        model.seen[counts >= max(1, counts.sum() // RARE)] |= model.seen.dtype.type(1 << k % BITS)
    return model


@operator
def predict(docs: DataFrame, model: Gru, with_familiar: bool = False) -> DataFrame:
    """doc_id, lang_pred, score of each row of docs: the language with the largest pooled probability over the whole
    text (the first of equal ones), and that probability; `und` and 0.0 if the text is null or has no letter.

    with_familiar adds familiar: the share of the text's grams that are learned pieces of a language that the network finds
    likely in their segment. The network always picks a learned language; this tells whether the segments are in it. A text in several
    languages is judged by each of them where it is spoken.
    """
    names = ["doc_id", "lang_pred", "score"] + ["familiar"] * with_familiar
    some = np.flatnonzero(model.seen).astype(np.int32)
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.w, (some, model.seen[some])))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, weights, codes = shared.value
        net, seen = Gru(languages, weights=weights), None
        if with_familiar:
            seen = np.zeros(1 << 24, codes[1].dtype)
            seen[codes[0]] = codes[1]
        for batch in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            p, labels = net.labelled(texts)
            best = p.argmax(1)
            out = [batch.column(0), pa.array([languages[b] if t else UNKNOWN for b, t in zip(best, texts, strict=True)]), pa.array(np.clip(p[np.arange(len(p)), best], 0, 1))]
            if with_familiar:
                out.append(pa.array([familiar(lowered(t or ""), len(b), own, seen) for t, b, own in zip(batch.column(1).to_pylist(), texts, labels, strict=True)], pa.float64()))
            yield pa.RecordBatch.from_arrays(out, names)
        tidy()

    lettered = F.when(F.col("text").rlike(r"\p{L}"), text_of())
    return docs.select("doc_id", lettered.alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double" + ", familiar double" * with_familiar)


def held_out(by: int, rest: int):
    """True for rows whose crc32 of doc_id as text has this remainder; their labels are never learned."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(by)) == rest, F.lit(False))


@operator
def identify(docs: DataFrame, with_familiar: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred, score, and familiar on demand; learned from labelled rows that are not held out. Without any such row all
    are `und`. Rows without doc_id are not held out. Repeated rows are predicted alike."""
    model = train(docs.where(~held_out(4, 2)))
    return predict(docs, model, with_familiar).withColumn("held_out", held_out(4, 2)).select("doc_id", "held_out", "lang_pred", "score", *["familiar"] * with_familiar)
