"""Byte-pair encoding and decoding with the vocabulary file of a public tokenizer.

The merge loop is the contiguous rank array: a short word is held as an array of parts with the rank of
each adjacent pair beside it; the smallest rank is looked up by a scan, the boundary is deleted, and the
ranks of the two neighbours are refreshed. Here one numpy row holds one word, so that the scan of many
words is one call. Words longer than LONG symbols take the same merges from a heap.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import operator, text_of, tidy

#: Symbols up to which a word counts as short.
LONG = 64
#: Bytes that each of the two generations of remembered words may take in a Python worker, and what an entry costs beyond
#: its characters. Words of more than LONG characters are not kept.
MEMO, ENTRY = 24 << 20, 250
#: Characters of text whose words are held at once.
CHUNK = 1 << 19
WHITE = regex.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: A split pattern for which words of letters are known to be one piece.
PLAIN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NONE = np.int64(1) << 40


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    table = {b: chr(b) for b in own} | {b: chr(256 + n) for n, b in enumerate(rest)}
    return [table[b] for b in range(256)]


def lowered(text: str) -> str:
    """NFC, then each character in lower case by itself (no rule for a final sigma)."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def words_of(text: str) -> list[str]:
    """Split at what the tokenizer sees as white space; str.split also takes the separators 1C to 1F."""
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return [w for w in WHITE.split(text) if w]
    return text.split()


def parts_of(texts: list[str]) -> Iterator[list[tuple[int, list[str]]]]:
    """Words of the texts in parts of about CHUNK characters: lists of (number of the text, words), texts in order."""
    part, size = [], 0
    for k, text in enumerate(texts):
        at = 0
        while at < len(text) or not at:
            end = at + CHUNK
            gap = WHITE.search(text, end) if end < len(text) else None
            end = gap.start() if gap else len(text)
            part.append((k, words_of(text[at:end])))
            size, at = size + end - at, max(end, 1)
            if size >= CHUNK:
                yield part
                part, size = [], 0
    if part:
        yield part


class PairTable:
    """Open addressing from a pair of ids to (rank, merged id), probed for whole arrays at once."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray):
        self.mask = (1 << max(4, int(len(left) * 4).bit_length())) - 1
        self.keys = np.full(self.mask + 1, -1, np.int64)
        self.rank = np.full(self.mask + 1, _NONE, np.int64)
        self.merged = np.zeros(self.mask + 1, np.int64)
        self.probes = 1
        for key, r, m in zip((left.astype(np.int64) << 32 | right).tolist(), rank.tolist(), merged.tolist(), strict=True):
            slot, n = self._slot(key), 1
            while self.keys[slot] != -1:
                slot, n = (slot + 1) & self.mask, n + 1
            self.keys[slot], self.rank[slot], self.merged[slot] = key, r, m
            self.probes = max(self.probes, n)

    def _slot(self, key):
        return (key ^ (key >> 29) ^ (key >> 15)) * 0x9E3779B1 >> 7 & self.mask

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (a very large one if there is no such merge) and merged id of each pair."""
        key = (left << 32) | right
        slot = self._slot(key)
        for _ in range(self.probes - 1):
            wrong = (self.keys[slot] != key) & (self.keys[slot] != -1)
            if not wrong.any():
                break
            slot = np.where(wrong, (slot + 1) & self.mask, slot)
        hit = (self.keys[slot] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.rank[slot], _NONE), self.merged[slot]


class Bpe:
    """Encoder and decoder of a `tokenizers` file with NFC, white space and lower-case normalisation, a
    split pattern, byte-level symbols and an end-of-word suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens: dict[int, str] = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.text_of_id = {str(i): t for i, t in self.tokens.items()}
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = regex.compile(pattern)
        self.plain = pattern == PLAIN
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        symbols = byte_symbols()
        self.inner = np.array([self.vocab.get(s, -1) for s in symbols], np.int64)
        self.last = np.array([self.vocab.get(s + self.suffix, -1) for s in symbols], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ids = np.array([(self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in merges], np.int64)
        self.pairs = PairTable(ids[:, 0], ids[:, 1], np.arange(len(ids)), ids[:, 2])
        self.digits = {i: str(i) for i in self.tokens}
        self.memo: dict[str, str] = {}
        self.old: dict[str, str] = {}
        self.held = 0

    # --- one piece at a time, or many ---

    def merge_short(self, words: list[bytes]) -> np.ndarray:
        """The contiguous rank array for words of at most LONG bytes, one row each; -1 behind a row's parts."""
        width = max(map(len, words))
        size = np.array([len(w) for w in words])
        flat = np.frombuffer(b"".join([w.ljust(width, b"\0") for w in words]), np.uint8).reshape(len(words), width)
        parts = np.where(np.arange(width) < size[:, None], self.inner[flat], -1)
        row = np.arange(len(words))
        parts[row, size - 1] = self.last[flat[row, size - 1]]
        parts = np.pad(parts, ((0, 0), (1, 2)), constant_values=-1)  # a border, so that each part has neighbours
        rank, merged = self.pairs.find(parts[:, :-1], parts[:, 1:])
        live, done, column = row, np.full((len(words), width), -1, np.int64), np.arange(parts.shape[1])
        while len(live):
            at = rank.argmin(1)  # the first of equal ranks: the leftmost pair
            go = rank[np.arange(len(live)), at] != _NONE
            if not go.all():
                done[live[~go], : parts.shape[1] - 3] = parts[~go, 1:-2]
                live, parts, rank, merged, at = live[go], parts[go], rank[go], merged[go], at[go]
                if not len(live):
                    break
            row = np.arange(len(live))
            parts[row, at] = merged[row, at]
            # delete the boundary: all behind it move up by one
            take = np.minimum(column + (column > at[:, None]), column[-1])
            parts = np.take_along_axis(parts, take, 1)
            take = np.minimum(take[:, :-1], column[-2])
            rank, merged = np.take_along_axis(rank, take, 1), np.take_along_axis(merged, take, 1)
            # refresh the ranks on both sides
            for side in (at - 1, at):
                rank[row, side], merged[row, side] = self.pairs.find(parts[row, side], parts[row, side + 1])
            if parts.shape[1] > 4 and (parts[:, -3] < 0).all():
                parts, rank, merged, column = parts[:, :-1], rank[:, :-1], merged[:, :-1], column[:-1]
        return done

    def merge_long(self, word: bytes) -> list[int]:
        """The same merges for a word of any length, smallest rank and then leftmost first."""
        part = [int(self.inner[b]) for b in word]
        part[-1] = int(self.last[word[-1]])
        part = [p for p in part if p >= 0]
        after, before = [*range(1, len(part)), -1], [*range(-1, len(part) - 1)]
        a = np.array(part, np.int64)
        ranks, merged = self.pairs.find(a[:-1], a[1:])
        heap = [(r, i, int(a[i]), int(a[i + 1]), m) for i, (r, m) in enumerate(zip(ranks.tolist(), merged.tolist(), strict=True)) if r != _NONE]
        heapq.heapify(heap)
        while heap:
            _, i, left, right, new = heapq.heappop(heap)
            j = after[i]
            if part[i] != left or j < 0 or part[j] != right:
                continue
            part[i], part[j], after[i] = new, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0:
                    x, y = part[k], part[after[k]]
                    r, m = self.pairs.find(np.array([x]), np.array([y]))
                    if r[0] != _NONE:
                        heapq.heappush(heap, (int(r[0]), k, x, y, int(m[0])))
        return [p for p in part if p >= 0]

    def merge(self, words: list[bytes]) -> list[str]:
        """For each word its ids, as decimal strings joined by a space."""
        out = [""] * len(words)
        for low, top in ((0, 8), (8, 16), (16, LONG)):
            own = [k for k, w in enumerate(words) if low < len(w) <= top]
            for at in range(0, len(own), 20_000):
                block = own[at : at + 20_000]
                rows = self.merge_short([words[k] for k in block])
                digits = list(map(self.digits.__getitem__, rows[rows >= 0].tolist()))
                ends = (rows >= 0).sum(1).cumsum().tolist()
                for k, a, b in zip(block, [0, *ends], ends, strict=False):
                    out[k] = " ".join(digits[a:b])
        for k, w in enumerate(words):
            if len(w) > LONG:
                out[k] = " ".join(map(str, self.merge_long(w)))
        return out

    # --- texts ---

    def cut(self, words: list[str]) -> list[list[str]]:
        """The pieces of each word without white space, as they are split before the merges."""
        every = "\n".join(words)
        low = (every.lower() if every.isascii() else lowered(every)).split("\n")
        if not self.plain:
            return [self.split.findall(w) for w in low]
        # letters are one piece, and so is one sign behind them
        return [[w] if w.isalpha() and w.isascii() else [w[:-1], w[-1]] if w[-1] in ".,!?;:" and w.isascii() and w[:-1].isalpha() else self.split.findall(w) for w in low]

    def learn(self, words: Iterable[str]) -> dict[str, str]:
        """The ids of words as decimal strings joined by a space; short ones are put into the memo."""
        known = {w: self.old[w] for w in words if w in self.old} if self.old else {}  # not seen since the memo was last cleared
        rest = [w for w in words if w not in known]
        special = [w for w in rest if "<|" in w] if self.specials and "<|" in "\n".join(rest) else []
        if special:
            parts = {p for w in special for p in self.specials.split(w) if p and p not in self.special}
            rest = list(set(rest).difference(special) | parts)
        cut = self.cut(rest) if rest else []
        pieces = set().union(*cut)
        ids = {p: self.memo[p] for p in pieces.intersection(self.memo)}  # most pieces are words of their own
        new = list(pieces.difference(ids))
        ids |= zip(new, self.merge([p.encode("utf-8") for p in new]), strict=True)
        known |= {w: ids[own[0]] if len(own) == 1 else " ".join([ids[p] for p in own]) for w, own in zip(rest, cut, strict=True)}
        for w in special:
            known[w] = " ".join([str(self.special[p]) if p in self.special else known[p] for p in self.specials.split(w) if p])
        short = known if max(map(len, known)) <= LONG else {w: i for w, i in known.items() if len(w) <= LONG}
        self.memo |= short
        self.held += ENTRY * len(short) + sum(map(len, short)) + sum(map(len, short.values()))
        return self.memo if short is known else known

    def encode_many(self, texts: list[str]) -> Iterator[str]:
        """For each text its ids, as decimal strings joined by a space."""
        now, ids = 0, []
        for part in parts_of(texts):
            if self.held > MEMO:
                self.old, self.memo, self.held = self.memo, {}, 0
            new = {w for _, words in part for w in words}.difference(self.memo)
            known = self.learn(new) if new else self.memo
            if known is not self.memo:  # with words that are not kept
                known = known | {w: self.memo[w] for _, words in part for w in words if w not in known}
            for k, words in part:
                if k != now:
                    yield " ".join(ids)
                    now, ids = k, []
                own = " ".join(map(known.__getitem__, words))
                if own:
                    ids.append(own if "  " not in own and own.strip(" ") == own else " ".join(own.split()))
        if texts:
            yield " ".join(ids)

    def forget(self) -> None:
        """Drop what was learned: Python workers live on into stages that have no use for it."""
        self.memo, self.old, self.held = {}, {}, 0

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in next(self.encode_many([text])).split()]

    def decode(self, ids: Iterable[int]) -> str:
        """Token strings joined by a space, special tokens too; ids that are not in the vocabulary are left out."""
        return " ".join([self.tokens[i] for i in ids if i in self.tokens])

    def decode_digits(self, ids: str) -> str:
        out, at = [], 0
        while at < len(ids):
            end = ids.find(" ", at + CHUNK)
            end = end if end >= 0 else len(ids)
            out.append(" ".join(map(self.text_of_id.__getitem__, ids[at:end].split(" "))))
            at = end + 1
        return " ".join(out)


_LOADED: dict[str, Bpe] = {}


def loaded(path: str) -> Bpe:
    """The tokenizer of a path, made once in each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


#: What bpe() can return for each text.
OUTPUTS = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "ids_sha256": pa.string(), "decoded": pa.string(), "decoded_sha256": pa.string()}
_SQL = {"n_tokens": "long", "ids": "array<int>", "ids_sha256": "string", "decoded": "string", "decoded_sha256": "string"}


@operator
def bpe(docs: DataFrame, path: str, outputs: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """doc_id and the chosen OUTPUTS of the whole text of each row of docs, in one narrow pass.

    ids are what the tokenizer of the vocabulary file gives without extra tokens; decoded is its text for
    these ids. A null text counts as empty: no ids, an empty decoded text. Rows that repeat give equal
    rows. Columns other than doc_id and text are not read.
    """
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = loaded(path)
        for batch in batches:
            out: dict[str, list] = {k: [] for k in outputs}
            for ids in own.encode_many(batch.column(1).to_pylist()):
                decoded = own.decode_digits(ids) if "decoded" in outputs or "decoded_sha256" in outputs else ""
                for k in outputs:
                    out[k].append(
                        ids.count(" ") + 1 if k == "n_tokens" and ids else 0 if k == "n_tokens" else
                        (np.fromstring(ids, np.int32, sep=" ") if ids else np.zeros(0, np.int32)) if k == "ids" else sha(ids) if k == "ids_sha256" else decoded if k == "decoded" else sha(decoded)
                    )
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(out[k], OUTPUTS[k]) for k in outputs]], ["doc_id", *outputs])
        own.forget()
        tidy()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{k} {_SQL[k]}" for k in outputs))


@operator
def decode(encoded: DataFrame, path: str, column: str = "ids") -> DataFrame:
    """doc_id and text decoded from an array of ids; null counts as no ids."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = loaded(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.decode(x or ()) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])
        tidy()

    return encoded.select("doc_id", column).mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")
