"""Benchmark decontamination by Wu-Manber search over words.

Patterns are the windows of benchmark items. They are grouped by their number of words m; for each m a block
of B words at the end of a window of the text is looked up in a shift table: a block that no pattern contains
lets the search skip m - B + 1 words, one that lies within patterns lets it skip to where it could end one, and
only a block that ends some pattern (shift 0) opens its suffix bucket, whose patterns are compared word by word.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, materialise, operator, text_of, tidy

#: Words in a window.
WINDOW = 10
#: Words in a block of the shift table (one for windows of one word).
BLOCK = 2
#: Windows searched for in one pass over the documents (about 800 bytes each in a worker); more are taken in further passes.
WINDOWS_PER_PASS = 200_000
#: A-Z to a-z, other ASCII but digits and small letters to a space, all other bytes stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lowered, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


class WuManber:
    """The tables for patterns of the same number of words: {words joined by spaces: items}."""

    def __init__(self, patterns: dict[bytes, set]):
        self.size = m = len(next(iter(patterns)).split(b" "))
        self.block = b = min(BLOCK, m)
        self.far = m - b + 1
        self.shift: dict = {}
        self.bucket: dict = {}
        for joined, items in patterns.items():
            p = joined.split(b" ")
            for end in range(b, m + 1):
                block = b" ".join(p[end - b : end])
                self.shift[block] = min(self.shift.get(block, self.far), m - end)
            self.bucket.setdefault(block, []).append((joined, items))

    def search(self, words: list[bytes], hit: np.ndarray, items: set) -> None:
        """Mark the words of all occurrences in hit and add the items of their patterns."""
        shift, bucket, far, m = self.shift.get, self.bucket, self.far, self.size
        at, n = m, len(words)  # at: one behind the last word of the window
        if self.block == 2:
            while at <= n:
                block = words[at - 2] + b" " + words[at - 1]
                skip = shift(block, far)
                if skip:
                    at += skip
                    continue
                self._compare(b" ".join(words[at - m : at]), bucket[block], at, hit, items)
                at += 1
        else:
            for at, word in enumerate(words, 1):
                if word in bucket:
                    self._compare(word, bucket[word], at, hit, items)

    def _compare(self, window: bytes, bucket: list, at: int, hit: np.ndarray, items: set) -> None:
        for pattern, own in bucket:
            if pattern == window:
                hit[at - self.size : at] = True
                items |= own


def search_tables(windows: Iterable[tuple[str, str | None]]) -> list[WuManber]:
    """Tables for rows of (window, item); a null item has no name, but its windows are found."""
    by_size: dict[int, dict[bytes, set]] = {}
    for window, item in windows:
        data = window.encode("utf-8", "surrogatepass")
        by_size.setdefault(data.count(b" "), {}).setdefault(data, set()).update(() if item is None else (item,))
    return [WuManber(p) for p in by_size.values()]


def windows_of(benchmark: DataFrame, window: int) -> DataFrame:
    """Distinct (window, item): the windows of items, words joined by spaces; an item of fewer words is one window, one
    without words none."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                size = min(window, len(words))
                places = range(len(words) - size + 1 if size else 0)
                for at in range(0, len(places), 10_000):
                    found = [b" ".join(words[k : k + size]).decode("utf-8", "surrogatepass") for k in places[at : at + 10_000]]
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([item] * len(found), pa.string())], ["window", "item"])

    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), text_of().alias("text"))
    return rows.mapInArrow(run, "window string, item string").distinct()


_SPANS = "array<struct<start:int,end:int>>"
_TABLES: dict[str, list[WuManber]] = {}


def _tables(key: str, windows: list[tuple[str, str | None]]) -> list[WuManber]:
    """The tables of a pass, made once in each Python worker, which holds those of one pass."""
    if key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = search_tables(windows)
    return _TABLES[key]


def _pass(docs: DataFrame, windows: list[tuple[str, str | None]], only_hits: bool) -> DataFrame:
    """doc_id, text_key, n_words, spans, items for the rows of docs, or for those with a hit."""
    shared, key = docs.sparkSession.sparkContext.broadcast(windows), uuid.uuid4().hex
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _tables(key, shared.value)
        for batch in batches:
            n_words, spans, items, kept = [], [], [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                words = words_of(text)
                hit, found = np.zeros(len(words), bool), set()
                for t in tables:
                    t.search(words, hit, found)
                edges = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8))) if hit.any() else []
                if len(edges) or not only_hits:
                    kept.append(k)
                    n_words.append(len(words))
                    spans.append([{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)])
                    items.append(sorted(found))
            rows = batch.select(["doc_id", "text_key"]).take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(n_words, pa.int64()), pa.array(spans, span), pa.array(items, pa.list_(pa.string()))], ["doc_id", "text_key", "n_words", "spans", "items"])
        tidy()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text_key", "text").mapInArrow(run, f"doc_id {kind}, text_key binary, n_words long, spans {_SPANS}, items array<string>")


@operator
def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, per_pass: int = WINDOWS_PER_PASS) -> DataFrame:
    """One row per row of docs: doc_id, n_words, spans (start and end word of hit stretches), items (sorted), both empty
    where nothing occurs.

    Windows are dealt to passes of about per_pass by a hash; with one pass, which is usual, documents are read once and
    nothing is shuffled. Further passes give only the rows that they hit, by a digest of the text, and these are merged and
    joined to the documents. A null text has no words. Windows of an item with a null id are hit, but it is not among the
    items; items that share an id count as one. Repeated rows are found alike.
    """
    windows = materialise(windows_of(benchmark, window))
    passes = max(1, -(-windows.count() // per_pass))
    rows = docs.select("doc_id", text_of().alias("text")).withColumn("text_key", F.unhex(F.md5("text")) if passes > 1 else F.lit(None).cast("binary"))
    dealt = lambda k: [tuple(r) for r in windows.where(F.pmod(F.xxhash64("window", "item"), F.lit(passes)) == k).toLocalIterator()]
    if passes == 1:
        return _pass(rows, dealt(0), False).select("doc_id", "n_words", "spans", "items")
    every = materialise(_pass(rows, [], False).select("doc_id", "text_key", "n_words"))
    hits = functools.reduce(DataFrame.union, [materialise(_pass(rows, dealt(k), True).select("text_key", "spans", "items")) for k in range(passes)])
    # a text's hits are alike in all rows that have it, so one of each pass is enough
    hits = hits.groupBy("text_key").agg(F.array_sort(F.flatten(F.collect_set("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    hits = materialise(hits.withColumn("spans", _merged("spans")))
    found = every.join(F.broadcast(hits) if hits.count() <= BROADCAST_ROWS // 100 else hits, "text_key", "left")
    return found.select("doc_id", "n_words", F.coalesce("spans", F.array().cast(_SPANS)).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _merged(spans: str) -> Column:
    """Sorted spans with those that touch made one; the last is held apart until it is complete."""
    kind = "struct<start:int,end:int>"
    step = lambda s, x: F.when(s["now"].isNull(), F.struct(s["done"].alias("done"), x.alias("now"))).when(
        x["start"] <= s["now"]["end"], F.struct(s["done"].alias("done"), F.struct(s["now"]["start"].alias("start"), F.greatest(s["now"]["end"], x["end"]).alias("end")).alias("now"))
    ).otherwise(F.struct(F.concat(s["done"], F.array(s["now"])).alias("done"), x.alias("now")))
    zero = F.struct(F.array().cast(f"array<{kind}>").alias("done"), F.lit(None).cast(kind).alias("now"))
    return F.aggregate(spans, zero, step, lambda s: F.concat(s["done"], F.array_compact(F.array(s["now"]))))


@operator
def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, per_pass: int = WINDOWS_PER_PASS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated (n_hit > 0) for each row of docs."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return find(docs, benchmark, window, per_pass).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )
