"""Token ids as sorted-string-table shards.

A shard holds documents in ascending order of their key. File format, all integers little-endian:

    block*  bloom  index  footer(44 bytes)
    block:  zstd of entry*, entry = shared u16, unshared u16, ids u32, unshared key bytes, ids as u16 or u32
    bloom:  bits of a Bloom filter over the keys, BLOOM_PROBES probes
    index:  zstd of (first key 9 bytes, offset u64, size u32, documents u32) for each block
    footer: bloom offset u64, index offset u64, index size u32, documents u64, ids u64, width u32, magic 4s

A key is a marker byte (0 for a null identifier, which comes first) and the identifier as eight bytes in big-endian
order with its sign flipped, so that the order of bytes is the order of identifiers; within a block each key leaves out
the bytes it shares with the one before it.
"""

from __future__ import annotations

import functools
import json
import os
import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import LONG, PLAIN, lowered, parts_of
from .common import dealt, groups_of, materialise, operator, shared_dir, text_of, tidy

MAGIC = b"SST1"
FOOTER = struct.Struct("<QQIQQI4s")
ENTRY = struct.Struct("<HHI")
INDEX = struct.Struct("<9sQII")
BLOOM_PROBES = 4
BLOOM_BITS_PER_KEY = 12
#: Bytes of entries in a block, and of blocks in a shard, before the next is begun.
BLOCK, SHARD = 64 << 10, 256 << 20
#: Bytes that each of the two generations of kept words may take in a Python worker, and what an entry costs beyond its
#: characters and ids.
MEMO, ENTRY_BYTES = 160 << 20, 220
#: The only normalisation and split of a tokenizer file for which words are taken apart before the library.
NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLITS = {"type": "Split", "pattern": {"Regex": PLAIN}, "behavior": "Removed", "invert": True}
#: Shards whose names a worker holds for a lookup.
SHARDS = 200_000
#: Pieces that go to the library as one text.
PIECES = 2_000


def key_of(doc_id: int | None) -> bytes:
    return b"\0" * 9 if doc_id is None else b"\1" + struct.pack(">Q", (doc_id + (1 << 63)) & (1 << 64) - 1)


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:])[0] - (1 << 63) if key[0] else None


def probes(key: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key[::-1], 0x5BD1E995) | 1
    return [(a + i * b) % bits for i in range(BLOOM_PROBES)]


class Writer:
    """Streams documents in key order to one file; holds one block, the sparse index and the keys' filter."""

    def __init__(self, out, width: int):
        self.out, self.width, self.dtype = out, width, np.dtype("<u2" if width == 2 else "<u4")
        self.block, self.filled, self.first, self.last, self.count = [], 0, b"", b"", 0
        self.at, self.index, self.keys, self.docs, self.ids = 0, [], [], 0, 0
        self.zip = zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, ids: bytes) -> None:
        shared = len(os.path.commonprefix([self.last, key])) if self.block else 0
        if not self.block:
            self.first = key
        n = len(ids) // self.width
        self.block += [ENTRY.pack(shared, len(key) - shared, n), key[shared:], ids]
        self.filled += len(ids) + 16
        self.last, self.count, self.docs, self.ids = key, self.count + 1, self.docs + 1, self.ids + n
        self.keys.append(key)
        if self.filled >= BLOCK:
            self.flush()

    def flush(self) -> None:
        if self.block:
            data = self.zip.compress(b"".join(self.block))
            self.index.append(INDEX.pack(self.first, self.at, len(data), self.count))
            self.out.write(data)
            self.at += len(data)
            self.block, self.filled, self.count = [], 0, 0

    def close(self) -> None:
        self.flush()
        bits = max(64, BLOOM_BITS_PER_KEY * len(self.keys) + 7 & ~7)
        bloom = np.zeros(bits // 8, np.uint8)
        for key in self.keys:
            for p in probes(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        index = self.zip.compress(b"".join(self.index))
        self.out.write(bloom.tobytes())
        self.out.write(index)
        self.out.write(FOOTER.pack(self.at, self.at + len(bloom), len(index), self.docs, self.ids, self.width, MAGIC))
        self.out.close()


class Reader:
    """Reads a shard: all entries in order, or one by a binary search of the sparse index."""

    def __init__(self, path: str):
        fs, name = pafs.FileSystem.from_uri(path)
        self.file = fs.open_input_file(name)
        size = self.file.size()
        self.bloom_at, index_at, index_size, self.docs, self.ids, self.width, magic = FOOTER.unpack(self.read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"not a shard: {path}")
        self.bloom = np.frombuffer(self.read(self.bloom_at, index_at - self.bloom_at), np.uint8)
        self.unzip = zstandard.ZstdDecompressor()
        self.index = list(INDEX.iter_unpack(self.unzip.decompress(self.read(index_at, index_size)))) if self.docs else []
        self.dtype = np.dtype("<u2" if self.width == 2 else "<u4")

    def read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def block(self, n: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, at, size, _ = self.index[n]
        data, here, key = self.unzip.decompress(self.read(at, size)), 0, b""
        while here < len(data):
            shared, rest, ids = ENTRY.unpack_from(data, here)
            here += ENTRY.size
            key = key[:shared] + data[here : here + rest]
            here += rest
            yield key, np.frombuffer(data, self.dtype, ids, here)
            here += ids * self.width

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for n in range(len(self.index)):
            yield from self.block(n)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of all documents with this identifier (repeated identifiers may span blocks)."""
        key = key_of(doc_id)
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in probes(key, len(self.bloom) * 8)):
            return []
        firsts = [x[0] for x in self.index]
        n, found = max(0, bisect_right(firsts, key) - 1), []
        while n > 0 and firsts[n] == key:
            n -= 1
        while n < len(self.index) and firsts[n] <= key:
            found += [ids for k, ids in self.block(n) if k == key]
            n += 1
        return found


class LibraryEncoder:
    """Ids from the tokenizers library, as packed bytes.

    Any tokenizer file gets whole texts. One whose normalisation and split pattern are those of SPLITS certainly cuts at
    white space and merges within pieces of words, so there each distinct piece goes to the library once and its packed ids
    are kept: many pieces make one text, and the marks at the ends of words part their ids again. That is what makes
    the difference between 900 and 350 CPU seconds a GB.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.width = 2 if size <= 1 << 16 else 4
        self.dtype = np.dtype("<u2" if self.width == 2 else "<u4")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.split = None
        suffix, normal, cut = spec["model"].get("end_of_word_suffix"), (spec["normalizer"] or {}).get("normalizers"), (spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        if suffix and normal == NORMAL and cut[0] == SPLITS and [c["type"] for c in cut[1:]] == ["ByteLevel"] and not (cut[1]["add_prefix_space"] or cut[1]["use_regex"]) and not any(t["normalized"] for t in spec["added_tokens"]):
            self.split = regex.compile(PLAIN)
            self.ends = np.zeros(size, bool)
            self.ends[[i for t, i in self.library.get_vocab(with_added_tokens=False).items() if t.endswith(suffix)]] = True
        self.forget()

    def forget(self) -> None:
        """Drop what was learned: Python workers live on into stages that have no use for it."""
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def pieces(self, word: str) -> list[str]:
        """The word in the tokenizer's normal form, cut as it cuts; plain words need no pattern."""
        low = word.lower() if word.isascii() else lowered(word)
        if low.isalpha() and low.isascii():
            return [low]
        if low[-1] in ".,!?;:" and low.isascii() and low[:-1].isalpha():
            return [low[:-1], low[-1]]
        return self.split.findall(low)

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """Packed ids of words; short ones are put into the memo."""
        memo, every = self.memo, " ".join(words)
        special = [w for w in words if any(s in w for s in self.special)] if any(s in every for s in self.special) else []
        words = list(set(words).difference(special)) if special else words
        known = dict(zip(special, self.whole(special), strict=True))
        cut = [self.pieces(w) for w in words]
        pieces = list(set().union(*cut).difference(memo))  # a piece is a word of its own
        fresh: dict[str, bytes] = {}
        for at in range(0, len(pieces), PIECES):
            block = pieces[at : at + PIECES]
            ids = np.array(self.library.encode_batch_fast([" ".join(block)], add_special_tokens=False)[0].ids, np.int64)
            ends = ((np.flatnonzero(self.ends[ids]) + 1) * self.width).tolist()
            if len(ends) != len(block):
                raise ValueError("the library cuts these pieces otherwise")
            packed, start = ids.astype(self.dtype).tobytes(), 0
            for p, end in zip(block, ends, strict=True):
                fresh[p] = packed[start:end]
                start = end
        of = lambda p: fresh[p] if p in fresh else memo[p]
        known |= {w: of(own[0]) if len(own) == 1 else b"".join([of(p) for p in own]) for w, own in zip(words, cut, strict=True)}
        return known

    def keep(self, known: dict[str, bytes]) -> bool:
        """Whether all are short enough to stay in the memo, where short ones are put."""
        short = known if max(map(len, known), default=0) <= LONG else {w: i for w, i in known.items() if len(w) <= LONG}
        self.memo |= short
        self.held += ENTRY_BYTES * len(short) + sum(map(len, short)) + sum(map(len, short.values()))
        return short is known

    def encode_many(self, texts: list[str]) -> list[bytes]:
        if self.split is None:
            return [ids for block in groups_of(texts) for ids in self.whole(block)]
        out: list[list[bytes]] = [[] for _ in texts]
        for part in parts_of(texts):
            if self.held > MEMO:
                self.old, self.memo, self.held = self.memo, {}, 0
            new = {w for _, words in part for w in words}.difference(self.memo)
            known = {w: self.old[w] for w in new if w in self.old} if self.old else {}
            self.keep(known)
            rest = list(new.difference(known))
            known = self.memo
            if rest and not self.keep(fresh := self.learn(rest)):  # with words that are not kept
                known = fresh | {w: self.memo[w] for _, words in part for w in words if w not in fresh}
            for k, words in part:
                out[k].append(b"".join(map(known.__getitem__, words)))
        return [b"".join(ids) for ids in out]


_LOADED: dict[str, LibraryEncoder] = {}


def loaded(path: str) -> LibraryEncoder:
    """The encoder of a path, made once in each Python worker, with what it has learned in earlier tasks. A function of the
    module: what a task's own function names would be copied into each task."""
    if path not in _LOADED:
        _LOADED[path] = LibraryEncoder(path)
    return _LOADED[path]


_MANIFEST = "path string, low string, high string, docs long, ids long"


@operator
def write_shards(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 1) -> DataFrame:
    """Write the ids of every whole text, each document followed by end_id, to shards in ascending doc_id order.

    Returns the manifest, one row per shard: path, low and high key as hex, docs, ids. Rows are dealt by ranges of
    doc_id and sorted within them by Spark, which spills; equal identifiers are ordered by the hash of their text. A
    task writes to names of its own, and only what a committed task reports is in the manifest, so that repeated and
    lost tasks leave nothing that is read. Null texts are empty, and hold only end_id; a null doc_id comes first.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(tokenizer)
        fs, base = pafs.FileSystem.from_uri(folder)
        end, writer, name, low, done = np.array([end_id], encoder.dtype).tobytes(), None, "", b"", []

        def finish():
            writer.close()
            done.append((f"{folder}/{name}", low.hex(), writer.last.hex(), writer.docs, writer.ids))

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode_many(batch.column(1).to_pylist()), strict=True):
                key = key_of(doc_id)
                if writer and writer.at >= SHARD:
                    finish()
                    writer = None
                if writer is None:
                    fs.create_dir(base)
                    name, low = f"{uuid.uuid4().hex}.sst", key
                    writer = Writer(fs.open_output_stream(f"{base}/{name}"), encoder.width)
                writer.add(key, ids + end)
        if writer:
            finish()
        tidy()
        if done:
            yield pa.RecordBatch.from_pandas(pd.DataFrame(done, columns=["path", "low", "high", "docs", "ids"]), preserve_index=False)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    ranged = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return materialise(ranged.mapInArrow(run, _MANIFEST))


@operator
def read_shards(manifest: DataFrame) -> DataFrame:
    """All documents of the shards: doc_id, start (ids before it, over all shards), n_tokens, ids_crc32.

    Only the manifest, one row per shard, is put in order by one task; each shard is then read by itself.
    """
    order = Window.orderBy("low", "high", "path")
    starts = manifest.withColumn("before", F.coalesce(F.sum("ids").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    shards = starts.select("path", F.col("before").cast("long").alias("before"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out = []
                for key, ids in Reader(path):
                    out.append((id_of(key), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(out) == 10_000:
                        yield _rows(out)
                        out = []
                if out:
                    yield _rows(out)

    return dealt(shards).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])


@operator
def lookup(manifest: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id and ids of the wanted identifiers (one column doc_id) that the shards hold.

    The manifest says which shards may hold a key: they are in order, so a binary search finds the last of them, and those
    before it follow. It goes to the tasks in slices of SHARDS. In a shard the Bloom filter, then a binary search of the
    sparse index, then one block decide.
    """
    spark = manifest.sparkSession
    keys, shards = materialise(wanted.select(F.col("doc_id").cast("long")).distinct()), materialise(manifest.select("low", "high", "path"))
    slices = -(-shards.count() // SHARDS)

    def routed(k: int) -> DataFrame:
        own = shards.where(F.pmod(F.xxhash64("path"), F.lit(slices)) == k)
        shared = spark.sparkContext.broadcast(sorted(tuple(r) for r in own.toLocalIterator()))

        def route(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            table = shared.value
            for pdf in batches:
                out = []
                for key in [key_of(None if pd.isna(x) else int(x)).hex() for x in pdf["doc_id"]]:
                    at = bisect_right(table, (key, "~")) - 1
                    while at >= 0 and table[at][1] >= key:
                        out.append((table[at][2], key))
                        at -= 1
                yield pd.DataFrame(out, columns=["path", "key"])

        return keys.mapInPandas(route, "path string, key string")

    every = [routed(k) for k in range(slices)] or [keys.select(F.lit("").alias("path"), F.lit("").alias("key")).limit(0)]
    found = functools.reduce(DataFrame.union, every)

    def fetch(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened: dict[str, Reader] = {}
        for pdf in batches:
            out = []
            for path, key in zip(pdf["path"], pdf["key"], strict=True):
                if path not in opened:
                    opened = {path: Reader(path)}
                doc_id = id_of(bytes.fromhex(key))
                out += [(doc_id, ids.astype(np.int64)) for ids in opened[path].get(doc_id)]
            yield pd.DataFrame({"doc_id": pd.array([d for d, _ in out], "Int64"), "ids": [i for _, i in out]})

    found = materialise(found)
    tasks = 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return found.repartition(tasks, "path").sortWithinPartitions("path").mapInPandas(fetch, "doc_id long, ids array<long>")


def tokens_to_shards(docs: DataFrame, tokenizer: str, end_id: int = 1, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Write, and read back: (manifest, rows of read_shards)."""
    manifest = write_shards(docs, tokenizer, folder or shared_dir(docs.sparkSession), end_id)
    return manifest, read_shards(manifest)
