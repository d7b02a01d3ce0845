"""Shards: round trip, order, lookup, and ids against the tokenizers library."""

import io
import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from legalspark.llm import sstable
from tests.llm.test_bpe import PATH, texts


def test_memo_gives_the_ids_of_whole_texts():
    library, own = Tokenizer.from_file(PATH), sstable.LibraryEncoder(PATH)
    for text, packed in zip(texts(), own.encode_many(texts()), strict=True):
        assert np.frombuffer(packed, own.dtype).tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_other_tokenizers_get_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), sstable.LibraryEncoder(path)
    some = ["Hello  world of\nlaw", *texts()[:500]]
    assert own.split is None
    for text, packed in zip(some, own.encode_many(some), strict=True):
        assert np.frombuffer(packed, own.dtype).tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_forgetting_and_parts_change_nothing(monkeypatch):
    library, own = Tokenizer.from_file(PATH), sstable.LibraryEncoder(PATH)
    monkeypatch.setattr(sstable, "MEMO", 20_000)
    monkeypatch.setattr("legalspark.llm.bpe.CHUNK", 200)
    some = texts() + texts()[::-1]
    for text, packed in zip(some, own.encode_many(some), strict=True):
        assert np.frombuffer(packed, own.dtype).tolist() == library.encode(text, add_special_tokens=False).ids, text
    assert own.held < 100_000 and max(map(len, own.memo)) <= 64


def brute(rows):
    library, start, out = Tokenizer.from_file(PATH), 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_whole_table(spark):
    rng = random.Random(2)
    rows = [(k * rng.choice((1, -1)), " ".join(rng.choice(("the", "Quick", "brown,", "fox.")) for _ in range(rng.randint(0, 50)))) for k in range(1, 400)]
    rows += [(0, None), (1000, ""), (1001, "word " * 60_000), (None, "no identifier")]
    docs = spark.createDataFrame([(i, "x", t) for i, t in rows], "doc_id long, ids string, text string").repartition(7)
    manifest, read = sstable.tokens_to_shards(docs, PATH)
    assert sorted((tuple(r) for r in read.collect()), key=lambda r: r[1]) == brute(rows)
    assert sum(r["docs"] for r in manifest.collect()) == len(rows)
    wanted = spark.createDataFrame([(i,) for i in (0, 1000, 1001, 5, 77777, rows[3][0], None)], "doc_id long")
    found = {r["doc_id"]: len(r["ids"]) for r in sstable.lookup(manifest, wanted).collect()}
    sizes = {i: n for i, _, n, _ in brute(rows)}
    assert found == {i: sizes[i] for i in (0, 1000, 1001, rows[3][0], None) if i in sizes} | {i: sizes[i] for i in (5,) if i in sizes}


def test_repeated_identifiers_and_an_empty_table(spark):
    docs = spark.createDataFrame([(3, "a b"), (3, "a b"), (3, "c")], "doc_id long, text string")
    manifest, read = sstable.tokens_to_shards(docs, PATH)
    got = sorted(tuple(r) for r in read.collect())
    assert [(g[0], g[2]) for g in sorted(got, key=lambda g: g[1])] in ([(3, 3), (3, 3), (3, 2)], [(3, 2), (3, 3), (3, 3)])
    assert sstable.lookup(manifest, docs.select("doc_id")).count() == 3
    assert sstable.tokens_to_shards(docs.limit(0), PATH)[1].count() == 0


def test_lookup_in_slices(spark, monkeypatch):
    monkeypatch.setattr(sstable, "SHARDS", 1)
    docs = spark.createDataFrame([(k // 3, f"word {k}") for k in range(300)], "doc_id long, text string").repartition(6)
    manifest, _ = sstable.tokens_to_shards(docs, PATH)
    assert sstable.lookup(manifest, spark.range(-5, 105).toDF("doc_id")).count() == 300


def test_blocks_share_prefixes(tmp_path):
    out = io.BytesIO()
    out.close = lambda: None
    writer = sstable.Writer(out, 2)
    for k in range(5000):
        writer.add(sstable.key_of(k * 3), np.arange(k % 50, dtype="<u2").tobytes())
    writer.close()
    (tmp_path / "a.sst").write_bytes(out.getvalue())
    reader = sstable.Reader(f"file://{tmp_path}/a.sst")
    assert [(sstable.id_of(k), len(v)) for k, v in reader] == [(k * 3, k % 50) for k in range(5000)]
    assert len(reader.index) > 1
    assert [len(x) for x in reader.get(3 * 4321)] == [4321 % 50]
    assert reader.get(3 * 4321 + 1) == []


def test_each_shard_is_read_by_a_task_of_its_own(spark):
    from legalspark.llm.common import dealt

    docs = spark.range(600).selectExpr("id AS doc_id", "repeat('the quick fox ', 20) AS text").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest, read = sstable.tokens_to_shards(docs, PATH)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    n = manifest.count()
    assert n == 4 and read.count() == 600
    assert sorted(len(x) for x in dealt(manifest).rdd.glom().collect()) == [1] * n
