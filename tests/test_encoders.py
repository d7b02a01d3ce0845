"""Encoders: models are loaded once in a worker, equal texts are encoded once, known ones not at all."""

import os
import uuid

import numpy as np

from legalspark.operators import retrieval, vectors


def counting(folder):
    """A factory whose model writes a file for each load and each batch."""

    def factory():
        open(f"{folder}/load-{os.getpid()}-{uuid.uuid4().hex}", "w").close()

        def model(texts):
            with open(f"{folder}/batch-{uuid.uuid4().hex}", "w") as f:
                f.write("\n".join(texts))
            return np.array([[len(t), t.count("a")] for t in texts], np.float32).reshape(-1, 2)

        return model

    factory.__qualname__ += uuid.uuid4().hex  # a model of its own for each test
    return factory


def noted(folder):
    loads = [f.split("-")[1] for f in os.listdir(folder) if f.startswith("load")]
    batches = [open(f"{folder}/{f}").read().split("\n") for f in os.listdir(folder) if f.startswith("batch")]
    return loads, [t for b in batches for t in b]


def test_loads_and_encoded_texts(spark, tmp_path):
    texts = [f"text {k % 40} " + "a" * (k % 40) for k in range(400)] + [None, ""]
    df = spark.createDataFrame([(k, t, "own") for k, t in enumerate(texts)], "id int, text string, digest string").repartition(12)
    factory = counting(tmp_path)
    known = vectors.new_vectors(df.where("id < 20"), "text", factory=factory)
    assert known.count() == 20 and sorted(noted(tmp_path)[1]) == sorted(texts[:20])
    out = vectors.embed(df, "text", factory=factory, known=known, once=True)
    assert out.columns == ["id", "text", "digest", "embedding"]
    for r in out.collect():
        assert r["digest"] == "own" and r["embedding"] == (None if r["text"] is None else [len(r["text"]), r["text"].count("a")])
    loads, encoded = noted(tmp_path)
    assert len(loads) == len(set(loads))  # once for each worker, however many tasks it had
    assert len(encoded) == len(set(encoded)) == 41 and sorted(encoded) == sorted(set(texts) - {None})


def test_batches_of_like_length():
    sizes = []

    def model(texts):
        sizes.append([len(t) for t in texts])
        return np.array([[len(t)] for t in texts])

    texts = ["x" * (k * 7919 % 3000) for k in range(500)] + ["y" * 200_000]
    assert [int(v[0]) for v in vectors._encoded(texts, model)] == [len(t) for t in texts]
    assert all(len(b) * max(b) <= vectors.TOGETHER or len(b) == 1 for b in sizes) and [max(b) for b in sizes] == sorted(max(b) for b in sizes)
    assert vectors._encoded([], model) == []


def test_context_blocks(spark):
    ranked = spark.createDataFrame([(1, "article", "a", 1), (1, "article", "b", 2), (1, "article", "a", 3), (1, "case", "c", 1), (1, "case", "e", 2)], "query_id int, type string, id string, rank int")
    laws = spark.createDataFrame([("a", "D", "1", "T", "whole a"), ("b", None, "2", None, None)], "id string, document_title string, article_number string, title string, content string")
    cases = spark.createDataFrame([("c", "C1", "K", None, "A v B", "[ERROR x", "sum", None), ("e", "C2", "K", "d", "E", "j" * 2000, "s", "/e")], "id string, citation string, court string, date string, title string, pdf_data string, summary string, pdf_link string")
    near = spark.createDataFrame([(1, "a", "x y", 1), (1, "a", "z", 2), (1, "b", "", 1)], "query_id int, article_id string, text string, rank int")
    plain = {(r["type"], r["rank"]): (r["header"], r["content"]) for r in retrieval.context_blocks(ranked, laws, cases).collect()}
    assert plain["article", 1] == ("[Statutory Law 1]\nDocument: D\nArticle 1: T", "Content: whole a") and plain["article", 2] == ("[Statutory Law 2]\nDocument: N/A\nArticle 2: N/A", "Content: N/A")
    assert plain["case", 1] == ("[Case Law 1]\nCitation: C1\nCourt: K\nDate: N/A\nTitle: A v B", "Summary: sum") and plain["case", 2][1] == "Judgment Text:\n" + "j" * 1500 + "\nFull Judgment: /e" and len(plain) == 4
    fine = retrieval.context_blocks(ranked, laws, cases, near).where("type = 'article'").orderBy("rank").select("content").collect()
    assert [r[0] for r in fine] == ["Relevant Clauses:\n- x y\n- z", "Content: N/A"]
