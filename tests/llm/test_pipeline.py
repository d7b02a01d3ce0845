"""The pipeline against a plain one, stage by stage, on a small table."""

import os
import random

import corpus_pipeline
from pyspark.sql import functions as F

from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_minhash import brute as near_groups

WORDS = {"en": "the of and that with this from have been were they which".split(), "de": "der die und nicht auch für über wäre können müssen groß straße".split()}


def corpus():
    rng = random.Random(9)
    text = lambda lang, n: " ".join(rng.choice(WORDS[lang]) + rng.choice("abcdefgh") * rng.randint(0, 3) for _ in range(n))
    rows = [(k, text("en" if k % 2 else "de", rng.randint(30, 60)), "en" if k % 2 else "de") for k in range(120)]
    rows += [(200 + k, rows[k][1], rows[k][2]) for k in range(15)]  # exact copies
    rows += [(300 + k, rows[20 + k][1] + " another", rows[20 + k][2]) for k in range(15)]  # near copies
    item = text("en", 14)
    rows += [(400 + k, text("en", 10) + " " + item + " " + text("en", 10), "en") for k in range(5)]
    rows += [(500, None, None), (501, "123 456", None), (502, "", "en"), (0, rows[0][1], rows[0][2])]
    return rows, [(1, item), (2, None)]


def test_stages(spark, tmp_path):
    rows, items = corpus()
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, str(tmp_path))
        assert name == "bpe" or now.columns == docs.columns
        now.write.parquet(str(tmp_path / str(k)))
        now = spark.read.parquet(str(tmp_path / str(k)))
        seen[name] = sorted((r["doc_id"], r["text"]) for r in now.select("doc_id", "text").collect()) if name != "bpe" else None
    assert [i for i, _ in seen["language"]] == sorted(i for i, t, _ in rows if t and any(c.isalpha() for c in t))
    best = {}
    for i, t in seen["language"]:
        best[t] = max(best.get(t, -1), i)
    assert seen["exact_dedup"] == sorted((i, t) for t, i in best.items())
    groups, _ = near_groups(seen["exact_dedup"], 80)
    assert seen["near_dedup"] == [(i, t) for i, t in seen["exact_dedup"] if groups[i] == i]
    bad = {r[0] for r in contaminated(seen["near_dedup"], items) if r[-1]}
    assert seen["decontaminate"] == [(i, t) for i, t in seen["near_dedup"] if i not in bad] and bad
    last = {r["doc_id"]: r for r in now.collect()}
    assert set(last) == {i for i, _ in seen["decontaminate"]} and all(len(r["ids"]) == r["n_tokens"] for r in last.values())
    whole = {r["doc_id"]: r["ids_sha256"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert whole == {i: r["ids_sha256"] for i, r in last.items()}


def test_unlearned_languages_go_and_mixtures_stay(spark):
    rows, _ = corpus()
    rng = random.Random(3)
    rows += [(900 + k, " ".join(rows[k + j][1] for j in range(2)), None) for k in range(10)]  # half en, half de
    rows += [(920 + k, "\n".join(" ".join(rows[k + j][1].split()[:6]) for j in range(8)), None) for k in range(10)]  # by line
    polish = "wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw są oni obdarzeni rozumem i sumieniem".split()
    bad = [(700 + k, " ".join(rng.choice(polish) for _ in range(40)), None) for k in range(10)]
    bad += [(720, "Все люди рождаются свободными и равными в своём достоинстве и правах", "en"), (721, "人人生而自由,在尊严和权利上一律平等", None)]
    bad += [(730 + k, "".join(rng.choice("bcdfghjklmnpqrstvwxyz ") for _ in range(300)), None) for k in range(10)]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows + bad], "doc_id long, text string, lang string, source string, n_chars long")
    labelled = docs.withColumn("lang", F.when(F.col("doc_id") < 700, F.col("lang")))
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, labelled, "").select("doc_id").collect()}
    assert kept == {i for i, t, _ in rows if t and any(c.isalpha() for c in t)}


def test_rows_without_or_with_shared_identifiers(spark, tmp_path):
    """Null and repeated doc_ids: each row has its own fate, in every stage."""
    rows, items = corpus()
    texts = dict((i, t) for i, t, _ in rows)
    odd = [(None, texts[3]), (None, "123"), (None, None), (None, texts[400]), (7, texts[8]), (7, "a text of its own " + texts[7][::-1]), (9, "456 7"), (9, texts[9])]
    every = [(i, t) for i, t, _ in rows if i is not None and i < 130 or i == 400] + odd
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in every], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    pairs = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    kept = pairs(corpus_pipeline.exact(spark, docs, ""))
    best = {}
    for i, t in every:
        best[t or ""] = max(best.get(t or "", -1), -1 if i is None else i)
    assert [(-1 if i is None else i, t or "") for i, t in kept].__len__() == len(best)
    assert {(t or "", -1 if i is None else i) for i, t in kept} == set(best.items())
    assert pairs(corpus_pipeline.clean(spark, docs, str(tmp_path))) == sorted([(i, t) for i, t in every if items[0][1] not in (t or "")], key=str)
    spoken = pairs(corpus_pipeline.language(spark, docs, ""))
    assert (None, "123") not in spoken and (9, "456 7") not in spoken and (9, texts[9]) in spoken and (None, texts[3]) in spoken
    near = corpus_pipeline.near(spark, docs, "")
    assert near.columns == docs.columns and {t or "" for _, t in pairs(near)} <= set(best) and sum(t == texts[8] for _, t in pairs(near)) == 1


def test_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "a b c")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_columns_of_any_name(spark):
    """An extra column keeps its values whatever its name, also where rows get keys of their own."""
    rows, _ = corpus()
    docs = spark.createDataFrame([(7, rows[0][1], "en", "X1", "a"), (7, rows[1][1], "de", "X2", "b"), (None, rows[2][1], "en", "X3", "c")], "doc_id long, text string, lang string, own_doc_id string, kept_doc_id string")
    for stage in (corpus_pipeline.exact, corpus_pipeline.near, corpus_pipeline.language):
        kept = stage(spark, docs, "").collect()
        assert sorted((r["text"], r["own_doc_id"], r["kept_doc_id"]) for r in kept) == sorted((rows[k][1], f"X{k + 1}", "abc"[k]) for k in range(3))


def test_only_the_result_is_left(spark, tmp_path, monkeypatch):
    rows, items = corpus()
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "in/documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "in/benchmark.parquet"))
    from legalspark.llm import common

    folders, plain = [], common.shared_dir

    def noted(*args, **named):
        folders.append(plain(*args, **named))
        return folders[-1]

    for module in (common, corpus_pipeline):
        monkeypatch.setattr(module, "shared_dir", noted)
    out = corpus_pipeline.run(spark, str(tmp_path / "in"))
    left = [f for f in folders if os.path.exists(f.removeprefix("file://").removeprefix("file:"))]
    assert out.count() > 0 and len(folders) > 20 and len(left) == 1
