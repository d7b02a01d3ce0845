"""The encoder against the tokenizers library, on random and awkward texts."""

import random
import time

import public_tokenizers
from tokenizers import Tokenizer

from legalspark.llm.bpe import Bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
ALPHABET = "abcdeßäéñ ABCΣσςİ\n\t'’.,!?|0123456789½²日本語한글ก็́ͅ ᲀ\x1c\x1f\x00 😀👩‍👩‍👧ﬁǅЖж"


def texts():
    rng = random.Random(5)
    out = ["", " ", "a", "<|startoftext|>", "x<|endoftext|>y <|startoftext", "it's they'LL 're''ve", "ΑΣ ΣΑΣ.", "é É", "a" * 300, "ab" * 5000, "9" * 200, "!" * 500, "\x1c a\x1db \x1e", "I'm", "İstanbul"]
    out += ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    out += [" ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 90))) for _ in range(30)) for _ in range(100)]
    return out


def test_same_ids_and_decoded_text_as_the_library():
    library, own = Tokenizer.from_file(PATH), Bpe(PATH)
    for text, ids in zip(texts(), own.encode_many(texts()), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert [int(i) for i in ids.split()] == want, text
        assert own.decode(want) == own.decode_digits(ids) == library.decode(want, skip_special_tokens=False), text


def test_forgetting_and_parts_change_nothing(monkeypatch):
    library, own = Tokenizer.from_file(PATH), Bpe(PATH)
    monkeypatch.setattr("legalspark.llm.bpe.MEMO", 20_000)
    monkeypatch.setattr("legalspark.llm.bpe.CHUNK", 200)
    some = texts() + texts()[::-1]
    for text, ids in zip(some, own.encode_many(some), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert [int(i) for i in ids.split()] == want and own.decode_digits(ids) == library.decode(want, skip_special_tokens=False), text
    assert own.held < 100_000 and max(map(len, own.memo)) <= 64


def test_merge_loops_agree():
    own, rng = Bpe(PATH), random.Random(1)
    words = ["".join(rng.choice("etaoinsh") for _ in range(rng.randint(1, 64))).encode() for _ in range(500)]
    assert own.merge(words) == [" ".join(map(str, own.merge_long(w))) for w in words]


def test_a_very_long_word():
    own, library = Bpe(PATH), Tokenizer.from_file(PATH)
    word, began = "thequickbrown" * 4000, time.time()
    assert own.encode(word) == library.encode(word, add_special_tokens=False).ids
    assert time.time() - began < 60


def test_whole_table(spark):
    import hashlib

    from pyspark.sql import functions as F

    from legalspark.llm.bpe import bpe, decode

    rows = [(k, t) for k, t in enumerate(texts()[:60])] + [(900, None), (None, "no identifier"), (0, "again"), (0, "again")]
    got = bpe(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, ids int"), PATH, ("n_tokens", "ids", "ids_sha256", "decoded", "decoded_sha256")).collect()
    library = Tokenizer.from_file(PATH)
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), ids, hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), text, hashlib.sha256(text.encode()).hexdigest()))
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
    again = decode(spark.createDataFrame([(r["doc_id"], r["ids"]) for r in got] + [(901, None)], "doc_id long, ids array<int>"), PATH).where(F.col("doc_id") == 901)
    assert again.first()["text"] == ""
    assert bpe(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
