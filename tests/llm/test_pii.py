"""Base spans against Python's regular expressions, discovered ones against a hand-made corpus."""

import hashlib
import re
import time

from legalspark.llm.pii import find

KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TEXTS = [
    None, "", "a", "x@y.zz a@b.co_x@y.zz.", "@a.b a@b a@b. a@b.c..d%e@f-g.h", "1.2.3.4.5 256.1.1.1 0001.2.3.255 1.2.3.4", "9999999999999999999999.1.1.1",
    "4111 1111 1111 1111 and 4111-1111-1111-1112", "4111111111111111 2", "+1 (974) 555-3436 +12 +1234567 +1.2.3.4.5.6.7.8", "😀 a@b.cd 😀 10.0.0.1", "5" * 20000, "1 " * 5000, "a.b@" + "c." * 5000 + "d", "+1" + "2" * 30,
    "١٢٣.1.1.1 é@é.fr ab+1 555 666 777@x.y", "a@b.c\nd@e.f\n+1 22\n333 444", "1.1.1.1.1.1.1.1.1", "++1 234 5678",
]


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def brute(text):
    out = []
    for kind, pattern in KINDS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 16 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 8 <= len(digits) <= 15 if kind == "phone" else True
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_base_spans(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(3, TEXTS[3])]
    found = find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == len(rows)
    for r in found:
        want = brute(TEXTS[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), (r, want)
        assert r["spans"] == ",".join(want)
        assert [r[f"n_{k}"] for k in KINDS] == [sum(w.startswith(k) for w in want) for k in KINDS]


def test_contexts_find_unseen_identifiers(spark):
    rows = [(k, f"some words here call me at +1 (974) 555-{1000 + k} today") for k in range(12)] + [(90, "please call me at 974/555/1234 or read page 1234567")]
    rows += [(100 + k, f"order number {77000000 + k} of the {90000000 + k} kind, mail of u{k}@example.com") for k in range(9)]
    found = {r["doc_id"]: r["spans"] for r in find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[90] == "phone:18:30"
    assert all(found[100 + k].startswith("email:") and "," not in found[100 + k] for k in range(9))


def test_rows_of_one_identifier_keep_their_spans(spark):
    rows = [(k, f"some words here call me at +1 (974) 555-{1000 + k} today") for k in range(30)]
    rows += [(90, "please call me at 974/555/1234 or read page 1234567"), (90, "nothing of the kind stands in this text"), (None, "you may call me at 974/555/9876 now"), (None, "and this one has nothing at all in it")]
    docs = spark.createDataFrame([(i, t, "x", 3) for i, t in rows], "doc_id long, text string, spans string, row int")
    found = sorted(r["spans"] for r in find(docs).collect() if r["doc_id"] in (90, None))
    assert found == ["", "", "phone:18:30", "phone:19:31"]


def test_tokens_that_touch_base_spans_are_no_candidates(spark):
    rows = [(k, f"call me at +1 (974) 555-{1000 + k} today") for k in range(12)] + [(90, "call me at x+1 (974) 555-2000y call me at 974/555/1234")]
    (r,) = [r for r in find(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["doc_id"] == 90]
    assert r["spans"] == "phone:12:29,phone:42:54"


def test_very_many_tokens(spark):
    text, began = "".join(f"tok{k} 10.0.{k % 256}.{k % 250} " for k in range(100_000)), time.time()
    (r,) = find(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert r["n_ip"] == 100_000 and time.time() - began < 120
    assert r["base_sha256"] == hashlib.sha256(",".join(brute(text)).encode()).hexdigest()


def test_empty_table(spark):
    assert find(spark.createDataFrame([], "doc_id long, text string, kind int, spans string")).count() == 0
