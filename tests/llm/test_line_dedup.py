"""Repeated passages against a plain version."""

import hashlib
import random

from legalspark.llm.line_dedup import line_dedup


def brute(rows):
    """Texts and numbers of removed lines, by row."""
    seen, places = {}, sorted({(i, t) for i, t in rows if t is not None}, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(r[1].encode()).digest()))
    for i, t in places:
        lines = t.split("\n")
        for k in range(max(1, len(lines) - 2)):
            w = tuple(lines[k : k + 3])
            if "".join(w).strip():
                seen.setdefault(w, []).append((i, t, k))
    covered, stay = {}, {}
    for w, found in seen.items():
        for n, (i, t, k) in enumerate(found if len(found) > 1 else ()):
            (covered if n else stay).setdefault((i, t), set()).update(range(k, k + len(w)))
    gone = {p: c - stay.get(p, set()) for p, c in covered.items()}
    out = []
    for i, t in rows:
        c = gone.get((i, t), set())
        out.append((i, t if not c else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in c), len(c)))
    return sorted(out, key=str)


def test_against_a_plain_version(spark):
    rng = random.Random(4)
    rows = [(k, "\n".join(rng.choice("abcdefghij") for _ in range(rng.randint(0, 12)))) for k in range(200)]
    rows += [(300 + k, "start %d\nhot one\nhot two\nhot three\nend %d" % (k, k)) for k in range(100)]
    rows += [(500, None), (501, ""), (502, "\n\n\n\n"), (503, "a\nb"), (504, "same\n" * 2000), (505, "\n\n\n\n"), (-5, "hot one\nhot two\nhot three")]
    rows += [(None, "hot one\nhot two\nhot three\nown"), (None, "hot one\nhot two\nhot three\nother"), (7, "hot one\nhot two\nhot three"), (600, "one line of its own"), (601, "one line of its own"), (602, "a\nb")]
    got = line_dedup(spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, n_lines int").repartition(5)).collect()
    assert sorted(((r["doc_id"], r["text"], r["n_removed"]) for r in got), key=str) == brute(rows)
    for r in got:
        assert r["n_removed"] == sum(int(b) - int(a) for a, b in (s.split(":") for s in r["removed"].split(",") if s))
    (long,) = [r for r in got if r["doc_id"] == 504]
    assert long["text"].startswith("same\nsame\nsame") and long["text"].count("same") == 3  # the first place stays whole


def test_repeated_rows_and_an_empty_table(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc")] * 2, "doc_id long, text string")
    assert [r["n_removed"] for r in line_dedup(docs).collect()] == [0, 0]
    assert line_dedup(docs.limit(0)).count() == 0


def test_columns_of_any_name(spark):
    text = "same one\nsame two\nsame three"
    docs = spark.createDataFrame([(1, text, "a", 5, None, "p"), (2, text, "b", 6, [1], "q")], "doc_id long, text string, own_spans string, own_id int, own_place array<int>, OWN_SPANS_ string")
    got = {r["doc_id"]: (r["own_spans"], r["own_id"], r["own_place"], r["OWN_SPANS_"], r["n_removed"]) for r in line_dedup(docs).collect()}
    assert got == {1: ("a", 5, None, "p", 0), 2: ("b", 6, [1], "q", 3)}
