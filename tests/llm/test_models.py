"""Language identification and quality: gradients, held-out accuracy, defined results for odd rows."""

import os

import numpy as np
import pytest

from legalspark.llm import langid, quality

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def test_gradients_are_those_of_finite_differences():
    rng = np.random.default_rng(2)
    net = langid.Gru(["a", "b", "c"], seed=3)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x, mask = langid.padded([bytes(rng.integers(97, 101, n).astype(np.uint8)) for n in (5, 3, 4)])
    y = np.array([0, 1, 2])

    def loss():
        ahead = {t: net.w["of"] @ s for t, *_, s in net._run("f", x, mask)}
        total = 0.0
        for t, *_, s in net._run("b", x, mask):
            logits = ahead[t] + net.w["ob"] @ s + net.w["bias"]
            p = np.exp(logits - logits.max(0)) / np.exp(logits - logits.max(0)).sum(0)
            total -= (np.log(p[y, np.arange(3)]) * mask[t]).sum()
        return total / mask.sum()

    grad = net.gradients(x, mask, y)
    for name, at in (("uf", (3, 2)), ("ub", (17, 1)), ("xf", (5, 98)), ("xb", (20, 97)), ("of", (1, 1)), ("bias", (2, 0))):
        eps, old = 1e-3, net.w[name][at]
        net.w[name][at] = old + eps
        up = loss()
        net.w[name][at] = old - eps
        down = loss()
        net.w[name][at] = old
        assert abs((up - down) / (2 * eps) - grad[name][at]) < 2e-3, name


def test_pooling_is_that_of_a_plain_network():
    """One text, one position at a time, in float64."""
    net, text = langid.Gru(["a", "b", "c"], seed=5), ("Straße, où l'été " * 12).encode()
    sig = lambda v: 1 / (1 + np.exp(-v))
    h, total = langid.UNITS, np.zeros(3)
    for start in range(0, len(text), langid.SEGMENT):
        part, states = text[start : start + langid.SEGMENT], {}
        for way, order in (("f", range(len(part))), ("b", range(len(part) - 1, -1, -1))):
            state = np.zeros(h)
            for t in order:
                a, g = net.w["x" + way][:, part[t]].astype(float), net.w["u" + way].astype(float) @ state
                z, r = sig(a[:h] + g[:h]), sig(a[h : 2 * h] + g[h : 2 * h])
                state = state + z * (np.tanh(a[2 * h :] + r * g[2 * h :]) - state)
                states[way, t] = state
        for t in range(len(part)):
            logits = net.w["of"] @ states["f", t] + net.w["ob"] @ states["b", t] + net.w["bias"][:, 0]
            total += np.exp(logits) / np.exp(logits).sum()
    assert np.allclose(net.pooled([text])[0], total / len(text), atol=1e-4)


def test_large_logits_do_not_overflow():
    net = langid.Gru(["a", "b"], seed=1)
    net.w["bias"] = np.array([[500.0], [-500.0]], np.float32)
    assert np.allclose(net.pooled([b"some text"])[0], [1, 0])


def test_repeated_rows_and_clashing_names(spark):
    """One identifier on very many rows is one row of the samples; other columns do not matter."""
    rng = np.random.default_rng(1)
    text = lambda words: " ".join(rng.choice(words, 30))
    rows = [(k, text(["the", "with", "this"]) if k % 2 else text(["der", "nicht", "für"]), "en" if k % 2 else "de") for k in range(80)]
    rows += [(3, "the with this the", "en")] * 300 + [(None, "the with this", "en")] * 20
    docs = spark.createDataFrame([(i, t, lang, 1, "x") for i, t, lang in rows], "doc_id long, text string, lang string, score int, piece string")
    got = langid.identify(docs).collect()
    assert len(got) == len(rows) and all(r["lang_pred"] == ("en" if r["doc_id"] is None or r["doc_id"] % 2 else "de") for r in got)
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(80)] + [(3, 1, 0)] * 50 + [(None, 1, 0), (5, None, 0), (6, 7, 0)], "doc_id long, quality int, features int")
    scored = quality.quality(docs, labels).collect()
    assert len(scored) == len(rows) and all(r["predicted"] == (1 if r["doc_id"] is None or r["doc_id"] % 2 else 0) for r in scored)
    assert quality.quality(docs, labels.limit(0)).count() == len(rows)


def test_coordinate_descent_reaches_the_optimum():
    """Against a plain projected gradient on the dense dual problem."""
    rng, n = np.random.default_rng(8), 60
    y = np.arange(n) % 2
    rows = [np.unique(np.concatenate((rng.integers(0, 12, 6), rng.integers(12, 24, 2) + 12 * y[k]))) for k in range(n)]
    model = quality.fit(rows, y)
    dense = np.zeros((n, 40))
    for k, r in enumerate(rows):
        dense[k, r] = model.ratio[r]
    dense = np.hstack((dense / np.maximum(np.sqrt((dense**2).sum(1, keepdims=True)), 1e-9), np.ones((n, 1))))
    sign = np.where(y == 1, 1.0, -1.0)
    gram, alpha = (dense * sign[:, None]) @ (dense * sign[:, None]).T, np.zeros(n)
    for _ in range(20_000):
        alpha = np.clip(alpha - (gram @ alpha - 1) / np.linalg.norm(gram, 2), 0, quality.COST)
    dual = lambda a: 0.5 * a @ gram @ a - a.sum()
    w = np.concatenate((model.weights[:40], [model.bias]))
    primal = 0.5 * w @ w + quality.COST * np.maximum(0, 1 - sign * (dense @ w)).sum()
    assert abs(primal + dual(alpha)) < 0.05 * primal  # no duality gap
    assert np.allclose([model.margin(r) for r in rows], dense @ w, atol=1e-5)


def test_segments_and_tails_pool_alike():
    net = langid.Gru(["a", "b"], seed=1)
    text = bytes(range(97, 123)) * 20
    whole = net.pooled([text, text[: langid.SEGMENT], text[:5], b""])
    parts = [net.probabilities(*langid.padded([text[k : k + langid.SEGMENT]])) for k in range(0, len(text), langid.SEGMENT)]
    assert np.allclose(whole[0], sum(p[:, 0] for p in parts) / len(text), atol=1e-4) and (whole[3] == 0).all()


@pytest.mark.skipif(not os.path.exists(DATA), reason="no data")
def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame([(-1, None, "en"), (-2, " 12 ?! ", "en"), (-3, "", None)], "doc_id long, text string, lang string")
    got = langid.identify(docs.select("doc_id", "text", "lang").union(odd)).join(docs.select("doc_id", "lang"), "doc_id", "left").toPandas()
    assert (got[got.doc_id < 0].lang_pred == "und").all() and (got[got.doc_id < 0].score == 0).all()
    held = got[(got.doc_id >= 0) & got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.97 and got.score.between(0, 1).all() and len(got) == docs.count() + 3


@pytest.mark.skipif(not os.path.exists(DATA), reason="no data")
def test_held_out_quality(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    odd = spark.createDataFrame([(-1, None), (-2, "")], "doc_id long, text string")
    got = quality.quality(docs.select("doc_id", "text").union(odd), labels).join(labels, "doc_id", "left").toPandas()
    held = got[got.held_out & got.quality.notna()]
    assert (held.predicted == held.quality).mean() > 0.95 and got.score.between(0, 1).all()
    low, high = held[held.quality == 0].score, held[held.quality == 1].score
    assert np.mean([(high > x).mean() for x in low]) > 0.97
    assert set(got[got.doc_id < 0].predicted) <= {0, 1}


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "text here", None)], "doc_id long, text string, lang string")
    assert langid.identify(docs).first()["lang_pred"] == langid.UNKNOWN
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.quality(docs, none).first()["predicted"] == 0
    assert quality.quality(docs.limit(0), none).count() == 0


def test_features_do_not_depend_on_pieces(monkeypatch):
    seen = np.zeros(quality.BUCKETS, bool)
    text = "Ab1 | c,, É!\n" * 300
    whole = quality.features(text, seen)
    monkeypatch.setattr(quality, "CHUNK", 500)
    assert (quality.features(text, seen) == whole).all() and not seen.any()
