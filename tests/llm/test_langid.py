import math
import random

import numpy as np
import pytest

from sievewright.llm import langid

from .conftest import WORDS, prose


@pytest.fixture(scope="module")
def net():
    rng = random.Random(1)
    return langid.train([(prose(rng, lang, 60).encode(), lang) for lang in WORDS for _ in range(20)], steps=90, batch=64, window=40)


def test_gradients_match_differences():
    net = langid.new_network(["a", "b"], hidden=3)
    for i, a in enumerate(net.arrays()):
        setattr(net, "xubvc"[i], a.astype(np.float64))
    g = np.random.default_rng(2)
    text, mask, labels = g.integers(0, 256, (6, 4)).astype(np.uint8), np.ones((6, 4)), np.array([0, 1, 1, 0])
    mask[4:, 2] = 0
    _, grads = langid.train_step(net, text, mask, labels)
    for a, d in zip(net.arrays(), grads, strict=True):
        flat, slope = a.reshape(-1), d.reshape(-1)
        for k in [int(np.abs(slope).argmax()), int(g.integers(len(flat)))]:
            was = flat[k]
            flat[k] = was + 1e-3
            up, _ = langid.train_step(net, text, mask, labels)
            flat[k] = was - 1e-3
            down, _ = langid.train_step(net, text, mask, labels)
            flat[k] = was
            assert np.isclose((up - down) / 2e-3, slope[k], rtol=0.05, atol=2e-4)


def test_fast_reading_equals_the_training_pass(net):
    text = np.frombuffer(prose(random.Random(5), "fr", 50).encode()[:120], np.uint8).reshape(4, 30).T.copy()
    p = langid.position_probabilities(net, text.astype(np.intp))
    loss, _ = langid.train_step(net, text, np.ones(text.shape, np.float32), np.full(4, net.langs.index("fr")))
    assert np.isclose(-np.log(p[:, net.langs.index("fr")] + 1e-9).mean(), loss, rtol=1e-3)


def test_held_out_accuracy(spark, net):
    rng = random.Random(77)
    rows = [(i, prose(rng, lang, n), lang) for i, (lang, n) in enumerate((lang, n) for lang in WORDS for n in (6, 20, 80, 400) for _ in range(8))]
    got = {r["doc_id"]: r for r in langid.identify_languages(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), net).collect()}
    assert np.mean([got[i]["lang_id"] == lang for i, _, lang in rows]) >= 0.97
    assert np.mean([got[i]["keep"] for i, _, _ in rows]) >= 0.97


def test_what_is_no_language_goes(spark, net):
    rows = [(0, "0123 4567, 89.10 - 11:12 / 2024 77 31415 9265 358979"), (1, "### $$$ %%% &&& ??? *** |||| ==== ----"), (2, "Добрый день всем кто читает этот текст сегодня"), (3, "qxzkv jwpqf zzxrt bvkqj wqzxp kjvbf xqzrw pvkjq"), (4, prose(random.Random(8), "fr", 30))]
    got = {r["doc_id"]: r for r in langid.identify_languages(spark.createDataFrame(rows, "doc_id bigint, text string"), net).collect()}
    assert [got[i]["keep"] for i in range(5)] == [False] * 4 + [True]


def test_pooling_covers_every_byte(net):
    texts = [b"", b"x", "é".encode() * 70, b"ab" * 300]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    prob, label = langid.pooled(net, data, offsets)
    assert np.allclose(prob.sum(axis=1), [len(t) for t in texts], rtol=1e-4)
    assert label.sum(axis=1).tolist() == [len(t) for t in texts]
    one = [langid.pooled(net, data[a:b], np.array([0, b - a]))[0][0] for a, b in zip(offsets, offsets[1:], strict=False) if b > a]
    assert np.allclose(one, prob[1:], rtol=1e-3, atol=1e-3)


def brute(net, text):
    """(language, mean probability, share of labels), reading byte by byte in plain Python, from both ends of the text."""
    hid, n = net.u.shape[2], len(text)
    gate = lambda x: min(1.0, max(0.0, x / 4 + 0.5))
    weights = [a.astype(float) for a in net.arrays()]
    x, u, b, v, c = weights
    states = []
    for d in (0, 1):
        h, own = [0.0] * hid, []
        for byte in text if d == 0 else text[::-1]:
            a, m = x[d][:, byte] + b[d], u[d] @ np.array(h)
            z = [min(langid.LONGEST, gate(a[k] + m[k])) for k in range(hid)]
            r = [gate(a[hid + k] + m[hid + k]) for k in range(hid)]
            new = [math.tanh(a[2 * hid + k] + r[k] * m[2 * hid + k]) for k in range(hid)]
            h = [new[k] + z[k] * (h[k] - new[k]) for k in range(hid)]
            own.append(h)
        states.append(own if d == 0 else own[::-1])
    total, labels = [0.0] * len(net.langs), [0] * len(net.langs)
    for t in range(n):
        e = [math.exp(float(v[0][k] @ np.array(states[0][t]) + v[1][k] @ np.array(states[1][t]) + c[k])) for k in range(len(net.langs))]
        labels[e.index(max(e))] += 1
        total = [s + y / sum(e) for s, y in zip(total, e, strict=True)]
    best = total.index(max(total))
    return net.langs[best], total[best] / n, labels[best] / n


def test_query_against_plain_python(spark, corpus):
    """op4_language_id's own steps, against reading every text byte by byte."""
    rng = random.Random(4)
    rows = [(i, t, lang) for i, t, lang, *_ in corpus] + [(500, prose(rng, "fr", 300) + prose(rng, "de", 300), "fr"), (501, "1234 " * 300, "en"), (502, "é", "fr")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    net = langid.fit_languages(df, steps=60)
    got = {r["doc_id"]: r for r in langid.identify_languages(df, net).collect()}
    for i, text, _ in rows[::6] + rows[-3:]:
        lang, prob, share = brute(net, text.encode())
        assert abs(got[i]["prob"] - prob) < 5e-3 and abs(got[i]["label_share"] - share) < 0.01 + 1.5 / len(text.encode())
        assert got[i]["lang_id"] == lang or prob < 0.55
        assert got[i]["keep"] == (prob >= langid.MIN_PROB and lang != langid.UNKNOWN) or abs(prob - langid.MIN_PROB) < 5e-3


@pytest.mark.parametrize("window, block", [(16, 64), (64, 256), (100, 100), (512, 1 << 19)])
def test_states_go_through_the_whole_text(net, window, block):
    rng = random.Random(2)
    texts = [prose(rng, "en", 300) + prose(rng, "de", 200), "a", prose(rng, "fr", 40), "x" * 100, prose(rng, "de", 90)[:256]]
    data = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, data)])
    prob, label = langid.pooled(net, np.frombuffer(b"".join(data), np.uint8), offsets, window, block)
    for k, t in enumerate(data):
        whole = langid.position_probabilities(net, np.frombuffer(t, np.uint8)[:, None].astype(np.intp))[:, :, 0]
        assert np.allclose(prob[k] / len(t), whole.mean(axis=0), atol=2e-3)
        assert np.abs(label[k] - np.bincount(whole.argmax(axis=1), minlength=len(net.langs))).max() <= 1 + 0.01 * len(t)


def test_stage_keeps_what_the_query_keeps(docs, net):
    keep = {r["doc_id"] for r in langid.identify_languages(docs, net).collect() if r["keep"]}
    kept = langid.keep_identified(docs, net)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == keep
    only = {r["doc_id"] for r in langid.keep_identified(docs, net, languages=frozenset(["de"])).collect()}
    assert only and only < keep


def test_messy_and_empty(spark, messy, empty_docs, net):
    got = langid.identify_languages(messy, net)
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == messy.count()
    none = [r for r in rows if r[1] is None]
    assert len(none) == 3 and all(r[2] == 0 and r[4] is False for r in none)  # two null texts and an empty one
    kept = langid.keep_identified(messy, net)
    assert kept.columns == messy.columns and kept.count() == sum(r[4] for r in rows)
    assert langid.identify_languages(empty_docs, net).count() == 0
    assert langid.fit_languages(empty_docs) is None
    assert langid.keep_identified(messy, None).count() == 0
    pieces = langid.labelled_sample(messy, 2)  # at most two of each language, null ids and texts left out
    assert len(pieces) == 3 + 2 * langid.PIECES and all(len(p) == langid.TRAIN_WINDOW for p, lang in pieces if lang == "de")
