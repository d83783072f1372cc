import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from sievewright.llm import brown

from .conftest import prose


def test_gain_is_the_change_of_the_objective():
    g = np.random.default_rng(0)
    words, k, total = 12, 4, 6
    n = g.integers(0, 5, (words, words)).astype(float)
    classes = np.concatenate([g.integers(0, k, words - 2), [4, 5]])

    def matrix(c):
        m = np.zeros((total, total))
        np.add.at(m, (c[:, None], c[None, :]), n)
        return m

    base = brown.objective(matrix(classes))
    for w in range(words - 2):
        right, left = np.bincount(classes, n[w], total), np.bincount(classes, n[:, w], total)
        got = brown.gains(matrix(classes), classes[w], right, left, n[w, w], k)
        for c in range(k):
            moved = classes.copy()
            moved[w] = c
            assert np.isclose(got[c], brown.objective(matrix(moved)) - base, atol=1e-8)


def named(word):
    b = np.frombuffer(word.encode(), np.uint8)
    return brown.named_words(b, np.array([0, len(b)]))[0]


def symbol(model, word):
    return int(model.vocabulary.symbols(named(word))[0])


def words_of(text):
    return re.findall(r"[0-9a-z\u0080-\uffff]+", (text or "").lower())


class Plain:
    """The model in plain Python, from the texts alone: counts, exchange, probabilities."""

    def __init__(self, texts, n_classes, rounds):
        k, self.first_ending = n_classes, n_classes + 1
        lines = [words_of(t) for t in texts]
        counts = Counter(w for line in lines for w in line)
        ending = lambda w: (lambda b: 0 if 48 <= b[-1] <= 57 else 1 + (b[-1] * 31 + (b[-2] if len(b) > 1 else 0)) % 31)(w.encode())
        order = sorted((w for w, n in counts.items() if n >= 2), key=lambda w: (-counts[w], int(named(w).view(np.int64)[0])))
        ids = {w: i + 1 for i, w in enumerate(order)}
        v = len(order)
        self.symbol = lambda w: ids.get(w, v + 1 + ending(w))
        rare = Counter(ending(w) for w, n in counts.items() if n < 2)
        pairs = Counter()
        for line in lines:
            before = 0
            for w in line:
                pairs[before, self.symbol(w)] += 1
                before = self.symbol(w)
        cls = {0: k, **{i: (i - 1) % k for i in range(1, v + 1)}, **{v + 1 + e: k + 1 + e for e in range(32)}}
        f = lambda x: x * math.log(x) if x > 0 else 0.0

        def matrix(c):
            m = np.zeros((k + 33, k + 33))
            for (a, b), n in pairs.items():
                m[c[a], c[b]] += n
            return m

        def value(m):
            return sum(f(x) for x in m.ravel()) - sum(f(x) for x in m.sum(axis=0)) - sum(f(x) for x in m.sum(axis=1))

        m, parts, turn, gained, done = matrix(cls), 2, 0, 0.0, 0
        best = value(m)
        around = {i: [] for i in range(v + 40)}
        for (a, b), n in pairs.items():
            around[a].append((a, b, n))
            if a != b:
                around[b].append((a, b, n))
        part = lambda i, p: int(brown.mix64(np.array([i], np.uint64))[0] % np.uint64(p))
        while rounds is None or done < rounds:
            new = dict(cls)
            for i in range(1, v + 1):
                if part(i, parts) != turn:
                    continue
                gain = []
                for c in range(k):
                    moved = m.copy()
                    for a, b, n in around[i]:
                        moved[cls[a], cls[b]] -= n
                        moved[c if a == i else cls[a], c if b == i else cls[b]] += n
                    gain.append(brown.objective(moved) - best)
                if max(gain) > 1e-6:
                    new[i] = int(np.argmax(np.round(gain, 7)))
            new_m = matrix(new)
            done += 1
            if value(new_m) < best:
                parts *= 2
                continue
            gained += value(new_m) - best
            cls, m, best = new, new_m, value(new_m)
            turn += 1
            if turn == parts:
                if gained < brown.TOLERANCE * m.sum():
                    break
                turn, gained = 0, 0.0
        into = [0.0 if c == k else m[:, c].sum() + 0.5 for c in range(k + 33)]
        low = [x / sum(into) for x in into]
        self.step = lambda a, c: (max(m[a, c] - 0.5, 0) + (m[a].sum() - sum(max(x - 0.5, 0) for x in m[a])) * low[c]) / m[a].sum() if m[a].sum() else low[c]
        self.emit = lambda w: counts[w] / m[:, cls[ids[w]]].sum() if w in ids else 1 / (rare[ending(w)] + 1)
        self.cls, self.start, self.best = cls, k, best

    def score(self, text):
        log, before = 0.0, self.start
        for w in words_of(text):
            c = self.cls[self.symbol(w)]
            log += math.log(self.step(before, c)) + math.log(self.emit(w))
            before = c
        return len(words_of(text)), log


@pytest.fixture(scope="module")
def fitted(spark, corpus):
    docs = spark.createDataFrame(corpus, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return brown.fit(docs, n_classes=8)


def test_counts_cover_all_tokens(corpus, docs):
    slim = docs.select("doc_id", "text")
    words = Counter(w for _, t, *_ in corpus for w in words_of(t))
    got = brown.word_counts(slim).collect()
    assert sorted(r["n"] for r in got) == sorted(words.values())
    empty = brown.Vocabulary(np.zeros(0, np.uint64), np.zeros(0, np.int32))
    rows = brown.neighbours(slim, empty, sum(words.values())).collect()
    assert sum(brown._ints(r["right_n"]).sum() for r in rows) == sum(brown._ints(r["left_n"]).sum() for r in rows) == sum(words.values())


def test_query_against_plain_python(spark, corpus, monkeypatch):
    """Fit and scores as op6_lm_scoring makes them, but for the number of classes, to convergence."""
    rows = [r[:2] for r in corpus[:40]] + [(900, ""), (901, "never seen before 77"), (902, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = brown.fit(df, n_classes=5)
    plain = Plain([t for _, t in rows], 5, None)
    assert all(int(model.classes[i]) == c for i, c in plain.cls.items())
    for r in brown.score_documents(df, model).collect():
        n, log = plain.score(dict(rows)[r["doc_id"]])
        assert r["n_tokens"] == n and np.isclose(r["log_prob"], log)
        assert (r["perplexity"] is None) == (n == 0) and (not n or np.isclose(r["perplexity"], math.exp(-log / n)))


def test_model_is_a_distribution(fitted):
    assert np.allclose(np.exp(fitted.transition).sum(axis=1), 1)
    size = fitted.vocabulary.size
    mass = np.bincount(fitted.classes[1 : size + 1], np.exp(fitted.emission[1 : size + 1]), 8)
    assert size > 50 and np.allclose(mass[mass > 0], 1)


def test_exchange_ends_when_a_pass_gains_little(docs, fitted):
    slim = docs.select("doc_id", "text")
    over = brown._Held(brown.neighbours(slim, fitted.vocabulary, 10_000), fitted.vocabulary.size, 8)
    before, after = (brown.objective(over.matrix(c)) for c in (over.start(), fitted.classes))
    again = brown.exchange(over, rounds=40, tolerance=-1.0)
    assert after > before and brown.objective(again[1]) - after < 3 * brown.TOLERANCE * again[1].sum()


def test_likely_text_has_lower_perplexity(spark, fitted):
    rng = random.Random(9)
    good = prose(rng, "en", 120)
    words = good.split()
    rng.shuffle(words)
    rows = [(0, good), (1, "qzx " * 100 + "zzk " * 50)]
    got = {r["doc_id"]: r["perplexity"] for r in brown.score_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), fitted).collect()}
    assert got[0] < got[1]


def test_messy_and_empty(messy, empty_docs, fitted):
    model = brown.fit(messy, n_classes=4, rounds=2)
    rows = [tuple(r) for r in brown.score_documents(messy, model).collect()]
    assert len(rows) == messy.count()
    assert all((r[3] is None) == (r[1] == 0) for r in rows)
    assert sorted(r[1] for r in rows)[-2:] == [60_001, 60_002]
    assert brown.fit(empty_docs) is None
    assert brown.score_documents(empty_docs, fitted).count() == 0
    assert all(r["perplexity"] is None for r in brown.score_documents(messy, None).collect())


def test_every_repeated_word_is_clustered_and_counted(spark, corpus, docs):
    text = " ".join(f"common{i % 50}" for i in range(200_000)) + " seldom seldom seldom twice twice once"
    df = spark.createDataFrame([(0, text)], "doc_id bigint, text string")
    model = brown.fit(df, n_classes=4, rounds=2)

    assert model.vocabulary.size == 52 and symbol(model, "once") > 52
    for w, n in (("seldom", 3), ("twice", 2)):
        s = symbol(model, w)
        assert s <= 52 and model.classes[s] < 4
        peers = [x for x in [f"common{i}" for i in range(50)] + ["seldom", "twice"] if model.classes[symbol(model, x)] == model.classes[s]]
        total = sum({"seldom": 3, "twice": 2}.get(x, 4000) for x in peers)
        assert np.isclose(model.emission[s], math.log(n / total))
    words = Counter(w for _, t, *_ in corpus for w in words_of(t))
    assert brown.fit(docs, n_classes=4, rounds=0).vocabulary.size == sum(n >= 2 for n in words.values())


def test_both_ways_of_fitting_and_scoring(docs, messy):
    for df in (docs, messy):
        one, other = (brown.score_documents(df, brown.fit(df, n_classes=8, rounds=2, driver_words=n)) for n in (brown.DRIVER_WORDS, 0))
        assert one.columns == other.columns
        one, other = (sorted(map(tuple, x.collect()), key=lambda r: (repr(r[0]), r[1], r[2])) for x in (one, other))
        assert [r[:2] for r in one] == [r[:2] for r in other]
        for x, y in zip(one, other, strict=True):
            assert np.isclose(x[2], y[2]) and (x[3] is None) == (y[3] is None) and (x[3] is None or np.isclose(x[3], y[3]))


def test_vocabulary_comes_in_slices_and_is_mapped(spark, docs, fitted, monkeypatch):
    """A vocabulary beyond a slice isn't collected or sent at once, nor joined, and gives the same model."""
    monkeypatch.setattr(brown, "_SLICE", 16)
    monkeypatch.setattr(brown, "_Joined", None)
    model = brown.fit(docs, n_classes=8)
    for name in ("hashes", "ids"):
        assert np.array_equal(getattr(model.vocabulary, name), getattr(fitted.vocabulary, name))
    assert np.array_equal(model.classes, fitted.classes) and np.array_equal(model.emission, fitted.emission)
    shared = model.vocabulary.mapped(spark)
    kinds = spark.sparkContext.parallelize([0], 1).map(lambda _: [type(x).__name__ for x in shared.arrays.values()]).collect()
    assert kinds == [["memmap"] * 3] and brown.DRIVER_WORDS >= 5_100_000  # about what 6 GB of documents have


def test_small_counts_are_products_of_matrices(monkeypatch):
    """Gains of many words at once are those of each alone, and only counts over _TINY have a row of changes each."""
    g = np.random.default_rng(5)
    words, k, total = 60, 8, 12
    n = g.poisson(0.4, (words, words)) * g.choice([1, 1, 1, 30], (words, words)).astype(float)
    classes = np.concatenate([g.integers(0, k, words - 4), k + np.arange(4)])
    m = np.zeros((total, total))
    np.add.at(m, (classes[:, None], classes[None, :]), n)
    right = np.stack([np.bincount(classes, n[w], total) for w in range(words - 4)])
    left = np.stack([np.bincount(classes, n[:, w], total) for w in range(words - 4)])
    own, self_n = classes[:-4], np.diag(n)[:-4]
    alone = np.stack([brown.gains(m, own[w], right[w], left[w], self_n[w], k) for w in range(words - 4)])
    rows, real = [], brown.Gains._added
    monkeypatch.setattr(brown.Gains, "_added", lambda self, n, *a: rows.append(len(n)) or real(self, n, *a))
    assert np.allclose(brown.Gains(m, k)(own, right, left, self_n), alone, atol=1e-8)
    many = sum((side > brown._TINY).sum() for side in (right, left))
    assert 0 < sum(rows) - 2 * len(own) <= many < sum((side > 0).sum() for side in (right, left))
