import random
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sievewright.llm import quality, toxicity

from .conftest import prose

BAD = {
    "empty": "   ", "symbols": "a### b$$$ c%%% d&&& e*** f###", "exclamations": "one! two! three! four!", "capitals": "THIS TEXT SHOUTS AT EVERYBODY HERE",
    "tables": "cell | cell | cell | cell | cell", "repeated_lines": "a line\n" * 9 + "another line", "repeated_words": "yes yes yes yes yes yes no", "digits": "1234567890 12345 678 90", "long_words": "x" * 200,
}


def test_each_rule_rejects_its_case_and_spares_prose(spark, corpus):
    rows = [(i, t) for i, (_, t, *_) in enumerate(corpus)] + [(1000 + i, t) for i, t in enumerate(BAD.values())]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["keep"] for r in quality.quality_verdicts(df).collect()}
    assert all(got[i] for i in range(len(corpus))) and not any(got[1000 + i] for i in range(len(BAD)))
    by_rule = {r.name: {x[0] for x in df.where(F.expr(r.reject)).select("doc_id").collect()} for r in quality.RULES}
    for i, name in enumerate(BAD):
        assert 1000 + i in by_rule[name]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    assert dict(con.sql(quality.QUALITY_SQL).fetchall()) == got


def test_order_is_by_rejections_per_cost_and_does_not_change_verdicts(spark, corpus):
    a, b, c, d = (quality.Rule(n, "length(text) > 10", "") for n in "abcd")
    patterns = {0: 50, 1: 5, 2: 4, 3: 1, 6: 9}
    made = [quality.Estimate(r, cost, frozenset(hits)) for r, cost, hits in ((a, 1.0, {1, 3}), (b, 0.2, {2, 3, 6}), (c, 0.1, {6}), (d, 0.01, set()))]
    assert [r.name for r in quality.ordered(made, patterns)] == ["c", "b", "a", "d"]  # c takes the most of b's away
    assert [r.name for r in quality.ordered(made[1:], {2: 4, 6: 9})] == ["c", "b", "d"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*BAD.values(), "fine words here"])], "doc_id bigint, text string")
    every = [sorted((r["doc_id"], r["v"] is None) for r in df.select("doc_id", quality.cascade(F.col("text"), list(o)).alias("v")).collect()) for o in (quality.RULES, quality.RULES[::-1])]
    assert every[0] == every[1]


def test_costs_are_measured_well_enough(spark, corpus):
    df = spark.createDataFrame([(k * 1000 + i, t) for k in range(8) for i, t, *_ in corpus], "doc_id bigint, text string")
    slow = quality.Rule("slow", "length(regexp_replace(regexp_replace(lower(text), '[aeiou]+', '-'), '(?i)([b-d]|[f-h])+x?', '+')) > 100", "")
    quick = quality.Rule("quick", "octet_length(text) > 100", "")
    middle = quality.Rule("middle", "regexp_count(text, '[0-9]') >= 0 and length(text) > 100", "")
    for _ in range(2):
        assert [r.name for r in quality.ordered(*quality.estimate(df, (slow, middle, quick)))] == ["quick", "middle", "slow"]


def test_later_rules_are_not_evaluated(spark):
    rules = [quality.Rule("first", "length(text) > 2", ""), quality.Rule("never", "raise_error('evaluated') is null", "")]
    got = spark.createDataFrame([("long text",)], "text string").select(quality.cascade(F.col("text"), rules).alias("v")).collect()
    assert got[0]["v"] == "first"


def test_quality_messy_and_empty(messy, empty_docs):
    rows = [tuple(r) for r in quality.quality_verdicts(messy).collect()]
    assert len(rows) == messy.count() and (2, False) in rows and (3, False) in rows and (8, True) in rows
    assert quality.quality_verdicts(empty_docs).count() == 0


# ---------------------------------------------------------------- toxicity


def simulated(copies):
    g = np.random.default_rng(4)
    y = g.random(40_000) < 0.1
    rate = np.array([[0.002, 0.6], [0.004, 0.5], [0.003, 0.55], [0.002, 0.4], [0.001, 0.5]])
    votes = np.stack([g.random(len(y)) < np.where(y, r[1], r[0]) for r in rate], axis=1)
    votes = np.column_stack([votes, *[votes[:, 0]] * copies])
    all_votes = votes @ (1 << np.arange(votes.shape[1]))
    patterns, counts = np.unique(all_votes, return_counts=True)
    return y, rate, all_votes, toxicity.fit_label_model(patterns, counts, votes.shape[1])


def test_label_model_recovers_accuracies():
    y, rate, votes, model = simulated(0)
    assert abs(model.prior - 0.1) < 0.01
    assert np.allclose(model.fires[1], rate[:, 1], atol=0.05) and np.allclose(model.fires[0], rate[:, 0], atol=0.01)
    assert not model.pairs
    assert ((model.posterior(votes) > 0.5) == y).mean() > 0.985


def test_label_model_discounts_copies():
    y, _, votes, model = simulated(1)
    assert model.pairs == [(0, 5)]
    twice = model.posterior(np.array([1 | 1 << 5]))[0]
    naive = toxicity._independent(model.prior, model.fires).posterior(np.array([1 | 1 << 5]))[0]
    one = simulated(0)[3].posterior(np.array([1]))[0]
    assert abs(twice - one) < 0.1 < naive - twice  # the copy adds nothing
    assert ((model.posterior(votes) > 0.5) == y).mean() > 0.97


def test_held_out_accuracy(spark):
    rng = random.Random(12)
    rude = ["idiot", "moron", "trash", "scum", "pathetic", "loser", "worthless"]
    rows, labels = [], []
    for i in range(500):
        lang = rng.choice(["en", "fr"])
        words = prose(rng, lang, rng.choice([30, 90])).split()
        bad = i % 6 == 0
        if bad:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(rude) if lang == "en" else "vilainmot" + rng.choice(["s", "es", "eur", "age"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    known = spark.createDataFrame(labels[:300], "doc_id bigint, toxic int")
    got = {r["doc_id"]: r["toxic"] for r in toxicity.toxicity_scores(df, known).collect()}
    held = labels[300:]
    assert np.mean([got[i] for i, y in held if y]) >= 0.95 and np.mean([got[i] for i, y in held if not y]) <= 0.02


def test_votes_by_hand():
    texts = ["an idiot and a moron", "nothing", "one idiot here among a good many other quiet words " * 9]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    bits = toxicity.vote(data, np.cumsum([0, *map(len, texts)]), toxicity.Known(np.zeros(0, np.uint64), np.zeros(0, np.uint64)))
    names = [{v for k, v in enumerate(toxicity.VOTERS) if b >> k & 1} for b in bits]
    assert names == [{"lexicon_a", "several", "dense"}, set(), {"lexicon_a", "dense"}]


def test_factors_meet_their_margins():
    g = np.random.default_rng(1)
    p = g.dirichlet(np.ones(16), 2)
    every = toxicity.bits_of(np.arange(16), 4)
    fires, together = p @ every, np.einsum("cp,pj,pk->cjk", p, every, every)
    model = toxicity._with_pairs(0.2, fires, together, [(0, 1), (1, 2)], 50)
    made = np.exp(model.log_p)
    assert np.allclose(made.sum(axis=1), 1) and np.allclose(made @ every, fires, atol=1e-6)
    got = np.einsum("cp,pj,pk->cjk", made, every, every)
    assert np.allclose(got[:, [0, 1], [1, 2]], together[:, [0, 1], [1, 2]], atol=1e-6)
    # no more than that is assumed: 0 and 2 are independent given 1, and 3 of all
    for c in (0, 1):
        m = made[c].reshape(2, 2, 2, 2)  # of voters 3, 2, 1, 0
        for x in (0, 1):
            part = m[:, :, x].sum(axis=0) / m[:, :, x].sum()
            assert np.allclose(part, np.outer(part.sum(axis=1), part.sum(axis=0)))
        assert np.allclose(m, m.sum(axis=0)[None] * m.sum(axis=(1, 2, 3))[:, None, None, None])


def test_query_against_plain_python(spark, monkeypatch):
    """Every document's votes, posterior and score, read word by word, with the parameters that were fitted."""
    rng = random.Random(2)
    rude = [w for words in toxicity.LEXICONS for w in words]
    rows, labels = [], []
    for i in range(400):
        words = prose(rng, "en", rng.choice([8, 40, 150])).split()
        if i % 5 == 0:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice([rng.choice(rude), "nastyword" + rng.choice(["", "s", "ly", "ish"])]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 5 == 0)))
    rows += [(900, None), (901, "")]
    seen = {}
    for name in ("fit_label_model", "fit_linear", "mine"):
        real = getattr(toxicity, name)
        monkeypatch.setattr(toxicity, name, lambda *a, real=real, name=name, **k: seen.setdefault(name, (a, real(*a, **k)))[1])
    got = {r["doc_id"]: r for r in toxicity.toxicity_scores(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")).collect()}
    tokens = lambda t: re.findall(r"[0-9a-z\u0080-\uffff]+", (t or "").lower())
    hash_of = {w: int(toxicity.word_hash(w)) for _, t in rows for w in tokens(t)}
    parts = lambda w: {hash_of[w]} | {int(h[0]) for live, h in toxicity.prefix_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w.encode())]), toxicity.PREFIXES) if len(live)}
    mined, begun = ({int(x) for x in side} for side in seen["mine"][1])
    names = {w for w in hash_of if hash_of[w] in mined}
    assert {"nastyword", "nastywords", "nastywordly", "nastywordish"} <= names | {w for w in hash_of if parts(w) & begun}
    counts = Counter()
    linear = seen["fit_linear"][1]
    weights = dict(zip(linear.find.hashes.tolist(), linear.weights.tolist(), strict=True))
    for i, t in rows:
        own = tokens(t)
        whole = [w for w in own if w in rude or w in names]
        beginning = {w for w in own if w not in rude and w not in names and parts(w) & begun}
        bits = [any(w in lexicon for w in own) for lexicon in toxicity.LEXICONS] + [any(w in names and w not in rude for w in own), bool(beginning), len(set(whole) | beginning) >= 2, (len(whole) + len(beginning)) * 50 >= max(1, len(own))]
        counts[sum(b << k for k, b in enumerate(bits))] += 1
        z = linear.bias + sum(weights.get(x, 0.0) for x in {x for w in own for x in parts(w)})
        assert np.isclose(got[i]["score"], 1 / (1 + np.exp(-z))) and got[i]["toxic"] == (got[i]["score"] >= toxicity.CUTOFF)
    patterns, n = seen["fit_label_model"][0]
    assert dict(zip(patterns.tolist(), n.tolist(), strict=True)) == dict(counts)
    model = seen["fit_label_model"][1]
    for pattern in counts:
        toxic, clean = (share * np.exp(model.log_p[c][pattern]) for c, share in ((1, model.prior), (0, 1 - model.prior)))
        assert np.isclose(model.posterior(np.array([pattern]))[0], toxic / (toxic + clean), atol=1e-6)
    assert np.mean([got[i]["toxic"] == bool(y) for i, y in labels]) > 0.97


def test_toxicity_messy_and_empty(spark, messy, empty_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (5, None), (7, 0)], "doc_id bigint, toxic int")
    rows = [tuple(r) for r in toxicity.toxicity_scores(messy, labels).collect()]
    assert len(rows) == messy.count() and not any(r[2] for r in rows)
    none = labels.limit(0)
    assert toxicity.toxicity_scores(messy, none).count() == messy.count()
    assert toxicity.toxicity_scores(empty_docs, labels).count() == 0
