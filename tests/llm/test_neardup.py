import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievewright.llm import neardup as nd
from sievewright.llm.common import text_buffers, tokenise


def tokens(text):
    b = np.frombuffer(text.encode(), np.uint8)
    return tokenise(b, np.array([0, len(b)]))[0]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute_groups(rows, threshold=nd.THRESHOLD):
    """root index of each (id, text), by aligning every pair."""
    own = [tokens(t) for _, t in rows]
    bags = [Counter(x.tolist()) for x in own]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = set()
    for i in range(len(rows)):
        for j in range(i):
            n = max(len(own[i]), len(own[j]))
            if rows[i][1] != rows[j][1] and n - (bags[i] & bags[j]).total() > (1 - threshold) * n + 1e-9:
                continue  # no alignment is better than the bags of words
            same = rows[i][1] == rows[j][1]
            if same or (n and min(len(own[i]), len(own[j])) >= threshold * n - 1e-6 and distance(own[i].tolist(), own[j].tolist()) <= int((1 - threshold) * n + 1e-9)):
                pairs.add((rows[j][0], rows[i][0]))
                root[find(i)] = find(j)
    return [find(i) for i in range(len(rows))], pairs


@given(st.lists(st.integers(0, 5), max_size=40), st.lists(st.integers(0, 5), max_size=40), st.integers(1, 45))
@settings(max_examples=200, deadline=None)
def test_banded_distance(a, b, k):
    true = distance(a, b)
    got = int(nd.banded_distance([np.array(a, np.int64)], [np.array(b, np.int64)], k)[0])
    assert got == true if true <= k else got > k


@given(st.lists(st.tuples(st.lists(st.integers(0, 3), max_size=30), st.lists(st.integers(0, 3), max_size=30)), max_size=12))
@settings(max_examples=100, deadline=None)
def test_near_is_the_threshold_on_edit_distance(pairs):
    a, b = [np.array(x, np.uint64) for x, _ in pairs], [np.array(y, np.uint64) for _, y in pairs]
    want = [distance(x, y) <= int(0.2 * max(len(x), len(y)) + 1e-9) for x, y in pairs]
    assert nd.near(a, b).tolist() == want


def test_sketch_keeps_text_order_and_occurrences():
    a, b = tokens("red green blue red green blue red"), tokens("blue red green blue red green red")
    ka, kb = (nd.labelled_kmers(x, np.array([0, len(x)]), 1)[0] for x in (a, b))
    assert set(ka.tolist()) == set(kb.tolist()) and len(set(ka.tolist())) == 7  # the same words, each occurrence its own
    same = (nd.order_sketches(ka, 48, 3) == nd.order_sketches(kb, 48, 3)).mean()
    assert same < 0.6  # another order, other sketches
    assert (nd.order_sketches(ka, 48, 3) == nd.order_sketches(ka.copy(), 48, 3)).all()


def test_groups_against_all_pairs(spark, corpus, docs):
    rows = [(i, t) for i, t, *_ in corpus]
    root, pairs = brute_groups(rows)
    got = {r["doc_id"]: (r["group_id"], r["keep"]) for r in nd.near_duplicates(docs).collect()}
    found = sum(a in got and b in got and got[a][0] == got[b][0] for a, b in pairs)
    assert len(pairs) > 50 and found >= 0.98 * len(pairs)
    want = {i: root[i] for i in range(len(rows)) if root.count(root[i]) > 1}
    assert all(i in want for i in got)  # nothing alone is taken
    for i in got:
        assert want[i] == want[got[i][0]]  # nor joined to what it isn't near
    for g in {g for g, _ in got.values()}:
        assert [i for i, (h, keep) in got.items() if h == g and keep] == [g] == [min(i for i, (h, _) in got.items() if h == g)]
    left = sorted(r["doc_id"] for r in nd.drop_near_duplicates(docs).collect())
    assert left == sorted(i for i, _ in rows if i not in got or got[i][1])


def test_large_group_of_chained_copies(spark):
    """A bucket's members that aren't near its smallest one still find each other."""
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(60):
        words = list(base)
        for j in range(i // 2):
            words[j] = f"x{j}"
        rows.append((i, " ".join(words)))
    got = {r["doc_id"]: r["group_id"] for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: 0 for i in range(60)}


def sketches_of(texts):
    data, offsets = text_buffers(pa.array([" ".join(t) for t in texts], pa.large_string()))
    return nd.sketch_texts(data, offsets)[1]


@pytest.mark.parametrize("evenly", [False, True])
@pytest.mark.parametrize("n", [5, 10, 15, 20, 25, 40, 60, 100, 400])
def test_recall_at_the_threshold_itself(n, evenly):
    rng = random.Random(n)
    found, trials = 0, 200
    for t in range(trials):
        a = [f"w{rng.randrange(50_000)}" for _ in range(n)]
        b, edits = list(a), int(0.2 * n + 1e-9)
        for k, i in enumerate(range(2, n, 5) if evenly else rng.sample(range(n), edits)):
            if k < edits:
                b[i] = f"x{t}y{i}"
        one, other = sketches_of([a, b])
        found += bool(set(one.tolist()) & set(other.tolist()))
    assert found >= 0.9 * trials


def test_families_meet_at_every_length():
    has = lambda n: {k for k, (_, _, _, least, most) in enumerate(nd.FAMILIES) if least <= n <= (most or n)}
    for n in range(1, 400):
        for m in range(n, 400):
            if m - n <= int((1 - nd.THRESHOLD) * m + 1e-9):
                assert has(n) & has(m), (n, m)


def notices(rng, count):
    shared = "notice to all members of the club that the meeting is".split()[:10]
    return [(i, " ".join([*shared, *(f"v{rng.randrange(10**7)}" for _ in range(4))])) for i in range(count)]


def aligned(spark, monkeypatch, rows):
    """(groups, pairs that were aligned)."""
    seen = []
    real = nd._verify

    def spy(pairs, texts, threshold):
        seen.append(pairs.count())
        return real(pairs, texts, threshold)

    monkeypatch.setattr(nd, "_verify", spy)
    got = {r["doc_id"]: r["group_id"] for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    return got, sum(seen)


def test_template_texts_are_not_aligned_with_each_other(spark, monkeypatch):
    rng = random.Random(6)
    rows = notices(rng, 20_000)
    copies = []
    for k in range(0, 20_000, 50):  # near copies: one of the 14 words is another
        words = rows[k][1].split()
        words[rng.randrange(14)] = f"n{k}"
        copies.append((100_000 + k, " ".join(words)))
    few, pairs_few = aligned(spark, monkeypatch, rows[:5000] + [c for c in copies if c[0] < 105_000])
    many, pairs_many = aligned(spark, monkeypatch, rows + copies)
    assert pairs_many <= 4.6 * pairs_few and pairs_many < 60 * len(rows)
    want = {k: k for k in range(0, 20_000, 50)} | {100_000 + k: k for k in range(0, 20_000, 50)}
    assert not many.keys() - want.keys() and sum(many.get(k) == g for k, g in want.items()) >= 0.95 * len(want)
    root, _ = brute_groups(rows[:300] + [c for c in copies if c[0] < 100_300])
    own, _ = aligned(spark, monkeypatch, rows[:300] + [c for c in copies if c[0] < 100_300])
    assert len(own) == sum(root.count(r) > 1 for r in root)


def test_near_texts_share_a_rare_word():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        a = rng.integers(1, 30, n).astype(np.uint64)
        b = a.copy()
        for _ in range(int(0.2 * n + 1e-9)):
            b[rng.integers(n)] = rng.integers(1, 60)
        sides = [nd.labelled_words(x, np.array([0, len(x)])) for x in (a, b)]
        counters = np.zeros(97, np.int64)
        for x in sides:
            counters += np.bincount((x % np.uint64(97)).astype(np.int64), minlength=97)
        assert set(nd.rarest(sides[0], counters, 0.8).tolist()) & set(nd.rarest(sides[1], counters, 0.8).tolist())


def test_components(spark):
    edges = [(b"a", b"b"), (b"c", b"b"), (b"d", b"c"), (b"x", b"y"), (b"p", b"q"), (b"q", b"r"), (b"r", b"s"), (b"s", b"t"), (b"t", b"u")]
    got = dict((bytes(r["node"]), bytes(r["root"])) for r in nd.components(spark.createDataFrame(edges, "a binary, b binary")).collect())
    assert got == {**{k: b"a" for k in (b"a", b"b", b"c", b"d")}, b"x": b"x", b"y": b"x", **{k: b"p" for k in (b"p", b"q", b"r", b"s", b"t", b"u")}}


def test_messy_and_empty(messy, empty_docs):
    got = sorted((tuple(r) for r in nd.near_duplicates(messy).collect()), key=repr)
    assert got == sorted([(1, 1, True), (1, 1, False), (None, 1, False), (5, 5, True), (6, 5, False)], key=repr)
    left = nd.drop_near_duplicates(messy)
    assert left.columns == messy.columns
    ids = [r[0] for r in left.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 1, 2, 3, 4, 5, 7, 8, 9] and ids.count(None) == 1
    assert nd.near_duplicates(empty_docs).count() == 0 and nd.drop_near_duplicates(empty_docs).count() == 0


def test_sketches_and_texts_are_shuffled_once_and_few(spark, corpus, docs, monkeypatch):
    """No table of sketches, one shuffle of them, and only texts that may be aligned are shuffled for that."""
    plans, write = {}, nd.write_table

    def spy(df, label, *a, **k):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, label, *a, **k)

    monkeypatch.setattr(nd, "write_table", spy)
    nd.near_groups(docs)
    assert "near-sketches" not in plans and plans["near-stars"].count("Exchange hashpartitioning") == 1
    assert "marked(" in plans["near-texts"]


@pytest.mark.parametrize("size", [nd.BITS, 8])
def test_filter_of_texts_loses_none(spark, size):
    base = spark.range(5000).select(F.unhex(F.md5(F.col("id").cast("string"))).alias("node"), "id")
    for some in (base.where("id % 50 = 0"), base.where("id < 0")):
        wanted = {r["id"] for r in some.collect()}
        got = {r["id"] for r in nd._maybe_in(base, some.select("node"), size).collect()}
        assert wanted <= got and (size == 8 or got == wanted)


def test_bags_lose_no_near_pair_and_most_others():
    rng = np.random.default_rng(8)
    for n in (1, 4, 30, 300, 3000):
        a = rng.integers(1, 2**63, n).astype(np.uint64)
        a[rng.random(n) < 0.3] = 5  # also more than fit in a byte
        b, edits = a.copy(), int(0.2 * n + 1e-9)
        b[rng.permutation(n)[:edits]] = rng.integers(1, 2**63, edits).astype(np.uint64)
        shorter = np.delete(a, rng.permutation(n)[:edits])
        bags = [nd.bag_of(x) for x in (a, b, shorter, np.zeros(0, np.uint64))]
        assert nd.maybe_near([bags[0]] * 3, bags[:3]).all() and nd.maybe_near(bags[1:3], [bags[0]] * 2).all()
        assert not nd.maybe_near([bags[0]], [bags[3]]).any()
    far = [nd.bag_of(rng.integers(1, 2**63, 200).astype(np.uint64)) for _ in range(40)]
    assert not nd.maybe_near(far[:20], far[20:]).any()


def test_pairs_that_cannot_be_near_need_no_texts(spark, monkeypatch):
    """Two texts in no bucket of three, and too different to be near: no text is fetched, no rare word is looked for."""
    rng = random.Random(4)
    shared = [f"s{i}" for i in range(60)]
    rows = [(i, " ".join([*shared, *(f"v{rng.randrange(10**7)}" for _ in range(25))])) for i in range(2)]
    seen = {}
    write = nd.write_table

    def spy(df, label, *a, **k):
        out = write(df, label, *a, **k)
        seen[label] = out.count()
        return out

    monkeypatch.setattr(nd, "write_table", spy)
    assert nd.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).count() == 0
    assert seen["near-pairs"] == 1 and seen["near-texts"] == seen["near-rare"] == 0


def test_rows_that_are_alone_are_not_shuffled(spark, corpus, docs):
    """All but those of groups are kept as they are read: one part of the union has neither a join nor a window."""
    plan = nd.drop_near_duplicates(docs)._jdf.queryExecution().optimizedPlan().toString()
    alone, grouped = plan.split("\n+- ", 1)
    assert plan.startswith("Union") and "Join" not in alone and "Window" not in alone
    assert "Join" in grouped and "Window" in grouped


@pytest.mark.parametrize("size", [8, 64])
def test_marked_rows_that_are_in_no_group_stay(docs, corpus, monkeypatch, size):
    want = sorted(r["doc_id"] for r in nd.drop_near_duplicates(docs).collect())
    real = nd._marks
    monkeypatch.setattr(nd, "_marks", lambda nodes, _=None: real(nodes, size))
    assert sorted(r["doc_id"] for r in nd.drop_near_duplicates(docs).collect()) == want


def test_filter_of_few_texts_is_small(spark, monkeypatch):
    sizes, real = [], nd.Mapped

    def spy(spark, **arrays):
        sizes.extend(x.nbytes for x in arrays.values())
        return real(spark, **arrays)

    monkeypatch.setattr(nd, "Mapped", spy)
    nd._maybe_in(spark.range(9).select(F.unhex(F.md5(F.col("id").cast("string"))).alias("node")), spark.range(5).select("id"))
    assert sizes == [nd.LEAST_BITS // 8]
