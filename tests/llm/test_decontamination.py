import re
import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sievewright.llm import decontamination as dc
from sievewright.llm.common import text_buffers


def words(text):
    return re.findall(r"[0-9a-z\u0080-￿]+", (text or "").lower())


def lines_of(text):
    """(first word, number of words) of each line with words."""
    out, at = [], 0
    for line in (text or "").split("\n"):
        if n := len(words(line)):
            out.append((at, n))
        at += n
    return out


def brute(docs, items, least=dc.LEAST_ITEM, most=dc.MIN_TOKENS):
    """Longest common runs, by extending every common seed word by word; short items line by line."""
    out = {}
    own = [(item, words(t)) for item, t in items]
    for k, (doc_id, text) in enumerate(docs):
        a = words(text)
        places = {}
        for i in range(len(a) - least + 1):
            places.setdefault(tuple(a[i : i + least]), []).append(i)
        for item, b in own:
            if len(b) < least:
                starts, stops = [i for i, _ in lines_of(text)], {i + n for i, n in lines_of(text)}
                if b and any(i + len(b) in stops and a[i : i + len(b)] == b for i in starts):
                    out[(k, doc_id, item)] = (len(b), len(b), 0)
                continue
            best = (0, 0, 0)
            for j in range(len(b) - least + 1):
                for i in places.get(tuple(b[j : j + least]), ()):
                    n = 0
                    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                        n += 1
                    best = max(best, (n, -i, -j))
            if best[0] >= min(most, len(b)):
                out[(k, doc_id, item)] = (best[0], len(b), -best[2])
    return out


@pytest.fixture(scope="module")
def leaky(corpus):
    rng = np.random.default_rng(1)
    items = [(i, " ".join(words(corpus[i][1])[: int(rng.integers(3, 50))])) for i in range(0, 60, 4)]
    docs = [(i, t) for i, t, *_ in corpus[:70]]
    for k, (item, t) in enumerate(items):
        i = (7 * k + 1) % len(docs)
        piece = " ".join(t.split()[: max(5, len(t.split()) - k % 9)])
        docs[i] = (docs[i][0], docs[i][1] + " — " + piece.upper() + ", " + docs[i][1][:100])
    return docs, items


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(0)
    seq = rng.integers(0, 4, 500).astype(np.uint64)
    seq[-1] = 0
    for seq in (seq, np.array([1] * 300 + [0] + [2, 1] * 50 + [0] + [2, 1] * 50 + [0], np.uint64)):
        sa = dc.suffix_array(seq)
        end = [int(np.flatnonzero(seq[i:] == 0)[0]) + i for i in range(len(seq))]
        assert sa.tolist() == sorted(np.flatnonzero(seq), key=lambda i: ([*seq[i : end[i]].tolist(), 0], i))


def test_matches_are_the_longest(spark, leaky):
    docs, items = leaky
    got = dc.benchmark_matches(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    want = brute(docs, items)
    assert want
    assert {(r["doc_id"], r["item_id"]): (r["match_tokens"], r["item_tokens"], r["item_offset"]) for r in got} == {(d, i): v for (_, d, i), v in want.items()}
    text = dict(docs)
    for r in got:
        piece = text[r["doc_id"]].encode()[r["byte_start"] : r["byte_end"]].decode()
        item = words(dict(items)[r["item_id"]])
        assert words(piece) == item[r["item_offset"] : r["item_offset"] + r["match_tokens"]]


def test_small_slices_give_the_same(spark, leaky):
    docs, items = leaky
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    rows = lambda x: sorted(map(tuple, x.collect()))
    assert rows(dc.benchmark_matches(d, b, slice_bytes=400)) == rows(dc.benchmark_matches(d, b))
    assert rows(dc.decontaminate(d, b, slice_bytes=400)) == rows(dc.decontaminate(d, b))


def test_removal_takes_the_matched_and_no_others(spark, leaky):
    docs, items = leaky
    left = dc.decontaminate(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    hit = {d for _, d, _ in brute(docs, items)}
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(d for d, _ in docs if d not in hit)


def test_shards_do_not_change_results(leaky):
    docs, items = leaky
    tests = dc.suffixes_of(items)
    data, offsets = text_buffers(pa.array([t for _, t in docs], pa.large_string()))
    whole = dc.longest_matches(data, offsets, tests)
    parts = []
    for i in range(0, len(docs), 7):
        j = min(len(docs), i + 7)
        m = dc.longest_matches(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], tests)
        parts += list(zip((m["row"] + i).tolist(), m["item"].tolist(), m["tokens"].tolist(), m["byte_start"].tolist(), strict=True))
    assert sorted(parts) == sorted(zip(whole["row"].tolist(), whole["item"].tolist(), whole["tokens"].tolist(), whole["byte_start"].tolist(), strict=True))


def test_messy_and_empty(spark, messy, empty_docs):
    bench = spark.createDataFrame([(1, "word " * 40), (1, "word " * 40), (None, None), (2, ""), (3, "one two three four five six seven")], "item_id bigint, text string")
    got = [tuple(r) for r in dc.benchmark_matches(messy, bench).collect()]
    assert sorted(map(repr, (r[:4] for r in got))) == sorted(map(repr, [(5, 1, 40, 40), (6, 1, 40, 40), (1, 3, 7, 7), (1, 3, 7, 7), (None, 3, 7, 7)]))
    left = dc.decontaminate(messy, bench)
    assert left.columns == messy.columns and left.count() == messy.count() - 5
    assert dc.benchmark_matches(empty_docs, bench).count() == 0 and dc.decontaminate(empty_docs, bench).count() == 0
    none = bench.limit(0)
    assert dc.benchmark_matches(messy, none).count() == 0 and dc.decontaminate(messy, none).count() == messy.count()


def test_repeated_text_on_both_sides():
    data, offsets = text_buffers(pa.array(["go " * 60_000, "x " + "a b " * 9000, "go " * 20], pa.large_string()))
    began = time.process_time()
    m = dc.longest_matches(data, offsets, dc.suffixes_of([(1, "go " * 5000), (2, "a b " * 2500), (3, "b a " * 700 + "c")]))
    assert time.process_time() - began < 30
    got = list(zip(*(m[k].tolist() for k in ("row", "item", "tokens", "item_offset", "byte_start")), strict=True))
    assert got == [(0, 0, 5000, 0, 0), (1, 1, 5000, 0, 2), (1, 2, 1400, 0, 4), (2, 0, 20, 0, 0)]


@given(st.lists(st.lists(st.sampled_from("ab"), max_size=60), min_size=1, max_size=4), st.lists(st.lists(st.sampled_from("ab"), min_size=8, max_size=40), min_size=1, max_size=3))
@settings(max_examples=150, deadline=None)
def test_ties_take_the_first_place(texts, items):
    data, offsets = text_buffers(pa.array([" ".join(t) for t in texts], pa.large_string()))
    m = dc.longest_matches(data, offsets, dc.suffixes_of([(k, " ".join(t)) for k, t in enumerate(items)], 9))
    want = []
    for r, a in enumerate(texts):
        for k, b in enumerate(items):
            best = max(((n, -i, -j) for i in range(len(a)) for j in range(len(b)) for n in [next((n for n in range(min(len(a) - i, len(b) - j)) if a[i + n] != b[j + n]), min(len(a) - i, len(b) - j))]), default=(0, 0, 0))
            if best[0] >= min(9, len(b)):
                want.append((r, k, best[0], -best[2], -2 * best[1]))
    assert list(zip(*(m[c].tolist() for c in ("row", "item", "tokens", "item_offset", "byte_start")), strict=True)) == want


def test_long_matches_beyond_the_single_steps():
    rng = np.random.default_rng(5)
    item = " ".join(f"w{x}" for x in rng.integers(0, 10**6, 3000))
    data, offsets = text_buffers(pa.array(["lead " + item + " tail", " ".join(item.split()[100:1777]) + " end"], pa.large_string()))
    m = dc.longest_matches(data, offsets, dc.suffixes_of([(1, "other " * 20), (2, item)]))
    assert list(zip(m["item"].tolist(), m["tokens"].tolist(), m["item_offset"].tolist(), strict=True)) == [(1, 3000, 0), (1, 1677, 100)]


def test_short_items_are_whole_lines(spark):
    docs = [(1, "What is it?\nA short answer."), (2, "he said what is it and left"), (3, "What is\nit"), (4, "so what is it"), (5, "- WHAT, is it! -")]
    items = [(9, "what is it")]
    got = dc.benchmark_matches(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert sorted(r["doc_id"] for r in got) == [1, 3, 5] == sorted(d for _, d, _ in brute(docs, items))


def test_scripts_without_spaces():
    text = "今日は天気がいいので公園を散歩しました。明日は雨が降るそうです。"
    data, offsets = text_buffers(pa.array(["前文。" + text + "終わり", "別の文章です", "สวัสดีครับวันนี้อากาศดีมาก"], pa.large_string()))
    m = dc.longest_matches(data, offsets, dc.suffixes_of([(1, text), (2, "วันนี้อากาศดีมาก")]))
    assert list(zip(m["row"].tolist(), m["item"].tolist(), m["tokens"].tolist(), strict=True)) == [(0, 0, len(text) - 2), (2, 1, 16)]
