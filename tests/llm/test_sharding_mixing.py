import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sievewright.llm import mixing, sharding


def as_oracle(sql: str, rows: list, columns: list[str]):
    import pandas as pd

    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=columns).astype({"doc_id": "Int64"}))
    rel = con.sql(sql)
    return rel.columns, rel.fetchall()


def brute_plan(rows, n):
    sizes = {}
    for doc_id, text, *_ in rows:
        b, k = sizes.get(doc_id, (0, 0))
        sizes[doc_id] = (b + len((text or "").encode()), k + 1)
    order = sorted(sizes, key=lambda x: (x is not None, x or 0))
    total, at, out = sum(b for b, _ in sizes.values()), 0, []
    for i in order:
        b, k = sizes[i]
        out.append((i, k, b, at, min(n - 1, at * n // total) if total else 0))
        at += b
    return out


@pytest.mark.parametrize("n", [1, 7, 128])
def test_plan_is_the_prefix_sum(spark, corpus, docs, n):
    got = [tuple(r) for r in sharding.shard_plan(docs.repartition(5), n).collect()]
    assert sorted(got) == brute_plan(corpus, n)


def test_plan_on_messy_rows(messy):
    rows = [tuple(r) for r in messy.collect()]
    got = {tuple(r) for r in sharding.shard_plan(messy, 3).collect()}
    assert got == set(brute_plan(rows, 3))


def test_shards_are_contiguous_and_balanced(corpus, docs):
    plan = sorted(sharding.shard_plan(docs, 9).collect(), key=lambda r: r["doc_id"])
    shards = [r["shard_id"] for r in plan]
    assert shards == sorted(shards)
    target = sum(r["n_bytes"] for r in plan) / 9
    longest = max(r["n_bytes"] for r in plan)
    assert all(abs(sum(r["n_bytes"] for r in plan if r["shard_id"] == s) - target) <= longest for s in range(9))


def test_assignment_follows_the_plan(corpus, docs, messy, empty_docs):
    plan = {r["doc_id"]: r["shard_id"] for r in sharding.shard_plan(docs, 9).collect()}
    got = sharding.assign_shards(docs, 9)
    assert got.columns == [*docs.columns, "shard_id"]
    assert {r["doc_id"]: r["shard_id"] for r in got.collect()} == plan
    wide = sharding.assign_shards(messy.withColumn("shard_id", F.lit("old")), 3)
    plan = {r["doc_id"]: r["shard_id"] for r in sharding.shard_plan(messy, 3).collect()}
    assert wide.columns == [*messy.columns, "shard_id"]
    assert [r["shard_id"] for r in wide.select("doc_id", "shard_id").collect()] == [plan[r["doc_id"]] for r in wide.select("doc_id", "shard_id").collect()]
    assert sharding.shard_plan(empty_docs).count() == 0 and sharding.assign_shards(empty_docs).count() == 0


def test_large_ids_and_names_as_ids(spark):
    base = 1 << 60
    rows = [(base + i, "x" * 10) for i in range(40)] + [(None, "y")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = {r[0]: r[4] for r in brute_plan(rows, 7)}
    assert {r["doc_id"]: r["shard_id"] for r in sharding.assign_shards(df, 7).collect()} == want
    named = spark.createDataFrame([(f"n{i:03}", "x" * 10) for i in range(40)], "doc_id string, text string")
    plan = {r["doc_id"]: r["shard_id"] for r in sharding.shard_plan(named, 7).collect()}
    assert {r["doc_id"]: r["shard_id"] for r in sharding.assign_shards(named, 7).collect()} == plan
    nameless = df.where("doc_id is null")
    assert [r["shard_id"] for r in sharding.assign_shards(nameless, 7).collect()] == [0]


def test_sharding_sql(corpus, docs):
    names, rows = as_oracle(sharding.SHARDING_SQL, corpus, docs.columns)
    got = [tuple(r[c] for c in names) for r in sharding.shard_plan(docs).collect()]
    assert sorted(got) == sorted(rows)


def test_raking_meets_the_targets():
    cells = [(s, lang, t, float(1 + i * j + k)) for i, s in enumerate("abc") for j, lang in enumerate("xy") for k, t in enumerate("pq")]
    goals = [{"a": 0.5, "b": 0.3, "c": 0.2}, {"x": 0.6, "y": 0.4}, {"p": 0.1, "q": 0.9}]
    w = mixing.rake(cells, goals)
    for d, goal in enumerate(goals):
        for key, share in goal.items():
            assert np.isclose(sum(x for x, c in zip(w, cells, strict=True) if c[d] == key), share, atol=1e-9)


def test_mixing_sql(corpus, docs):
    names, rows = as_oracle(mixing.MIXING_SQL, corpus, docs.columns)
    assert sorted(tuple(r[c] for c in names) for r in mixing.mixture_sample_ids(docs).collect()) == sorted(rows)


def test_both_ways_of_raking(docs):
    one, other = (sorted(map(tuple, mixing.mixture_sample_ids(docs, driver_cells=n, rounds=8).collect())) for n in (mixing.DRIVER_CELLS, 0))
    assert one == other


def brute_probabilities(cells, goals, kept):
    """cell -> probability: raked for long, the scale found by bisection."""
    w = [c[-1] for c in cells]
    for _ in range(300):
        for d, goal in enumerate(goals):
            sums = {}
            for c, x in zip(cells, w, strict=True):
                sums[c[d]] = sums.get(c[d], 0.0) + x
            w = [x * goal[c[d]] / sums[c[d]] for c, x in zip(cells, w, strict=True)]
    low, high, budget = 0.0, 1e15, kept * sum(c[-1] for c in cells)
    for _ in range(300):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(c[-1], mid * x) for c, x in zip(cells, w, strict=True)) < budget else (low, mid)
    return {c[:-1]: min(1.0, high * x / c[-1]) for c, x in zip(cells, w, strict=True)}


def test_a_rare_value_does_not_hold_back_the_rest(spark):
    text = "ten words are in this text and no others here"
    rows = [(i, text, "en" if i % 3 else "fr", f"s{i % 4}", 1) for i in range(4000)]
    rare = [*rows, (9001, text, None, "s0", 1), (9002, text, "en", "new", 1)]
    for some in (rows, rare):
        df = spark.createDataFrame(some, "doc_id bigint, text string, lang string, source string, n_chars bigint")
        got = mixing.mixture_sample_ids(df).collect()
        assert abs(len(got) / len(some) - mixing.TOKENS_KEPT) < 0.03
    assert {9001, 9002} <= {r["doc_id"] for r in got}  # all of what there is too little of


def test_topics_of_a_column(spark):
    rows = [(i, "some words here", "en", "s", 1, "rare" if i % 20 == 0 else "usual") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, kind string")
    got = mixing.mixture_sample_ids(df, topic_col="kind", targets={"topic": {"rare": 0.2, "usual": 0.8}}, tokens_kept=0.2).collect()
    assert abs(sum(r["topic"] == "rare" for r in got) / len(got) - 0.2) < 0.06 and abs(len(got) / 2000 - 0.2) < 0.03


def test_sample_keeps_columns_and_expected_shares(spark):
    text = "ten words are in this text and no others here"
    rows = [(i, text, "en" if i % 4 else "fr", "big" if i % 10 else "small", 1) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    goals = {"source": {"big": 0.5, "small": 0.5}, "lang": {"en": 0.5, "fr": 0.5}, "topic": {"prose": 1.0}}
    kept = mixing.sample_mixture(df, targets=goals, tokens_kept=0.15)
    assert kept.columns == df.columns
    got = [r for r in kept.collect()]
    assert abs(sum(r["source"] == "small" for r in got) / len(got) - 0.5) < 0.05
    assert abs(sum(r["lang"] == "fr" for r in got) / len(got) - 0.5) < 0.05
    assert sorted(r["doc_id"] for r in mixing.sample_mixture(df.repartition(7), targets=goals, tokens_kept=0.15).collect()) == sorted(r["doc_id"] for r in got)


def test_mixing_on_messy_and_empty(messy, empty_docs):
    kept = mixing.sample_mixture(messy)
    assert kept.columns == messy.columns
    texts = [r[1] for r in kept.collect()]
    assert all(t and t.strip() for t in texts)
    assert mixing.sample_mixture(empty_docs).count() == 0
    ids = [r["doc_id"] for r in mixing.mixture_sample_ids(messy).collect()]
    assert len(ids) == len(texts)
