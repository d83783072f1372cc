import hashlib

import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from sievewright.llm import langid, mixing, sharding

from .test_decontamination import brute
from .test_neardup import brute_groups
from .test_sharding_mixing import brute_plan, brute_probabilities

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The input and output of each stage on a small table."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = []
    for name, stage in corpus_pipeline.STAGES:
        after = spark.createDataFrame(stage(spark, docs, SF).toPandas())
        out.append((name, docs, after))
        docs = after
    return {name: (before.toPandas(), after.toPandas()) for name, before, after in out}


def test_order_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "benchmark_decontamination", "source_mixing", "sharding"]
    for name, (before, after) in stages.items():
        assert list(after.columns) == [*before.columns, *(["shard_id"] if name == "sharding" else [])]
        assert 0 < len(after) <= len(before)


def test_language_stage(spark, stages):
    before, after = stages["language_id"]
    net = langid.fit_languages(spark.createDataFrame(before))
    keep = []
    for i, text in zip(before.doc_id, before.text, strict=True):
        b = np.frombuffer(text.encode(), np.uint8)
        prob, _ = langid.pooled(net, b, np.array([0, len(b)]))
        if prob.max() / len(b) >= langid.MIN_PROB:
            keep.append(i)
    assert sorted(after.doc_id) == sorted(keep) and len(keep) >= 0.97 * len(before)


def test_near_dedup_stage(stages):
    before, after = stages["near_dedup"]
    rows = list(zip(before.doc_id, before.text, strict=True))
    root, _ = brute_groups(rows)
    groups = {}
    for (i, _), r in zip(rows, root, strict=True):
        groups.setdefault(r, []).append(i)
    want = {min(g) for g in groups.values()}
    assert set(after.doc_id) >= want and len(after) <= 1.02 * len(want)  # none is lost; a rare pair may be missed


def test_decontamination_stage(spark, stages):
    before, after = stages["benchmark_decontamination"]
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    hit = {d for _, d, _ in brute(list(zip(before.doc_id, before.text, strict=True)), bench)}
    assert set(after.doc_id) == set(before.doc_id) - hit


def test_mixing_stage(stages):
    before, after = stages["source_mixing"]
    topic = lambda t: next((n for n, p in mixing.TOPICS if p.strip("%") in t.lower()), "prose")
    keys = [(s, lang, topic(t)) for s, lang, t in zip(before.source, before.lang, before.text, strict=True)]
    tokens = {}
    for k, t in zip(keys, before.text, strict=True):
        tokens[k] = tokens.get(k, 0) + len(t.split())
    goals = []
    for d, a in enumerate(mixing.ALPHAS.values()):
        sums = {}
        for k, n in tokens.items():
            sums[k[d]] = sums.get(k[d], 0) + n
        total = sum(n**a for n in sums.values())
        goals.append({k: n**a / total for k, n in sums.items()})
    cells = [(*k, float(n)) for k, n in tokens.items()]
    prob = brute_probabilities(cells, goals, mixing.TOKENS_KEPT)
    draw = lambda i: int(hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest()[:12], 16) / 2**48
    assert set(after.doc_id) == {i for i, k in zip(before.doc_id, keys, strict=True) if draw(i) < prob[k]}


def test_sharding_stage(stages):
    before, after = stages["sharding"]
    plan = {r[0]: r[4] for r in brute_plan(list(zip(before.doc_id, before.text, strict=True)), sharding.N_SHARDS)}
    assert dict(zip(after.doc_id, after.shard_id, strict=True)) == plan


def test_run_is_the_stages(spark, stages):
    got = corpus_pipeline.run(spark, SF).toPandas()
    assert sorted(zip(got.doc_id, got.shard_id, strict=True)) == sorted(zip(stages["sharding"][1].doc_id, stages["sharding"][1].shard_id, strict=True))


def test_registered(spark):
    names = [n for n in __spark_entry__.queries() if n.startswith("op") or n == "pipeline"]
    assert sorted(int(n[2:].split("_")[0]) for n in names if n != "pipeline") == list(range(1, 11)) and "pipeline" in names
    assert {"op1_sharding", "op5_warc", "op8_quality", "op10_mixing"} <= set(__spark_entry__.oracle_sql())


def test_stages_handle_messy_rows(spark, messy):
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, messy, SF)
        assert after.columns[: len(messy.columns)] == messy.columns, name
        assert after.count() <= messy.count()
        assert stage(spark, messy.limit(0), SF).count() == 0
