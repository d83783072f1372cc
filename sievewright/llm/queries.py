"""Driver queries of the corpus operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sievewright.llm import brown, decontamination, html, langid, mixing, neardup, quality, sharding, toxicity, warc
from sievewright.llm.common import read_table

Query = Callable[[SparkSession, str], DataFrame]


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_plan(read_table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.benchmark_matches(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read_table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return langid.identify_languages(docs, langid.fit_languages(docs))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(read_table(spark, sf_dir, "pages"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return brown.score_documents(docs, brown.fit(docs))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(read_table(spark, sf_dir, "pages"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(read_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture_sample_ids(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_sharding, op2_decontamination, op3_near_dedup, op4_language_id, op5_warc, op6_lm_scoring, op7_html, op8_quality, op9_toxicity, op10_mixing)}
ORACLE_SQL: dict[str, str] = {"op1_sharding": sharding.SHARDING_SQL, "op5_warc": warc.WARC_SQL, "op8_quality": quality.QUALITY_SQL, "op10_mixing": mixing.MIXING_SQL}
