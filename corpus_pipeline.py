"""From raw documents to shards: five stages over all that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievewright.llm import decontamination, langid, mixing, neardup, sharding
from sievewright.llm.common import read_table, write_table
from sievewright.storage import delete_path, new_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the network is sure of; it is trained on a bounded sample of the stage's own input."""
    return langid.keep_identified(docs, langid.fit_languages(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies."""
    return neardup.drop_near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no long verbatim run with a benchmark item."""
    return decontamination.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens have the target weights of source, language and topic."""
    return mixing.sample_mixture(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the contiguous, byte-balanced shard that each belongs to."""
    return sharding.assign_shards(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("sharding", sharding_stage),
]

#: Language identification by a trained network isn't expressible in SQL; tests compare with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet to the shared folder and read by the next.

    A stage's table is deleted when the next one is written; the last one, which the result reads, stays.
    """
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"stage-{name}")
        docs = write_table(stage(spark, docs, sf_dir), name, path=path)
        if before:
            delete_path(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
