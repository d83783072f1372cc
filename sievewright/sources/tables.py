"""Scans and sinks: delimited text with typed nulls, Parquet, small reports."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from sievewright.functions.coerce import missing_to_null


class InputMissing(FileNotFoundError):
    """There is no input at the path; raised before any plan is built."""


def _require(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop)
    if not found:
        raise InputMissing(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, multi_line: bool = True) -> DataFrame:
    """A file with a header, doubled quotes and line breaks in fields; the usual spellings of missing are null.

    Without a schema every column is text, to be coerced by the operators: nothing is inferred. multi_line=False lets
    large files be split among tasks, if no field holds a line break.
    """
    _require(spark, path)
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("quote", '"').option("escape", '"')
    return missing_to_null(reader.schema(schema).csv(path) if schema is not None else reader.csv(path))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    _require(spark, path)
    return spark.read.parquet(path)


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """A folder of CSV files with headers; one_file for small reports only."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_csv_with_bom(df: DataFrame, path: str) -> Path:
    """A small report as one local file that begins with a byte order mark, for spreadsheets.

    Its rows pass through the driver: only for ranked or aggregated results.
    """
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    df.toPandas().to_csv(target, index=False, encoding="utf-8-sig")
    return target
