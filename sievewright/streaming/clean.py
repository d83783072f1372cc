"""Cleaning as a stream: the rules are a stateless projection, so they run on micro-batches as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sievewright.operators.clean import clean_inspections, default_license
from sievewright.roles import Roles


def cleaned_stream(spark: SparkSession, folder: str, schema: T.StructType, roles: Roles = Roles()) -> DataFrame:
    """Cleaned records of the Parquet files that arrive in a folder."""
    return clean_inspections(default_license(spark.readStream.schema(schema).parquet(folder), roles), roles)


def write_cleaned(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Appends to Parquet, each input file once; stops when all files present are done."""
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
