"""Tables in the folder that all executors share, to cut lineage that must not be computed twice."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir).

    Where it is unset, a local session gets a temporary folder; on a cluster that is an error, because each executor
    would write to a disk of its own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = made.get() if made.isDefined() else None
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors share; it is unset on {master}")
        path = "file://" + tempfile.mkdtemp(prefix="sievewright-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/sievewright-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    """A path in this application's folder that nothing else has."""
    return f"{_own_folder(spark)}/{label}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard_tables(spark: SparkSession) -> None:
    """Delete this application's tables; frames that still read them can't be used afterwards."""
    delete_path(spark, _own_folder(spark))


def write_table(df: DataFrame, label: str, codec: str = "snappy", path: str | None = None) -> DataFrame:
    """Cut the lineage: write df as Parquet to the shared folder (or to a path in it) and read it back.

    The files survive the loss of any executor, and their sizes let the planner choose joins. They stay until
    discard_tables(), because results are lazy.
    """
    spark = df.sparkSession
    path = path or new_path(spark, label)
    df.write.mode("errorifexists").option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
