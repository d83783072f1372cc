"""Contiguous, byte-balanced shards from global prefix sums."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievewright.llm.common import Columns, write_table

N_SHARDS = 128


def shard_plan(docs: DataFrame, n_shards: int = N_SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_rows, n_bytes, byte_offset, shard_id): where each document lies in the id-ordered corpus.

    Ids are range-partitioned and reduced to one row each; the partitions' totals alone give each partition's
    start, to which a running sum inside the partition is added. A document belongs to the shard in whose equal
    slice of the total its first byte lies, so shards are contiguous in id order and differ from the target by
    less than one document. The texts themselves are never shuffled.

    Nulls: a null text has 0 bytes; rows with a null id form one entry, which comes first. Rows that repeat an id
    stay together in one entry and one shard. Documents without bytes go where they begin (a corpus without any
    bytes is all shard 0). An empty table gives an empty plan. Other columns are ignored.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    sizes = Columns(docs).select(id=id_col, text=text_col).select("id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"))
    ranged = sizes.repartitionByRange(F.col("id").asc_nulls_first())
    per_id = ranged.groupBy("id").agg(F.count("*").alias("n_rows"), F.sum("bytes").alias("n_bytes"))
    placed = write_table(per_id.withColumn("part", F.spark_partition_id()), "shard-sizes")
    totals = placed.groupBy("part").agg(F.sum("n_bytes").alias("part_bytes"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("part_start"), F.sum("part_bytes").over(Window.partitionBy()).alias("total"))
    inside = Window.partitionBy("part").orderBy(F.col("id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    running = placed.withColumn("inside", F.coalesce(F.sum("n_bytes").over(inside), F.lit(0)))
    # one row per partition of the range shuffle: thousands at most, whatever the size of the corpus
    offset = running.join(F.broadcast(starts), "part").withColumn("byte_offset", F.col("part_start") + F.col("inside"))
    exact = F.col("byte_offset").cast("decimal(38,0)") * F.lit(n_shards).cast("decimal(10,0)")
    shard = F.when(F.col("total") > 0, F.least(F.lit(n_shards - 1), F.floor(exact / F.col("total")).cast("long"))).otherwise(F.lit(0))
    return offset.select(F.col("id").alias(id_col), "n_rows", "n_bytes", "byte_offset", shard.cast("int").alias("shard_id"))


def assign_shards(docs: DataFrame, n_shards: int = N_SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with their shard_id, after shard_plan(); a column shard_id that is there already is replaced.

    Only the first id of each shard (n_shards values at most) leaves the plan; rows find their shard by binary
    search among them, without a shuffle of the texts. Rows with a null id are in shard 0.
    """
    plan = shard_plan(docs, n_shards, id_col, text_col)
    cuts = plan.where(F.col(id_col).isNotNull()).groupBy("shard_id").agg(F.min(id_col).alias("first")).orderBy("first").collect()
    shards = np.array([r["shard_id"] for r in cuts], np.int32)
    firsts = np.array([r["first"] for r in cuts], np.int64 if cuts and isinstance(cuts[0]["first"], int) else object)

    @F.pandas_udf("int")
    def shard_of(ids: pd.Series) -> pd.Series:
        return pd.Series(shards[np.searchsorted(firsts, ids.to_numpy(), side="right") - 1])

    t = Columns(docs)
    shard = F.lit(0)
    if cuts:  # ids without nulls stay whole numbers on their way through pandas
        shard = F.when(t(id_col).isNull(), 0).otherwise(shard_of(F.coalesce(t(id_col), F.lit(cuts[0]["first"]))))
    keep = [(i, o) for i, o in zip(t.inner, t.outer, strict=True) if o != "shard_id"]
    cast = t.df.select(*[i for i, _ in keep], shard.alias("shard_id"))
    return cast.toDF(*[o for _, o in keep], "shard_id")


SHARDING_SQL = f"""
with ids as (select doc_id, count(*) n_rows, cast(sum(coalesce(strlen(text), 0)) as bigint) n_bytes from documents group by doc_id),
placed as (select *, coalesce(sum(n_bytes) over (order by doc_id nulls first rows between unbounded preceding and 1 preceding), 0) byte_offset,
    sum(n_bytes) over () total from ids)
select doc_id, n_rows, n_bytes, cast(byte_offset as bigint) byte_offset,
  cast(case when total > 0 then least({N_SHARDS - 1}, (byte_offset * {N_SHARDS}) // total) else 0 end as int) shard_id
from placed
"""
