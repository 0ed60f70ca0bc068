"""Tables at rest: keyed upserts, set differences, pivots, and lineage cut through the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a local session without one gets a folder of its own, a cluster an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessera-ckpt-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage by a table in the shared folder, whose size the planner knows and whose columns are read one by one."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def latest(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def upsert(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The new rows and those of the old that they do not replace."""
    return existing.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def remaining(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def pivot_attributes(df: DataFrame, key: str, name: str, value: str, names: list[str]) -> DataFrame:
    """One row a key with a column for each of the named attributes, the least value where one repeats."""
    return df.groupBy(key).pivot(name, names).agg(F.min(value))


def batches(df: DataFrame, size: int, order: str) -> DataFrame:
    """A batch number of ``size`` rows each in order, without one task that sorts everything.

    Rows are ranged into partitions, counted, and numbered from each partition's offset.
    """
    from pyspark.sql.types import LongType

    ranged = checkpoint(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id()))
    counts = {r["_part"]: r["count"] for r in ranged.groupBy("_part").count().collect()}
    offset, at = {}, 0
    for p in sorted(counts):
        offset[p], at = at, at + counts[p]
    start = F.create_map(*[F.lit(x) for kv in (offset or {0: 0}).items() for x in kv])
    w = Window.partitionBy("_part").orderBy(order)
    number = F.row_number().over(w) - 1 + start[F.col("_part")].cast(LongType())
    return ranged.withColumn("batch", F.floor(number / size)).drop("_part")


def dense_rows(shards: DataFrame) -> DataFrame:
    return shards.where(F.size("dense") > 0)


def sparse_rows(shards: DataFrame) -> DataFrame:
    return shards.where((F.size("indices") > 0) & (F.size("values") > 0))


def shard_summary(shards: DataFrame) -> DataFrame:
    return shards.agg(F.count_distinct("shard").alias("shard_count"), F.count_if(F.size("dense") > 0).alias("dense_rows"), F.count_if((F.size("indices") > 0) & (F.size("values") > 0)).alias("sparse_rows"))
