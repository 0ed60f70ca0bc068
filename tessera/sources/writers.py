"""Writers: batches, shards with resumption, versions that are kept in number, and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.tables import batches, dense_rows, remaining, shard_summary, sparse_rows, upsert
from tessera.sources.readers import exists


def write_batches(df: DataFrame, folder: str, size: int, order: str) -> None:
    """JSON lines in folders ``batch=n`` of ``size`` rows each, in order."""
    batches(df, size, order).write.partitionBy("batch").mode("overwrite").json(folder)


def write_shards(df: DataFrame, folder: str, shard: str = "shard") -> DataFrame:
    """Append the shards that are not there yet and return all; the commit protocol is the mark that one is done."""
    spark = df.sparkSession
    if exists(spark, f"{folder}/_SUCCESS"):
        df = remaining(df, spark.read.parquet(folder).select(shard).distinct(), [shard])
    df.write.partitionBy(shard).mode("append").parquet(folder)
    return spark.read.parquet(folder)


def versions(spark: SparkSession, folder: str) -> list[str]:
    """Committed versions of a table, the oldest first."""
    base = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(base):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(base) if s.isDirectory()]
    return sorted(n for n in names if n.startswith("v") and exists(spark, f"{folder}/{n}/_SUCCESS"))


def write_version(df: DataFrame, folder: str, keep: int = 5) -> str:
    """A new version of a table beside the old ones, of which the latest ``keep`` stay."""
    spark = df.sparkSession
    old = versions(spark, folder)
    name = f"v{int(old[-1][1:]) + 1 if old else 0:08d}"
    df.write.parquet(f"{folder}/{name}")
    base = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    for gone in [*old, name][:-keep]:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{gone}"), True)
    return name


def read_version(spark: SparkSession, folder: str, name: str | None = None) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name or versions(spark, folder)[-1]}")


def upsert_table(new: DataFrame, folder: str, keys: list[str], keep: int = 5) -> str:
    """A version with the new rows in place of those of the same keys."""
    spark = new.sparkSession
    old = versions(spark, folder)
    return write_version(upsert(read_version(spark, folder), new, keys) if old else new, folder, keep)


def export_vectors(shards: DataFrame, folder: str) -> dict[str, int]:
    """Dense and sparse rows as two tables; raises if either would be empty."""
    counts = shard_summary(shards).collect()[0].asDict()
    if not counts["dense_rows"] or not counts["sparse_rows"]:
        raise ValueError(f"nothing to export: {counts}")
    dense_rows(shards).drop("indices", "values").write.mode("overwrite").parquet(f"{folder}/dense")
    sparse_rows(shards).drop("dense").write.mode("overwrite").parquet(f"{folder}/sparse")
    return counts


def sample_export(df: DataFrame, folder: str, columns: list[str], n: int = 100_000) -> None:
    """The first rows of a table, a few columns of them, as JSON lines."""
    df.select(*[F.col(c) for c in columns]).limit(n).write.mode("overwrite").json(folder)
