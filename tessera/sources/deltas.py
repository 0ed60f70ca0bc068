"""Keyed tables that are merged when read: updates are written beside the base, in proportion to their rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.sources.readers import exists


@dataclass(frozen=True)
class DeltaTable:
    """A table of one row a key. folder: ``v=N`` folders, each partitioned by a bucket of the key.

    A version is base (``kind=base``: all rows as of N) or delta. The latest row of a key counts; a row
    marked ``_gone`` takes the key away. One writer at a time; a reader sees whole versions only.
    """

    folder: str
    keys: tuple[str, ...]
    buckets: int = 32
    #: Deltas from which an update compacts.
    most: int = 16

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def versions(self, spark: SparkSession) -> list[tuple[int, str]]:
        """(number, kind) of whole versions from the latest base on."""
        at = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        found = sorted((int(n[2:12]), n[13:]) for n in names if n.startswith("v=") and exists(spark, f"{self.folder}/{n}/_SUCCESS"))
        bases = [i for i, (_, kind) in enumerate(found) if kind == "base"]
        return found[bases[-1] :] if bases else found

    def _write(self, rows: DataFrame, number: int, kind: str) -> None:
        rows.withColumn("_bucket", self.bucket()).hint("rebalance", "_bucket").write.partitionBy("_bucket").mode("overwrite").parquet(f"{self.folder}/v={number:010d}-{kind}")

    def raw(self, spark: SparkSession, columns: list[str] | None = None) -> DataFrame | None:
        """Rows of all versions that count, with ``_v``; None of a table without any."""
        out = None
        for number, kind in self.versions(spark):
            part = spark.read.parquet(f"{self.folder}/v={number:010d}-{kind}").withColumn("_v", F.lit(number))
            part = part if columns is None else part.select(*columns, "_gone", "_bucket", "_v")
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out

    def read(self, spark: SparkSession, schema: StructType | str | None = None) -> DataFrame:
        """The latest row of each key. schema: of a table that nothing was written to."""
        rows = self.raw(spark)
        if rows is None:
            return spark.createDataFrame([], schema)
        return self._latest(rows).drop("_gone", "_bucket", "_v")

    def _latest(self, rows: DataFrame) -> DataFrame:
        w = Window.partitionBy("_bucket", *self.keys).orderBy(F.desc("_v"))
        return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1 AND NOT _gone").drop("_n")

    def update(self, rows: DataFrame, gone: DataFrame | None = None) -> int:
        """Put rows in place of those of their keys, and take keys away; (of equal keys one row must be given).

        Writes these rows alone, and returns the version. Compacts once there are ``most`` deltas.
        """
        spark = rows.sparkSession
        done = self.versions(spark)
        number = done[-1][0] + 1 if done else 0
        new = rows.withColumn("_gone", F.lit(False))
        if gone is not None:
            new = new.unionByName(gone.select(*self.keys).distinct().join(rows.select(*self.keys), list(self.keys), "left_anti").withColumn("_gone", F.lit(True)), allowMissingColumns=True)
        self._write(new, number, "delta")
        if len(done) + 1 - any(kind == "base" for _, kind in done) > self.most:
            self.compact(spark)
        return number

    def compact(self, spark: SparkSession) -> None:
        """Write all that counts as a base, then delete what came before; a reader that has begun keeps its files until then."""
        old = self.versions(spark)
        if not old or old[-1][1] == "base":
            return
        number = old[-1][0]
        self._write(self._latest(self.raw(spark)).drop("_bucket", "_v"), number, "base")
        at = spark._jvm.org.apache.hadoop.fs.Path
        fs = at(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        for n, kind in old:
            fs.delete(at(f"{self.folder}/v={n:010d}-{kind}"), True)

    def absent(self, rows: DataFrame) -> DataFrame:
        """Rows whose key the table lacks. Only the keys of the buckets that the rows fall in are read."""
        spark = rows.sparkSession
        known = self.raw(spark, list(self.keys))
        if known is None:
            return rows
        hit = [r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect()]  # at most ``buckets``
        return rows.join(self._latest(known.where(F.col("_bucket").isin(hit))).select(*self.keys), list(self.keys), "left_anti")
