"""Tables laid out by ranges of a key, and readers that each scan one range."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RangeTable:
    """A table in folders ``_range=i``, sorted by key, each between two bounds; ``bounds`` is beside it.

    Range i holds lower bound <= key < upper bound; the first has no lower bound and takes null keys too, the
    last no upper one. So every row is in one range, and a scan of a stretch of keys
    reads the folders that it meets, and within them the row groups that their statistics leave.
    """

    folder: str
    key: str

    def write(self, df: DataFrame, n: int, accuracy: int = 10_000) -> int:
        """Write ``df`` in at most ``n`` ranges of about equal size, by quantiles of the key; says how many there are.

        The quantiles are a summary of bounded size that tasks make of their own rows and merge. A key
        that many rows share is one range of several files.
        """
        shares = [i / n for i in range(1, n)]
        cuts = df.agg(F.percentile_approx(self.key, shares, accuracy).alias("q")).collect()[0]["q"] if shares else None
        cuts = sorted({c for c in cuts or [] if c is not None})
        spark = df.sparkSession
        kind = df.schema[self.key].dataType.simpleString()
        spark.createDataFrame([(i, c) for i, c in enumerate(cuts)], f"i int, bound {kind}").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/bounds")
        place = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(self.key))) if cuts else F.lit(0)
        dealt = df.withColumn("_range", F.when(F.col(self.key).isNull(), 0).otherwise(place)).hint("rebalance", "_range").sortWithinPartitions("_range", self.key)
        dealt.write.partitionBy("_range").mode("overwrite").parquet(f"{self.folder}/rows")
        return len(cuts) + 1

    def bounds(self, spark: SparkSession) -> list[Any]:
        return [r["bound"] for r in spark.read.parquet(f"{self.folder}/bounds").orderBy("i").collect()]

    def scan(self, spark: SparkSession, low: Any = None, high: Any = None) -> DataFrame:
        """Rows of low <= key < high; without either bound, of all keys on that side (null keys where there is no lower one)."""
        cuts = self.bounds(spark)
        first = 0 if low is None else bisect_right(cuts, low)
        last = len(cuts) if high is None else bisect_left(cuts, high)
        rows = spark.read.parquet(f"{self.folder}/rows").where(F.col("_range").between(first, last))
        if low is not None:
            rows = rows.where(F.col(self.key) >= F.lit(low))
        if high is not None:
            rows = rows.where((F.col(self.key) < F.lit(high)) | (F.col(self.key).isNull() if low is None else F.lit(False)))
        return rows.drop("_range")

    def readers(self, spark: SparkSession) -> list[DataFrame]:
        """One scan a range; together they read every row once."""
        cuts = self.bounds(spark)
        return [self.scan(spark, a, b) for a, b in zip([None, *cuts], [*cuts, None], strict=True)]

    def export(self, spark: SparkSession, folder: str, columns: list[str], most: int | None = None) -> None:
        """The named columns as JSON lines in order of the key: all rows, or the ``most`` of least key."""
        rows = spark.read.parquet(f"{self.folder}/rows").select("_range", *dict.fromkeys([self.key, *columns]))
        if most is not None:
            sizes = {r["_range"]: r["count"] for r in rows.groupBy("_range").count().collect()}
            have, last = 0, -1
            for i in sorted(sizes):
                if have < most:
                    have, last = have + sizes[i], i
            rows = rows.where(F.col("_range") <= last).orderBy(self.key).limit(most)
        else:
            rows = rows.repartitionByRange("_range", self.key).sortWithinPartitions("_range", self.key)
        rows.select(*columns).write.mode("overwrite").json(folder)
