"""Places and running sums over a whole table without one task that sees all rows, and samples that merge."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.tables import checkpoint


def running(df: DataFrame, order: list[Column | str], sums: dict[str, Column]) -> DataFrame:
    """``df`` with, for each named sum, its total over all rows in front (not the row itself).

    Rows are ranged into partitions by the order and summed in each; the driver holds one row a
    partition, the offsets. Rows that tie in the order lie in one partition, in any order of their own:
    give a full order where places must be the same on every run.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(*order)
    held = checkpoint(ranged.select("*", F.spark_partition_id().alias("_part"), *[x.alias(f"_own_{name}") for name, x in sums.items()]))
    totals = sorted(held.groupBy("_part").agg(*[F.sum(f"_own_{name}").alias(name) for name in sums]).collect())
    offsets = {name: [0, *accumulate(r[name] or 0 for r in totals)] for name in sums}
    # One row a partition: the side is as small as the number of partitions.
    side = spark.createDataFrame([(r["_part"], *(offsets[n][i] for n in sums)) for i, r in enumerate(totals)], ", ".join(["_part int", *[f"_from_{n} {held.schema[f'_own_{n}'].dataType.simpleString()}" for n in sums]]))
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = held.join(F.broadcast(side), "_part")
    return placed.select(*df.columns, *[(F.col(f"_from_{n}") + F.coalesce(F.sum(f"_own_{n}").over(within), F.lit(0))).alias(n) for n in sums])


def placed(df: DataFrame, order: list[Column | str], place: str = "place") -> DataFrame:
    """``df`` with each row's place from 0 in the whole order."""
    return running(df, order, {place: F.lit(1).cast("long")})


def bottom(df: DataFrame, keys: list[str], k: int, seed: int = 42) -> DataFrame:
    """The ``k`` rows of least keyed hash, with it as ``_h``: a uniform sample that depends on the rows alone.

    Samples of two parts merge by ``merged`` into the sample of both, so parts can be drawn when
    they come. Tasks keep ``k`` rows each; ``k`` is the sample's bound.
    """
    h = F.xxhash64(F.lit(seed), *keys)
    return df.withColumn("_h", h).orderBy("_h", *keys).limit(k)


def merged(samples: list[DataFrame], keys: list[str], k: int) -> DataFrame:
    """The sample of all rows from samples of their parts. A row that is in several parts counts once."""
    every = samples[0]
    for other in samples[1:]:
        every = every.unionByName(other)
    return every.dropDuplicates(["_h", *keys]).orderBy("_h", *keys).limit(k)
