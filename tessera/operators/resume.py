"""Aggregates that go on where they stopped: a row of mergeable state for each finished shard."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.tables import remaining
from tessera.sources.readers import exists


@dataclass(frozen=True)
class Resumable:
    """An aggregate by shards. folder: its state, a table a run with one row a finished shard.

    partial: of rows with the shard's column, one row a shard that has it and the state. merge: of all states, the
    result. ``per_run`` shards are one job; what a job has finished stays when a later one
    fails, and a shard whose job failed leaves nothing.
    """

    folder: str
    shard: str
    partial: Callable[[DataFrame], DataFrame]
    merge: Callable[[DataFrame], DataFrame]
    per_run: int = 64

    def states(self, spark: SparkSession) -> DataFrame | None:
        """One row a finished shard: the first that was written, should two runs have met."""
        if not exists(spark, f"{self.folder}/run=*/_SUCCESS"):
            return None
        rows = spark.read.option("basePath", self.folder).parquet(f"{self.folder}/run=*")
        kept = rows.groupBy(self.shard).agg(F.min_by(F.struct(*[c for c in rows.columns if c != "run"]), "run").alias("s"))
        return kept.select("s.*")

    def pending(self, df: DataFrame) -> DataFrame:
        """(shard) of what is not finished."""
        done = self.states(df.sparkSession)
        shards = df.select(self.shard).distinct()
        return shards if done is None else remaining(shards, done, [self.shard])

    def step(self, df: DataFrame, n: int | None = None) -> int:
        """Finish the next ``n`` shards in order, and say how many there were; their rows alone are read."""
        todo = [r[0] for r in self.pending(df).where(F.col(self.shard).isNotNull()).orderBy(self.shard).limit(n or self.per_run).collect()]
        if todo:
            number = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
            self.partial(df.where(F.col(self.shard).isin(todo))).write.parquet(f"{self.folder}/run={number}")
        return len(todo)

    def run(self, df: DataFrame) -> DataFrame:
        """Finish all shards and merge. A shard that was finished before is not read again; rows without a shard do not count."""
        while self.step(df):
            pass
        done = self.states(df.sparkSession)
        return self.merge(done if done is not None else self.partial(df.limit(0)))


def sums(columns: list[str]) -> Callable[[DataFrame], DataFrame]:
    """A merge for states that are counts: each column's sum, 0 of none."""
    return lambda states: states.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns])


@dataclass(frozen=True)
class Prepared:
    """Batches that were prepared once: ``make`` writes what is not there yet, whole batches at a time."""

    folder: str
    batch: str = "batch"

    def have(self, spark: SparkSession) -> DataFrame | None:
        return spark.read.parquet(self.folder) if exists(spark, f"{self.folder}/{self.batch}=*") else None

    def reuse(self, rows: DataFrame, size: int, sample: int | None = None) -> DataFrame:
        """The first batches that hold ``sample`` rows of ``size`` each (all without one), written only where they are missing.

        rows: with a batch number from 0. A limit of rows means whole batches: ``sample`` / ``size``, rounded up.
        """
        spark = rows.sparkSession
        wanted = rows if sample is None else rows.where(F.col(self.batch) < -(-sample // size))
        there = self.have(spark)
        new = wanted if there is None else remaining(wanted, there.select(self.batch).distinct(), [self.batch])
        new.repartition(self.batch).write.partitionBy(self.batch).mode("append").parquet(self.folder)
        out = self.have(spark)
        if out is None:
            return wanted.limit(0)
        return out if sample is None else out.where(F.col(self.batch) < -(-sample // size))
