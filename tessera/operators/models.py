"""Model stages over rows: batched by length, loaded once a worker; and calls whose replies are kept."""

from __future__ import annotations

import sys
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from threading import Thread
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tessera.functions.text import nli_label
from tessera.sources.readers import exists


def loaded() -> dict[str, Any]:
    """What this process has loaded, by the stage's name; kept outside this package, which comes anew with every task."""
    return sys.__dict__.setdefault("_tessera_stages", {})


def about_tokens(text: str) -> int:
    """A token a four characters, for batching alone."""
    return 1 + len(text) // 4


@dataclass(frozen=True)
class Stage:
    """A model that Spark's tasks run: ``load`` gives, once a worker and name, what maps a list of rows to a list of results.

    A row is the values of the input columns; a result a value of ``result`` (a type in DDL).
    A window of rows is sorted by length and cut into batches of at most ``batch_rows`` rows and
    ``batch_tokens`` tokens, padding counted; the rows leave in the order in which they came.
    A row with a null among its inputs is not shown to the model and has a null result. A row longer than a
    batch is one by itself.
    """

    name: str
    load: Callable[[], Callable[[list[tuple]], Sequence]]
    result: str
    window: int = 4096
    batch_rows: int = 64
    batch_tokens: int = 16_384
    tokens: Callable[[str], int] = about_tokens

    def batches(self, rows: list[tuple]) -> Iterator[list[int]]:
        """Positions of rows without nulls, the longest first, in batches."""
        size = {i: sum(self.tokens(x) for x in r if isinstance(x, str)) for i, r in enumerate(rows) if None not in r}
        batch: list[int] = []
        for i in sorted(size, key=lambda i: -size[i]):
            if batch and (len(batch) >= self.batch_rows or size[batch[0]] * (len(batch) + 1) > self.batch_tokens):
                yield batch
                batch = []
            batch.append(i)
        if batch:
            yield batch

    def run(self, rows: list[tuple]) -> list:
        held = loaded()
        if self.name not in held:
            held[self.name] = self.load()
        out: list = [None] * len(rows)
        for batch in self.batches(rows):
            got = held[self.name]([rows[i] for i in batch])
            if len(got) != len(batch):
                raise ValueError(f"{self.name} gave {len(got)} results for {len(batch)} rows")
            for i, x in zip(batch, got, strict=True):
                out[i] = x
        return out

    def over(self, df: DataFrame, inputs: list[str], output: str) -> DataFrame:
        """``df`` with a column of results; all other columns, and the order of a task's rows, stay."""
        schema = StructType([*df.schema.fields, *StructType.fromDDL(f"`{output}` {self.result}").fields])
        arrow = to_arrow_schema(schema)
        at = [df.columns.index(c) for c in inputs]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, self.window):
                    part = batch.slice(lo, self.window)
                    rows = list(zip(*(part.column(i).to_pylist() for i in at), strict=True))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(self.run(rows), arrow.types[-1])], schema=arrow)

        return df.mapInArrow(run, schema)


# -- what models say, in one form


def query_text(text: Column, prefix: str = "", task: str = "") -> Column:
    """A question as its embedding model wants it: under a task's instruction, else after a prefix."""
    return F.concat(F.lit(f"Instruct: {task}\nQuery: " if task else prefix), text)


def passage_text(text: Column, prefix: str = "") -> Column:
    return F.concat(F.lit(prefix), text)


def entailment(scored: Column, names: dict[int, str] | None = None) -> Column:
    """struct(entails, contradicts, neutral) from a model's array of (label, score).

    Labels go by their usual aliases; ``LABEL_n`` goes by ``names``. A label that the model does
    not give scores 0; no array gives nulls.
    """

    def canonical(x: Column) -> Column:
        said = x["label"]
        for n, name in (names or {}).items():
            said = F.when(F.upper(F.trim(said)) == f"LABEL_{n}", F.lit(name)).otherwise(said)
        return nli_label(said)

    def of(label: str) -> Column:
        own = F.filter(scored, lambda x: canonical(x) == label)
        best = F.array_max(F.transform(own, lambda x: x["score"]))
        return F.when(scored.isNotNull(), F.coalesce(best, F.lit(0.0))).alias(label)

    return F.struct(of("entails"), of("contradicts"), of("neutral"))


def intent(reply: Column) -> Column:
    """struct(label, confidence) of a citation's intent; BACKGROUND at 0 where the model said nothing that is one."""
    label = F.upper(F.trim(reply["label"]))
    known = label.isin("METHOD", "BACKGROUND", "RESULT_COMPARISON")
    sure = F.coalesce(known, F.lit(False))
    return F.struct(F.when(sure, label).otherwise("BACKGROUND").alias("label"), F.when(sure, F.coalesce(reply["confidence"], F.lit(0.0))).otherwise(0.0).alias("confidence"))


# -- calls


@dataclass(frozen=True)
class Calls:
    """Replies to prompts, each distinct prompt of a model asked once and for good.

    folder: a table of (key, reply, error), a version a run. A reply is known by the
    hash of model, settings and prompt. ``ask`` maps a list of prompts to their replies;
    it is tried ``attempts`` times a batch, waiting ``wait`` seconds and twice as long each time, and
    ``timeout`` seconds at most. A batch that fails leaves its prompts unknown, with the
    error beside, so that a later run asks them again. A task that is lost asks its batches again.
    """

    folder: str
    model: str
    ask: Callable[[list[str]], Sequence[str]]
    settings: str = ""
    batch_rows: int = 16
    tasks: int = 8
    attempts: int = 3
    wait: float = 1.0
    timeout: float = 300.0
    #: Batches a second that one task may start; 0: as many as it can.
    pace: float = 0.0

    def key(self, prompt: Column) -> Column:
        return F.sha2(F.concat_ws("\0", F.lit(self.model), F.lit(self.settings), prompt), 256)

    def known(self, spark: SparkSession) -> DataFrame:
        """(key, reply), the latest of each key."""
        if not exists(spark, f"{self.folder}/run=*"):
            return spark.createDataFrame([], "key string, reply string")
        rows = spark.read.schema("key string, reply string, error string, run string").parquet(self.folder).where("error IS NULL")
        w = Window.partitionBy("key").orderBy(F.desc("run"))
        return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("key", "reply")

    def missing(self, prompts: DataFrame, column: str = "prompt") -> DataFrame:
        """(key, prompt) that nothing is known of, once each."""
        asked = prompts.where(F.col(column).isNotNull()).select(self.key(F.col(column)).alias("key"), F.col(column).alias("prompt")).dropDuplicates(["key"])
        return asked.join(self.known(prompts.sparkSession).select("key"), "key", "left_anti")

    def fill(self, prompts: DataFrame, column: str = "prompt") -> None:
        """Ask what is missing and append it. The run's rows are there all or not at all."""
        me = self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last = float("-inf")
            for batch in batches:
                for lo in range(0, batch.num_rows, me.batch_rows):
                    part = batch.slice(lo, me.batch_rows)
                    if me.pace:
                        time.sleep(max(0.0, last + 1 / me.pace - time.monotonic()))
                    last = time.monotonic()
                    replies, error = me._tried(part.column(1).to_pylist())
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(replies, pa.string()), pa.array([error] * part.num_rows, pa.string())], names=["key", "reply", "error"])

        todo = self.missing(prompts, column).repartition(self.tasks, "key").mapInArrow(run, "key string, reply string, error string")
        number = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        todo.write.mode("errorifexists").parquet(f"{self.folder}/run={number}")

    def _once(self, prompts: list[str]) -> list[str]:
        """One try, given up after ``timeout`` seconds whatever the client does."""
        got: list = []

        def work() -> None:
            try:
                got.append((list(self.ask(prompts)), None))
            except Exception as e:  # whatever a model's client raises
                got.append((None, e))

        thread = Thread(target=work, daemon=True)
        thread.start()
        thread.join(self.timeout)
        if not got:
            raise TimeoutError(f"no reply within {self.timeout} s")
        replies, error = got[0]
        if error is not None:
            raise error
        if len(replies) != len(prompts):
            raise ValueError(f"{len(replies)} replies to {len(prompts)} prompts")
        return replies

    def _tried(self, prompts: list[str]) -> tuple[list[str | None], str | None]:
        error = "not asked"
        for n in range(self.attempts):
            if n:
                time.sleep(self.wait * 2 ** (n - 1))
            try:
                return self._once(prompts), None
            except Exception as e:
                error = f"{type(e).__name__}: {e}"
        return [None] * len(prompts), error

    def over(self, df: DataFrame, column: str = "prompt", output: str = "reply") -> DataFrame:
        """``df`` with each row's reply, asking only what no run has asked; null for a null prompt and where asking failed."""
        self.fill(df, column)
        keyed = df.withColumn("_key", self.key(F.col(column)))
        known = self.known(df.sparkSession).select(F.col("key").alias("_key"), F.col("reply").alias(output))
        # A null prompt has the key of an empty one, and must not take its reply.
        return keyed.join(known, "_key", "left").withColumn(output, F.when(F.col(column).isNotNull(), F.col(output))).drop("_key")

    def failures(self, spark: SparkSession) -> DataFrame:
        """(key, error, run) of what failed and is still unknown."""
        if not exists(spark, f"{self.folder}/run=*"):
            return spark.createDataFrame([], "key string, error string, run string")
        rows = spark.read.schema("key string, reply string, error string, run string").parquet(self.folder).where("error IS NOT NULL").select("key", "error", "run")
        return rows.join(self.known(spark).select("key"), "key", "left_anti")
