"""Pieces shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows turned into Python objects at once; Arrow batches are bounded in bytes by Spark.
SLICE_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by the reader of the session."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_rows(df: DataFrame, columns: list[str], fn: Callable[..., dict[str, list]], schema: str) -> DataFrame:
    """Run ``fn`` over bounded slices of ``columns`` in Arrow batches.

    ``fn`` gets one list per column and returns one list, or Arrow array of the right type, per output column. Only
    ``columns`` leave the JVM, so other columns (of any name) cannot clash.
    """
    out = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                got = fn(*(part.column(i).to_pylist() for i in range(part.num_columns)))
                yield pa.RecordBatch.from_arrays([got[f.name] if isinstance(got[f.name], pa.Array) else pa.array(got[f.name], type=f.type) for f in out], schema=out)
        release()

    return df.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(run, schema)


def release() -> None:
    """Give back what a task has freed: a worker goes on to other stages, beside other workers."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def _arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is sorted and shuffled, whatever its size is taken for: the driver never holds it to broadcast it."""
    return df.hint("merge")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares: the session's ``spark.checkpoint.dir``.

    Only a local session without one (a test) gets a folder of its own; on a cluster that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            import tempfile

            named = tempfile.mkdtemp(prefix="tessera-ckpt-")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the folder that the cluster shares."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage by a table written to the folder that the cluster shares.

    Unlike a checkpoint it is compressed, read by column, and of a size that the planner
    knows; estimates of a checkpoint's size multiply with every join of an iteration.
    """
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    held = df.sparkSession.read.schema(df.schema).parquet(path)
    held.stored_at = path
    return held


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``stored`` that nothing reads any more."""
    for held in tables:
        sc = held.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(held.stored_at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
