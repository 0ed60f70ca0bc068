"""Incremental ingest: files as they come, each key once, and sections as papers complete."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tessera.operators.tables import latest
from tessera.sources.readers import exists


def file_stream(spark: SparkSession, folder: str, schema: StructType | str, form: str = "parquet", files_a_batch: int = 16) -> DataFrame:
    """Files of a folder as they come; a path that is one file is a stream of that file."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        return spark.readStream.schema(schema).option("pathGlobFilter", at.getName()).format(form).load(at.getParent().toString())
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).format(form).load(folder)


def ingest(stream: DataFrame, table: str, checkpoint: str, keys: list[str], order: list[str], buckets: int = 64) -> StreamingQuery:
    """Append rows whose keys the table lacks; of a batch's rows of one key, the first in order.

    The table is dealt by a bucket of the key: a batch reads the keys, and nothing else, of the buckets
    that its own rows fall in. A batch that is run again after a failure finds its own folder and replaces it, so
    each is written once.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def write(batch: DataFrame, number: int) -> None:
        new = latest(batch, keys, [F.col(o) for o in order]).withColumn("_bucket", bucket)
        spark = batch.sparkSession
        if exists(spark, f"{table}/batch=*/_bucket=*"):
            hit = [r[0] for r in batch.select(bucket.alias("b")).distinct().collect()]  # at most ``buckets``
            before = spark.read.parquet(table).where((F.col("batch") != number) & F.col("_bucket").isin(hit))
            new = new.join(before.select(*keys), keys, "left_anti")
        new.write.partitionBy("_bucket").mode("overwrite").parquet(f"{table}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time: str, key: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts a window and key; a window is final once the watermark has passed it."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, window).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def keep_updates(counts: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Write what each batch has changed to a folder of its own.

    The state of windows that the watermark has passed is freed; a batch that is run again replaces its folder.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_updates(spark: SparkSession, table: str, keys: list[str], value: str) -> DataFrame:
    """The last written value of each key."""
    return spark.read.parquet(table).groupBy(*keys).agg(F.max_by(value, "batch").alias(value))


def sections_when_complete(stream: DataFrame, time: str, late: str = "1 hour", gap: str = "30 minutes") -> DataFrame:
    """Sections of papers whose chunks have stopped coming for ``gap``: a session window a section, so none is cut by page or batch.

    stream: (paper_id, title_norm, chunk_index, text, time).
    """
    w = F.session_window(time, gap)
    return stream.withWatermark(time, late).groupBy(w.alias("w"), "paper_id", "title_norm").agg(F.min("chunk_index").alias("chunk_index_min"), F.count("*").alias("n_chunks"), F.min_by("text", "chunk_index").alias("text")).drop("w")
