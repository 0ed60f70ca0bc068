"""Readers: JSON lines, wrapped rows and attribute stores; archives of lines are in ``archives``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.operators.tables import pivot_attributes


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path, patterns included, names anything in any store that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines under a schema; malformed lines fall away, and a missing path is an empty table."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def batch_files(spark: SparkSession, folder: str, schema: StructType | str, stems: list[str] | None = None) -> DataFrame:
    """All ``batch_*.jsonl`` of a folder, or those of the named stems that exist, in one scan."""
    paths = [f"{folder}/{s}.jsonl" for s in stems] if stems is not None else [f"{folder}/batch_*.jsonl"]
    found = [p for p in paths if exists(spark, p)]
    return spark.read.schema(schema).json(found, mode="DROPMALFORMED") if found else spark.createDataFrame([], schema)


def parsed(lines: DataFrame, schema: StructType | str, column: str = "line") -> DataFrame:
    """Objects of a text column; those that aren't fall away."""
    return lines.select(F.from_json(column, schema).alias("o"), F.try_parse_json(column).alias("v")).where("v IS NOT NULL AND o IS NOT NULL").select("o.*")


def unwrapped(rows: DataFrame, schema: StructType | str, marks: tuple[str, ...] = ("paper_id", "abstract", "title", "content"), wrapper: str = "jsonl") -> DataFrame:
    """Rows that are papers by one of their marks, and the first line of the others' wrapper column.

    Columns that a row set lacks count as null.
    """
    target = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    has = [F.col(m).isNotNull() for m in marks if m in rows.columns]
    own = F.struct(*[(F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in target])
    first = F.get(F.filter(F.split(F.col(wrapper), "\n"), lambda x: F.trim(x) != ""), F.lit(0)) if wrapper in rows.columns else F.lit(None).cast("string")
    any_mark: Column = F.lit(False)
    for h in has:
        any_mark = any_mark | h
    return rows.select(F.when(any_mark, own).otherwise(F.from_json(first, target)).alias("o")).where("o IS NOT NULL").select("o.*")


def attribute_store(rows: DataFrame, names: list[str]) -> DataFrame:
    """A document a row from (document_id, name, value) attributes; JSON strings lose their quotes."""
    plain = rows.withColumn("value", F.coalesce(F.when(F.col("value").startswith('"'), F.from_json("value", "string")), F.col("value")))
    return pivot_attributes(plain, "document_id", "name", "value", names)
