"""Approximate dense search by an inverted file: vectors lie in the cells of learned centres, and a search reads a few cells.

A folder holds ``centres`` (a row a cell) and ``cells`` (all vectors, partitioned by cell).
Scores within the cells that are read are exact, so reading all of them is exact search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StructField, StructType

from tessera.operators.retrieval import SLICE_ROWS, Best, hits_of, matrix, of_width, top_k

#: Numbers that the centres may have in all: each task holds them.
CENTRE_CELLS = 16_000_000
#: Queries that are one block.
BLOCK = 4096


def learn(vectors: DataFrame, cells: int, sample: int = 200_000, rounds: int = 20, seed: int = 17) -> np.ndarray:
    """(cells, width) centres of unit length, by spherical k-means on Spark.

    The fit takes about ``sample`` vectors, those of least keyed hash of the id, and all if there are
    fewer: a stated bound, which does not limit what is indexed. Null and zero vectors, and
    those of another width than the first, take no part. Fewer distinct vectors than cells give fewer cells.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    good = vectors.where(F.exists("vector", lambda x: x != 0))
    some = good.select(F.size("vector").alias("n")).take(1)
    if not some:
        return np.zeros((0, 0))
    width = some[0]["n"]
    if cells * width > CENTRE_CELLS:
        raise ValueError(f"{cells} centres of {width} numbers are more than a task is to hold")
    good = of_width(good, width)
    share = min(1.0, sample / max(1, good.count()))
    drawn = good.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 31)) < int(share * (1 << 31))) if share < 1 else good
    rows = drawn.select(array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
    model = KMeans(k=cells, distanceMeasure="cosine", maxIter=rounds, seed=seed).fit(rows)
    centres = np.array(model.clusterCenters())
    return centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-300)


def in_cells(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """(doc_id, vector, cell): every vector with its nearest centre, the first among equals; a zero one is in cell 0."""
    schema = StructType([*vectors.select("doc_id", "vector").schema.fields, StructField("cell", IntegerType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                cell = np.round(matrix(part.column(1)) @ centres.T, 9).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cell, pa.int32())], schema=arrow)

    return of_width(vectors, centres.shape[1]).select("doc_id", "vector").mapInArrow(run, schema)


def write_index(vectors: DataFrame, folder: str, centres: np.ndarray) -> None:
    """Write every vector that the centres fit to its cell; large cells are several files, written by several tasks."""
    spark = vectors.sparkSession
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{folder}/centres")
    in_cells(vectors, centres).hint("rebalance", "cell").write.partitionBy("cell").mode("overwrite").parquet(f"{folder}/cells")


def build_index(vectors: DataFrame, folder: str, cells: int, sample: int = 200_000, seed: int = 17) -> np.ndarray:
    """Learn centres and index every vector; vectors: (doc_id, vector)."""
    centres = learn(vectors, cells, sample, seed=seed)
    write_index(vectors, folder, centres)
    return centres


def search(spark: SparkSession, folder: str, queries: DataFrame, k: int = 10, probes: int = 8) -> DataFrame:
    """(query_id, doc_id, score, rank): the best of the vectors in each query's ``probes`` nearest cells.

    queries: (query_id, vector), a stated set that the driver holds; a null vector, or one of
    another width, finds nothing. Cells that no query of a block reads are pruned from its scan; each
    task keeps ``k`` a query and cell before anything is shuffled.
    """
    centres = np.array([r["centre"] for r in spark.read.parquet(f"{folder}/centres").orderBy("cell").collect()])
    if not centres.size:
        return spark.createDataFrame([], hits_of(queries.select(F.col("query_id").alias("doc_id")), queries)[0].add("rank", IntegerType()))
    table = spark.read.parquet(f"{folder}/cells")
    schema, arrow = hits_of(table, queries)
    held = of_width(queries, centres.shape[1]).select("query_id", "vector").orderBy("query_id").collect()
    out = spark.createDataFrame([], schema)
    for lo in range(0, len(held), BLOCK):
        part = held[lo : lo + BLOCK]
        ids, q = [r["query_id"] for r in part], np.array([r["vector"] for r in part], np.float64)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        near = np.argsort(-np.round(q @ centres.T, 9), axis=1, kind="stable")[:, :probes]
        asks = {c: np.flatnonzero((near == c).any(axis=1)) for c in np.unique(near).tolist()}

        def score(batches: Iterator[pa.RecordBatch], ids: list = ids, q: np.ndarray = q, asks: dict = asks) -> Iterator[pa.RecordBatch]:
            best: dict[int, Best] = {}
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE_ROWS):
                    piece = batch.slice(at, SLICE_ROWS)
                    v, cell, docs = matrix(piece.column(1)), piece.column(2).to_numpy(), np.array(piece.column(0).to_pylist())
                    for c in np.unique(cell).tolist():
                        own = cell == c
                        best.setdefault(c, Best(k, asks[c].size)).add(docs[own], np.round(q[asks[c]] @ v[own].T, 9))
            for c, kept in best.items():
                yield from kept.rows([ids[i] for i in asks[c].tolist()], arrow)

        out = out.unionByName(table.where(F.col("cell").isin(*asks)).select("doc_id", "vector", "cell").mapInArrow(score, schema))
    return top_k(out, k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(n, hit, recall): how many of the exact hits were found."""
    keys = ["query_id", "doc_id"]
    met = exact.select(*keys).join(found.select(*keys).withColumn("hit", F.lit(1)), keys, "left")
    return met.agg(F.count("*").alias("n"), F.count("hit").alias("hit")).withColumn("recall", F.col("hit") / F.col("n"))
