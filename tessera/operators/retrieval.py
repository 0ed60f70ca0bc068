"""Ranked retrieval over batches of queries: lexical, dense, sparse, fused and re-ranked."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from tessera.functions import scores
from tessera.functions.text import all_tokens, fold_related_work
from tessera.operators.tables import checkpoint

#: Rows of query terms that a broadcast may hold; beyond it the join is shuffled.
BROADCAST_ROWS = 1_000_000
#: Cells of a block's matrix of terms and queries, and rows scored at once.
BLOCK_CELLS, SLICE_ROWS = 8_000_000, 512
#: Words as ``all_tokens`` has them.
TOKEN = re.compile("[a-z0-9]+")


def bounded(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if a count shows that it is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def settled(score: Column) -> Column:
    """A score to nine places, so that equal texts tie in whatever order their sums were taken."""
    return F.round(score, 9)


def top_k(hits: DataFrame, k: int, by: str = "score", keys: tuple[str, ...] = ("query_id",), tie: str = "doc_id", rank: str = "rank") -> DataFrame:
    """The best ``k`` a group with their rank from 1; ties by ``tie``. Spark prunes each task's rows to ``k`` before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.desc(by), F.asc(tie))
    return hits.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


class Best:
    """The best ``k`` documents of each of a block of queries, over the batches of a task; ties by document."""

    def __init__(self, k: int, n_queries: int):
        self.k = k
        self.docs: np.ndarray | None = None
        self.scores = np.zeros((n_queries, 0))

    def add(self, docs: np.ndarray, scores: np.ndarray) -> None:
        """scores: (queries, docs), -inf where a document does not count."""
        every = np.broadcast_to(docs, scores.shape)
        docs = every if self.docs is None else np.concatenate([self.docs, every], axis=1)
        scores = np.concatenate([self.scores, scores], axis=1)
        order = np.lexsort((docs, -scores), axis=1)[:, : self.k]
        self.docs, self.scores = np.take_along_axis(docs, order, 1), np.take_along_axis(scores, order, 1)

    def rows(self, ids: list, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        if self.docs is not None:
            q, at = np.nonzero(self.scores > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array([ids[x] for x in q.tolist()], schema.types[0]), pa.array(self.docs[q, at], schema.types[1]), pa.array(self.scores[q, at])], schema=schema)


def hits_of(docs: DataFrame, queries: DataFrame) -> tuple[StructType, pa.Schema]:
    """The schema of scored hits, with the ids' own types."""
    schema = StructType([StructField("query_id", queries.schema["query_id"].dataType), StructField("doc_id", docs.schema["doc_id"].dataType), StructField("score", DoubleType())])
    return schema, to_arrow_schema(schema)


@dataclass
class Postings:
    """Counts of the queries' words in every document, a row a document: (doc_id, n_tokens, at, tf)."""

    rows: DataFrame
    ids: list
    #: Terms of each query, by number, and how many terms there are.
    asked: list[np.ndarray]
    n_terms: int

    def blocks(self) -> Iterator[tuple[list, np.ndarray]]:
        """Ids of queries and (terms, queries) marks, as many at once as BLOCK_CELLS allow."""
        step = max(1, BLOCK_CELLS // max(1, self.n_terms))
        for lo in range(0, len(self.ids), step):
            part = self.asked[lo : lo + step]
            marks = np.zeros((self.n_terms, len(part)))
            for q, t in enumerate(part):
                marks[t, q] = 1.0
            yield self.ids[lo : lo + step], marks


def postings(docs: DataFrame, queries: DataFrame) -> Postings:
    """Reads and splits every whole text once, for all legs of a search; no text is shuffled.

    The queries are a stated set that the driver holds; its words are all that is counted.
    docs: (doc_id, text), queries: (query_id, text). A null text has no words.
    """
    asked = queries.select("query_id", F.array_distinct(all_tokens(F.col("text"))).alias("t")).orderBy("query_id").collect()
    number: dict[str, int] = {}
    terms = [np.array([number.setdefault(x, len(number)) for x in r["t"]], np.int64) for r in asked]
    schema = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), *StructType.fromDDL("n_tokens int, at array<int>, tf array<int>").fields])
    out = to_arrow_schema(schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = number.get
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(lo, SLICE_ROWS)
                n, at, tf = [], [], []
                for text in part.column(1).to_pylist():
                    words = TOKEN.findall(text.lower()) if text else []
                    found = Counter(x for x in map(get, words) if x is not None)
                    n.append(len(words))
                    at.append(list(found))
                    tf.append(list(found.values()))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, f.type) for c, f in zip((n, at, tf), list(out)[1:], strict=True))], schema=out)

    rows = checkpoint(docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(count, schema))
    return Postings(rows, [r["query_id"] for r in asked], terms, len(number))


def _scored(found: Postings, queries: DataFrame, k: int, weigh: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], marks_of: Callable[[np.ndarray], np.ndarray], unit: bool = False) -> DataFrame:
    """Top ``k`` of the products of documents' and queries' term weights.

    A block of queries is one matrix. Each task multiplies its documents with it and keeps
    ``k`` a query, so the shuffle holds those alone. weigh: from tf, n_tokens (of each count)
    and term numbers; marks_of: from a block's marks to the queries' weights; unit: scores are
    over the document's length.
    """
    schema, arrow = hits_of(found.rows, queries)
    out = None
    for ids, marks in found.blocks():
        right = marks_of(marks)

        def score(batches: Iterator[pa.RecordBatch], ids: list = ids, right: np.ndarray = right) -> Iterator[pa.RecordBatch]:
            best = Best(k, len(ids))
            for batch in batches:
                for lo in range(0, batch.num_rows, SLICE_ROWS):
                    part = batch.slice(lo, SLICE_ROWS)
                    counts = pc.list_value_length(part.column(2)).to_numpy()
                    doc, at, tf = np.repeat(np.arange(part.num_rows), counts), part.column(2).flatten().to_numpy(), part.column(3).flatten().to_numpy()
                    left = np.zeros((part.num_rows, right.shape[0]))
                    left[doc, at] = weigh(tf.astype(np.float64), part.column(1).to_numpy()[doc].astype(np.float64), at)
                    s = left @ right
                    if unit:
                        s /= np.maximum(np.sqrt((left * left).sum(axis=1, keepdims=True)), 1e-300)
                    best.add(np.array(part.column(0).to_pylist()), np.where(s > 0, np.round(s, 9), -np.inf).T)
            yield from best.rows(ids, arrow)

        hits = found.rows.select("doc_id", "n_tokens", "at", "tf").mapInArrow(score, schema)
        out = hits if out is None else out.unionByName(hits)
    return top_k(out if out is not None else queries.sparkSession.createDataFrame([], schema), k)


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10, k1: float = 1.5, b: float = 0.75, found: Postings | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank) of the best documents. Only positive scores count.

    docs: (doc_id, text). queries: (query_id, text). found: their ``postings``, if at hand.
    """
    found = found or postings(docs, queries)
    whole = found.rows.agg(F.count("*").alias("n"), F.avg("n_tokens").alias("avg")).collect()[0]
    df = np.zeros(found.n_terms)
    for r in found.rows.select(F.explode("at").alias("at")).groupBy("at").count().collect():  # a row a term of the queries
        df[r["at"]] = r["count"]
    idf = np.log(1 + (whole["n"] - df + 0.5) / (df + 0.5))
    mean = whole["avg"] or 1.0
    return _scored(found, queries, k, lambda tf, n, at: tf * (k1 + 1) / (tf + k1 * (1 - b + b * n / mean)), lambda marks: marks * idf[:, None])


def sparse(docs: DataFrame, queries: DataFrame, k: int = 10, found: Postings | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank) by the dot product of 1 + ln tf weights, each side at unit length over the terms asked for."""
    found = found or postings(docs, queries)
    return _scored(found, queries, k, lambda tf, n, at: 1 + np.log(tf), lambda marks: marks / np.maximum(np.sqrt(marks.sum(axis=0)), 1e-300), unit=True)


def matrix(vectors: pa.Array) -> np.ndarray:
    """Rows of unit length; none is null, and all have one width. A zero vector stays zero."""
    v = vectors.flatten().to_numpy().astype(np.float64).reshape(len(vectors), -1)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def of_width(df: DataFrame, width: int) -> DataFrame:
    """Rows whose vector has that many numbers, none of them null."""
    return df.where((F.size("vector") == width) & ~F.exists("vector", lambda x: x.isNull()))


def dense(vectors: DataFrame, queries: DataFrame, k: int = 10, block_rows: int = 4096, by: Column | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): exact cosine of a stated query set against all vectors, in blocks.

    vectors: (doc_id, vector). queries: (query_id, vector). A block of queries is one
    matrix; each task scores its vectors against it and keeps ``k`` a query before
    anything is shuffled. Null vectors, and those with another width than the query's, are not met.
    """
    schema, arrow = hits_of(vectors, queries)
    widths: dict[int, list] = {}
    for r in queries.where("vector IS NOT NULL").select("query_id", "vector").orderBy("query_id").collect():
        if r["vector"] and None not in r["vector"]:
            widths.setdefault(len(r["vector"]), []).append(r)
    out = None
    for width, lo in ((w, lo) for w, held in widths.items() for lo in range(0, len(held), block_rows)):
        part = widths[width][lo : lo + block_rows]
        ids, q = [r["query_id"] for r in part], np.array([r["vector"] for r in part], np.float64)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)

        def score(batches: Iterator[pa.RecordBatch], ids: list = ids, q: np.ndarray = q) -> Iterator[pa.RecordBatch]:
            best = Best(k, len(ids))
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE_ROWS):
                    part = batch.slice(at, SLICE_ROWS)
                    best.add(np.array(part.column(0).to_pylist()), np.round(q @ matrix(part.column(1)).T, 9))
            yield from best.rows(ids, arrow)

        hits = of_width(vectors, width).select("doc_id", "vector").mapInArrow(score, schema)
        out = hits if out is None else out.unionByName(hits)
    return top_k(out if out is not None else queries.sparkSession.createDataFrame([], schema), k)


def reciprocal_rank_fusion(legs: list[DataFrame], k: int, depth: int = 100) -> DataFrame:
    """(query_id, doc_id, score, rank) of ranked legs by the sum of 1 / (60 + rank); a missing hit adds nothing."""
    every = None
    for leg in legs:
        part = leg.where(F.col("rank") <= depth).select("query_id", "doc_id", scores.reciprocal_rank(F.col("rank")).alias("part"))
        every = part if every is None else every.unionByName(part)
    return top_k(every.groupBy("query_id", "doc_id").agg(settled(F.sum("part")).alias("score")), k)


def alpha_fusion(a: DataFrame, b: DataFrame, k: int, alpha: float = 0.5) -> DataFrame:
    """Legs scaled to 0..1 a query, alpha of the first and the rest of the second; a missing hit is 0."""
    scaled = lambda d, name: d.select("query_id", "doc_id", scores.min_max(F.col("score"), "query_id").alias(name))
    both = scaled(a, "x").join(scaled(b, "y"), ["query_id", "doc_id"], "full_outer")
    mixed = both.select("query_id", "doc_id", settled(alpha * F.coalesce("x", F.lit(0.0)) + (1 - alpha) * F.coalesce("y", F.lit(0.0))).alias("score"))
    return top_k(mixed, k)


def rerank(hits: DataFrame, score: Column, k: int, least: float = 0.15) -> DataFrame:
    """Hits under a new score, those of at least ``least``, ranked anew. Any expression or Pandas UDF may score."""
    # Ranked before the threshold, so that the score stands under the window and is taken once.
    return top_k(hits.drop("rank").withColumn("score", score), k).where(F.col("score") >= least)


def section_boost(hits: DataFrame, gamma: float = 0.10, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Hits whose folded section is among their targets gain ``gamma`` of the group's best score.

    hits: (..., score, section, targets array).
    """
    best = F.max("score").over(Window.partitionBy(*keys))
    meets = F.array_contains("targets", fold_related_work(F.col("section")))
    return hits.withColumn("score", F.when(F.coalesce(meets, F.lit(False)), F.col("score") + gamma * best).otherwise(F.col("score")))


def keep_best(hits: DataFrame, keys: tuple[str, ...] = ("paper_id", "chunk_uid"), tie: str = "pos") -> DataFrame:
    """One row a key, that of greatest score; the first by ``tie`` among equals."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc(tie))
    return hits.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def diversity_cap(hits: DataFrame, k: int, per_paper: int = 3, paper: str = "paper_id", tie: str = "doc_id") -> DataFrame:
    """At most ``per_paper`` hits of a paper a query, in order of score, then the best ``k``."""
    few = top_k(hits, per_paper, keys=("query_id", paper), tie=tie, rank="_place").drop("_place")
    return top_k(few, k, tie=tie)


def provenance(hits: DataFrame, by: tuple[str, ...] = ("query_id", "doc_id")) -> DataFrame:
    """For each hit, the best score and the sorted sub-queries that found it."""
    return hits.groupBy(*by).agg(F.max("score").alias("score"), F.array_sort(F.collect_set("sq_idx")).alias("sub_queries"))


#: Citations, and chunks, of a paper that are compared within a task.
HOP_BLOCK = 2048
#: Citations of a block that are compared at once.
HOP_STRIP = 64


def _vectors(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a column of vectors, shorter ones filled up with zeros, and their norms; null or with a null element, a vector is zero."""
    held = [v if v is not None and None not in v else [] for v in column.to_pylist()]
    rows = np.zeros((len(held), max(map(len, held), default=0)))
    for i, v in enumerate(held):
        rows[i, : len(v)] = v
    squares = np.zeros(len(held))
    for c in rows.T:
        squares += c * c
    return rows, np.sqrt(squares)


def _nearest(cited: pa.Table, chunks: pa.Table, k: int) -> pa.Table:
    """(citation_id, chunk_uid, score): of each citation the chunks that may be among its best ``k`` to nine places, ties by chunk.

    Sums are taken in order of the elements, as ``scores.cosine`` takes them.
    """
    chunks = chunks.take(pc.sort_indices(chunks["chunk_uid"], null_placement="at_start"))
    (x, nx), (y, ny) = _vectors(cited["vector"]), _vectors(chunks["vector"])
    codes = chunks["chunk_uid"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
    begins = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if codes.size else np.zeros(0, np.int64)
    at, which, score = [], [], []
    for low in range(0, len(x) if begins.size else 0, HOP_STRIP):
        part, n = x[low : low + HOP_STRIP], nx[low : low + HOP_STRIP, None] * ny[None, :]
        s = np.zeros(n.shape)
        with np.errstate(all="ignore"):
            for c in range(min(x.shape[1], y.shape[1])):
                s += part[:, c, None] * y[None, :, c]
            s = np.where(n != 0, s / n, 0.0)
        s = np.maximum.reduceat(s, begins, axis=1)
        rank = np.where(np.isnan(s), np.inf, s)  # as Spark orders them
        least = np.partition(rank, max(0, begins.size - k), axis=1)[:, max(0, begins.size - k)]
        for i, row in enumerate(rank):
            near = np.flatnonzero(row >= least[i] - 2e-9)
            # Of equal scores, the first k chunks.
            order = near[np.argsort(row[near], kind="stable")]
            first = np.maximum.accumulate(np.where(np.append(True, row[order[1:]] != row[order[:-1]]), np.arange(order.size), 0))
            order = order[np.arange(order.size) - first < k]
            at.append(np.full(order.size, low + i))
            which.append(begins[order])
            score.append(s[i, order])
    at, which = (np.concatenate([np.zeros(0, np.int64), *z]).astype(np.int64) for z in (at, which))
    return pa.table({"citation_id": cited["citation_id"].take(pa.array(at)), "chunk_uid": chunks["chunk_uid"].take(pa.array(which)), "score": np.concatenate([np.zeros(0), *score])})


def hop(citations: DataFrame, chunks: DataFrame, k: int = 2) -> DataFrame:
    """The cited paper's best chunks for each citation, by the cosine of what is looked for.

    citations: (citation_id, arxiv, doi, vector); chunks: (chunk_uid, paper_arxiv, paper_doi,
    vector). Both meet in each of the two ids. Citations and chunks of a paper are dealt into
    blocks, and each pair of blocks is compared on its own, so that a much cited paper is no one
    task's; what a pair of blocks gives is bounded by its citations, not by its pairs.
    """

    def of(df: DataFrame, uid: str, arxiv: str, doi: str) -> DataFrame:
        ids = F.explode(F.array(*[F.struct(F.lit(i).alias("kind"), F.col(c).cast("string").alias("id")) for i, c in enumerate((arxiv, doi))]))
        return df.select(uid, F.col("vector").cast("array<double>").alias("vector"), ids.alias("x")).where("x.id != ''").select("x.kind", "x.id", uid, "vector")

    a, b = of(citations, "citation_id", "arxiv", "doi"), of(chunks, "chunk_uid", "paper_arxiv", "paper_doi")
    key = ["kind", "id"]
    blocks = lambda df, name: df.groupBy(*key).agg(F.ceil(F.count("*") / HOP_BLOCK).cast("int").alias(name))
    sizes = blocks(a, "_p").join(blocks(b, "_q"), key)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = lambda uid, n: F.pmod(F.xxhash64(uid), F.col(n)).cast("int")
    left = a.join(sizes, key).select(*key, mine("citation_id", "_p").alias("p"), every("_q").alias("q"), "citation_id", "vector")
    right = b.join(sizes, key).select(*key, mine("chunk_uid", "_q").alias("q"), every("_p").alias("p"), "chunk_uid", "vector")
    out = StructType([a.schema["citation_id"], b.schema["chunk_uid"], StructField("score", DoubleType())])
    by = [*key, "p", "q"]
    met = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(lambda x, y: _nearest(x, y, k), out)
    scored = met.groupBy("citation_id", "chunk_uid").agg(F.max("score").alias("score")).withColumn("_settled", settled(F.col("score")))
    return top_k(scored, k, by="_settled", keys=("citation_id",), tie="chunk_uid").drop("_settled")
