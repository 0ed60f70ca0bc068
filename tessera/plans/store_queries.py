"""Queries of archives, the inverted file and hops, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions import imrad
from tessera.operators import classifier, hops, models, ranks, sections, tables, vectors
from tessera.plans.queries import DENSE, _chunks, _shown, query, table
from tessera.sources import archives, deltas, ranges, readers


def scratch(spark, name: str) -> str:
    return f"{tables.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT o_orderpriority, count(*) AS n, sum(o_custkey)::BIGINT AS custkeys, count(DISTINCT o_orderkey % 60) AS members FROM orders GROUP BY ALL")
def archive_lines(spark, d):
    """All orders as lines of tar archives, half of their members compressed, read back by the members' offsets."""
    o, folder = table(spark, d, "orders"), scratch(spark, "archives")
    number = F.pmod("o_orderkey", F.lit(60))
    name = F.concat(F.lit("batch_"), number, F.when(number % 2 == 0, ".jsonl.gz").otherwise(".jsonl"))
    archives.write_tars(o.select(name.alias("member"), F.to_json(F.struct("o_orderkey", "o_custkey", "o_orderpriority")).alias("line")), folder).collect()
    back = readers.parsed(archives.tar_lines(spark, f"{folder}/*.tar"), "o_orderkey long, o_custkey long, o_orderpriority string")
    return back.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.sum("o_custkey").alias("custkeys"), F.count_distinct(F.pmod("o_orderkey", F.lit(60))).alias("members"))


def _searched(spark, d, cells: int, probes: int):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    folder = scratch(spark, "inverted")
    vectors.build_index(v, folder, cells)
    return _shown(vectors.search(spark, folder, v.where("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id"), 10, probes))


@query()
def inverted_topk(spark, d):
    """The stated queries, ids divisible by 100, against the nearest cells; tests hold its recall against ``dense_topk``."""
    return _searched(spark, d, cells=16, probes=6)


@query(f"WITH {DENSE} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM dn")
def inverted_exact(spark, d):
    """The same with every cell read, which is exact."""
    return _searched(spark, d, cells=16, probes=16)


# Claims are line items of an order's chunk, which cites the parts of that order; parts have two chunks each.
_HOPS = """i AS (SELECT l_orderkey % 40 AS query_id, 'claim:' || l_orderkey || ':' || l_linenumber AS claim_id, l_orderkey * 10 + l_linenumber AS pos, l_orderkey AS chunk, l_linenumber AS n, min(l_partkey) AS part, min(l_returnflag) AS flag, min(l_quantity) AS q FROM lineitem GROUP BY l_orderkey, l_linenumber),
c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS place FROM i WHERE flag <> 'N'),
r AS (SELECT c.*, p_partkey, p_size FROM c LEFT JOIN part ON p_partkey = part AND n % 7 <> 3 AND NOT (n % 5 = 2 AND part % 4 = 3)),
o AS (SELECT query_id, claim_id, pos, part, p_partkey, CASE WHEN place > 50 THEN 'over_budget' WHEN q >= 48 THEN 'no_hop_reason' WHEN q < 3 THEN 'no_linked_citations' WHEN n % 7 = 3 THEN 'citation_raw_mismatch'
  WHEN part % 4 = 3 THEN 'no_resolved_id' WHEN part % 4 = 0 AND part % 8 = 0 THEN 'retrieval_zero' WHEN p_partkey IS NULL THEN 'retrieval_zero' ELSE 'success' END AS outcome FROM r)"""


def _expanded(spark, d):
    i = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in ("l_partkey", "l_returnflag", "l_quantity")])
    key, n, part, q = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_quantity")
    raw = F.sha1(F.concat(F.lit("part "), part))
    link = F.struct(F.when(n % 7 == 3, F.concat(F.lit("odd"), F.md5(raw.cast("binary")))).otherwise(raw).alias("raw"), F.lit(0.5).alias("alignment"))
    items = i.select(
        (key % 40).alias("query_id"), F.concat(F.lit("claim:"), key, F.lit(":"), n).alias("claim_id"), (key * 10 + n).alias("pos"), key.cast("string").alias("chunk_uid"),
        F.when(F.col("l_returnflag") == "N", "none").when(q >= 48, "whim").otherwise(hops.REASONS[1]).alias("hop_reason"), F.when(q < 3, " ").otherwise("method").alias("look_for"), F.array(link).alias("linked"),
    )
    at = lambda k, c: F.when(part % 4 == k, c)
    spans = i.select(key.cast("string").alias("chunk_uid"), n.alias("cite_index"), raw.alias("raw"), at(0, F.concat(F.lit("a"), part)).alias("arxiv_id"), F.coalesce(at(1, F.concat(F.lit("d"), part)), at(2, F.concat(F.lit("d"), part))).alias("doi"), at(3, F.lit("W1")).alias("openalex_id"))
    p = table(spark, d, "part").withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    k = F.col("p_partkey")
    chunks = p.select(F.concat(F.lit("chunk:"), k, F.lit(":"), "copy").alias("chunk_uid"), F.when((k % 4 == 0) & (k % 8 != 0), F.concat(F.lit("a"), k)).alias("paper_arxiv"), F.when(k % 4 != 0, F.concat(F.lit("d"), k)).alias("paper_doi"), F.lit(None).cast("string").alias("paper_openalex"), (F.col("copy") * 1.0).alias("worth"))
    none = items.limit(0)
    return hops.expand(items, spans, chunks, none.select("query_id", F.col("claim_id").alias("node_id")), none.select("query_id", F.col("claim_id").alias("src"), F.col("claim_id").alias("dst")), score=lambda: F.col("worth"))


@query(f"WITH {_HOPS} SELECT query_id, outcome, count(*) AS n FROM (SELECT DISTINCT claim_id, query_id, outcome FROM o) GROUP BY ALL")
def hop_outcomes(spark, d):
    return _expanded(spark, d).counts()


@query(f"""WITH {_HOPS}, s AS (SELECT DISTINCT query_id, claim_id, part FROM o WHERE outcome = 'success'),
k AS (SELECT query_id, claim_id, 'chunk:' || part || ':' || copy AS chunk, CASE WHEN part % 4 = 0 THEN 'a' ELSE 'd' END || part AS paper FROM s, (VALUES (1), (2)) v(copy))
SELECT query_id, claim_id AS src, chunk AS dst, 'hop_evidence' AS relation, 0.5::DOUBLE AS score FROM k UNION ALL SELECT DISTINCT query_id, chunk, paper, 'CHUNK_OF', 1.0::DOUBLE FROM k""")
def hop_edges(spark, d):
    return _expanded(spark, d).edges


@query(f"""WITH {_HOPS}, s AS (SELECT DISTINCT query_id, part FROM o WHERE outcome = 'success')
SELECT query_id, CASE WHEN part % 4 = 0 THEN 'a' ELSE 'd' END || part AS node_id, 'paper' AS node_type FROM s UNION ALL SELECT query_id, 'chunk:' || part || ':' || copy, 'chunk' FROM s, (VALUES (1), (2)) v(copy)""")
def hop_nodes(spark, d):
    return _expanded(spark, d).nodes


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n, count(DISTINCT upper('say ' || o_orderpriority || o_orderstatus)) AS replies, min(upper('say ' || o_orderpriority || o_orderstatus)) AS reply, 1::BIGINT AS calls FROM orders GROUP BY ALL")
def memoised_calls(spark, d):
    """A reply for every order, of a few distinct prompts; a second run over all of them asks nothing."""
    asks = models.Calls(scratch(spark, "calls"), "upper", lambda prompts: [p.upper() for p in prompts], batch_rows=4)
    o = table(spark, d, "orders").select("o_orderpriority", "o_orderstatus", F.concat(F.lit("say "), "o_orderpriority", "o_orderstatus").alias("prompt"))
    asks.over(o)
    said = asks.over(o)
    times = spark.read.parquet(asks.folder).groupBy("key").agg(F.count("*").alias("calls"))
    each = said.withColumn("key", asks.key(F.col("prompt"))).join(times, "key")
    return each.groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), F.count_distinct("reply").alias("replies"), F.min("reply").alias("reply"), F.max("calls").alias("calls"))


@query("SELECT doc_id, length(text) AS n_chars, 'DOC ' || doc_id || ' ' || length(text) AS said FROM documents")
def staged_model(spark, d):
    """Every document through a stage, in batches by length."""
    stage = models.Stage("lengths", lambda: lambda rows: [f"DOC {i} {len(t)}" for i, t in rows], "string", batch_tokens=8192)
    return stage.over(table(spark, d, "documents").select("doc_id", "text", F.length("text").cast("long").alias("n_chars")), ["doc_id", "text"], "said").drop("text")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'Y' WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS status FROM orders WHERE o_orderkey % 5 <> 0 OR o_orderkey % 10 = 0""")
def merged_updates(spark, d):
    """All orders as a base of keys; then some change, some go and some come back, each as a delta beside it."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    t = deltas.DeltaTable(scratch(spark, "deltas"), ("o_orderkey",), most=2)
    t.update(o)
    t.update(o.where("o_orderkey % 3 = 0").withColumn("status", F.lit("X")))
    t.update(o.limit(0), gone=o.where("o_orderkey % 5 = 0"))  # compacts
    t.update(o.where("o_orderkey % 10 = 0").withColumn("status", F.lit("Y")))
    return t.read(spark)


@query("""SELECT o_orderpriority, count(*) AS n, sum(place)::BIGINT AS places FROM (SELECT o_orderpriority, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS place FROM orders) GROUP BY ALL""")
def ranged_places(spark, d):
    """Each order's place by price, from offsets of ranges."""
    placed = ranks.placed(table(spark, d, "orders"), [F.desc("o_totalprice"), "o_orderkey"])
    return placed.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.sum("place").alias("places"))


@query()
def merged_samples(spark, d):
    """A sample of 500 line items as the merge of the samples of seven parts."""
    i = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").distinct()
    keys = i.columns
    return ranks.merged([ranks.bottom(i.where(F.col("l_orderkey") % 7 == k), keys, 500) for k in range(7)], keys, 500).drop("_h")


@query()
def classified_sections(spark, d):
    """Labels of all sections: by title where it is a usual one, else by a classifier that learned from those."""
    folded = tables.checkpoint(sections.fold(_chunks(spark, d)))
    known = folded.withColumn("label", imrad.heuristic_label(F.col("title_norm")))
    model = classifier.fit(known, sections.CLASSES, sample=20_000)
    return sections.label(folded, model.classified(folded)).select("paper_id", "title_norm", "label", "source")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey >= 200 AND o_custkey < 900")
def range_scan(spark, d):
    """Orders laid out by customer in twelve ranges; a stretch of customers reads the ranges that it meets."""
    t = ranges.RangeTable(scratch(spark, "ranges"), "o_custkey")
    t.write(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), 12)
    return t.scan(spark, 200, 900)


@query("SELECT count(*) AS n, count(DISTINCT o_orderkey) AS keys, sum(o_custkey)::BIGINT AS custkeys FROM orders")
def range_readers(spark, d):
    """All orders, a reader a range."""
    t = ranges.RangeTable(scratch(spark, "ranges"), "o_custkey")
    t.write(table(spark, d, "orders").select("o_orderkey", "o_custkey"), 7)
    every, *others = t.readers(spark)
    for other in others:
        every = every.unionByName(other)
    return every.agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("keys"), F.sum("o_custkey").alias("custkeys"))
