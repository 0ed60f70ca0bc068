"""Queries of lookups, prompts, payloads and further measures, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scores, text
from tessera.operators import evaluation, graph, lookups
from tessera.plans.queries import LINES, NORM, _list, lines, query, table


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 25 AND l_returnflag = 'R'")
def collection_scroll(spark, d):
    return lookups.scroll(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber", "l_quantity"], F.expr("l_quantity > 25 AND l_returnflag = 'R'"))


@query("SELECT ((('0x' || substr(md5(event_id::VARCHAR), 1, 8))::BIGINT * 7) // 4294967296)::INT AS stride, count(*) AS n FROM events GROUP BY ALL")
def key_ranges(spark, d):
    return table(spark, d, "events").groupBy(lookups.key_range(F.md5(F.col("event_id").cast("string").cast("binary")), 7).alias("stride")).agg(F.count("*").alias("n"))


@query("SELECT vec_id, embedding[1]::DOUBLE AS first FROM embeddings WHERE vec_id IN (SELECT item_id FROM benchmark)")
def point_lookup(spark, d):
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("vec_id"))
    return lookups.by_keys(table(spark, d, "embeddings"), asked, ["vec_id"]).select("vec_id", F.get("embedding", F.lit(0)).cast("double").alias("first"))


@query(f"WITH {LINES} SELECT paper_id, chunk_index, length(text)::INT AS n FROM (SELECT doc_id AS paper_id, ord AS chunk_index, text, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS p FROM l WHERE ord > 0 AND doc_id IN (SELECT item_id FROM benchmark)) WHERE p <= 5")
def paper_lookup(spark, d):
    kind = F.when(F.col("ord") > 0, "subsection").otherwise("abstract")
    chunks = lines(spark, d).select(F.col("doc_id").alias("paper_id"), F.col("ord").alias("chunk_index"), kind.alias("chunk_type"), "text")
    return lookups.paper_chunks(chunks, table(spark, d, "benchmark").select(F.col("item_id").alias("paper_id")), most=5).select("paper_id", "chunk_index", F.length("text").alias("n"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50)")
def id_filter(spark, d):
    first = table(spark, d, "customer").where("c_nationkey = 3").select("c_custkey")
    second = table(spark, d, "lineitem").where("l_quantity = 50").select("l_orderkey")
    return lookups.of_either(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", first, "o_orderkey", second)


_WORDS = rf"list_distinct(list_filter(string_split_regex(lower(regexp_replace({{0}}, '[^\p{{{{L}}}}\p{{{{N}}}}\s]', ' ', 'g')), '\s+'), lambda q: q <> '' AND NOT list_contains({_list(text.TITLE_STOP_WORDS)}, q)))"


@query(f"""WITH c AS (SELECT p_partkey AS citation_id, {_WORDS.format("p_name || ' part'")} AS h FROM part WHERE p_partkey % 100 = 0), t AS (SELECT p_partkey AS paper_id, {_WORDS.format("p_name || ' part of ' || p_type")} AS w FROM part)
SELECT * FROM (SELECT citation_id, paper_id, row_number() OVER (PARTITION BY citation_id ORDER BY paper_id)::INT AS rank FROM c JOIN t ON len(list_intersect(h, w)) = len(h)) WHERE rank <= 2""")
def title_fallback(spark, d):
    """The stated queries, ids divisible by 100, against all rows."""
    p = table(spark, d, "part")
    asked = p.where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("citation_id"), F.concat(F.lit('Smith. "'), F.col("p_name"), F.lit(' part" 1999')).alias("raw"))
    return lookups.by_title(asked, p.select(F.col("p_partkey").alias("paper_id"), F.concat("p_name", F.lit(" part of "), "p_type").alias("title")))


@query(f"""WITH {LINES}, s AS (SELECT DISTINCT doc_id, {NORM.format('title')} AS t FROM l)
SELECT l.doc_id AS paper_id, ord, CASE WHEN ord % 7 = 0 THEN 'kept' WHEN s.t LIKE '%s' THEN upper(s.t) END AS label FROM l JOIN s ON s.doc_id = l.doc_id AND s.t = {NORM.format('l.title')}""")
def section_label_join(spark, d):
    own = lines(spark, d).select(F.col("doc_id").alias("paper_id"), "ord", F.col("title").alias("section_title"), F.when(F.col("ord") % 7 == 0, "kept").alias("label"))
    labels = own.select("paper_id", text.title_norm(F.col("section_title")).alias("title_norm")).distinct().where("title_norm LIKE '%s'").withColumn("label", F.upper("title_norm"))
    return lookups.labels_to_chunks(own, labels).select("paper_id", "ord", "label")


@query("SELECT event_id, kind FROM (SELECT event_id, NULLIF(props->>'k', '1') AS kind FROM events) WHERE kind IS NULL")
def unlabelled_rows(spark, d):
    rows = table(spark, d, "events").select("event_id", F.nullif(F.get_json_object("props", "$.k"), F.lit("1")).alias("kind"))
    return lookups.unlabelled(rows, "kind")


@query("""WITH f AS (SELECT o_orderkey AS id, 'W' || o_custkey AS w, CASE WHEN o_orderkey % 3 = 0 THEN '10.1/' || o_orderkey END AS doi FROM orders), u AS (SELECT 'W' || c_custkey AS w, '10.2/' || c_custkey AS d, CASE WHEN c_custkey % 2 = 0 THEN '17.' || c_custkey END AS a FROM customer WHERE c_nationkey < 12)
SELECT id, coalesce(doi, d) AS doi, CASE WHEN doi IS NULL THEN a END AS arxiv_id FROM f LEFT JOIN u USING (w)""")
def openalex_upgrade(spark, d):
    found = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("W"), "o_custkey").alias("openalex_id"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("10.1/"), "o_orderkey")).alias("doi"), F.lit(None).cast("string").alias("arxiv_id"))
    c = table(spark, d, "customer").where("c_nationkey < 12")
    new = c.select(F.concat(F.lit("W"), "c_custkey").alias("openalex_id"), F.concat(F.lit("10.2/"), "c_custkey").alias("doi"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("17."), "c_custkey")).alias("arxiv_id"))
    return lookups.upgrade(found, new).select("id", "doi", "arxiv_id")


@query("""WITH r AS (SELECT o_custkey AS query_id, o_orderkey AS chunk_uid, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 48) AS c FROM orders)
SELECT query_id, chunk_uid FROM r WHERE c OR query_id NOT IN (SELECT query_id FROM r WHERE c)""")
def eval_context(spark, d):
    hits = table(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("chunk_uid"))
    cited = lookups.by_keys(hits, table(spark, d, "lineitem").where("l_returnflag = 'R' AND l_quantity > 48").select(F.col("l_orderkey").alias("chunk_uid")), ["chunk_uid"])
    return lookups.cited_context(hits, cited)


@query("SELECT o_orderkey AS golden_id, (o_orderkey % 4 + 1)::INT AS category FROM orders WHERE o_orderkey % 4 < 2 OR o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def shortcut_filter(spark, d):
    goldens = table(spark, d, "orders").select(F.col("o_orderkey").alias("golden_id"), (F.col("o_orderkey") % 4 + 1).cast("int").alias("category"))
    said = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("golden_id"), F.when(F.col("l_quantity") > 45, " yes.").otherwise("no").alias("verdict"))
    return lookups.without_shortcuts(goldens, said)


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN ['Methods', 'Abstract'] WHEN 1 THEN ['Results'] ELSE []::VARCHAR[] END AS sections FROM part""")
def section_names(spark, d):
    k = F.col("p_partkey") % 3
    raw = F.when(k == 0, F.array(F.lit(" METHODS "), F.lit("abstract"), F.lit("Appendix"))).when(k == 1, F.array(F.lit("Results"))).otherwise(F.array(F.lit("nothing")))
    return table(spark, d, "part").select("p_partkey", scores.target_sections(raw).alias("sections"))


@query("SELECT doc_id, CASE WHEN contains(t, 'error') THEN 'faults' WHEN contains(t, 'password') OR contains(t, 'license') THEN 'legal' WHEN contains(t, 'th') THEN 'plain' END AS cluster FROM (SELECT doc_id, lower(coalesce(lang, '') || ' ' || coalesce(text, '')) AS t FROM documents)")
def keyword_clusters(spark, d):
    kinds = {"faults": ["error"], "legal": ["password", "license"], "plain": ["th"]}
    return table(spark, d, "documents").select("doc_id", scores.cluster(F.col("lang"), F.col("text"), kinds).alias("cluster"))


@query("SELECT task, count(*) AS n FROM (SELECT (o_orderkey % 12)::INT AS task FROM orders) GROUP BY task")
def round_robin(spark, d):
    return table(spark, d, "orders").groupBy(scores.task_of(F.col("o_orderkey"), 12).alias("task")).agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority AS stage, round(sum(o_totalprice) / count(*) * 2300000 * 1.1, 2) AS projected FROM orders GROUP BY ALL")
def scale_projection(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("stage")).agg(F.sum("o_totalprice").alias("v"), F.count("*").alias("n"))
    return o.select("stage", F.round(scores.projected(F.col("v"), F.col("n"), 2_300_000), 2).alias("projected"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'Available citations:' || chr(10) || '- "A ' || o_custkey || '"' || chr(10) || '- "B"' ELSE 'Available citations: none' END AS block, CASE WHEN o_orderkey % 4 = 0 THEN ['x' || o_custkey, 'y'] ELSE []::VARCHAR[] END AS ids FROM orders""")
def payload_citations(spark, d):
    """Payloads as JSON objects, as JSON of another kind, as no JSON, and none at all."""
    k, c = F.col("o_orderkey") % 4, F.col("o_custkey")
    spans = F.to_json(F.struct(F.array(*[F.struct(F.concat(F.lit(a), c.cast("string") if full else F.lit("")).alias("raw"), F.concat(F.lit(x), c.cast("string") if x == "x" else F.lit("")).alias("arxiv_id")) for a, x, full in ((" A ", "x", True), ("B", "y", False), (" ", "", False), ("B ", "y", False))]).alias("cite_spans")))
    raw = F.when(k == 0, spans).when(k == 1, "[1, 2]").when(k == 2, "not json")
    held = table(spark, d, "orders").select("o_orderkey", text.cite_spans(raw).alias("s"))
    return held.select("o_orderkey", text.citations_block(F.col("s.raw")).alias("block"), text.cited_ids(F.col("s.arxiv_id")).alias("ids"))


@query("SELECT main, count(*) AS n FROM (SELECT unnest(CASE o_orderkey % 3 WHEN 0 THEN ['cs'] WHEN 1 THEN ['math', 'hep-th', 'cs'] ELSE ['stat', 'stat'] END) AS main FROM orders) GROUP BY main")
def main_category_counts(spark, d):
    k = F.col("o_orderkey") % 3
    raw = F.when(k == 0, " cs.CL ").when(k == 1, "math.AG hep-th cs.LG physics.bio-ph").otherwise("stat.ML stat.ME")
    return table(spark, d, "orders").select(F.explode(text.main_categories(raw)).alias("main")).groupBy("main").agg(F.count("*").alias("n"))


@query("SELECT key, count(*) AS n FROM (SELECT 'doi' AS key FROM part WHERE p_size > 10 UNION ALL SELECT 'raw' FROM part) GROUP BY key")
def bib_key_presence(spark, d):
    held = F.create_map(F.lit("doi"), F.when(F.col("p_size") > 10, F.col("p_brand")).otherwise(" "), F.lit("raw"), F.col("p_name"), F.lit("url"), F.lit(None).cast("string"))
    return evaluation.key_presence(table(spark, d, "part").select(held.alias("ids")), "ids")


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'Supported' WHEN 1 THEN 'Inconclusive' ELSE 'Not-Supported' END AS verdict, CASE o_orderkey % 3 WHEN 0 THEN 'inner text' ELSE o_orderstatus END AS body FROM orders""")
def reply_parsing(spark, d):
    k = F.col("o_orderkey") % 3
    raw = F.when(k == 0, '```json\n{"verdict": "Supported", "reasoning": "x"}\n```').when(k == 1, "I think so").otherwise('{"verdict": "Not-Supported"}')
    body = F.when(k == 0, "Title. {'section': 'Abstract', 'text': 'inner text'}").otherwise(F.col("o_orderstatus"))
    return table(spark, d, "orders").select("o_orderkey", text.verdict_of(raw).alias("verdict"), text.unwrapped(body).alias("body"))


_CLASSES = "c AS (SELECT l_returnflag AS y, CASE WHEN l_quantity > 20 THEN l_returnflag WHEN l_linestatus = 'O' THEN 'N' ELSE 'A' END AS p FROM lineitem)"


@query(f"""WITH {_CLASSES}, t AS (SELECT y, count(*) AS s, count(*) FILTER (WHERE y = p) AS r FROM c GROUP BY y), q AS (SELECT p AS y, count(*) AS n FROM c GROUP BY p),
f AS (SELECT s, coalesce(r / n, 0) AS p, r / s AS r, CASE WHEN coalesce(r / n, 0) + r / s > 0 THEN 2 * coalesce(r / n, 0) * (r / s) / (coalesce(r / n, 0) + r / s) ELSE 0 END AS f FROM t LEFT JOIN q USING (y))
SELECT round(avg(p), 9) AS macro_precision, round(avg(r), 9) AS macro_recall, round(avg(f), 9) AS macro_f1, round(sum(p * s) / sum(s), 9) AS weighted_precision, round(sum(r * s) / sum(s), 9) AS weighted_recall, round(sum(f * s) / sum(s), 9) AS weighted_f1, round(sum(r * s) / sum(s), 9) AS micro_f1 FROM f""")
def f1_averages(spark, d):
    said = F.when(F.col("l_quantity") > 20, F.col("l_returnflag")).when(F.col("l_linestatus") == "O", "N").otherwise("A")
    got = evaluation.averaged(evaluation.class_report(table(spark, d, "lineitem").select(F.col("l_returnflag").alias("y"), said.alias("p")), "y", "p"))
    return got.select(*[F.round(c, 9).alias(c) for c in got.columns])


_RANKED = "r AS (SELECT o_custkey AS query_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INT AS rank, o_orderkey % 5 AS paper_id, o_custkey % 5 AS gold_paper, o_orderstatus || ' ' || o_orderpriority AS text FROM orders)"


def _ranked(spark, d):
    rank = F.row_number().over(graph.Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return table(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), rank.alias("rank"), (F.col("o_orderkey") % 5).alias("paper_id"), (F.col("o_custkey") % 5).alias("gold_paper"), F.concat_ws(" ", "o_orderstatus", "o_orderpriority").alias("text"))


@query(f"WITH {_RANKED} SELECT query_id, coalesce(bool_or(rank <= 3 AND paper_id = gold_paper), false) AS paper_hit FROM r GROUP BY query_id")
def paper_hit_at_k(spark, d):
    return evaluation.paper_hit(_ranked(spark, d), 3)


@query(f"WITH {_RANKED}, t AS (SELECT query_id, lower(string_agg(text, ' ' ORDER BY rank)) AS t FROM r WHERE rank <= 3 GROUP BY query_id) SELECT query_id, contains(t, 'urgent') OR contains(t, 'low f') AS answer_contained FROM t")
def answer_contained_at_k(spark, d):
    return evaluation.answer_contained(_ranked(spark, d).withColumn("answers", F.array(F.lit("URGENT"), F.lit("LOW F"))), 3)


@query("""SELECT o_orderstatus AS system, o_orderpriority AS domain, NULL::VARCHAR AS source, count(*) AS n, round(avg(o_totalprice), 4) AS hit, round(avg(o_custkey % 3 + 1.0), 4) AS mrr, round(avg(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END), 4) AS avg_rank FROM orders GROUP BY ALL
UNION ALL SELECT o_orderstatus, NULL, o_orderstatus, count(*), round(avg(o_totalprice), 4), round(avg(o_custkey % 3 + 1.0), 4), round(avg(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END), 4) FROM orders GROUP BY ALL
UNION ALL SELECT o_orderstatus, NULL, NULL, count(*), round(avg(o_totalprice), 4), round(avg(o_custkey % 3 + 1.0), 4), round(avg(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END), 4) FROM orders GROUP BY ALL""")
def metric_means(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("system"), F.col("o_orderpriority").alias("domain"), F.col("o_orderstatus").alias("source"), F.col("o_totalprice").alias("hit"), (F.col("o_custkey") % 3 + 1.0).alias("mrr"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey")).alias("rank"))
    got = evaluation.means_by(o, "system", ["domain", "source"], ["hit", "mrr"], "rank")
    return got.select("system", "domain", "source", "n", *[F.round(c, 4).alias(c) for c in ("hit", "mrr", "avg_rank")])


@query("SELECT o_custkey AS query_id, (o_orderkey % 3)::INT AS sq_idx, count(*) AS n, round(avg(CASE WHEN o_orderpriority IN ('1-URGENT', '5-LOW') THEN 1.0 ELSE 0.0 END), 6) AS section_rate, max(o_totalprice) AS best, min(o_totalprice) AS worst FROM orders GROUP BY ALL")
def sub_query_ranges(spark, d):
    hits = table(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), (F.col("o_orderkey") % 3).cast("int").alias("sq_idx"), F.col("o_orderpriority").alias("section"), F.col("o_totalprice").alias("score"))
    got = evaluation.sub_query_summary(hits, F.array(F.lit("1-URGENT"), F.lit("5-LOW")))
    return got.withColumn("section_rate", F.round("section_rate", 6))


@query("""SELECT count(*) AS n_chunks, count(DISTINCT o_custkey) AS n_papers, count(DISTINCT CASE WHEN o_custkey % 3 = 0 THEN o_custkey END) AS papers_with_arxiv, count(DISTINCT CASE WHEN o_orderkey % 5 = 0 THEN o_custkey END) AS papers_with_doi,
round(count(*) / count(DISTINCT o_custkey), 6) AS chunks_per_paper, sum(o_orderkey % 7)::BIGINT AS n_spans, round(sum(o_orderkey % 7 // 2) / sum(o_orderkey % 7), 6) AS span_coverage FROM orders""")
def id_coverage(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    chunks = table(spark, d, "orders").select(c.alias("paper_id"), F.when(c % 3 == 0, c).alias("arxiv_id"), F.when(k % 5 == 0, k).alias("doi"), (k % 7).alias("n_spans"), F.floor(k % 7 / 2).alias("n_spans_with_id"))
    return evaluation.id_coverage(chunks).withColumns({"chunks_per_paper": F.round("chunks_per_paper", 6), "span_coverage": F.round("span_coverage", 6)})


@query(f"WITH {_RANKED} SELECT query_id, paper_id, count(*) AS n_chunks, min(rank) AS first_rank, row_number() OVER (PARTITION BY query_id ORDER BY min(rank), paper_id)::INT AS place FROM r GROUP BY query_id, paper_id")
def stage_summary(spark, d):
    return graph.stage_papers(_ranked(spark, d))


@query("SELECT DISTINCT o_custkey AS query_id, 'c' || o_custkey AS claim_id, 'o' || o_orderkey AS chunk_uid, o_orderstatus AS text FROM orders WHERE o_orderpriority <> '5-LOW'")
def direct_evidence(spark, d):
    o = table(spark, d, "orders")
    edges = o.select(F.col("o_custkey").alias("query_id"), F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("o"), "o_orderkey").alias("dst"), F.when(F.col("o_orderpriority") == "5-LOW", "contradicts").otherwise("METHOD").alias("relation"))
    return graph.direct_evidence(edges, o.select(F.concat(F.lit("o"), "o_orderkey").alias("chunk_uid"), F.col("o_orderstatus").alias("text")))


@query("SELECT l_orderkey AS claim_id, l_partkey AS link_pos, l_quantity AS alignment FROM (SELECT DISTINCT l_orderkey, l_partkey, l_quantity FROM lineitem) QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_partkey) = 1")
def best_citation(spark, d):
    cited = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("claim_id"), F.col("l_partkey").alias("link_pos"), F.col("l_quantity").alias("alignment"))
    return graph.best_citation(cited).select("claim_id", "link_pos", "alignment")


@query("SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' OR o_orderkey % 2 = 0 THEN 'llm' ELSE 'nli' END AS f, 'nli' AS a, 'llm' AS b, 'none' AS c FROM orders")
def ablation_routes(spark, d):
    odd, multi = F.col("o_orderpriority") == "5-LOW", F.col("o_orderkey") % 2 == 0
    return table(spark, d, "orders").select("o_orderkey", *[graph.route_by(m, odd, multi).alias(x) for m, x in (("full", "f"), ("nli", "a"), ("llm", "b"), ("none", "c"))])


@query("SELECT doc_id, len(list_distinct(m)) AS n_refs, len(m) AS n_markers FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[a-z]+tion') AS m FROM documents)")
def distinct_markers(spark, d):
    """Distinct and all markers of each paper; here words of one ending stand for markers."""
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("([a-z]+tion)"), F.lit(1))
    return table(spark, d, "documents").select("doc_id", found.alias("m")).select("doc_id", F.size(F.array_distinct("m")).alias("n_refs"), F.size("m").alias("n_markers"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN upper(o_orderstatus) ELSE NULL END AS title, CASE WHEN o_orderkey % 2 = 0 THEN 1999 ELSE 2007 END::INT AS year, CASE WHEN o_orderkey % 2 = 0 THEN ['Ann Lee', 'Bo'] ELSE ['C D', 'E'] END AS authors, ['cs.CL', 'math.AG'] AS categories FROM orders""")
def paper_metadata(spark, d):
    even = F.col("o_orderkey") % 2 == 0
    none = F.array().cast("array<array<string>>")
    parsed = F.when(even, F.array(F.array(F.lit("Lee"), F.lit("Ann")), F.array(F.lit("Bo"), F.lit("")))).otherwise(none)
    meta = scores.paper_meta(F.when(even, F.concat(F.lit(" "), F.upper("o_orderstatus"), F.lit("\n "))).otherwise(" "), F.lit(""), F.lit(""), F.when(even, F.array(F.lit("Mon, 4 Jan 1999"))).otherwise(F.array().cast("array<string>")), F.lit("2007-05-23"), parsed, F.lit("C D; E, "), F.lit("cs.CL math.AG"))
    return table(spark, d, "orders").select("o_orderkey", meta.alias("m")).select("o_orderkey", "m.title", "m.year", "m.authors", "m.categories")
