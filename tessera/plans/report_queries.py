"""Queries of a graph's viewer rows, tallies, coverage and bibliography entries, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import answers, citations, graph, profile, resume, sections, tables
from tessera.plans.queries import LINES, NORM, lines, query, table


@query("""SELECT o_custkey AS query_id, 'n' || o_orderkey || repeat('x', 30) AS node_id, CASE o_orderkey % 3 WHEN 0 THEN 'paper' WHEN 1 THEN 'chunk' ELSE 'claim' END AS type,
CASE o_orderkey % 3 WHEN 0 THEN 'p' || o_custkey WHEN 1 THEN left(o_orderpriority, 22) || ' · ' || (o_custkey % 7) ELSE o_orderstatus || ' b c d e f…' END AS label,
CASE o_orderkey % 3 WHEN 0 THEN 'p' || o_custkey ELSE left('n' || o_orderkey || repeat('x', 30), 32) || CASE WHEN length('n' || o_orderkey) > 2 THEN '…' ELSE '' END END AS display_id,
left(o_orderstatus || ' b c d e f g' || repeat(' word', 200), 800) AS full_text, round(o_totalprice / 7, 4) AS score FROM orders""")
def viewer_nodes(spark, d):
    k = F.col("o_orderkey")
    kind = F.when(k % 3 == 0, "paper").when(k % 3 == 1, "chunk").otherwise("claim")
    said = F.concat(F.lit(" "), "o_orderstatus", F.lit("\nb  c d e f g"), F.repeat(F.lit(" word"), F.lit(200)))
    nodes = table(spark, d, "orders").select(
        F.col("o_custkey").alias("query_id"), F.concat(F.lit("n"), k.cast("string"), F.repeat(F.lit("x"), F.lit(30))).alias("node_id"), kind.alias("node_type"), said.alias("text"),
        F.concat(F.lit("p"), "o_custkey").alias("paper_id"), F.col("o_orderpriority").alias("section"), (F.col("o_custkey") % 7).alias("chunk_index"), (F.col("o_totalprice") / 7).alias("score"),
    )
    return graph.viewer_nodes(nodes)


@query("SELECT l_orderkey AS query_id, 'a' || l_partkey AS source, 'b' || l_suppkey AS target, CASE WHEN l_returnflag = 'N' THEN 'related' ELSE l_returnflag END AS relation, CASE WHEN l_linenumber = 1 THEN 0.0 ELSE round(l_extendedprice / 7, 4) END::DOUBLE AS score FROM lineitem")
def viewer_edges(spark, d):
    kind = F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).otherwise("")
    score = F.when(F.col("l_linenumber") != 1, F.col("l_extendedprice") / 7)
    return graph.viewer_edges(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.concat(F.lit("a"), "l_partkey").alias("src"), F.concat(F.lit("b"), "l_suppkey").alias("dst"), kind.alias("relation"), score.alias("score")))


@query("""SELECT o_custkey AS query_id, 'node_type' AS kind, o_orderstatus AS bucket, count(*) AS n FROM orders GROUP BY ALL
UNION ALL SELECT o_custkey, 'verdict', CASE WHEN o_orderkey % 3 = 0 THEN '?' ELSE o_orderpriority END AS b, count(*) FROM orders GROUP BY ALL
UNION ALL SELECT o_custkey, 'verifier', CASE WHEN o_orderkey % 2 = 0 THEN 'nli' ELSE 'llm' END AS b, count(*) FROM orders GROUP BY ALL""")
def scorecard_tallies(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    judged = o.select(F.col("o_custkey").alias("query_id"), F.when(k % 3 != 0, F.col("o_orderpriority")).alias("verdict"), F.when(k % 2 == 0, "nli").otherwise("llm").alias("verifier"))
    return graph.tallies(o.select(F.col("o_custkey").alias("query_id"), F.col("o_orderstatus").alias("node_type")), judged)


def _labelled(spark, d):
    norm = text.title_norm(F.col("title"))
    label = F.when(norm.isin("methods", "results"), F.initcap(norm))
    return lines(spark, d).select(F.col("doc_id").alias("paper_id"), norm.alias("title_norm"), label.alias("label"), F.when(F.col("ord") % 3 == 0, "classifier").otherwise("skip").alias("source"))


_LABELLED = f"WITH {LINES}, s AS (SELECT {NORM.format('title')} AS title_norm, CASE WHEN ord % 3 = 0 THEN 'classifier' ELSE 'skip' END AS source FROM l)"


@query(f"{_LABELLED} SELECT title_norm, source, count(*) AS n FROM s WHERE title_norm NOT IN ('methods', 'results') GROUP BY ALL")
def title_source_counts(spark, d):
    return sections.title_sources(_labelled(spark, d))


@query(f"{_LABELLED} SELECT count(*) AS n_sections, count(*) FILTER (WHERE title_norm IN ('methods', 'results')) AS n_labelled, round(count(*) FILTER (WHERE title_norm IN ('methods', 'results')) / count(*), 6) AS coverage FROM s")
def label_coverage(spark, d):
    return sections.coverage(_labelled(spark, d))


@query("SELECT o_custkey AS query_id, o_orderkey AS claim_id, CASE WHEN o_orderkey % 3 = 0 THEN 'Supported' ELSE 'Inconclusive' END AS verdict FROM orders WHERE o_orderkey % 3 = 0 OR (o_orderkey % 3 = 1 AND o_orderstatus = 'F')")
def answerable_claims(spark, d):
    """The judge's verdict for some claims, none or an empty one for others; those keep their own."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    claims = o.select(F.col("o_custkey").alias("query_id"), k.alias("claim_id"), F.when(F.col("o_orderstatus") == "F", "Inconclusive").otherwise("Contradicted").alias("verdict"))
    said = o.where(k % 3 != 1).unionByName(o.where(k % 6 == 1)).select(F.col("o_custkey").alias("query_id"), k.alias("claim_id"), F.when(k % 3 == 0, "Supported").when(k % 3 == 2, "Not-Supported").otherwise("").alias("verdict"))
    return answers.answerable(claims, said)


@query("SELECT item_id AS query_id, 0 AS sq_idx, text, ['Introduction', 'Introduction'] AS sections, 1.0::DOUBLE AS weight FROM benchmark")
def fallback_sub_query(spark, d):
    return answers.whole_question(table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"))


@query("""WITH p AS (SELECT p_partkey, p_partkey % 6 AS k, p_partkey::VARCHAR AS s FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN '10.1234/a' || s WHEN 1 THEN 'D' || s WHEN 2 THEN '10.5555/l' || s WHEN 3 THEN '10.7777/r' || s END AS doi,
CASE k WHEN 0 THEN 'arXiv:1203.00123' WHEN 1 THEN 'cs/' || s WHEN 2 THEN 'hep-th/9901001' END AS arxiv_id, CASE k WHEN 1 THEN 'W' || s WHEN 4 THEN 'W4' END AS openalex_id, CASE k WHEN 0 THEN 'A title ' || s WHEN 4 THEN 'entry raw' END AS title FROM p""")
def bib_entry_ids(spark, d):
    """Entries with ids in texts, objects, lists, links and raw text; entries that are no JSON."""
    k, s = F.col("p_partkey") % 6, F.col("p_partkey").cast("string")
    fill = lambda pattern: F.replace(F.lit(pattern), F.lit("@"), s)
    entry = (
        F.when(k == 0, fill('{"doi": "https://doi.org/10.1234/a@", "eprint": "see arXiv:1203.00123v2", "title": " A title @ "}'))
        .when(k == 1, fill('{"doi": null, "ids": {"DOI": "D@", "arxiv_id": "cs/@", "open_alex_id": "W@"}, "title": "short"}'))
        .when(k == 2, fill('{"ids": [1, "none", "10.5555/l@"], "contained_arXiv_ids": ["x", "hep-th/9901001"]}'))
        .when(k == 3, fill('{"contained_links": [], "raw_text": "", "raw": "Smith, 10.7777/r@ 1999"}'))
        .when(k == 4, '{"openAlexId": " W4 ", "title": 7, "bib_entry_raw": "entry raw"}')
        .otherwise("not json")
    )
    return table(spark, d, "part").select("p_partkey", citations.entry_ids(entry).alias("x")).select("p_partkey", "x.*")


_PROFILE = """WITH c AS (SELECT count(*) FILTER (WHERE o_orderkey % 4 = 0) AS a, count(*) FILTER (WHERE o_orderkey % 4 = 1) AS b, count(*) FILTER (WHERE o_orderkey % 4 = 2) AS e, count(*) FILTER (WHERE o_orderkey % 4 = 3) AS f FROM orders)
SELECT a + b + e + f AS n_papers, b + e + f AS has_title, a + e + f AS has_authors, a + b + f AS has_year, f AS has_doi, a + b AS has_arxiv_id, a + b AS has_year_in_id, a + b AS has_categories, a + b + e AS has_abstract, f AS abstract_empty,
a + b AS has_body, e + f AS body_empty, a AS without_titles, e + f AS without_citations, 2 * a + 2 * b AS n_sections, a AS empty_titles, a AS noise_titles, b AS usual_titles, 6 * a + 5 * b AS words, a AS figures, b AS tables, 2 * a + 3 * b AS markers,
3 * a + 3 * b + e + f AS chunks, 2 * a + 2 * b AS cited, b AS cited_doi, b AS cited_arxiv, a AS cited_openalex, a AS cited_without_id, 2 * a + 2 * b AS bib_entries, b AS bib_doi, b AS bib_arxiv_id, a AS bib_openalex_id, b AS bib_title, 2 * b AS bib_year, a + 2 * b AS bib_any_id, a AS bib_without_id FROM c"""


def _papers(spark, d):
    """Papers of four kinds, told apart by their key: marks, blank titles, entries of every form, and nothing at all."""
    k = F.col("o_orderkey") % 4
    pair = lambda names, rows: F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(names, r, strict=True)]) for r in rows])
    full = [("Methods", "a {{cite:ab}} {{cite:cd}} {{cite:ab}} {{table:9}}"), ("Lattice", "")]
    bare = [(" ", "two words {{cite:ab}} {{cite:ff}}"), ("3.1", "x {{figure:1-a}}")]
    entries = [("ab", '{"doi": "10.1234/z", "year": 1999, "title": "A long title"}'), ("cd", '{"ids": {"arxiv": "1203.00001"}, "Year": "in 2001"}'), ("ee", "not json")]
    others = [("ab", '{"openalex_id": "W1"}'), ("zz", '{"raw": "nothing"}')]
    s, b = ("section", "text"), ("ref_id", "entry")
    return table(spark, d, "orders").select(
        F.pmod("o_orderkey", F.lit(11)).alias("shard"),
        F.when(k == 0, " ").otherwise("T").alias("title"), F.when(k != 1, F.array(F.lit("A"))).alias("authors"), F.when(k == 2, "n.d.").otherwise("2003-01-01").alias("year"),
        F.when(k == 3, "10.1/x").alias("doi"), F.when(k == 0, "2101.00001").when(k == 1, "cs/0701001").when(k == 2, "none").alias("arxiv_id"), F.when(k < 2, F.array(F.lit("cs.CL"))).alias("categories"),
        F.when(k != 3, "text").otherwise("").alias("abstract"), F.when(k == 0, pair(s, bare)).when(k == 1, pair(s, full)).when(k == 2, F.slice(pair(s, full), 1, 0)).alias("sections"),
        F.when(k == 0, pair(b, others)).when(k == 1, pair(b, entries)).alias("bibs"),
    )


@query(_PROFILE)
def paper_profile(spark, d):
    return profile.paper_profile(_papers(spark, d))


@query(_PROFILE)
def resumed_profile(spark, d):
    """The same by shards: three of eleven, then a run that goes on with the others."""
    papers = _papers(spark, d)
    columns = profile.paper_profile(papers.limit(0)).columns
    held = resume.Resumable(f"{tables.shared_folder(spark)}/profile-{uuid.uuid4().hex}", "shard", lambda rows: profile.paper_profile(rows, ("shard",)), resume.sums(columns), per_run=4)
    held.step(papers, 3)
    return held.run(papers)
