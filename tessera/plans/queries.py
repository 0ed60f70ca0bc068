"""Queries over the driver's tables, one or more for each kind of operator, and their SQL.

Papers are ``documents``, their lines are sections under titles in turn; questions are
``benchmark`` items; vectors are ``embeddings``; graphs come from the order tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import imrad, scores, text
from tessera.operators import answers, chunking, citations, evaluation, graph, retrieval, sampling, sections, tables
from tessera.plans.engine import Config, Engine
from tessera.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TITLES = ["Abstract", "Introduction", "  Methods ", "Related Work", "RESULTS", "Experimental  Setup", "Discussion", "Conclusions", "References", "Lattice Models", "Results and Analysis", "3.1 Proofs"]


def query(sql: str | None = None) -> Callable:
    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, ord, title, text) of every line."""
    each = table(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("ord", "text"))
    return each.select("doc_id", "ord", F.get(F.array(*map(F.lit, TITLES)), F.pmod(F.col("doc_id") + F.col("ord"), F.lit(len(TITLES))).cast("int")).alias("title"), "text")


def _list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


LINES = f"""ls AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
li AS (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i FROM ls),
l AS (SELECT doc_id, (i - 1)::INT AS ord, {_list(TITLES)}[((doc_id + i - 1) % {len(TITLES)} + {len(TITLES)}) % {len(TITLES)} + 1] AS title, a[i] AS text FROM li)"""
NORM = r"regexp_replace(lower(trim(coalesce({0}, ''))), '\s+', ' ', 'g')"


def _tokens(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+')"


# -- text


@query(f"WITH {LINES} SELECT doc_id, ord, text FROM l")
def line_unnest_index(spark, d):
    return lines(spark, d).select("doc_id", "ord", "text")


@query(rf"WITH {LINES} SELECT doc_id, ord, {NORM.format('title')} AS title_norm, regexp_replace({NORM.format('title')}, '^[\d.\s]+', '') AS profile_title, {NORM.format('text')} AS line_norm FROM l")
def title_normalize(spark, d):
    return lines(spark, d).select("doc_id", "ord", text.title_norm(F.col("title")).alias("title_norm"), text.profile_title(F.col("title")).alias("profile_title"), text.title_norm(F.col("text")).alias("line_norm"))


@query(rf"""WITH {LINES} SELECT doc_id, ord, title FROM l WHERE NOT regexp_matches({NORM.format('title')}, '{"|".join(text.SKIPPED_TITLES)}')""")
def section_skip_filter(spark, d):
    return lines(spark, d).where(~text.skips_section(F.col("title"))).select("doc_id", "ord", "title")


LABEL = "CASE " + " ".join(f"WHEN regexp_matches({NORM.format('title')}, '{imrad.pattern(x)}') THEN '{x}'" for x in imrad.TITLES) + " END"


@query(f"WITH {LINES} SELECT doc_id, ord, {LABEL} AS label FROM l")
def imrad_heuristic_label(spark, d):
    return lines(spark, d).select("doc_id", "ord", imrad.heuristic_label(F.col("title")).alias("label"))


def _dois(spark, d):
    link = F.when(F.col("o_orderkey") % 3 == 0, "https://doi.org/").when(F.col("o_orderkey") % 3 == 1, " http://dx.doi.org/").otherwise("")
    return table(spark, d, "orders").select("o_orderkey", F.concat(link, F.lit("10.1234/x."), F.col("o_orderkey")).alias("raw"))


@query("SELECT o_orderkey, '10.1234/x.' || o_orderkey AS doi FROM orders")
def doi_normalize(spark, d):
    return _dois(spark, d).select("o_orderkey", text.normalize_doi(F.col("raw")).alias("doi"))


@query(f"WITH {LINES} SELECT doc_id, ord, sha1(concat_ws(chr(0), doc_id::VARCHAR, title, ord::VARCHAR, text)) AS uid FROM l")
def chunk_uid(spark, d):
    return lines(spark, d).select("doc_id", "ord", text.chunk_uid(F.col("doc_id").cast("string"), F.col("title"), F.col("ord"), F.col("text")).alias("uid"))


@query(rf"""WITH {LINES} SELECT doc_id, ord, trim(regexp_replace(regexp_replace(text || ' , , , and  so', '(\s*,)(\s*,)+', ',', 'g'), '  +', ' ', 'g')) AS embed FROM l""")
def embed_text_clean(spark, d):
    return lines(spark, d).select("doc_id", "ord", text.embed_text(F.concat("text", F.lit(" , , , and  so"))).alias("embed"))


#: The pattern for an engine whose boundaries know ASCII alone.
_OUT = r"[^\p{L}\p{N}_]"
_ATOMIC = rf"(^|{_OUT})([0-9]|[A-Z]{{2}}([A-Z0-9-]*[A-Z0-9])?($|{_OUT})|[A-Z]{{2}}[A-Z0-9-]*-[\p{{L}}\p{{N}}_]|[A-Z][a-z]+-[0-9]+($|{_OUT}))"


@query(rf"WITH {LINES} SELECT doc_id, ord, CASE WHEN regexp_matches(text, '{_ATOMIC}') THEN 'atomic_factual' ELSE 'inferential' END AS claim_type FROM l")
def claim_type_classify(spark, d):
    return lines(spark, d).select("doc_id", "ord", text.claim_type(F.col("text")).alias("claim_type"))


def _raws(spark, d):
    n = F.col("o_orderkey")
    raw = F.when(n % 4 == 0, F.concat(F.lit("A. Smith, in arXiv:2101."), F.lpad((n % 100000).cast("string"), 5, "0"), F.lit("v2, 2021."))).when(n % 4 == 1, F.concat(F.lit("B. Jones. doi:10.1109/X."), n, F.lit(", 2016."))).when(n % 4 == 2, F.concat(F.lit("C. Lee, https://arxiv.org/abs/cs/0705001, "), n)).otherwise("no ids at all")
    return table(spark, d, "orders").select("o_orderkey", raw.alias("raw"))


@query("""WITH r AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '2101.' || lpad((o_orderkey % 100000)::VARCHAR, 5, '0') WHEN 2 THEN 'cs/0705001' ELSE '' END AS arxiv FROM orders)
SELECT o_orderkey, arxiv, CASE WHEN o_orderkey % 4 = 1 THEN '10.1109/X.' || o_orderkey WHEN arxiv <> '' THEN '10.48550/arxiv.' || arxiv ELSE '' END AS doi FROM r""")
def arxiv_id_extract(spark, d):
    return _raws(spark, d).withColumn("ids", text.ids_in_text(F.col("raw"))).select("o_orderkey", "ids.arxiv", "ids.doi")


@query("""WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 IN (0, 2) THEN 'arxiv_in_text' WHEN o_orderkey % 4 = 1 THEN 'doi_in_text' ELSE 'unresolved' END AS id_source, count(l_orderkey) AS n
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT id_source, count(*) AS n_refs, sum(n)::BIGINT AS n_citations, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS refs_pct, round(100.0 * sum(n) / sum(sum(n)) OVER (), 2) AS citations_pct FROM r GROUP BY id_source""")
def resolution_stats(spark, d):
    cited = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    refs = _raws(spark, d).join(cited, "o_orderkey", "left").select(F.col("o_orderkey").alias("source_ref_id"), "raw", F.coalesce("n", F.lit(0)).alias("n_citations"))
    return citations.resolution_stats(citations.resolve_in_text(refs))


_STOP = _list(text.ANSWER_STOP_WORDS)


@query(f"""WITH t AS (SELECT conv_id, turn, list_filter(list_distinct({_tokens('text')}), lambda x: NOT list_contains({_STOP}, x)) AS w FROM conversations),
p AS (SELECT a.conv_id, a.turn, len(list_intersect(a.w, b.w)) AS n, len(a.w) AS na, len(b.w) AS nb FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
SELECT conv_id, turn, round(CASE WHEN na > 0 AND nb > 0 THEN n / (na + nb - n) ELSE 0.0 END, 6) AS jaccard, round(CASE WHEN na > 0 THEN n / na ELSE 0.0 END, 6) AS overlap FROM p""")
def token_jaccard(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", text.token_set(F.col("text")).alias("w"))
    both = t.alias("a").join(t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("next")), ["conv_id", "turn"])
    return both.select("conv_id", "turn", F.round(text.jaccard(F.col("w"), F.col("next")), 6).alias("jaccard"), F.round(text.overlap(F.col("w"), F.col("next")), 6).alias("overlap"))


@query(rf"""WITH t AS (SELECT p_partkey, p_name || ' in the deep sea of ' || p_type AS x, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' ' || p_type || ' ' || p_brand WHEN 2 THEN p_type ELSE p_name || ' sea' END AS y FROM part),
w AS (SELECT p_partkey,
  list_distinct(list_filter(string_split_regex(lower(regexp_replace(x, '[^\p{{L}}\p{{N}}\s]', ' ', 'g')), '\s+'), lambda q: q <> '' AND NOT list_contains({_list(text.TITLE_STOP_WORDS)}, q))) AS a,
  list_distinct(list_filter(string_split_regex(lower(regexp_replace(y, '[^\p{{L}}\p{{N}}\s]', ' ', 'g')), '\s+'), lambda q: q <> '' AND NOT list_contains({_list(text.TITLE_STOP_WORDS)}, q))) AS b FROM t),
n AS (SELECT *, len(list_intersect(a, b)) AS n FROM w)
SELECT p_partkey, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE greatest(n / (len(a) + len(b) - n),
  CASE WHEN len(a) <= 1.5 * len(b) AND len(b) <= 1.5 * len(a) THEN greatest(n / len(a), n / len(b)) ELSE 0.0 END,
  CASE WHEN len(b) >= 3 THEN n / len(b) ELSE 0.0 END) END, 6) AS score FROM n""")
def title_score(spark, d):
    k = F.col("p_partkey") % 4
    x = F.concat(F.col("p_name"), F.lit(" in the deep sea of "), F.col("p_type"))
    y = F.when(k == 0, F.col("p_name")).when(k == 1, F.concat_ws(" ", "p_name", "p_type", "p_brand")).when(k == 2, F.col("p_type")).otherwise(F.concat_ws(" ", "p_name", F.lit("sea")))
    return table(spark, d, "part").select("p_partkey", F.round(text.title_score(x, y), 6).alias("score"))


@query(rf"""WITH {LINES}, m AS (SELECT doc_id, ord, CASE WHEN ord % 5 = 0 THEN '{{{{formula:' || substr(text, 1, 3) || '}}}} ' || substr(text, 1, 20) ELSE text END AS t FROM l)
SELECT doc_id, ord FROM m WHERE length(regexp_replace(t, '[ \n\t]+', '', 'g')) > 0
AND length(t) - length(regexp_replace(t, '\{{\{{formula:[^}}]+\}}\}}|\bREF\b', '', 'g')) < 0.4 * length(regexp_replace(t, '[ \n\t]+', '', 'g'))""")
def usable_chunk_filter(spark, d):
    t = F.when(F.col("ord") % 5 == 0, F.concat(F.lit("{{formula:"), F.substring("text", 1, 3), F.lit("}} "), F.substring("text", 1, 20))).otherwise(F.col("text"))
    return lines(spark, d).where(text.usable_chunk(t)).select("doc_id", "ord")


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'cs' WHEN 1 THEN 'physics' WHEN 2 THEN 'math' ELSE 'other' END AS domain FROM documents""")
def domain_assign(spark, d):
    c = F.get(F.array(*map(F.lit, ["cs.CL", "hep-th", "math.AG", "q-bio.GN"])), (F.col("doc_id") % 4).cast("int"))
    return table(spark, d, "documents").select("doc_id", scores.domain(F.array(F.lit("econ.TH"), c)).alias("domain"))


@query("SELECT o_orderkey, year(o_orderdate)::INT AS year FROM orders")
def paper_year(spark, d):
    return table(spark, d, "orders").select("o_orderkey", scores.year_of(F.array(F.lit("none"), F.date_format("o_orderdate", "'on' d MMM yyyy")), F.lit("")).alias("year"))


@query("""WITH w AS (SELECT conv_id, turn, (length(text) - 100)::DOUBLE AS w FROM conversations WHERE trim(text) <> '')
SELECT conv_id, turn, round(CASE WHEN sum(w) OVER p > 0 THEN w / sum(w) OVER p ELSE 1.0 / count(*) OVER p END, 6) AS weight FROM w WINDOW p AS (PARTITION BY conv_id)""")
def budget_weights(spark, d):
    t = table(spark, d, "conversations").where("trim(text) <> ''")
    return t.select("conv_id", "turn", F.round(scores.budget_weights((F.length("text") - 100).cast("double"), "conv_id"), 6).alias("weight"))


@query()
def sentence_citations(spark, d):
    """Sentences that citation markers stand in; markers are put after every second line's tenth word."""
    marked = F.concat_ws(" ", F.substring_index("text", " ", 10), F.lit("{{cite:ab12}}"), F.regexp_replace("text", r"^(\S+ ){10}", ""))
    nothing = F.create_map().cast("map<string,string>")
    bib = F.create_map(F.lit("ab12"), F.struct(F.lit("10.1/x").alias("doi"), F.lit("").alias("openalex_id"), F.lit("").alias("arxiv_id"), F.lit("A. Smith").alias("raw")))
    sec = lines(spark, d).select(F.col("doc_id").cast("string").alias("paper_id"), F.col("ord").alias("section_ord"), F.col("title").alias("section_title"), F.lit("subsection").alias("chunk_type"), marked.alias("text"), bib.alias("bib"), nothing.alias("captions"))
    return citations.records(chunking.window_rows(sec).withColumn("chunk_uid", text.chunk_uid(F.col("paper_id"), F.col("section_title"), F.col("section_ord"), F.col("text"))))


@query()
def sliding_window_chunks(spark, d):
    """Chunks of papers whose abstract is the first line and whose one section is the whole text."""
    section = F.struct(F.lit(0).alias("ord"), F.lit("Body").alias("title"), F.col("text").alias("text"))
    bib = F.create_map().cast("map<string,struct<doi:string,openalex_id:string,arxiv_id:string,raw:string>>")
    papers = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("paper_id"), F.substring_index("text", "\n", 1).alias("abstract"), F.array(section).alias("sections"), bib.alias("bib"), F.create_map().cast("map<string,string>").alias("captions"))
    return chunking.chunks(papers).select("paper_id", "chunk_index", "total_chunks", "section_title", "chunk_uid", "text")


# -- retrieval

TOK = f"""tok AS (SELECT doc_id, {_tokens('text')} AS w FROM documents),
whole AS (SELECT count(*) AS nd, avg(len(w)) AS avgt FROM tok),
qt AS (SELECT DISTINCT item_id AS query_id, unnest({_tokens('text')}) AS term FROM benchmark),
pt AS (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM tok),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM pt WHERE term IN (SELECT term FROM qt) GROUP BY ALL)"""
_RANK = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)"


def BM25(k: int) -> str:
    return f"""df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bs AS (SELECT query_id, doc_id, round(sum(ln(1 + (nd - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / avgt))), 9) AS score
  FROM tf JOIN df USING (term) JOIN qt USING (term), whole GROUP BY ALL),
bm AS (SELECT * FROM (SELECT *, {_RANK}::INT AS rank FROM bs WHERE score > 0) WHERE rank <= {k})"""


def SPARSE(k: int) -> str:
    return f"""ln_ AS (SELECT doc_id, sqrt(sum((1 + ln(tf)) * (1 + ln(tf)))) AS len FROM tf GROUP BY doc_id),
qw AS (SELECT query_id, term, 1 / sqrt(count(*) OVER (PARTITION BY query_id)) AS qw FROM qt),
ss AS (SELECT query_id, doc_id, round(sum((1 + ln(tf)) * qw) / any_value(len), 9) AS score FROM tf JOIN qw USING (term) JOIN ln_ USING (doc_id) GROUP BY ALL),
sp AS (SELECT * FROM (SELECT *, {_RANK}::INT AS rank FROM ss) WHERE rank <= {k})"""


def corpus(spark, d):
    """(doc_id, text), and the questions (query_id, text)."""
    return table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _shown(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {TOK}, {BM25(10)} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM bm")
def bm25_topk(spark, d):
    return _shown(retrieval.bm25(*corpus(spark, d), 10))


@query(f"WITH {TOK}, {SPARSE(10)} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM sp")
def sparse_dot_topk(spark, d):
    return _shown(retrieval.sparse(*corpus(spark, d), 10))


DENSE = f"""dq AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0),
dsc AS (SELECT query_id, vec_id AS doc_id, round(list_cosine_similarity(q, embedding::DOUBLE[]), 9) AS score FROM dq, embeddings),
dn AS (SELECT * FROM (SELECT *, {_RANK}::INT AS rank FROM dsc) WHERE rank <= 10)"""


def _dense(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    return retrieval.dense(v, v.where("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id"), 10)


@query(f"WITH {DENSE} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM dn")
def dense_topk(spark, d):
    return _shown(_dense(spark, d))


RRF = f"""{TOK}, {BM25(100)}, {SPARSE(100)}, u AS (SELECT query_id, doc_id, rank FROM bm UNION ALL SELECT query_id, doc_id, rank FROM sp),
rs AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM u GROUP BY ALL)"""


@query(f"WITH {RRF} SELECT * FROM (SELECT query_id, doc_id, round(score, 6) AS score, {_RANK}::INT AS rank FROM rs) WHERE rank <= 15")
def rrf_fusion(spark, d):
    docs, asked = corpus(spark, d)
    found = retrieval.postings(docs, asked)
    return _shown(retrieval.reciprocal_rank_fusion([leg(docs, asked, 100, found=found) for leg in (retrieval.bm25, retrieval.sparse)], 15))


_SCALED = "(score - min(score) OVER w) / CASE WHEN max(score) OVER w > min(score) OVER w THEN max(score) OVER w - min(score) OVER w ELSE 1 END"


@query(f"""WITH {TOK}, {BM25(50)}, {SPARSE(50)},
a AS (SELECT query_id, doc_id, {_SCALED} AS x FROM bm WINDOW w AS (PARTITION BY query_id)), b AS (SELECT query_id, doc_id, {_SCALED} AS y FROM sp WINDOW w AS (PARTITION BY query_id)),
m AS (SELECT query_id, doc_id, round(0.5 * coalesce(x, 0) + 0.5 * coalesce(y, 0), 9) AS score FROM a FULL JOIN b USING (query_id, doc_id))
SELECT * FROM (SELECT query_id, doc_id, round(score, 6) AS score, {_RANK}::INT AS rank FROM m) WHERE rank <= 10""")
def alpha_fusion(spark, d):
    docs, asked = corpus(spark, d)
    found = retrieval.postings(docs, asked)
    return _shown(retrieval.alpha_fusion(*[leg(docs, asked, 50, found=found) for leg in (retrieval.bm25, retrieval.sparse)], 10))


def _sectioned(spark, d):
    hits = retrieval.bm25(*corpus(spark, d), 30)
    title = F.get(F.array(*map(F.lit, TITLES)), F.pmod("doc_id", F.lit(len(TITLES))).cast("int"))
    return hits.withColumns({"section": F.trim(title), "targets": F.array(F.lit("Methods"), F.lit("Introduction")), "paper_id": F.col("doc_id") % 10})


_SEC = f"{TOK}, {BM25(30)}, h AS (SELECT *, trim({_list(TITLES)}[doc_id % {len(TITLES)} + 1]) AS section, doc_id % 10 AS paper_id FROM bm)"
_BOOST = "CASE WHEN section IN ('Methods', 'Introduction', 'Related Work') THEN score + 0.1 * max(score) OVER (PARTITION BY query_id) ELSE score END"


@query(f"WITH {_SEC} SELECT query_id, doc_id, section, round({_BOOST}, 6) AS score FROM h")
def section_boost(spark, d):
    return retrieval.section_boost(_sectioned(spark, d)).select("query_id", "doc_id", "section", F.round("score", 6).alias("score"))


@query(f"WITH {_SEC} SELECT query_id, paper_id, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, paper_id ORDER BY score DESC, doc_id) AS p FROM h) WHERE p = 1")
def dedup_max_score(spark, d):
    return retrieval.keep_best(_sectioned(spark, d), ("query_id", "paper_id"), tie="doc_id").select("query_id", "paper_id", "doc_id", F.round("score", 6).alias("score"))


@query(f"""WITH {_SEC}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, paper_id ORDER BY score DESC, doc_id) AS p FROM h) WHERE p <= 3)
SELECT * FROM (SELECT query_id, paper_id, doc_id, round(score, 6) AS score, {_RANK}::INT AS rank FROM f) WHERE rank <= 15""")
def diversity_cap(spark, d):
    return retrieval.diversity_cap(_sectioned(spark, d).drop("rank"), 15).select("query_id", "paper_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {_SEC} SELECT * FROM (SELECT query_id, doc_id, round(score, 6) AS score, {_RANK}::INT AS rank FROM h WHERE score >= 5) WHERE rank <= 10")
def score_threshold_topk(spark, d):
    return _shown(retrieval.rerank(_sectioned(spark, d), F.col("score"), 10, 5.0))


@query(f"""WITH {_SEC} SELECT doc_id, round(max(score), 6) AS score, list_sort(list(DISTINCT query_id)) AS sub_queries FROM h GROUP BY doc_id""")
def hit_provenance(spark, d):
    return retrieval.provenance(_sectioned(spark, d).withColumn("sq_idx", F.col("query_id")), ("doc_id",)).select("doc_id", F.round("score", 6).alias("score"), "sub_queries")


@query("""WITH c AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, (vec_id + 1) % 50 AS cited FROM embeddings WHERE vec_id % 100 = 0), k AS (SELECT vec_id AS u, embedding::DOUBLE[] AS w, vec_id % 50 AS paper FROM embeddings)
SELECT * FROM (SELECT id AS citation_id, u AS chunk_uid, round(list_cosine_similarity(v, w), 6) AS score, row_number() OVER (PARTITION BY id ORDER BY round(list_cosine_similarity(v, w), 9) DESC, u)::INT AS rank FROM c JOIN k ON cited = paper) WHERE rank <= 2""")
def hop_join(spark, d):
    """The stated queries, ids divisible by 100, against all rows."""
    e = table(spark, d, "embeddings")
    cited = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("citation_id"), ((F.col("vec_id") + 1) % 50).cast("string").alias("arxiv"), F.lit("").alias("doi"), F.col("embedding").alias("vector"))
    chunk = e.select(F.col("vec_id").alias("chunk_uid"), (F.col("vec_id") % 50).cast("string").alias("paper_arxiv"), F.lit(None).cast("string").alias("paper_doi"), F.col("embedding").alias("vector"))
    return retrieval.hop(cited, chunk, 2).select("citation_id", "chunk_uid", F.round("score", 6).alias("score"), "rank")


GOLD = "gold AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents x ON contains(x.text, b.text) WHERE trim(b.text) <> '')"


def _metric_sql(k: int) -> str:
    n, dcg = f"count(*) FILTER (WHERE rank <= {k} AND g.doc_id IS NOT NULL)", f"coalesce(sum(1 / log2(rank + 1)) FILTER (WHERE rank <= {k} AND g.doc_id IS NOT NULL), 0)"
    ideal = f"list_sum(list_transform(range(1, least(any_value(n_gold), {k}) + 1), lambda i: 1 / log2(i + 1)))"
    return f"(CASE WHEN {n} > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS hit_{k}, round({n} / any_value(n_gold), 6) AS recall_{k}, round({n} / {k}, 6) AS precision_{k}, round(CASE WHEN min(rank) FILTER (WHERE g.doc_id IS NOT NULL) <= {k} THEN 1 / min(rank) FILTER (WHERE g.doc_id IS NOT NULL) ELSE 0.0 END, 6) AS mrr_{k}, round({dcg} / {ideal}, 6) AS ndcg_{k}"


@query(f"""WITH {TOK}, {BM25(10)}, {GOLD}, n AS (SELECT query_id, count(*) AS n_gold FROM gold GROUP BY query_id)
SELECT n.query_id, min(rank) FILTER (WHERE g.doc_id IS NOT NULL) AS gold_rank, {", ".join(map(_metric_sql, (1, 5, 10)))}
FROM n LEFT JOIN bm USING (query_id) LEFT JOIN gold g ON g.query_id = n.query_id AND g.doc_id = bm.doc_id GROUP BY n.query_id""")
def ir_metrics_at_k(spark, d):
    docs, questions = corpus(spark, d)
    found = evaluation.retrieval_metrics(retrieval.bm25(docs, questions, 10), evaluation.holders(docs, questions), questions)
    return found.select("query_id", "gold_rank", *[F.round(c, 6).alias(c) for c in found.columns[2:]])


@query()
def answer_engine(spark, d):
    """Cited answers to every benchmark item over all documents."""
    return Engine(_engine_chunks(spark, d), Config(top_k=10)).answer(_questions(spark, d))


def _engine_chunks(spark, d):
    title = F.get(F.array(*map(F.lit, TITLES)), F.pmod("doc_id", F.lit(len(TITLES))).cast("int"))
    return table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("paper_id"), title.alias("section"), "text")


def _questions(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text", F.array(F.lit("Methods")).alias("targets"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid retrieval of every benchmark item: two legs fused, re-ranked, boosted and capped a paper."""
    return Engine(_engine_chunks(spark, sf_dir)).retrieve(_questions(spark, sf_dir)).select("query_id", "doc_id", "paper_id", "section", F.round("score", 6).alias("score"), "rank")


QUERIES["hybrid_retrieval"] = flagship
_SET = f"list_distinct(list_filter(regexp_extract_all(lower(coalesce({{}}, '')), '[a-z0-9]+'), lambda w: NOT list_contains({_list(text.ANSWER_STOP_WORDS)}, w)))"
ORACLES["hybrid_retrieval"] = f"""WITH {RRF}, h AS (SELECT query_id, doc_id FROM (SELECT *, {_RANK} AS rank FROM rs) WHERE rank <= 30),
dw AS (SELECT doc_id, {_SET.format('text')} AS a FROM documents WHERE doc_id IN (SELECT doc_id FROM h)), qw2 AS (SELECT item_id AS query_id, {_SET.format('text')} AS b FROM benchmark),
j AS (SELECT query_id, doc_id, {_list(TITLES)}[doc_id % {len(TITLES)} + 1] AS section, len(a) AS na, len(b) AS nb, len(list_intersect(a, b)) AS n FROM h JOIN dw USING (doc_id) JOIN qw2 USING (query_id)),
k AS (SELECT query_id, doc_id, section, CASE WHEN na > 0 AND nb > 0 THEN n / (na + nb - n) ELSE 0.0 END::DOUBLE AS score FROM j),
b AS (SELECT query_id, doc_id, section, CASE WHEN section = 'Methods' THEN score + 0.1::DOUBLE * max(score) OVER (PARTITION BY query_id) ELSE score END AS score FROM k)
SELECT * FROM (SELECT query_id, doc_id, doc_id::VARCHAR AS paper_id, section, round(score, 6) AS score, {_RANK}::INT AS rank FROM b) WHERE rank <= 15"""


# -- sections


def _chunks(spark, d):
    return lines(spark, d).select(F.col("doc_id").cast("string").alias("paper_id"), F.col("title").alias("section_title"), F.col("ord").alias("chunk_index"), F.concat_ws(":", "doc_id", "ord").alias("chunk_uid"), "text")


FOLD = f"""{LINES}, fo AS (SELECT doc_id::VARCHAR AS paper_id, {NORM.format('title')} AS title_norm, min(ord) AS chunk_index_min, arg_min(title, ord) AS title, arg_min(text, ord) AS text, count(*) AS n_chunks FROM l GROUP BY ALL),
la AS (SELECT *, {LABEL.replace(NORM.format('title'), 'title_norm')} AS label FROM fo), lb AS (SELECT *, CASE WHEN label = 'SKIP' THEN 'skip' WHEN label IS NOT NULL THEN 'heuristic' ELSE 'unresolved' END AS source FROM la)"""
PAPERS = f"""{FOLD}, kn AS (SELECT paper_id, chunk_index_min, label, lag(label) OVER w AS before, CASE label WHEN 'Introduction' THEN 0 WHEN 'Methods' THEN 1 WHEN 'Results' THEN 2 ELSE 3 END AS r FROM lb WHERE label IN ('Introduction', 'Methods', 'Results', 'Discussion') WINDOW w AS (PARTITION BY paper_id ORDER BY chunk_index_min, title_norm)),
co AS (SELECT *, lag(r) OVER (PARTITION BY paper_id ORDER BY chunk_index_min) AS last FROM kn WHERE before IS NULL OR before <> label),
pp AS (SELECT paper_id, list(label ORDER BY chunk_index_min) AS labels, bool_and(last IS NULL OR r > last) AS ordered, count(DISTINCT CASE WHEN r < 3 THEN r END) = 3 AS core FROM co GROUP BY paper_id)"""


@query(f"WITH {FOLD} SELECT paper_id, title_norm, chunk_index_min, title, text, n_chunks FROM fo")
def section_fold(spark, d):
    return sections.fold(_chunks(spark, d))


def _labelled(spark, d):
    return sections.label(sections.fold(_chunks(spark, d)))


@query(f"WITH {FOLD} SELECT paper_id, title_norm, label, source FROM lb")
def section_labels(spark, d):
    return _labelled(spark, d).select("paper_id", "title_norm", "label", "source")


@query(f"WITH {PAPERS} SELECT paper_id, array_to_string(labels, '>') AS labels FROM pp")
def consecutive_label_collapse(spark, d):
    return sections.papers(_labelled(spark, d)).select("paper_id", F.array_join("labels", ">").alias("labels"))


@query(f"WITH {PAPERS} SELECT paper_id, ordered, core FROM pp")
def imrad_sequence_check(spark, d):
    return sections.papers(_labelled(spark, d)).select("paper_id", "ordered", "core")


@query(f"""WITH {PAPERS} SELECT 'label' AS kind, coalesce(label, '<missing>') AS bucket, count(*) AS n FROM lb GROUP BY ALL UNION ALL SELECT 'source', source, count(*) FROM lb GROUP BY ALL
UNION ALL SELECT 'papers', 'any', count(*) FROM pp UNION ALL SELECT 'papers', 'core', count(*) FILTER (WHERE core) FROM pp UNION ALL SELECT 'papers', 'core_in_order', count(*) FILTER (WHERE core AND ordered) FROM pp""")
def imrad_statistics(spark, d):
    return sections.statistics(_labelled(spark, d))


@query(f"""WITH {FOLD}, od AS (SELECT * FROM lb WHERE label IS NULL OR label NOT IN ('Introduction', 'Methods', 'Results', 'Discussion'))
SELECT title_norm, count(*) AS n, any_value(source) AS reason, CASE WHEN any_value(source) = 'skip' THEN '' ELSE array_to_string(list_sort(list(DISTINCT paper_id))[:50], ',') END AS papers FROM od GROUP BY title_norm""")
def non_imrad_report(spark, d):
    return sections.unlabelled_titles(_labelled(spark, d)).select("title_norm", "n", "reason", F.array_join("papers", ",").alias("papers"))


@query()
def imrad_repair(spark, d):
    """Labels after the order of sections is repaired; unknown titles get a stand-in classifier's probabilities."""
    folded = sections.fold(_chunks(spark, d))
    share = lambda i: F.pmod(F.xxhash64("paper_id", "title_norm", F.lit(i)), F.lit(1000)) / 1000.0
    probs = F.array(*[share(i) for i in range(len(sections.CLASSES))])
    guess = folded.select("paper_id", "title_norm", probs.alias("probs")).withColumn("class_confidence", F.array_max("probs"))
    guess = guess.withColumn("class", F.get(F.array(*map(F.lit, sections.CLASSES)), F.array_position("probs", F.col("class_confidence")).cast("int") - 1))
    return sections.repair(sections.label(folded, guess))


# -- graphs, judgement and answers

INTENT = "CASE l_returnflag WHEN 'R' THEN 'RESULT_COMPARISON' WHEN 'A' THEN 'METHOD' ELSE 'BACKGROUND' END"


def _graph_docs(spark, d):
    """Orders as chunks of their customers' papers; a line item cites a part."""
    intent = F.when(F.col("l_returnflag") == "R", "RESULT_COMPARISON").when(F.col("l_returnflag") == "A", "METHOD")
    cites = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", F.concat(F.lit("p"), F.col("l_partkey")).alias("paper_id"), intent.alias("intent")))), lambda x: F.struct(x["paper_id"].alias("paper_id"), x["intent"].alias("intent"))).alias("cites"))
    orders = table(spark, d, "orders").join(cites, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return orders.select((F.col("o_custkey") % 25).alias("query_id"), F.concat(F.lit("o"), F.col("o_orderkey")).alias("chunk_uid"), F.concat(F.lit("c"), F.col("o_custkey")).alias("paper_id"), F.col("o_totalprice").alias("score"), "cites")


@query("""SELECT DISTINCT o_custkey % 25 AS query_id, 'o' || o_orderkey AS node_id, 'chunk' AS node_type FROM orders UNION SELECT o_custkey % 25, 'c' || o_custkey, 'paper' FROM orders
UNION SELECT o_custkey % 25, 'p' || l_partkey, 'paper' FROM orders JOIN lineitem ON l_orderkey = o_orderkey""")
def graph_nodes(spark, d):
    return graph.base_nodes(_graph_docs(spark, d))


EDGES = f"""ge AS (SELECT DISTINCT o_custkey % 25 AS query_id, 'o' || o_orderkey AS src, 'c' || o_custkey AS dst, 'CHUNK_OF' AS relation FROM orders
UNION ALL SELECT o_custkey % 25, 'o' || o_orderkey, 'p' || l_partkey, arg_min({INTENT}, l_linenumber * 10 + CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 2 ELSE 0 END) FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)"""


@query(f"WITH {EDGES} SELECT * FROM ge")
def graph_edges(spark, d):
    return graph.base_edges(_graph_docs(spark, d))


@query(f"""WITH {EDGES}, dd AS (SELECT o_custkey % 25 AS query_id, count(*) AS n_documents, count(DISTINCT o_custkey) AS n_papers, round(max(o_totalprice), 4) AS score_max, round(avg(o_totalprice), 2) AS score_mean FROM orders GROUP BY ALL),
nn AS (SELECT query_id, count(*) AS n_nodes FROM (SELECT DISTINCT query_id, src AS n FROM ge UNION SELECT query_id, dst FROM ge) GROUP BY query_id)
SELECT dd.*, n_nodes, 0::BIGINT AS n_claims, n_edges FROM dd JOIN nn USING (query_id) JOIN (SELECT query_id, count(*) AS n_edges FROM ge GROUP BY query_id) USING (query_id)""")
def scorecard(spark, d):
    docs = _graph_docs(spark, d)
    return graph.scorecard(docs, graph.base_nodes(docs), graph.base_edges(docs)).withColumn("score_mean", F.round("score_mean", 2))


def _items(spark, d):
    label = F.when(F.col("l_returnflag") == "R", "RESULT_COMPARISON").when(F.col("l_returnflag") == "A", "METHOD").otherwise("odd")
    return table(spark, d, "lineitem").select(
        (F.col("l_suppkey") % 7).alias("query_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.concat(F.lit("o"), F.col("l_orderkey") % 500).alias("chunk_uid"),
        F.when(F.col("l_linenumber") == 5, "aside").otherwise("claim").alias("type"), F.concat(F.lit("Part "), F.col("l_partkey"), F.lit(" sells.")).alias("text"), F.col("l_linestatus").alias("subtype"), label.alias("label"),
    )


CLAIMS = f"""it AS (SELECT l_suppkey % 7 AS query_id, l_orderkey * 10 + l_linenumber AS pos, 'o' || (l_orderkey % 500) AS chunk_uid, 'Part ' || l_partkey || ' sells.' AS text, l_linestatus AS subtype, {INTENT} AS label FROM lineitem WHERE l_linenumber <> 5),
ci AS (SELECT *, 'claim:' || substr(sha1('claim:' || text), 1, 12) AS claim_id FROM it)"""


@query(f"WITH {CLAIMS} SELECT query_id, claim_id, arg_min(text, pos) AS text, arg_min(subtype, pos) AS subtype, arg_min(chunk_uid, pos) AS chunk_uid, 'atomic_factual' AS claim_type FROM ci GROUP BY query_id, claim_id")
def claim_nodes(spark, d):
    return graph.claims(_items(spark, d))[0]


@query(f"WITH {CLAIMS} SELECT query_id, claim_id AS src, chunk_uid AS dst, arg_max(label, pos) AS relation FROM ci GROUP BY query_id, claim_id, chunk_uid")
def claim_edges(spark, d):
    return graph.claims(_items(spark, d))[1]


@query("""WITH e AS (SELECT o_custkey % 25 AS query_id, 'c' || o_custkey AS claim_id, bool_or(l_linestatus = 'O' AND l_returnflag = 'N' AND l_quantity > 49) AS odd FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT query_id, claim_id, CASE WHEN odd THEN 'multi' ELSE 'single' END AS hop_depth FROM e""")
def hop_depth(spark, d):
    both = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    edges = both.select((F.col("o_custkey") % 25).alias("query_id"), F.concat(F.lit("c"), F.col("o_custkey")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey")).alias("dst"), F.when(F.expr("l_linestatus = 'O' AND l_returnflag = 'N' AND l_quantity > 49"), "extends").otherwise("METHOD").alias("relation"))
    return graph.hop_depth(edges.select("query_id", F.col("src").alias("claim_id")).distinct(), edges)


@query("""WITH RECURSIVE e AS (SELECT 'claim:' || o_custkey AS src, 'o' || o_orderkey AS dst, 'BACKGROUND' AS relation FROM orders UNION ALL SELECT 'o' || a.o_orderkey, 'o' || b.o_orderkey, 'hop_evidence' FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1),
w AS (SELECT src AS claim_id, dst AS node_id, relation, 1 AS depth FROM e WHERE starts_with(src, 'claim:') UNION SELECT w.claim_id, e.dst, e.relation, depth + 1 FROM w JOIN e ON e.src = w.node_id WHERE depth < 5),
m AS (SELECT claim_id, node_id, min(depth)::INT AS depth, arg_min(relation, depth) AS relation FROM w GROUP BY ALL)
SELECT 0 AS query_id, * FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY depth, node_id)::INT AS place FROM m) WHERE place <= 5""")
def evidence_trail(spark, d):
    o = table(spark, d, "orders")
    chunk = F.concat(F.lit("o"), F.col("o_orderkey"))
    claim = o.select(F.lit(0).alias("query_id"), F.concat(F.lit("claim:"), F.col("o_custkey")).alias("src"), chunk.alias("dst"), F.lit("BACKGROUND").alias("relation"))
    after = o.select((F.col("o_orderkey") + 1).alias("o_orderkey")).join(o, "o_orderkey")
    hop = after.select(F.lit(0).alias("query_id"), F.concat(F.lit("o"), F.col("o_orderkey") - 1).alias("src"), chunk.alias("dst"), F.lit("hop_evidence").alias("relation"))
    kinds = o.select(F.lit(0).alias("query_id"), chunk.alias("node_id"), F.lit("chunk").alias("node_type"))
    return graph.evidence_trail(claim.select("query_id", F.col("src").alias("claim_id")).distinct(), claim.unionByName(hop), kinds)


@query("""WITH RECURSIVE e AS (SELECT n_nationkey AS s, (n_nationkey * n_nationkey + 1) % 25 AS t FROM nation), r AS (SELECT s, t FROM e UNION SELECT r.s, e.t FROM r JOIN e ON e.s = r.t) SELECT 0 AS query_id, 'n' || s AS node_id FROM r WHERE s = t""")
def cycle_nodes(spark, d):
    n = F.col("n_nationkey")
    edges = table(spark, d, "nation").select(F.lit(0).alias("query_id"), F.concat(F.lit("n"), n).alias("src"), F.concat(F.lit("n"), (n * n + 1) % 25).alias("dst"), F.lit("supports").alias("relation"))
    return graph.cyclic_nodes(edges)


VERDICT = """v AS (SELECT l_orderkey AS claim_id, 0.6 * max(l_discount * 8) + 0.4 * avg(l_discount * 8) AS entail, 0.6 * max(l_tax * 12) + 0.4 * avg(l_tax * 12) AS contradict, count(*) AS n_evidence FROM lineitem GROUP BY 1),
vv AS (SELECT *, CASE WHEN entail > 0.65 THEN 'Supported' WHEN contradict > 0.7 THEN 'Contradicted' ELSE 'Neutral' END AS verdict FROM v)"""


def _verdicts(spark, d):
    return graph.verdicts(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("claim_id"), (F.col("l_discount") * 8).alias("entails"), (F.col("l_tax") * 12).alias("contradicts")))


@query(f"WITH {VERDICT} SELECT claim_id, round(entail, 5) AS entail, round(contradict, 5) AS contradict, n_evidence FROM vv")
def nli_blend_verdict(spark, d):
    return _verdicts(spark, d).select("claim_id", F.round("entail", 5).alias("entail"), F.round("contradict", 5).alias("contradict"), "n_evidence")


@query("""SELECT o_orderkey AS claim_id, CASE WHEN o_orderpriority = '1-URGENT' OR o_orderkey % 5 = 0 THEN 'llm' WHEN o_orderstatus = 'F' THEN 'nli' ELSE 'nli_then_llm' END AS route FROM orders""")
def judge_routing(spark, d):
    judged = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("claim_id"), F.when(F.col("o_orderkey") % 5 == 0, "multi").otherwise("single").alias("hop_depth"),
        (F.col("o_orderpriority") == "1-URGENT").alias("has_conflict"), F.when(F.col("o_orderstatus") == "F", "Supported").otherwise("Neutral").alias("verdict"),
    )
    return graph.route(judged).select("claim_id", "route")


def _scored(spark, d):
    o = table(spark, d, "orders")
    return o.select((F.col("o_custkey") % 100).cast("long").alias("query_id"), F.concat(F.lit("claim:"), F.col("o_orderkey")).alias("claim_id"), F.array((F.col("o_orderkey") % 3).cast("int"), (F.col("o_orderkey") % 5).cast("int")).alias("sub_queries"), F.lit(5).alias("n_sub_queries"), F.concat(F.lit("said "), F.col("o_orderkey") % 4000).alias("text"), F.col("o_totalprice").alias("claim_score"))


@query()
def claim_selection(spark, d):
    return answers.select_claims(_scored(spark, d))


@query()
def citation_numbering(spark, d):
    chosen = answers.select_claims(_scored(spark, d))
    selected = chosen.select("query_id", "ordinal", F.col("claim_id").alias("chunk_uid"), F.substring("claim_id", 1, 8).alias("paper_id"))
    sentences = chosen.select("query_id", F.col("ordinal").alias("sentence_pos"), F.array(F.col("ordinal"), F.col("ordinal") - 1, F.lit(99)).alias("claim_refs"))
    return answers.sentence_citations(sentences, selected)


@query("""SELECT event_id AS id, 0 AS pos, '{"k": ' || (props->>'k') || '}' AS item FROM events""")
def parse_json_items(spark, d):
    return answers.parse_items(table(spark, d, "events").select("event_id", F.concat(F.lit("Sure:\n```json\n["), F.col("props"), F.lit(", 3]\n```")).alias("t")), "event_id", "t")


# -- tables, measures and profiles


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def pending_antijoin(spark, d):
    done = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return tables.remaining(table(spark, d, "orders").select("o_orderkey"), done, ["o_orderkey"])


@query("SELECT CASE WHEN k % 6 = 3 THEN k + 1000000 ELSE k END AS c_custkey, c_name, CASE WHEN k % 3 = 0 THEN -1.0 ELSE b END::DOUBLE AS c_acctbal FROM (SELECT c_custkey AS k, c_name, c_acctbal AS b FROM customer) UNION ALL SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 6 = 3")
def upsert_merge(spark, d):
    old = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    key = F.when(F.col("c_custkey") % 6 == 3, F.col("c_custkey") + 1_000_000).otherwise(F.col("c_custkey"))
    return tables.upsert(old, old.where("c_custkey % 3 = 0").select(key.alias("c_custkey"), "c_name", F.lit(-1.0).alias("c_acctbal")), ["c_custkey"])


@query("SELECT count(DISTINCT label) AS shard_count, count(*) FILTER (WHERE vec_id % 7 <> 0) AS dense_rows, count(*) FILTER (WHERE vec_id % 5 <> 0) AS sparse_rows FROM embeddings")
def shard_summary(spark, d):
    empty = lambda c, kind: F.array().cast(kind)
    e = table(spark, d, "embeddings")
    shards = e.select(F.col("label").alias("shard"), F.when(F.col("vec_id") % 7 != 0, F.col("embedding")).otherwise(empty(0, "array<float>")).alias("dense"), F.when(F.col("vec_id") % 5 != 0, F.array(F.lit(1))).otherwise(empty(0, "array<int>")).alias("indices"), F.array(F.lit(1.0)).alias("values"))
    return tables.shard_summary(shards)


@query("SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 1000 AS batch FROM events")
def row_batches(spark, d):
    return tables.batches(table(spark, d, "events").select("event_id"), 1000, "event_id").select("event_id", F.col("batch").cast("long").alias("batch"))


@query("SELECT user_id, min(value) FILTER (WHERE event_type = t1) AS a, min(value) FILTER (WHERE event_type = t2) AS b FROM events, (SELECT 'click' AS t1, 'view' AS t2) GROUP BY user_id")
def attribute_pivot(spark, d):
    return tables.pivot_attributes(table(spark, d, "events"), "user_id", "event_type", "value", ["click", "view"]).select("user_id", F.col("click").alias("a"), F.col("view").alias("b"))


@query("SELECT quality, toxic, count(*) AS n, round(avg(doc_id % 100), 4) AS metric FROM labels GROUP BY GROUPING SETS ((quality, toxic), ())")
def metric_pivot_grouping_sets(spark, d):
    return evaluation.means(table(spark, d, "labels").withColumn("metric", F.col("doc_id") % 100), ["quality", "toxic"], ["metric"])


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def latency_percentiles(spark, d):
    return evaluation.latency(table(spark, d, "events"), "event_type", "value").select("event_type", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@query("""WITH s AS (SELECT l_quantity AS v, row_number() OVER (ORDER BY l_quantity) - 1 AS i, count(*) OVER () AS n FROM lineitem) SELECT p, v AS value FROM s, (VALUES (5), (50), (95), (100)) t(p) WHERE i = least(n * p // 100, n - 1)""")
def reservoir_percentiles(spark, d):
    return evaluation.percentile_by_index(table(spark, d, "lineitem"), "l_quantity", [5, 50, 95, 100])


@query("""WITH c AS (SELECT o_custkey, count(*) AS v FROM orders GROUP BY 1), s AS (SELECT v, row_number() OVER (ORDER BY v DESC) AS i, count(*) OVER () AS n, sum(v) OVER () AS t FROM c)
SELECT p, round(sum(v) / any_value(t), 6) AS share FROM s, (VALUES (1), (10), (50)) x(p) WHERE i <= greatest(1, n * p // 100) GROUP BY p""")
def citation_concentration(spark, d):
    c = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("v"))
    return evaluation.concentration(c, "v", [1, 10, 50]).select("p", F.round("share", 6).alias("share"))


@query("SELECT source AS value, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, value LIMIT 5")
def top_sources(spark, d):
    return evaluation.top_values(table(spark, d, "documents"), F.col("source"), 5)


@query(r"""SELECT count(*) AS n_documents, count(*) FILTER (WHERE length(trim(text)) > 0) AS with_text, count(lang) AS with_lang, count(source) AS with_source, count(DISTINCT source) AS n_sources,
count(*) FILTER (WHERE regexp_matches(text, '[0-9]')) AS with_digit, count(*) FILTER (WHERE contains(text, '@')) AS with_at, count(*) FILTER (WHERE regexp_matches(text, '(?i)licen[sc]e')) AS with_license,
sum(length(text))::BIGINT AS n_chars, sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')))::BIGINT AS n_words, max(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')))::INT AS longest FROM documents""")
def corpus_profile(spark, d):
    return evaluation.corpus_profile(table(spark, d, "documents"))


def _predicted(spark, d):
    return table(spark, d, "labels").where("quality IS NOT NULL AND toxic IS NOT NULL").select(F.col("quality").alias("label"), (1 - F.col("toxic")).alias("predicted"), (F.col("doc_id") % 100 / 100.0).alias("score"))


PRED = "pr AS (SELECT quality AS label, 1 - toxic AS predicted, doc_id % 100 / 100.0 AS score FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL)"


@query(f"""WITH {PRED}, c AS (SELECT label, count(*) AS support, count(*) FILTER (WHERE label = predicted) AS r, (SELECT count(*) FROM pr q WHERE q.predicted = pr.label) AS said FROM pr GROUP BY label)
SELECT label, support, round(coalesce(r / nullif(said, 0), 0), 6) AS "precision", round(r / support, 6) AS recall, round(CASE WHEN r > 0 THEN 2.0 * r / (support + said) ELSE 0 END, 6) AS f1 FROM c""")
def f1_report(spark, d):
    found = evaluation.class_report(_predicted(spark, d), "label", "predicted")
    return found.select("label", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(f"WITH {PRED} SELECT label, predicted, count(*) AS n FROM pr GROUP BY ALL")
def confusion_counts(spark, d):
    return evaluation.confusion(_predicted(spark, d), "label", "predicted")


@query(f"WITH {PRED}, n AS (SELECT label, count(*) AS n FROM pr GROUP BY label) SELECT label, n, round((1 / n) * count(*) OVER () / sum(1 / n) OVER (), 6) AS weight FROM n")
def class_weights(spark, d):
    return evaluation.class_weights(_predicted(spark, d), "label").select("label", "n", F.round("weight", 6).alias("weight"))


@query(f'WITH {PRED} SELECT threshold, count(*) FILTER (WHERE score >= threshold) AS resolved, count(*) FILTER (WHERE score >= threshold AND label = predicted) AS "right", count(*) FILTER (WHERE score < threshold) AS left_over FROM pr, (VALUES (0.25::DOUBLE), (0.5), (0.75)) t(threshold) GROUP BY threshold')
def threshold_sweep(spark, d):
    return evaluation.threshold_sweep(_predicted(spark, d), [0.25, 0.5, 0.75])


# -- samples


def _sample_chunks(spark, d):
    c = lines(spark, d).where("text != ''")
    return c.select(F.col("doc_id").alias("paper_id"), (F.col("doc_id") % 3).alias("domain"), F.col("ord").alias("chunk_index"), F.concat_ws(":", "doc_id", "ord").alias("chunk_uid"), F.trim("title").alias("section"), "text")


@query(f"""WITH {LINES}, s AS (SELECT doc_id AS paper_id, ord, count(*) OVER w AS n_chunks, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS i FROM l WHERE text <> '' WINDOW w AS (PARTITION BY doc_id))
SELECT paper_id, ord AS chunk_index, n_chunks, CASE WHEN i <= greatest(1, n_chunks // 3) THEN 0 WHEN i > n_chunks - greatest(1, n_chunks // 3) THEN 2 ELSE 1 END AS tercile FROM s""")
def tercile_assign(spark, d):
    return sampling.terciles(_sample_chunks(spark, d)).select("paper_id", "chunk_index", "n_chunks", "tercile")


@query()
def tercile_sample(spark, d):
    return sampling.single_paper(_sample_chunks(spark, d), 20).select("domain", "paper_id", "chunk_ids", "place")


@query()
def pair_sample(spark, d):
    return sampling.cross_section(_sample_chunks(spark, d), 20, 5)


@query()
def stratified_sample(spark, d):
    return sampling.stratified(table(spark, d, "documents").select("doc_id", "source"), "source", 10, "doc_id")


@query(f"""WITH {DENSE}, f AS (SELECT query_id, doc_id, score FROM dn WHERE score BETWEEN 0.2 AND 0.95 AND query_id % 2 = doc_id % 2 AND doc_id <> query_id)
SELECT query_id, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS p FROM f) WHERE p <= 2""")
def knn_neighbor_sample(spark, d):
    near = _dense(spark, d).withColumns({"seed_paper": F.col("query_id"), "seed_domain": F.col("query_id") % 2, "paper_id": F.col("doc_id"), "domain": F.col("doc_id") % 2})
    return sampling.thematic(near, 0.2, 0.95).select("query_id", "doc_id", F.round("score", 6).alias("score"))


# -- streams


def _fresh(spark) -> str:
    return f"{tables.shared_folder(spark)}/stream_{uuid.uuid4().hex}"


@query("SELECT event_id, user_id, event_type FROM events")
def stream_ingest(spark, d):
    """Events read as a stream, each key appended once."""
    at, schema = _fresh(spark), table(spark, d, "events").schema
    ingest.ingest(ingest.file_stream(spark, f"{d}/events.parquet", schema), f"{at}/table", f"{at}/log", ["event_id"], ["ts"]).awaitTermination()
    return spark.read.parquet(f"{at}/table").select("event_id", "user_id", "event_type")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windowed_counts(spark, d):
    at, schema = _fresh(spark), table(spark, d, "events").schema
    counts = ingest.windowed_counts(ingest.file_stream(spark, f"{d}/events.parquet", schema), "ts", "event_type")
    ingest.keep_updates(counts, f"{at}/table", f"{at}/log").awaitTermination()
    return ingest.latest_updates(spark, f"{at}/table", ["start", "event_type"], "n").withColumn("start", F.col("start").cast("timestamp_ntz"))
