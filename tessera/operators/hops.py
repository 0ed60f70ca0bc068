"""Hop expansion: claims that want to look further lead to chunks of the papers that they cite."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scores
from tessera.functions.text import ids_in_text
from tessera.operators.citations import sequence_ratio
from tessera.operators.graph import first
from tessera.operators.tables import checkpoint

# Reasons to look further, and what can come of it.
REASONS = ["missing_scope_context", "missing_comparison_baseline", "missing_method_origin", "missing_definition_context"]
OUTCOMES = ["no_hop_reason", "no_linked_citations", "citation_raw_mismatch", "no_resolved_id", "retrieval_zero", "success", "over_budget"]
ITEM = ["query_id", "claim_id", "pos"]


@dataclass(frozen=True)
class Expansion:
    """What a graph gains, and why each candidate did or did not lead anywhere."""

    #: (query_id, node_id, node_type) and (query_id, src, dst, relation, score) that were not there before.
    nodes: DataFrame
    edges: DataFrame
    #: (query_id, claim_id, pos, outcome), a row a candidate.
    outcomes: DataFrame

    def counts(self) -> DataFrame:
        """(query_id, outcome, n)."""
        return self.outcomes.groupBy("query_id", "outcome").agg(F.count("*").alias("n"))


def filled(c: Column | str) -> Column:
    return F.trim(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))


def candidates(items: DataFrame, budget: int = 50) -> tuple[DataFrame, DataFrame]:
    """Items with a reason to look further: those within the budget in document order, with what is wrong with them, if anything, and (*ITEM) of the others.

    Rank limits are applied within tasks, so that only the first ones of each task are shuffled.
    """
    reason = filled("hop_reason")
    asked = items.where(~reason.isin("", "none"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("pos", "claim_id"))
    bare = (filled("look_for") == "") | (F.coalesce(F.size("linked"), F.lit(0)) <= 0)
    wrong = F.when(~reason.isin(*REASONS), "no_hop_reason").when(bare, "no_linked_citations")
    within = checkpoint(asked.withColumn("_place", place).where(F.col("_place") <= budget).drop("_place").withColumn("wrong", wrong))
    keys = within.select(*[F.col(c).alias(f"_{c}") for c in ITEM])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ITEM]
    return within, asked.select(*ITEM).join(keys, same, "left_anti")


def resolved(wanted: DataFrame, spans: DataFrame, cutoff: float = 0.85, by_openalex: bool = False) -> DataFrame:
    """Each item's best-aligned citation that has an id: (query_id, claim_id, pos, arxiv_id, doi, openalex_id, alignment), and ``met``, whether any equals a span's text.

    A citation is its chunk's first span of equal text, else the most similar one of at
    least ``cutoff``. A span without ids takes those that its text names. Without ``by_openalex``
    an OpenAlex id alone is none, as where chunks don't carry one.
    """
    link = ["link", *ITEM]
    linked = wanted.select(*ITEM, "chunk_uid", F.posexplode("linked").alias("link", "x")).select(*link, "chunk_uid", F.trim("x.raw").alias("raw"), F.coalesce("x.alignment", F.lit(0.0)).alias("alignment"))
    linked = linked.where("raw != ''")
    known = spans.withColumn("raw", F.trim("raw")).where("raw != ''")
    known = first(known, ["chunk_uid", "raw"], ["cite_index"]).select("chunk_uid", F.col("raw").alias("span"), filled("arxiv_id").alias("arxiv_id"), filled("doi").alias("doi"), filled("openalex_id").alias("openalex_id"))
    equal = linked.join(known, (linked["chunk_uid"] == known["chunk_uid"]) & (linked["raw"] == known["span"])).drop(known["chunk_uid"]).withColumn("equal", F.lit(True))
    rest = linked.join(equal.select(*link), link, "left_anti").join(known, "chunk_uid").withColumn("ratio", sequence_ratio("span", "raw")).where(F.col("ratio") >= cutoff)
    close = first(rest, link, [F.desc("ratio"), F.desc("span")]).withColumn("equal", F.lit(False))
    columns = [*link, "raw", "alignment", "arxiv_id", "doi", "openalex_id", "equal"]
    found = equal.select(*columns).unionByName(close.select(*columns))
    named = ids_in_text(F.col("raw"))
    bare = (F.col("arxiv_id") == "") & (F.col("doi") == "")
    found = found.withColumn("ids", F.when(bare, named))
    found = found.withColumns({"arxiv_id": F.when(bare, F.coalesce("ids.arxiv", F.lit(""))).otherwise(F.col("arxiv_id")), "doi": F.when(bare, F.coalesce("ids.doi", F.lit(""))).otherwise(F.col("doi"))})
    has = (F.col("arxiv_id") != "") | (F.col("doi") != "")
    has = has | (F.col("openalex_id") != "") if by_openalex else has
    best = F.min(F.when(has, F.struct((-F.col("alignment")).alias("down"), "link", "arxiv_id", "doi", "openalex_id"))).alias("best")
    each = found.groupBy(*ITEM).agg(best, F.bool_or("equal").alias("met"))
    return each.select(*ITEM, "met", F.col("best.arxiv_id").alias("arxiv_id"), F.col("best.doi").alias("doi"), F.col("best.openalex_id").alias("openalex_id"), (-F.col("best.down")).alias("alignment"))


def of_paper(wanted: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks of the papers asked for by any of three ids, once each: one equality join an id."""
    out = None
    for mine, theirs in (("arxiv_id", "paper_arxiv"), ("doi", "paper_doi"), ("openalex_id", "paper_openalex")):
        met = wanted.where(F.col(mine) != "").join(chunks.where(F.col(theirs) != ""), F.col(mine) == F.col(theirs))
        out = met if out is None else out.unionByName(met)
    return out.dropDuplicates([*ITEM, "found_uid"])


def cosine_of(item: str = "look_vector", chunk: str = "vector") -> Column:
    return scores.cosine(F.col(item), F.col(chunk))


def expand(items: DataFrame, spans: DataFrame, chunks: DataFrame, nodes: DataFrame, edges: DataFrame, budget: int = 50, per_claim: int = 2, score: Callable[[], Column] = cosine_of, by_openalex: bool = False) -> Expansion:
    """Chunks of cited papers put into the graph as evidence of the claims that cite them.

    items: (query_id, claim_id, pos, chunk_uid, hop_reason, look_for, linked array<struct<raw, alignment>>, ...) in
    document order by ``pos``, one row a (query_id, claim_id, pos); the first ``budget`` candidates of a query are tried. spans: (chunk_uid,
    cite_index, raw, arxiv_id, doi, openalex_id). chunks: (chunk_uid, paper_arxiv, paper_doi,
    paper_openalex, ...). nodes, edges: the graph so far, (query_id, node_id) and
    (query_id, src, dst). score: of an item and a chunk, from their further columns.

    Each candidate has one outcome. A node or an edge between two nodes comes once, whatever
    leads to it, and those already there stay as they are; of a claim's hits the alignment is
    the edge's score.
    """
    every, over = candidates(items, budget)
    tried = every.where("wrong IS NULL").drop("wrong")
    ids = resolved(tried, spans, by_openalex=by_openalex)
    tried = checkpoint(tried.join(ids, ITEM, "left"))
    has = F.coalesce(F.col("alignment").isNotNull(), F.lit(False))
    target = chunks.withColumnRenamed("chunk_uid", "found_uid")
    scored = of_paper(tried.where(has), target).withColumn("_score", F.round(score(), 9))
    w = Window.partitionBy(*ITEM).orderBy(F.desc("_score"), "found_uid")
    paper = F.coalesce(*[F.nullif(c, F.lit("")) for c in ("doi", "arxiv_id", "openalex_id")])
    hits = checkpoint(scored.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= per_claim).select(*ITEM, "found_uid", paper.alias("paper_id"), "alignment"))
    came = hits.select(*ITEM).distinct().withColumn("came", F.lit(True))
    said = tried.join(came, ITEM, "left").select(*ITEM, F.when(~has & F.coalesce("met", F.lit(False)), "no_resolved_id").when(~has, "citation_raw_mismatch").when(F.col("came").isNull(), "retrieval_zero").otherwise("success").alias("outcome"))
    outcomes = every.where("wrong IS NOT NULL").select(*ITEM, F.col("wrong").alias("outcome")).unionByName(said).unionByName(over.select(*ITEM, F.lit("over_budget").alias("outcome")))
    # The first claim that leads to a chunk says whose it is.
    chunk = first(hits, ["query_id", "found_uid"], ["pos", "claim_id", "paper_id"]).select("query_id", F.col("found_uid").alias("node_id"), "paper_id")
    chunk = checkpoint(chunk.join(nodes.select("query_id", "node_id").distinct(), ["query_id", "node_id"], "left_anti"))
    papers = hits.select("query_id", F.col("paper_id").alias("node_id")).distinct().join(nodes.select("query_id", "node_id").distinct(), ["query_id", "node_id"], "left_anti")
    new_nodes = chunk.select("query_id", "node_id", F.lit("chunk").alias("node_type")).unionByName(papers.select("query_id", "node_id", F.lit("paper").alias("node_type")))
    of = chunk.select("query_id", F.col("node_id").alias("src"), F.col("paper_id").alias("dst"), F.lit("CHUNK_OF").alias("relation"), F.lit(1.0).alias("score"))
    proof = first(hits, ["query_id", "claim_id", "found_uid"], ["pos"]).select("query_id", F.col("claim_id").alias("src"), F.col("found_uid").alias("dst"), F.lit("hop_evidence").alias("relation"), F.col("alignment").alias("score"))
    new_edges = of.unionByName(proof).join(edges.select("query_id", "src", "dst").distinct(), ["query_id", "src", "dst"], "left_anti")
    return Expansion(new_nodes, new_edges.select("query_id", "src", "dst", "relation", "score"), outcomes)
