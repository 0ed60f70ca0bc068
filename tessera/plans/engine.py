"""The engine: batches of questions through retrieval, graph, judgement and answer."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import jaccard, sentences, token_set
from tessera.operators import answers, graph, retrieval
from tessera.operators.models import Stage
from tessera.operators.tables import checkpoint


def lexical_relevance(query: Column, text: Column) -> Column:
    """A stand-in for a cross-encoder: Jaccard of word sets."""
    return jaccard(token_set(query), token_set(text))


def lexical_entailment(claim: Column, evidence: Column) -> Column:
    """A stand-in for an entailment model: the share of the claim's words that the evidence has; it contradicts nothing."""
    words = token_set(claim)
    share = F.when(F.size(words) > 0, F.size(F.array_intersect(words, token_set(evidence))) / F.size(words)).otherwise(0.0)
    return F.struct(share.alias("entails"), F.lit(0.0).alias("contradicts"), (1 - share).alias("neutral"))


def cautious(claim: Column, evidence: Column) -> Column:
    """A stand-in for a language model that judges: it leaves open what it is asked."""
    return F.lit("Inconclusive")


def taken(model: Callable[..., Column] | Stage, df: DataFrame, inputs: list[str], output: str) -> DataFrame:
    """``df`` with a model's column: an expression of the inputs, or a stage that tasks run in batches."""
    return model.over(df, inputs, output) if isinstance(model, Stage) else df.withColumn(output, model(*map(F.col, inputs)))


@dataclass(frozen=True)
class Config:
    """What a run may vary; ablations are changes of this."""

    top_k: int = 15
    prefetch: int = 100
    pool: int = 30
    per_paper: int = 3
    score_threshold: float = 0.0
    legs: tuple[str, ...] = ("bm25", "sparse")
    rerank: bool = True
    least_rerank: float = 0.0
    gamma: float = 0.10
    #: Models: an expression, or a Stage. Of query and text a double; of claim and evidence struct(entails,
    #: contradicts, neutral) of doubles; of claim and evidence texts a verdict.
    relevance: Callable[[Column, Column], Column] | Stage = field(default=lexical_relevance)
    entailment: Callable[[Column, Column], Column] | Stage = field(default=lexical_entailment)
    judge: Callable[[Column, Column], Column] | Stage = field(default=cautious)
    #: Who judges: "full" as ``graph.route``, "nli", "llm", or "none" which lets every claim stand.
    judging: str = "full"

    def __post_init__(self) -> None:
        if self.judging not in ("full", "nli", "llm", "none"):
            raise ValueError(f"no such way of judging: {self.judging}")
        if not 1 <= self.top_k <= 100 or not 0 <= self.score_threshold <= 20:
            raise ValueError("top_k is 1 to 100 and score_threshold 0 to 20")


class Engine:
    """Stages as DataFrames keyed by query_id, so that any number of questions is one job.

    chunks: (doc_id, paper_id, section, text). Models are expressions or Pandas UDFs; the
    ones built in are lexical stand-ins that reproduce the flow and not a network's quality.
    """

    def __init__(self, chunks: DataFrame, config: Config = Config()):
        self.chunks, self.config = chunks, config

    def retrieve(self, queries: DataFrame) -> DataFrame:
        """(query_id, doc_id, paper_id, section, text, score, rank). queries: (query_id, text, targets array<string>)."""
        c = self.config
        legs = {"bm25": retrieval.bm25, "sparse": retrieval.sparse}
        docs = self.chunks.select("doc_id", "text")
        shared = retrieval.postings(docs, queries)
        found = [legs[name](docs, queries, c.prefetch, found=shared) for name in c.legs]
        hits = retrieval.reciprocal_rank_fusion(found, c.pool if c.rerank else c.top_k) if len(found) > 1 else retrieval.top_k(found[0].drop("rank"), c.pool)
        full = hits.join(self.chunks, "doc_id").join(queries.select("query_id", F.col("text").alias("query"), "targets"), "query_id")
        if c.rerank:
            full = retrieval.rerank(taken(c.relevance, full, ["query", "text"], "_relevance"), F.col("_relevance"), c.pool, c.least_rerank).drop("_relevance")
        boosted = retrieval.section_boost(full, c.gamma).where(F.col("score") >= c.score_threshold)
        best = retrieval.keep_best(boosted, ("query_id", "paper_id", "doc_id"), tie="doc_id")
        return retrieval.diversity_cap(best, c.top_k, c.per_paper).select("query_id", "doc_id", "paper_id", "section", "text", "score", "rank")

    def claims(self, hits: DataFrame) -> DataFrame:
        """Sentences of each hit as claims, all of them about the query."""
        each = hits.select("query_id", "doc_id", "rank", F.posexplode(sentences(F.col("text"))).alias("i", "text"))
        return each.select("query_id", (F.col("rank") * (1 << 32) + F.col("i")).alias("pos"), F.col("doc_id").cast("string").alias("chunk_uid"), F.lit("claim").alias("type"), "text", F.lit("finding").alias("subtype"), F.lit("BACKGROUND").alias("label"))

    def judged(self, nodes: DataFrame, edges: DataFrame, texts: DataFrame) -> DataFrame:
        """(query_id, claim_id, entail, contradict, route, verdict, low_confidence) of every claim.

        nodes: (query_id, claim_id, text); edges: (query_id, src, dst, relation); texts: (query_id,
        chunk_uid, text) of chunks. Entailment is taken once a claim and chunk that its evidence leads to. By route,
        its verdict stands or the judge is asked; of what entailment left open and the judge too, confidence is low.
        """
        c, key = self.config, ["query_id", "claim_id"]
        claims = nodes.select(*key, "text")
        if c.judging == "none":
            return claims.select(*key, F.lit(None).cast("double").alias("entail"), F.lit(None).cast("double").alias("contradict"), F.lit("none").alias("route"), F.lit("Supported").alias("verdict"), F.lit(False).alias("low_confidence"))
        step = edges.where(F.col("relation").isin(*graph.EVIDENCE)).select("query_id", F.col("src").alias("claim_id"), F.col("dst").alias("chunk_uid")).distinct()
        met = claims.join(step, key).join(texts.select("query_id", "chunk_uid", F.col("text").alias("evidence")), ["query_id", "chunk_uid"])
        scored = checkpoint(taken(c.entailment, met, ["text", "evidence"], "said"))
        blend = graph.verdicts(claims.join(scored.select(*key, "said.*"), key, "left"), key)
        conflict = edges.where("relation = 'contradicts'").select("query_id", F.col("src").alias("claim_id")).distinct().withColumn("has_conflict", F.lit(True))
        known = blend.join(graph.hop_depth(nodes, edges), key).join(conflict, key, "left")
        routed = checkpoint(graph.route(known) if c.judging == "full" else known.withColumn("route", F.lit(c.judging)))
        open_ = routed.where(F.col("route") != "nli").select(*key).join(claims, key)
        proof = scored.groupBy(*key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_uid", "evidence"))), lambda x: x["evidence"]), "\n\n").alias("evidence"))
        asked = taken(c.judge, open_.join(proof, key, "left").withColumn("evidence", F.coalesce("evidence", F.lit(""))), ["text", "evidence"], "_said").select(*key, "_said")
        final = F.when(F.col("route") == "nli", F.col("verdict")).otherwise(F.coalesce("_said", F.lit("Inconclusive")))
        return routed.join(asked, key, "left").select(*key, "entail", "contradict", "route", final.alias("verdict"), ((F.col("route") != "nli") & (final == "Inconclusive")).alias("low_confidence"))

    def answer(self, queries: DataFrame) -> DataFrame:
        """(query_id, answer) of cited sentences."""
        hits = checkpoint(self.retrieve(queries))  # read six times below
        nodes, edges = (checkpoint(x) for x in graph.claims(self.claims(hits)))
        documents = hits.select("query_id", F.col("doc_id").cast("string").alias("chunk_uid"), "paper_id", "score", F.array(F.lit(0)).alias("sub_queries"))
        said = self.judged(nodes, edges, hits.select("query_id", F.col("doc_id").cast("string").alias("chunk_uid"), "text"))
        kept = answers.collect_claims(nodes, documents, edges, said).join(queries.select("query_id", F.array("text").alias("sub_texts"), F.lit(1).alias("n_sub_queries")), "query_id")
        chosen = answers.select_claims(answers.claim_scores(kept)).join(kept.select("query_id", "claim_id", "text", "chunk_uid", "paper_id"), ["query_id", "claim_id"])
        sentences_ = chosen.select("query_id", F.col("ordinal").alias("sentence_pos"), "text", F.array("ordinal").alias("claim_refs"))
        return answers.assemble(sentences_, answers.sentence_citations(sentences_, chosen))
