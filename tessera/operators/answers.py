"""Claims to cited answers: joining, scoring, choosing and numbering."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.replies import items as items_of
from tessera.functions.scores import budget_weights
from tessera.functions.text import jaccard, token_set

MOST_CLAIMS, LEAST_PER_SUB_QUERY = 12, 2


def collect_claims(claims: DataFrame, documents: DataFrame, edges: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Claims that stand, with their document's score, the first label of citation, and whether they are contradicted."""
    kept = claims.join(verdicts.select("query_id", "claim_id", "verdict", "low_confidence"), ["query_id", "claim_id"], "left").where(F.col("verdict").isin("Supported", "Inconclusive"))
    docs = documents.select("query_id", "chunk_uid", "paper_id", F.col("score").alias("doc_score"), "sub_queries")
    label = edges.where(~F.col("relation").startswith("judged_") & (F.col("relation") != "contradicts")).groupBy("query_id", F.col("src").alias("claim_id")).agg(F.min_by("relation", F.struct("dst", "relation")).alias("label"))
    conflict = edges.where("relation = 'contradicts'").select("query_id", F.col("src").alias("claim_id")).distinct().withColumn("conflict", F.lit(True))
    joined = kept.join(docs, ["query_id", "chunk_uid"], "left").join(label, ["query_id", "claim_id"], "left").join(conflict, ["query_id", "claim_id"], "left")
    return joined.withColumns({"doc_score": F.coalesce("doc_score", F.lit(0.0)), "conflict": F.coalesce("conflict", F.lit(False))})


def claim_scores(claims: DataFrame) -> DataFrame:
    """doc_score + 0.3 of the best Jaccard with a sub-query's text - 0.5 if of low confidence. claims: (..., text, sub_texts)."""
    best = F.coalesce(F.array_max(F.transform("sub_texts", lambda t: jaccard(token_set(F.col("text")), token_set(t)))), F.lit(0.0))
    return claims.withColumn("claim_score", F.col("doc_score") + 0.3 * best - F.when(F.col("low_confidence"), 0.5).otherwise(0.0))


def select_claims(scored: DataFrame, most: int = MOST_CLAIMS, least: int = LEAST_PER_SUB_QUERY) -> DataFrame:
    """(query_id, claim_id, claim_score, ordinal): claims that fill their sub-queries up to a floor, then the best of the rest.

    scored: (query_id, claim_id, text, sub_queries array<int>, n_sub_queries, claim_score). In
    order of score, a claim goes to the first of its sub-queries that is not yet full; one
    without any counts for sub-query 0. The floor is the greater of ``least`` and an even
    share of ``most``, and may lead beyond ``most``. Of claims of one text the first counts.
    Ordinals follow the order of choice. A query's claims are few, so they are one array.
    """
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("claim_score")).alias("down"), "claim_id", "text", "sub_queries")))
    many = F.greatest(F.max("n_sub_queries"), F.lit(1))
    widest = F.greatest(many, 1 + F.coalesce(F.max(F.array_max("sub_queries")), F.lit(0)))
    per = scored.groupBy("query_id").agg(ranked.alias("ranked"), F.greatest(F.lit(least), F.floor(F.lit(most) / many)).cast("int").alias("floor"), widest.cast("int").alias("widest"))
    strings = F.array().cast("array<string>")
    start = F.struct(F.array_repeat(F.lit(0), F.col("widest")).alias("full"), strings.alias("taken"), strings.alias("texts"))

    def fill(s: Column, x: Column) -> Column:
        own = F.when(F.size(x["sub_queries"]) > 0, x["sub_queries"]).otherwise(F.array(F.lit(0)))
        to = F.get(F.filter(own, lambda q: F.get(s["full"], q) < F.col("floor")), F.lit(0))
        goes = to.isNotNull() & ~F.array_contains(s["texts"], x["text"])
        return F.when(goes, F.struct(
            F.transform(s["full"], lambda n, i: n + (i == to).cast("int")).alias("full"),
            F.array_append(s["taken"], x["claim_id"]).alias("taken"), F.array_append(s["texts"], x["text"]).alias("texts"),
        )).otherwise(s)

    def rest(s: Column, x: Column) -> Column:
        goes = (F.size(s["taken"]) < most) & ~F.array_contains(s["texts"], x["text"])
        return F.when(goes, F.struct(s["full"].alias("full"), F.array_append(s["taken"], x["claim_id"]).alias("taken"), F.array_append(s["texts"], x["text"]).alias("texts"))).otherwise(s)

    filled = per.withColumn("state", F.aggregate("ranked", start, fill)).withColumn("state", F.aggregate("ranked", F.col("state"), rest))
    chosen = filled.select("query_id", "ranked", F.posexplode("state.taken").alias("at", "claim_id"))
    score = F.get(F.filter("ranked", lambda x: x["claim_id"] == F.col("claim_id")), F.lit(0))["down"]
    return chosen.select("query_id", "claim_id", (-score).alias("claim_score"), (F.col("at") + 1).cast("int").alias("ordinal"))


def sentence_citations(sentences: DataFrame, selected: DataFrame) -> DataFrame:
    """Citations of sentences by claim ordinals, numbered by first appearance in the answer.

    sentences: (query_id, sentence_pos, claim_refs array<int>); selected: (query_id, ordinal,
    chunk_uid, paper_id). References out of range fall away; repeats in a sentence count once.
    """
    refs = sentences.select("query_id", "sentence_pos", F.posexplode("claim_refs").alias("ref_pos", "ordinal"))
    met = refs.join(selected, ["query_id", "ordinal"])
    once = met.groupBy("query_id", "sentence_pos", "paper_id", "chunk_uid").agg(F.min("ref_pos").alias("ref_pos"))
    seen = once.groupBy("query_id", "paper_id", "chunk_uid").agg(F.min(F.struct("sentence_pos", "ref_pos")).alias("seen"))
    number = F.row_number().over(Window.partitionBy("query_id").orderBy("seen", "paper_id", "chunk_uid"))
    return once.join(seen.withColumn("number", number).drop("seen"), ["query_id", "paper_id", "chunk_uid"])


def assemble(sentences: DataFrame, cited: DataFrame) -> DataFrame:
    """(query_id, answer): sentences in order, their end mark after the citation numbers."""
    marks = cited.groupBy("query_id", "sentence_pos").agg(F.array_join(F.transform(F.array_sort(F.collect_set("number")), lambda n: F.concat(F.lit("["), n.cast("string"), F.lit("]"))), "").alias("marks"))
    each = sentences.join(marks, ["query_id", "sentence_pos"], "left")
    bare = F.regexp_replace(F.trim("text"), r"[.!?]+$", "")
    written = each.select("query_id", "sentence_pos", F.concat(bare, F.coalesce(F.concat(F.lit(" "), F.col("marks")), F.lit("")), F.lit(".")).alias("s"))
    return written.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sentence_pos", "s"))), lambda x: x["s"]), " ").alias("answer"))


def parse_items(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pos, item) objects of the JSON list or object inside a model's answer; fences and prose around it are ignored.

    What is left open is closed and what is astray dropped, so a broken answer gives what it
    holds; a value deeper than ``replies.DEEPEST`` is null. Items that are not objects fall away; an answer
    without any gives no row.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(i, k, json.dumps(x, sort_keys=True)) for i, t in zip(pdf["id"], pdf["t"], strict=True) for k, x in enumerate(items_of(t))]
            yield pd.DataFrame(rows, columns=["id", "pos", "item"])

    return texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInPandas(run, "id long, pos int, item string")


def answerable(claims: DataFrame, said: DataFrame) -> DataFrame:
    """Claims whose verdict lets them into an answer: the judge's, or the node's own where the judge said none.

    claims: (query_id, claim_id, ..., verdict); said: (query_id, claim_id, verdict).
    """
    judge = said.select("query_id", "claim_id", F.nullif("verdict", F.lit("")).alias("_said"))
    joined = claims.join(judge, ["query_id", "claim_id"], "left").withColumn("verdict", F.coalesce("_said", "verdict"))
    return joined.where(F.col("verdict").isin("Supported", "Inconclusive")).select(*claims.columns)


def whole_question(queries: DataFrame) -> DataFrame:
    """A query that was not taken apart, as its own sub-query of full weight. queries: (query_id, text)."""
    return queries.select("query_id", F.lit(0).alias("sq_idx"), "text", F.array(F.lit("Introduction"), F.lit("Introduction")).alias("sections"), F.lit(1.0).alias("weight"))


def weighed(sub_queries: DataFrame) -> DataFrame:
    """Sub-queries that have a text, with weights that add up to 1 a query; null and negative ones count as 0. sub_queries: (query_id, text, weight, ...)."""
    return sub_queries.where(F.trim(F.coalesce("text", F.lit(""))) != "").withColumn("weight", budget_weights(F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0)), "query_id"))
