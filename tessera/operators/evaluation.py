"""Measures of retrieval, answers and classifiers, and profiles of a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ranks import running
from tessera.operators.retrieval import bounded
from tessera.operators.tables import checkpoint


def retrieval_metrics(ranked: DataFrame, gold: DataFrame, queries: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Per query: rank of the first gold document, and hit, recall, precision, reciprocal rank and NDCG at each k.

    ranked: (query_id, doc_id, rank); gold: (query_id, doc_id); queries: (query_id). A query
    without gold documents is left out.
    """
    g = gold.select("query_id", "doc_id").distinct()
    n_gold = g.groupBy("query_id").agg(F.count("*").alias("n_gold"))
    met = ranked.join(g, ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg(
        F.min("rank").alias("first"),
        *[F.count_if(F.col("rank") <= k).alias(f"n{k}") for k in ks],
        *[F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias(f"dcg{k}") for k in ks],
    )
    base = queries.select("query_id").distinct().join(n_gold, "query_id").join(met, "query_id", "left")
    out = ["query_id", F.col("first").alias("gold_rank")]
    for k in ks:
        n = F.coalesce(F.col(f"n{k}"), F.lit(0))
        ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_gold"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
        out += [
            F.when(n > 0, 1.0).otherwise(0.0).alias(f"hit_{k}"),
            (n / F.col("n_gold")).alias(f"recall_{k}"),
            (n / F.lit(k)).alias(f"precision_{k}"),
            F.when(F.col("first") <= k, 1 / F.col("first")).otherwise(0.0).alias(f"mrr_{k}"),
            (F.coalesce(F.col(f"dcg{k}"), F.lit(0.0)) / ideal).alias(f"ndcg_{k}"),
        ]
    return base.select(*out)


def holders(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(query_id, doc_id) where a document holds an item's whole text: gold for the item as a question.

    documents: (doc_id, text); items: (query_id, text). A holder has each word that stands
    whole within the item, so the two meet in the item's rarest one and are then compared.
    An item of one or two words has none such; it is looked for in every text. Blank items
    are held by none.
    """
    named = items.where(F.trim("text") != "").select("query_id", F.col("text").alias("item"))
    inner = F.regexp_extract_all(F.regexp_replace("item", r"^\S*|\S*$", ""), F.lit(r"(\S+)"), F.lit(1))
    words = named.select("query_id", F.explode(F.array_distinct(inner)).alias("word"))
    split = documents.select("doc_id", F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("word"))
    met = checkpoint(split.join(bounded(words.select("word").distinct()), "word", "left_semi"))
    often = met.groupBy("word").agg(F.count("*").alias("often"))
    rarest = words.join(often, "word", "left").groupBy("query_id").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("n"), "word")).alias("x"))
    pairs = rarest.select("query_id", F.col("x.word").alias("word")).join(met, "word").select("query_id", "doc_id")
    held = pairs.join(named, "query_id").join(documents.select("doc_id", "text"), "doc_id").where(F.col("text").contains(F.col("item"))).select("query_id", "doc_id")
    short = named.join(words.select("query_id").distinct(), "query_id", "left_anti")
    if short.isEmpty():
        return held.distinct()
    # A stated set of short items against all rows.
    every = documents.join(bounded(short), F.col("text").contains(F.col("item")))
    return held.unionByName(every.select("query_id", "doc_id")).distinct()


def graded_ndcg(ranked: DataFrame, k: int) -> DataFrame:
    """Chunk NDCG with grade 1 for the chunk and 0.5 for its paper, over an ideal of 1 and at most 1. ranked: (query_id, rank, is_chunk, is_paper)."""
    grade = F.when(F.col("is_chunk"), 1.0).when(F.col("is_paper"), 0.5).otherwise(0.0)
    return ranked.where(F.col("rank") <= k).groupBy("query_id").agg(F.least(F.lit(1.0), F.sum(grade / F.log2(F.col("rank") + 1))).alias("ndcg"))


def section_hit(ranked: DataFrame, k: int) -> DataFrame:
    """Whether a section of the first k contains the gold one or is contained in it; null without a gold one."""
    a, b = F.lower("section"), F.lower("gold_section")
    meets = a.contains(b) | b.contains(a)
    return ranked.where(F.col("rank") <= k).groupBy("query_id").agg(F.max(F.when(F.col("gold_section").isNotNull(), F.coalesce(meets, F.lit(False)))).alias("section_hit"))


def means(df: DataFrame, by: list[str], metrics: list[str], digits: int = 4) -> DataFrame:
    """Means of metrics for each group and, under nulls, over all: one pass of grouping sets. A metric without values is 0."""
    columns = [F.round(F.coalesce(F.avg(m), F.lit(0.0)), digits).alias(m) for m in metrics]
    return df.groupingSets([[F.col(c) for c in by], []], *by).agg(F.count("*").alias("n"), *columns)


def latency(df: DataFrame, key: str, value: str) -> DataFrame:
    """Median and 95th percentile, linear between ranks."""
    return df.groupBy(key).agg(F.percentile(value, F.lit(0.5)).alias("p50"), F.percentile(value, F.lit(0.95)).alias("p95"))


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def class_report(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Support, precision, recall and F1 of each class."""
    c = confusion(df, label, predicted)
    truth = c.groupBy("label").agg(F.sum("n").alias("support"), F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)).alias("right"))
    said = c.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("said"))
    p, r = F.col("right") / F.nullif(F.col("said"), F.lit(0)), F.col("right") / F.col("support")
    joined = truth.join(said, "label", "left").withColumns({"precision": F.coalesce(p, F.lit(0.0)), "recall": r})
    total = F.col("precision") + F.col("recall")
    return joined.select("label", "support", "precision", "recall", F.when(total > 0, 2 * F.col("precision") * F.col("recall") / F.when(total > 0, total)).otherwise(0.0).alias("f1"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """N / (classes * n) of each class, scaled to a mean of 1."""
    n = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    raw = n.agg(F.sum("n").alias("total"), F.count("*").alias("k"), F.sum(1 / F.col("n")).alias("inverse"))
    return n.join(F.broadcast(raw)).select("label", "n", ((1 / F.col("n")) * F.col("k") / F.col("inverse")).alias("weight"))  # one row


def threshold_sweep(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """For each threshold: how many are settled, how many of those rightly, and how many are left to a costlier judge.

    scored: (score, label, predicted). Thresholds are an array in each row, so nothing is joined.
    """
    each = scored.select("score", (F.col("label") == F.col("predicted")).alias("right"), F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    done = F.col("score") >= F.col("threshold")
    return each.groupBy("threshold").agg(F.count_if(done).alias("resolved"), F.count_if(done & F.col("right")).alias("right"), F.count_if(~done).alias("left_over"))


def top_values(df: DataFrame, column: Column, n: int) -> DataFrame:
    """The commonest values; ties by value."""
    return df.groupBy(column.alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(n)


def percentile_by_index(df: DataFrame, column: str, percents: list[int]) -> DataFrame:
    """sorted[int(n * p / 100)] for each percent, from counts of values in ranges: no task sees all of them."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    run = running(counts, ["value"], {"before": F.col("n")})
    total = run.agg(F.sum("n").alias("total"))
    asked = run.join(F.broadcast(total)).select("value", "n", "before", "total", F.explode(F.array(*map(F.lit, percents))).alias("p"))  # one row
    index = F.least(F.floor(F.col("total") * F.col("p") / 100), F.col("total") - 1)
    return asked.where((F.col("before") + F.col("n") > index) & (F.col("before") <= index)).select("p", "value")


def concentration(df: DataFrame, value: str, shares: list[int]) -> DataFrame:
    """Percent of the total held by the greatest p percent of rows, from counts of values in ranges."""
    counts = df.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    run = running(counts, [F.desc("v")], {"before": F.col("n")})
    total = run.agg(F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("v")).alias("total"))
    asked = run.join(F.broadcast(total)).select("*", F.explode(F.array(*map(F.lit, shares))).alias("p"))  # one row
    top = F.greatest(F.lit(1), F.floor(F.col("rows") * F.col("p") / 100))
    inside = F.greatest(F.lit(0), F.least(F.col("n"), top - F.col("before")))
    return asked.groupBy("p").agg((F.sum(inside * F.col("v")) / F.first("total")).alias("share"))


def corpus_profile(documents: DataFrame) -> DataFrame:
    """Counts of what documents have, in one pass. documents: (doc_id, text, lang, source)."""
    has = lambda pattern: F.count_if(F.col("text").rlike(pattern))
    words = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), ""))
    return documents.agg(
        F.count("*").alias("n_documents"),
        F.count_if(F.length(F.trim("text")) > 0).alias("with_text"),
        F.count("lang").alias("with_lang"),
        F.count("source").alias("with_source"),
        F.count_distinct("source").alias("n_sources"),
        has(r"[0-9]").alias("with_digit"),
        has(r"@").alias("with_at"),
        has(r"(?i)licen[sc]e").alias("with_license"),
        F.sum(F.length("text")).alias("n_chars"),
        F.sum(words).alias("n_words"),
        F.max(words).alias("longest"),
    )


def averaged(report: DataFrame) -> DataFrame:
    """Macro (plain) and weighted (by support) means of a class report, and micro F1, which is the accuracy."""
    weighted = lambda c: F.sum(F.col(c) * F.col("support")) / F.sum("support")
    return report.agg(
        *[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")],
        *[weighted(c).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")],
        weighted("recall").alias("micro_f1"),
    )


def paper_hit(ranked: DataFrame, k: int) -> DataFrame:
    """Whether one of the first k hits is of the gold paper. ranked: (query_id, rank, paper_id, gold_paper)."""
    return ranked.groupBy("query_id").agg(F.coalesce(F.bool_or((F.col("rank") <= k) & (F.col("paper_id") == F.col("gold_paper"))), F.lit(False)).alias("paper_hit"))


def answer_contained(ranked: DataFrame, k: int) -> DataFrame:
    """Whether the first k texts, joined in order, hold one of the answers in any case. ranked: (query_id, rank, text, answers array)."""
    top = ranked.where(F.col("rank") <= k).groupBy("query_id", "answers").agg(F.sort_array(F.collect_list(F.struct("rank", "text"))).alias("t"))
    joined = F.lower(F.array_join(F.transform("t", lambda x: x["text"]), " "))
    return top.select("query_id", F.exists("answers", lambda a: joined.contains(F.lower(a))).alias("answer_contained"))


def means_by(df: DataFrame, system: str, by: list[str], metrics: list[str], rank: str) -> DataFrame:
    """Means of metrics by system, and by system with each of ``by``, in one pass; the rank's mean is over what was found."""
    sets = [[F.col(system)], *[[F.col(system), F.col(b)] for b in by]]
    return df.groupingSets(sets, system, *by).agg(F.count("*").alias("n"), *[F.avg(m).alias(m) for m in metrics], F.avg(rank).alias(f"avg_{rank}"))


def sub_query_summary(hits: DataFrame, targets: Column) -> DataFrame:
    """By query and sub-query: hits, the share of them in its target sections, and the range of their scores."""
    return hits.groupBy("query_id", "sq_idx").agg(F.count("*").alias("n"), F.avg(F.array_contains(targets, F.col("section")).cast("double")).alias("section_rate"), F.max("score").alias("best"), F.min("score").alias("worst"))


def id_coverage(chunks: DataFrame) -> DataFrame:
    """Chunks, papers, and the papers and citation spans that have ids, in one pass.

    chunks: (paper_id, arxiv_id, doi, n_spans, n_spans_with_id).
    """
    paper = lambda c: F.count_distinct(F.when(F.col(c).isNotNull(), F.col("paper_id")))
    return chunks.agg(
        F.count("*").alias("n_chunks"), F.count_distinct("paper_id").alias("n_papers"), paper("arxiv_id").alias("papers_with_arxiv"), paper("doi").alias("papers_with_doi"),
        (F.count("*") / F.count_distinct("paper_id")).alias("chunks_per_paper"), F.sum("n_spans").alias("n_spans"), (F.sum("n_spans_with_id") / F.sum("n_spans")).alias("span_coverage"),
    )


def key_presence(papers: DataFrame, column: str) -> DataFrame:
    """How many papers' maps have each key with a value that isn't blank."""
    each = papers.select(F.explode(column).alias("key", "value")).where(F.trim("value") != "")
    return each.groupBy("key").agg(F.count("*").alias("n"))
