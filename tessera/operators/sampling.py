"""Samples of contexts for questions: seeded by hash, so the same on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scores
from tessera.operators.ranks import placed

# Section labels no question is drawn from.
EXCLUDED = ["", "abstract", "references", "bibliography", "acknowledgements", "acknowledgments", "appendix", "supplementary", "related work", "table of contents"]


def draw(*keys: str, seed: int = 42) -> Column:
    """An order like a shuffle's."""
    return F.xxhash64(*keys, F.lit(seed))


def first_per(df: DataFrame, keys: list[str], n: int, order: list) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def terciles(chunks: DataFrame) -> DataFrame:
    """Chunks with their third of the paper: as many in the first as in the last, the rest between."""
    w = Window.partitionBy("paper_id")
    n, i = F.count("*").over(w), F.row_number().over(w.orderBy("chunk_index", "chunk_uid"))
    third = F.greatest(F.lit(1), F.floor(n / 3))
    return chunks.withColumns({"n_chunks": n, "tercile": F.when(i <= third, 0).when(i > n - third, 2).otherwise(1)})


def single_paper(chunks: DataFrame, quota: int, seed: int = 42) -> DataFrame:
    """A chunk of each third of papers with three chunks or more, ``quota`` papers a domain.

    chunks: (paper_id, domain, chunk_index, chunk_uid, text), usable ones only.
    """
    thirds = terciles(chunks).where("n_chunks >= 3")
    one = first_per(thirds, ["domain", "paper_id", "tercile"], 1, [draw("chunk_uid", seed=seed), "chunk_uid"])
    groups = one.groupBy("domain", "paper_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("tercile", "chunk_uid"))), lambda x: x["chunk_uid"]).alias("chunk_ids")).where("size(chunk_ids) = 3")
    return first_per(groups, ["domain"], quota, [draw("paper_id", seed=seed), "paper_id"])


def cross_section(chunks: DataFrame, quota: int, per_pair: int, seed: int = 42) -> DataFrame:
    """Two chunks of one paper whose sections make a pair; at most ``per_pair`` of a pair and ``quota`` a domain.

    chunks: (paper_id, domain, section, chunk_uid); one chunk of each section stands for it.
    """
    one = first_per(chunks.where(~F.lower("section").isin(EXCLUDED)), ["domain", "paper_id", "section"], 1, [draw("chunk_uid", seed=seed), "chunk_uid"])
    a, b = one.select("domain", "paper_id", F.col("section").alias("a"), F.col("chunk_uid").alias("ua")), one.select("domain", "paper_id", F.col("section").alias("b"), F.col("chunk_uid").alias("ub"))
    pairs = a.join(b, ["domain", "paper_id"]).where((F.col("a") < F.col("b")) & scores.valid_pair(F.col("a"), F.col("b")))
    few = first_per(pairs, ["domain", "a", "b"], per_pair, [draw("paper_id", seed=seed), "paper_id"]).drop("place")
    return first_per(few, ["domain"], quota, [draw("paper_id", "a", "b", seed=seed), "paper_id", "a", "b"])


def citing_pairs(chunks: DataFrame, low: float = 0.40, high: float = 0.80) -> DataFrame:
    """A citing chunk and the most similar chunk of the cited paper inside the window of cosines.

    chunks: (chunk_uid, paper_id, vector, cites array<string>).
    """
    a = chunks.select(F.col("chunk_uid").alias("ua"), F.col("paper_id").alias("pa"), F.col("vector").alias("va"), F.explode(F.array_distinct("cites")).alias("pb"))
    b = chunks.select(F.col("paper_id").alias("pb"), F.col("chunk_uid").alias("ub"), F.col("vector").alias("vb"))
    met = a.join(b, "pb").where("pa != pb").withColumn("cosine", scores.cosine(F.col("va"), F.col("vb"))).where(F.col("cosine").between(low, high))
    return first_per(met, ["ua"], 1, [F.desc("cosine"), "ub"]).select("ua", "pa", "ub", "pb", "cosine")


def thematic(neighbours: DataFrame, low: float = 0.50, high: float = 0.80, n: int = 2) -> DataFrame:
    """The first ``n`` neighbours of a seed from other papers of its domain inside the window, one a paper.

    neighbours: (query_id, doc_id, score, seed_paper, seed_domain, paper_id, domain), ranked exactly.
    """
    fit = neighbours.where((F.col("paper_id") != F.col("seed_paper")) & (F.col("domain") == F.col("seed_domain")) & F.col("score").between(low, high))
    one = first_per(fit, ["query_id", "paper_id"], 1, [F.desc("score"), "doc_id"]).drop("place")
    return first_per(one, ["query_id"], n, [F.desc("score"), "doc_id"])


def stratified(df: DataFrame, stratum: str, n: int, key: str, seed: int = 42) -> DataFrame:
    """``n`` rows of each stratum in the order of a seeded hash. Tasks keep ``n`` each before the shuffle."""
    return first_per(df, [stratum], n, [draw(key, seed=seed), key])


def styles(df: DataFrame, category: str, key: str, quota: int, n_styles: int = 7) -> DataFrame:
    """Styles in turn within a category, ``quota`` of each, and running ids."""
    i = F.row_number().over(Window.partitionBy(category).orderBy(key)) - 1
    styled = df.withColumn("style", F.pmod(i, F.lit(n_styles)))
    few = first_per(styled, [category, "style"], quota, [key]).drop("place")
    return placed(few, [category, key]).withColumn("golden_id", F.format_string("g_%04d", "place")).drop("place")


def best_sections(sections: DataFrame, priority: list[str], least: int = 150, most: int = 1200) -> DataFrame:
    """The section of each paper that ranks first by the order of names, long enough, cut to ``most`` characters."""
    case = F
    for i, name in enumerate(priority):
        case = case.when(F.lower("section").contains(name), i)
    rank = case.otherwise(len(priority)) if priority else F.lit(0)
    return first_per(sections.where(F.length("text") >= least).withColumn("rank_", rank), ["paper_id"], 1, ["rank_", "pos"]).select("paper_id", "section", F.substring("text", 1, most).alias("text"))
