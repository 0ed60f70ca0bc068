"""Lookups over chunk tables: by id, by paper, by key range, and labels or ids joined back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import title_hint, title_norm, title_tokens


def scroll(table: DataFrame, columns: list[str], where: Column | None = None) -> DataFrame:
    """The named columns of all rows that meet the condition; both reach the scan."""
    return (table if where is None else table.where(where)).select(*columns)


def key_range(uid: Column, n: int) -> Column:
    """The stride, of ``n`` even ones, of the key space that a hexadecimal id falls in."""
    return F.floor(F.conv(F.substring(F.replace(uid, F.lit("-"), F.lit("")), 1, 8), 16, 10).cast("long") * n / (1 << 32)).cast("int")


def by_keys(table: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows whose key is among the keys, each once, however often a key is asked for."""
    return table.join(keys.select(*on), on, "left_semi")


def paper_chunks(chunks: DataFrame, papers: DataFrame, kind: str = "subsection", most: int = 50) -> DataFrame:
    """The first ``most`` chunks of one kind of each paper asked for."""
    w = Window.partitionBy("paper_id").orderBy("chunk_index")
    own = by_keys(chunks.where(F.col("chunk_type") == kind), papers, ["paper_id"])
    return own.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= most).drop("_place")


def of_either(table: DataFrame, first: str, firsts: DataFrame, second: str, seconds: DataFrame) -> DataFrame:
    """Rows whose first or second id is among those asked for, once each. Blank ids never match."""
    ids = lambda df, name: df.select(F.col(df.columns[0]).alias(name)).where(F.col(name).cast("string") != "").distinct().withColumn(f"_{name}", F.lit(True))
    marked = table.join(ids(firsts, first), first, "left").join(ids(seconds, second), second, "left")
    return marked.where(F.coalesce(f"_{first}", f"_{second}")).select(*table.columns)


def by_title(citations: DataFrame, papers: DataFrame, most: int = 2) -> DataFrame:
    """For citations without an id: papers whose title has every word of the raw text's title, the first ``most`` by id.

    citations: (citation_id, raw), one an id; papers: (paper_id, title). Hints of the same words are one, and so are titles,
    of whose papers only the first ``most`` can be among a hint's; the two meet in the hint's rarest word.
    """
    hints = citations.select("citation_id", F.array_sort(title_tokens(title_hint(F.col("raw")))).alias("hint")).where(F.size("hint") > 0).groupBy("citation_id").agg(F.min("hint").alias("hint"))
    first = lambda df, key: df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("paper_id"))).where(F.col("rank") <= most)
    titles = first(papers.select("paper_id", F.array_sort(title_tokens(F.col("title"))).alias("words")), "words")
    titles = titles.groupBy("words").agg(F.collect_list(F.struct("paper_id")).alias("papers"))
    words = titles.select("words", "papers", F.explode("words").alias("word"))
    often = words.groupBy("word").agg(F.count("*").alias("n"))
    asked = hints.select("hint").distinct().select("hint", F.explode("hint").alias("word")).join(often, "word", "left")
    rarest = asked.groupBy("hint").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")).alias("x"))
    met = rarest.select("hint", F.col("x.word").alias("word")).join(words, "word").where(F.size(F.array_except("hint", "words")) == 0)
    best = first(met.select("hint", F.explode("papers").alias("p")).select("hint", "p.paper_id"), "hint")
    return hints.join(best, "hint").select("citation_id", "paper_id", "rank")


def labels_to_chunks(chunks: DataFrame, labels: DataFrame) -> DataFrame:
    """Chunks with their section's label; those already labelled keep theirs.

    chunks: (paper_id, section_title, label, ...); labels: (paper_id, title_norm, label), one a section.
    """
    found = labels.select("paper_id", "title_norm", F.col("label").alias("_label"))
    joined = chunks.withColumn("title_norm", title_norm(F.col("section_title"))).join(found, ["paper_id", "title_norm"], "left")
    return joined.withColumn("label", F.coalesce("label", "_label")).select(*chunks.columns)


def unlabelled(chunks: DataFrame, column: str = "label") -> DataFrame:
    """Rows that an earlier run has not written yet."""
    return chunks.where(F.col(column).isNull())


def upgrade(found: DataFrame, upgrades: DataFrame) -> DataFrame:
    """Citations that have a third-party id alone, with the public ids found for it; others as they are.

    found: (..., openalex_id, doi, arxiv_id); upgrades: (openalex_id, doi, arxiv_id), one an id.
    """
    new = upgrades.select("openalex_id", F.col("doi").alias("_doi"), F.col("arxiv_id").alias("_arxiv"))
    joined = found.join(new, "openalex_id", "left")
    alone = F.col("doi").isNull() & F.col("arxiv_id").isNull()
    return joined.withColumns({"doi": F.when(alone, F.col("_doi")).otherwise(F.col("doi")), "arxiv_id": F.when(alone, F.col("_arxiv")).otherwise(F.col("arxiv_id"))}).select(*found.columns)


def cited_context(retrieved: DataFrame, cited: DataFrame) -> DataFrame:
    """The retrieved chunks that an answer cites; all of a query's if it cites none of them."""
    marks = cited.select("query_id", "chunk_uid").distinct().withColumn("_cited", F.lit(1))
    marked = retrieved.join(marks, ["query_id", "chunk_uid"], "left")
    some = F.count("_cited").over(Window.partitionBy("query_id"))
    return marked.withColumn("_some", some).where("_cited = 1 OR _some = 0").select(*retrieved.columns)


def without_shortcuts(goldens: DataFrame, verdicts: DataFrame, categories: tuple[int, ...] = (3, 4)) -> DataFrame:
    """Goldens of the given categories that no single chunk answers; all of the others."""
    yes = verdicts.where(F.upper(F.trim("verdict")).startswith("YES")).select("golden_id").distinct()
    return goldens.join(yes.withColumn("_yes", F.lit(True)), "golden_id", "left").where(~F.col("category").isin(*categories) | F.col("_yes").isNull()).select(*goldens.columns)
