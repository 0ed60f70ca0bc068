"""Sections of papers: folding chunks, labelling, repairing the order, and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import imrad
from tessera.functions.text import title_norm

CLASSES = ["Introduction", "Methods", "Results", "Discussion", "Related Work"]


def fold(chunks: DataFrame) -> DataFrame:
    """One row a section of a paper: its first chunk's place, title and text, and how many chunks it has.

    chunks: (paper_id, section_title, chunk_index, chunk_uid, text).
    """
    named = chunks.withColumn("title_norm", title_norm(F.col("section_title")))
    first = lambda c: F.min_by(c, F.struct("chunk_index", "chunk_uid"))
    return named.groupBy("paper_id", "title_norm").agg(
        F.min("chunk_index").alias("chunk_index_min"), first("section_title").alias("title"), first("text").alias("text"), F.count("*").alias("n_chunks")
    )


def label(sections: DataFrame, classified: DataFrame | None = None) -> DataFrame:
    """Sections with label, source and confidence.

    classified: (paper_id, title_norm, class, class_confidence, probs), for titles that the
    heuristic does not know.
    """
    known = sections.withColumn("heuristic", imrad.heuristic_label(F.col("title_norm")))
    if classified is not None:
        known = known.join(classified, ["paper_id", "title_norm"], "left")
    else:
        nothing = {"class": "string", "class_confidence": "double", "probs": "array<double>"}
        known = known.withColumns({c: F.lit(None).cast(t) for c, t in nothing.items()})
    final = imrad.final_label(F.col("heuristic"), F.col("class"), F.col("class_confidence"))
    return known.withColumn("_final", final).select(*sections.columns, "probs", *[F.col(f"_final.{c}").alias(c) for c in ("label", "source", "confidence")])


def repair(labelled: DataFrame, classes: list[str] = CLASSES) -> DataFrame:
    """Labels of each paper made to rise where a classifier gave them. A paper's sections are few; papers are spread."""
    s = F.struct("chunk_index_min", "title_norm", "label", "source", "confidence", "probs")
    ordered = labelled.groupBy("paper_id").agg(F.sort_array(F.collect_list(s)).alias("s"))
    plain = F.transform("s", lambda x: F.struct(x["label"].alias("label"), x["source"].alias("source"), x["confidence"].alias("confidence"), x["probs"].alias("probs")))
    fixed = ordered.select("paper_id", "s", imrad.repaired(plain, classes).alias("r"))
    pairs = fixed.select("paper_id", F.explode(F.arrays_zip("s", "r")).alias("z"))
    return pairs.select("paper_id", "z.s.title_norm", "z.s.chunk_index_min", "z.r.label", "z.r.source", "z.r.confidence")


def papers(labelled: DataFrame) -> DataFrame:
    """Each paper's known labels in order, repeats in a row collapsed, with whether they rise and have the core."""
    known = labelled.where(F.col("label").isin(*imrad.ORDER))
    ordered = known.groupBy("paper_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("chunk_index_min", "title_norm", "label"))), lambda x: x["label"]).alias("all_labels"))
    collapsed = ordered.withColumn("labels", imrad.collapse(F.col("all_labels")))
    return collapsed.select("paper_id", "labels", imrad.in_order(F.col("labels")).alias("ordered"), imrad.has_core(F.col("labels")).alias("core"))


def statistics(labelled: DataFrame) -> DataFrame:
    """(kind, bucket, n): sections by label and by source, papers with any label, the core, and both in order."""
    bucket = F.coalesce("label", F.lit("<missing>"))
    by = lambda kind, c: labelled.groupBy(c.alias("bucket")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "bucket", "n")
    p = papers(labelled).agg(F.count("*").alias("any"), F.count_if(F.col("core")).alias("core"), F.count_if(F.col("core") & F.col("ordered")).alias("core_in_order"))
    wide = p.select(F.explode(F.create_map(F.lit("any"), "any", F.lit("core"), "core", F.lit("core_in_order"), "core_in_order")).alias("bucket", "n"))
    return by("label", bucket).unionByName(by("source", F.col("source"))).unionByName(wide.select(F.lit("papers").alias("kind"), "bucket", "n"))


def unlabelled_titles(labelled: DataFrame, most_papers: int = 50) -> DataFrame:
    """Titles outside the usual labels: how often, the commonest reason, and some papers, unless the title is skipped."""
    odd = labelled.where(~F.coalesce(F.col("label").isin(*imrad.ORDER), F.lit(False)))
    reasons = odd.groupBy("title_norm", "source").agg(F.count("*").alias("n"))
    grouped = reasons.groupBy("title_norm").agg(F.sum("n").alias("n"), F.max_by("source", F.struct("n", "source")).alias("reason"))
    # Only the first papers of a title reach the shuffle: rank limits are applied within tasks.
    w = Window.partitionBy("title_norm").orderBy("paper_id")
    few = odd.select("title_norm", "paper_id").distinct().withColumn("place", F.row_number().over(w)).where(F.col("place") <= most_papers)
    named = few.groupBy("title_norm").agg(F.array_sort(F.collect_list("paper_id")).alias("p"))
    return grouped.join(named, "title_norm").select("title_norm", "n", "reason", F.when(F.col("reason") == "skip", F.slice("p", 1, 0)).otherwise(F.col("p")).alias("papers"))


def lowest_confidence(labelled: DataFrame, n: int = 50) -> DataFrame:
    return labelled.where("source = 'classifier'").orderBy("confidence", "paper_id", "title_norm").limit(n)


def chunk_numbers(chunks: DataFrame, order: list[str]) -> DataFrame:
    """chunk_index from 0 and total_chunks of each paper."""
    w = Window.partitionBy("paper_id")
    return chunks.withColumns({"chunk_index": F.row_number().over(w.orderBy(*order)) - 1, "total_chunks": F.count("*").over(w)})


def title_sources(labelled: DataFrame) -> DataFrame:
    """(title_norm, source, n): where the labels of titles outside the usual ones come from."""
    odd = labelled.where(~F.coalesce(F.col("label").isin(*imrad.ORDER), F.lit(False)))
    return odd.groupBy("title_norm", "source").agg(F.count("*").alias("n"))


def coverage(labelled: DataFrame) -> DataFrame:
    """Sections, those with a label, and their share; 0 of none."""
    return labelled.agg(F.count("*").alias("n_sections"), F.count("label").alias("n_labelled"), F.coalesce(F.round(F.count("label") / F.nullif(F.count("*"), F.lit(0)), 6), F.lit(0.0)).alias("coverage"))
