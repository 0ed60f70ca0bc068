"""A corpus of papers in counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import bound, chunk_estimate, is_noise_title
from tessera.operators.citations import ENTRY_ARXIV, parsed_ids

# Marks in texts, years, and words of the usual section titles.
CITE = r"\{\{cite:([0-9a-f]+)\}\}"
FIGURE = r"\{\{figure:[0-9a-f\-]+\}\}"
TABLE = r"\{\{table:[0-9a-f\-]+\}\}"
YEAR = r"\b(19|20)\d{2}\b"
YEAR_IN_ID = r"^\s*\d{4}\.\d{4,5}|/\d{7}"
USUAL_TITLES = [
    "introduction", "related work", "background", "method", "approach", "experiment", "result", "evaluation",
    "discussion", "conclusion", "abstract", "acknowledgement", "reference", "appendix",
]


def _field(name: str):
    return lambda x: x[name]


def _has(id_name: str):
    return lambda entry: entry["ids"][id_name].isNotNull()


def _total(of: Column | str, value) -> Column:
    return F.aggregate(F.transform(of, value), F.lit(0).cast("long"), lambda a, x: a + x)


def per_paper(papers: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """What each paper has: its sections' marks and words, and its bibliography's ids.

    papers: (title, authors array, year, doi, arxiv_id, categories array, abstract,
    sections array<struct<section,text>>, bibs array<struct<ref_id,entry>>), entries in JSON. A
    missing array counts as an empty one; entries that are no JSON object don't count.
    """
    text = lambda x: F.trim(F.coalesce(x, F.lit("")))
    words = lambda x: F.size(F.array_remove(F.split(x, r"\s+"), "")).cast("long")
    number = lambda x, pattern: F.regexp_count(x, F.lit(pattern)).cast("long")

    def section(x: Column) -> Column:
        title, body = text(x["section"]), text(x["text"])
        kind = F.when(title == "", "empty").when(is_noise_title(title), "noise").otherwise("named")
        return F.struct(
            kind.alias("kind"), F.lower(title).rlike("|".join(USUAL_TITLES)).alias("usual"), words(body).alias("words"), F.regexp_extract_all(body, F.lit(CITE), F.lit(1)).alias("cites"),
            number(body, FIGURE).alias("figures"), number(body, TABLE).alias("tables"),
        )

    def entry(x: Column) -> Column:
        return bound(F.try_parse_json(x["entry"]), lambda held: _entry(x["ref_id"], held))

    def _entry(ref_id: Column, held: Column) -> Column:
        year = F.coalesce(F.try_variant_get(held, "$.year", "string"), F.try_variant_get(held, "$.Year", "string"))
        return F.struct(ref_id.alias("ref_id"), F.coalesce(F.schema_of_variant(held).startswith("OBJECT"), F.lit(False)).alias("is_object"), parsed_ids(held).alias("ids"), F.coalesce(year.rlike(YEAR), F.lit(False)).alias("year"))

    parts = papers.select(
        *keep, *[F.coalesce(text(F.col(c)) != "", F.lit(False)).alias(f"has_{c}") for c in ("title", "doi", "abstract")],
        *[F.coalesce(F.size(c) > 0, F.lit(False)).alias(f"has_{c}") for c in ("authors", "categories")],
        F.coalesce(F.col("year").rlike(YEAR), F.lit(False)).alias("has_year"),
        F.coalesce(F.col("arxiv_id").rlike(ENTRY_ARXIV), F.lit(False)).alias("has_arxiv_id"),
        F.coalesce(F.col("arxiv_id").rlike(ENTRY_ARXIV) & F.col("arxiv_id").rlike(YEAR_IN_ID), F.lit(False)).alias("has_year_in_id"),
        F.transform(F.coalesce("sections", F.array()), section).alias("s"),
        F.filter(F.transform(F.coalesce("bibs", F.array()), entry), lambda x: x["is_object"]).alias("b"),
    )
    kind = lambda name: F.size(F.filter("s", lambda x: x["kind"] == name)).cast("long")
    refs = lambda c: F.transform(F.filter("b", _has(c)), _field("ref_id"))
    return parts.select(
        "*", F.size("s").cast("long").alias("n_sections"), kind("empty").alias("empty_titles"), kind("noise").alias("noise_titles"), kind("named").alias("named"),
        F.size(F.filter("s", lambda x: (x["kind"] == "named") & x["usual"])).cast("long").alias("usual_titles"),
        *[_total("s", _field(c)).alias(c) for c in ("words", "figures", "tables")],
        _total("s", lambda x: F.size(x["cites"]).cast("long")).alias("markers"),
        (1 + _total("s", lambda x: chunk_estimate(x["words"]))).alias("chunks"),
        F.array_distinct(F.flatten(F.transform("s", lambda x: x["cites"]))).alias("cites"),
        refs("doi").alias("by_doi"), refs("arxiv_id").alias("by_arxiv"), refs("openalex_id").alias("by_openalex"),
    )


def paper_profile(papers: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row of counts over all papers, 0 of none, in one pass without a shuffle of rows; papers as in ``per_paper``.

    With ``by`` a row for each of its values that there is; the counts of parts add up to those of the whole.

    A cited reference resolves by the first of DOI, arXiv and third-party id that its entry has.
    """
    p = per_paper(papers, by)
    size = lambda x: F.size(x).cast("long")
    doi, arxiv = F.array_intersect("cites", "by_doi"), F.array_intersect("cites", F.array_except("by_arxiv", "by_doi"))
    third = F.array_intersect("cites", F.array_except(F.array_except("by_openalex", "by_doi"), "by_arxiv"))
    p = p.withColumns({"cited": size("cites"), "cited_doi": size(doi), "cited_arxiv": size(arxiv), "cited_openalex": size(third)})
    entries = lambda has: F.sum(size(F.filter("b", has)))
    some = lambda x: x["ids"]["doi"].isNotNull() | x["ids"]["arxiv_id"].isNotNull() | x["ids"]["openalex_id"].isNotNull()
    flags = ["title", "authors", "year", "doi", "arxiv_id", "year_in_id", "categories", "abstract"]
    sums = ["n_sections", "empty_titles", "noise_titles", "usual_titles", "words", "figures", "tables", "markers", "chunks", "cited", "cited_doi", "cited_arxiv", "cited_openalex"]
    return p.groupBy(*by).agg(
        F.count("*").alias("n_papers"), *[F.count_if(F.col(f"has_{c}")).alias(f"has_{c}") for c in flags], F.count_if(~F.col("has_abstract")).alias("abstract_empty"),
        F.count_if(F.col("words") > 0).alias("has_body"), F.count_if(F.col("words") == 0).alias("body_empty"),
        F.count_if((F.col("words") > 0) & (F.col("named") == 0)).alias("without_titles"), F.count_if(F.col("cited") == 0).alias("without_citations"),
        *[F.sum(c).alias(c) for c in sums], F.sum(F.col("cited") - F.col("cited_doi") - F.col("cited_arxiv") - F.col("cited_openalex")).alias("cited_without_id"),
        F.sum(size("b")).alias("bib_entries"), *[entries(_has(c)).alias(f"bib_{c}") for c in ("doi", "arxiv_id", "openalex_id", "title")],
        entries(lambda x: x["year"]).alias("bib_year"), entries(some).alias("bib_any_id"), entries(lambda x: ~some(x)).alias("bib_without_id"),
    ).fillna(0)
