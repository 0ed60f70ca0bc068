"""Citation records: unnesting, grouping by reference, resolving once and fanning out."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tessera.functions.text import bound, ids_in_text, title_hint, title_score, title_tokens


def records(chunks: DataFrame) -> DataFrame:
    """(chunk_uid, cite_index, source_ref_id, doi, openalex_id, arxiv_id, raw) a citation span; blank ids are null."""
    each = chunks.select("chunk_uid", F.posexplode("cite_spans").alias("cite_index", "s"))
    blank = lambda c: F.nullif(F.trim(F.col(f"s.{c}")), F.lit("")).alias(c)
    return each.select("chunk_uid", "cite_index", *map(blank, ("source_ref_id", "doi", "openalex_id", "arxiv_id", "raw")))


def public_id() -> Column:
    return F.coalesce("doi", "arxiv_id", "openalex_id")


def missing(found: DataFrame) -> DataFrame:
    return found.where(public_id().isNull())


def openalex_only(found: DataFrame) -> DataFrame:
    return found.where("openalex_id IS NOT NULL AND doi IS NULL AND arxiv_id IS NULL")


def references(found: DataFrame) -> DataFrame:
    """One row a reference: how often it is cited and its first raw text."""
    return found.groupBy("source_ref_id").agg(F.count("*").alias("n_citations"), F.min_by("raw", F.struct("chunk_uid", "cite_index")).alias("raw"))


def resolve_in_text(refs: DataFrame) -> DataFrame:
    """References with the ids that their raw text holds and the way they were found."""
    ids = refs.withColumn("_ids", ids_in_text(F.col("raw")))
    blank = lambda c: F.nullif(F.col(f"_ids.{c}"), F.lit(""))
    return ids.select(*refs.columns, blank("arxiv").alias("arxiv_id"), blank("doi").alias("doi"), F.when(blank("arxiv").isNotNull(), "arxiv_in_text").when(blank("doi").isNotNull(), "doi_in_text").otherwise("unresolved").alias("id_source"))


def match_registry(refs: DataFrame, registry: DataFrame, accept: float = 0.85) -> DataFrame:
    """The first registry title by priority, rank and DOI that scores ``accept`` with each reference's hint.

    refs: (source_ref_id, raw); registry: (priority, rank, title, doi). A score of ``accept``
    asks that the two share so much of one side's words. Then of that side's words, rarest
    first, one of the first n - ceil(accept * n) + 1 is shared; pairs meet in those alone,
    which loses no match and keeps words that most titles have out of the join.
    """
    titles = registry.select("priority", "rank", "title", "doi", title_tokens(F.col("title")).alias("words"))
    hints = refs.select("source_ref_id", title_hint(F.col("raw")).alias("hint")).withColumn("words", title_tokens(F.col("hint")))
    each = lambda df: df.select(*[c for c in df.columns if c != "words"], F.size("words").alias("n"), F.explode("words").alias("word"))
    a, b = each(hints), each(titles)
    often = b.groupBy("word").agg(F.count("*").alias("often"))

    def rarest(rows: DataFrame, keys: list[str]) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.coalesce("often", F.lit(0)), "word"))
        return rows.join(often, "word", "left").withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(accept * F.col("n") - 1e-9) + 1)

    of_hint, of_title = ["source_ref_id", "hint"], ["priority", "rank", "title", "doi"]
    met = rarest(a, ["source_ref_id"]).select("word", *of_hint).join(b.select("word", *of_title), "word")
    met = met.unionByName(rarest(b, of_title).select("word", *of_title).join(a.select("word", *of_hint), "word")).select(*of_hint, *of_title).distinct()
    good = met.withColumn("match", title_score(F.col("hint"), F.col("title"))).where(F.col("match") >= accept)
    w = Window.partitionBy("source_ref_id").orderBy("priority", "rank", "doi")
    return good.withColumn("place", F.row_number().over(w)).where("place = 1").select("source_ref_id", "title", "doi", "match")


def fan_out(found: DataFrame, resolved: DataFrame) -> DataFrame:
    """Ids of resolved references put on every citation of them; what a citation has of its own stays."""
    ids = resolved.select("source_ref_id", F.col("doi").alias("_doi"), F.col("arxiv_id").alias("_arxiv"))
    joined = found.join(ids, "source_ref_id", "left")
    return joined.withColumns({"doi": F.coalesce("doi", "_doi"), "arxiv_id": F.coalesce("arxiv_id", "_arxiv")}).drop("_doi", "_arxiv")


def rebuild_spans(chunks: DataFrame, found: DataFrame) -> DataFrame:
    """Chunks with their citation spans' ids replaced by those of the records, in place."""
    new = found.groupBy("chunk_uid").agg(F.map_from_entries(F.collect_list(F.struct("cite_index", F.struct("doi", "arxiv_id", "openalex_id")))).alias("_new"))
    put = lambda s, i: s.withField("doi", F.coalesce(F.try_element_at("_new", i)["doi"], F.lit(""))).withField("arxiv_id", F.coalesce(F.try_element_at("_new", i)["arxiv_id"], F.lit("")))
    return chunks.join(new, "chunk_uid", "left").withColumn("cite_spans", F.when(F.col("_new").isNotNull(), F.transform("cite_spans", put)).otherwise(F.col("cite_spans"))).drop("_new")


def resolution_stats(refs: DataFrame) -> DataFrame:
    """By source: references, citations, and their percentages to two places."""
    g = refs.groupBy("id_source").agg(F.count("*").alias("n_refs"), F.sum("n_citations").alias("n_citations"))
    whole = g.agg(F.sum("n_refs").alias("r"), F.sum("n_citations").alias("c"))
    return g.join(F.broadcast(whole)).select("id_source", "n_refs", "n_citations", F.round(100 * F.col("n_refs") / F.col("r"), 2).alias("refs_pct"), F.round(100 * F.col("n_citations") / F.col("c"), 2).alias("citations_pct"))  # one row


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-blocks similarity of two strings, for the few rows that equality left over."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def link_claims(linked: DataFrame, spans: DataFrame, cutoff: float = 0.85) -> DataFrame:
    """The cited paper of a claim's citation: by equal raw text, else the most similar span of its chunk, else ids in the text.

    linked: (claim_id, link_pos, chunk_uid, raw); spans: (chunk_uid, cite_index, raw, paper_id).
    """
    a, b = linked.withColumn("raw", F.trim("raw")), spans.withColumn("raw", F.trim("raw"))
    keys = ["claim_id", "link_pos"]
    pick = lambda df, order: df.withColumn("_p", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_p = 1")
    equal = pick(a.join(b, ["chunk_uid", "raw"]), ["cite_index"]).select(*keys, "paper_id", F.lit("equal").alias("how"))
    rest = a.join(equal, keys, "left_anti")
    close = rest.join(b.withColumnRenamed("raw", "span_raw"), "chunk_uid").withColumn("ratio", sequence_ratio("raw", "span_raw")).where(F.col("ratio") >= cutoff)
    fuzzy = pick(close, [F.desc("ratio"), "cite_index"]).select(*keys, "paper_id", F.lit("similar").alias("how"))
    last = rest.join(fuzzy, keys, "left_anti").withColumn("ids", ids_in_text(F.col("raw"))).select(*keys, F.nullif(F.when(F.col("ids.arxiv") != "", F.col("ids.arxiv")).otherwise(F.col("ids.doi")), F.lit("")).alias("paper_id"), F.lit("in_text").alias("how"))
    return equal.unionByName(fuzzy).unionByName(last.where("paper_id IS NOT NULL"))


# Ids as they stand in bibliography entries.
ENTRY_DOI = r"10\.\d{4,}/\S+"
ENTRY_ARXIV = r"(?i)(?:arxiv[^\d]*)?([0-9]{4}\.[0-9]{4,5}|(?:hep-ph|hep-th|cs|math|eess|stat|physics)/[0-9]{7})"
# Where an entry keeps its ids, first ones first: keys, fields of such a key's object, a list, raw texts.
DOI_PLACES = (("doi", "DOI", "ids"), ("doi", "DOI"), "contained_links")
ARXIV_PLACES = (("arxiv_id", "arxivId", "eprint", "ids"), ("arxiv", "arxiv_id", "eprint"), "contained_arXiv_ids")
OPENALEX_PLACES = (("openalex_id", "open_alex_id", "openAlexId", "ids"), ("openalex_id", "open_alex_id", "openAlexId"))


def entry_ids(entry: Column) -> Column:
    """(doi, arxiv_id, openalex_id, title) of a bibliography entry in JSON, whose keys hold texts, objects or lists.

    The first place that has an id gives it; no JSON gives nulls.
    """
    return bound(F.try_parse_json(entry), parsed_ids)


def parsed_ids(held: Column) -> Column:
    """``entry_ids`` of an entry that is parsed already. What lies under a key is taken out once, and only where the key is there."""

    def under(key: str, fn) -> Column:
        return bound(F.try_variant_get(held, f"$.{key}", "variant"), lambda v: F.when(v.isNotNull(), fn(v)))

    def text(v: Column) -> Column:
        return F.when(F.schema_of_variant(v) == "STRING", F.nullif(F.trim(F.try_variant_get(v, "$", "string")), F.lit("")))

    def field(v: Column, name: str) -> Column:
        return bound(F.try_variant_get(v, f"$.{name}", "variant"), text)

    def match(x: Column, pattern: str) -> Column:
        return F.nullif(F.regexp_extract(x, pattern, 0), F.lit(""))

    def any_of(v: Column, pattern: str) -> Column:
        listed = F.try_variant_get(v, "$", "array<string>")
        return F.get(F.filter(F.transform(listed, lambda x: match(x, pattern)), lambda x: x.isNotNull()), F.lit(0))

    raw = F.coalesce(under("raw_text", text), under("raw", text))

    def found(places: tuple, pattern: str, lists: bool) -> Column:
        keys, fields, links = places
        at = lambda v: F.coalesce(match(text(v), pattern), *[field(v, f) for f in fields], *([any_of(v, pattern)] if lists else []))
        return F.coalesce(*[under(k, at) for k in keys], under(links, lambda v: any_of(v, pattern)), match(raw, pattern))

    openalex = [under(k, lambda v: F.coalesce(text(v), *[field(v, f) for f in OPENALEX_PLACES[1]])) for k in OPENALEX_PLACES[0]]
    title = [bound(under(k, text), lambda x: F.when(F.length(x) > 5, x)) for k in ("title", "bib_entry_raw")]
    return F.struct(found(DOI_PLACES, ENTRY_DOI, True).alias("doi"), found(ARXIV_PLACES, ENTRY_ARXIV, False).alias("arxiv_id"), F.coalesce(*openalex).alias("openalex_id"), F.coalesce(*title).alias("title"))
