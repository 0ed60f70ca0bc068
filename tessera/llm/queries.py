"""The registered queries of this subpackage, with SQL where SQL can say the same.

Each applies its operator to the whole of its table. Of null, empty and very long texts,
ties, repeated rows and empty tables each makes what its operator's docstring states.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, collocations, decontaminate, langid, lm, pieces, pii, quality, secrets, simhash, substrings, urls, variants
from tessera.llm.common import table


def page_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of pages: a labelled item of the page's id that is of low quality or toxic is bad."""
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)
    labelled = F.col("quality").isNotNull() & F.col("toxic").isNotNull()
    return table(spark, sf_dir, "labels").where(labelled).select(F.col("doc_id").alias("page_id"), bad.alias("bad"))


def op1_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """urls.judge: every page's url by rules and by the reputation of its host."""
    return urls.judge(table(spark, sf_dir, "pages"), page_outcomes(spark, sf_dir))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """quality.judge: counts and verdicts of every document."""
    return quality.judge(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """decontaminate.matches: every benchmark item in every document."""
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pieces.encode: ids of every document, with merge dropout."""
    return pieces.encode(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """simhash.near_duplicates: every document's fingerprint and component."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """substrings.dedup: what is left of every document without repeated windows."""
    return substrings.dedup(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pii.scan: personal data of every document."""
    return pii.scan(table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """secrets.scan: secrets of every document."""
    return secrets.scan(table(spark, sf_dir, "documents"))


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lm.score: every document under a model of the training ones."""
    return lm.score(table(spark, sf_dir, "documents"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """langid.identify: the languages of every document."""
    return langid.identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score", "langs")


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """variants.group: the spelling variants among the words of all documents, one in 199 of which loses a letter."""
    return variants.group(variants.dictionary(table(spark, sf_dir, "documents"), slip=199))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """collocations.mine: each language's best phrases."""
    return collocations.mine(table(spark, sf_dir, "documents"))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bpe.encode: ids of every document, and the text that they decode to."""
    done = bpe.encode(table(spark, sf_dir, "documents"), decoded=True)
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    return done.select("doc_id", "n_tokens", ids.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_urls": op1_urls,
    "op2_quality": op2_quality,
    "op3_decontaminate": op3_decontaminate,
    "op4_pieces": op4_pieces,
    "op5_simhash": op5_simhash,
    "op6_substrings": op6_substrings,
    "op7_pii": op7_pii,
    "op8_secrets": op8_secrets,
    "op9_lm": op9_lm,
    "op10_langid": op10_langid,
    "op11_variants": op11_variants,
    "op12_collocations": op12_collocations,
    "op13_bpe": op13_bpe,
}
ORACLES: dict[str, str] = {"op1_urls": urls.ORACLE, "op2_quality": quality.ORACLE, "op12_collocations": collocations.ORACLE}
