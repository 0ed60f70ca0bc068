"""Section labels: introduction, methods, results and discussion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import title_norm

ORDER = {"Introduction": 0, "Methods": 1, "Results": 2, "Discussion": 3}
CORE = ["Introduction", "Methods", "Results"]

# Whole titles that stand for each label, tried in this order.
TITLES = {
    "SKIP": [
        "abstract", "acknowledg(e?ments?|ements?)", "references", "bibliography", "index", "table of contents", "list of (figures|tables|algorithms)",
    ],
    "Introduction": [
        "intro(duction)?", "introduction section", "background", "background and motivation", "motivation", "overview",
        "problem (statement|formulation|definition|setup)", "preliminaries", "setup", "related work", "related work and (prior|background)",
        "literature review", "prior work", "related (research|literature|studies)", "background and related work", "state of the art", "previous work",
    ],
    "Methods": [
        "methods?", "materials? and methods?", "methodology", "approach", "proposed (method|approach|model|framework|algorithm)", "model", "framework",
        "algorithm(s)?", "implementation", "experimental setup", "dataset(s)?", "data", "data (collection|preparation|preprocessing)",
        "training (procedure|details|setup)", "(our )?system", "architecture", "technical (approach|details)",
    ],
    "Results": [
        "results?", "experiments?", "evaluation", "experimental results?", "results? and (analysis|discussion|evaluation)", "analysis",
        "ablation(s| study| studies)?", "performance", "benchmarks?", "quantitative (results?|evaluation|analysis)",
        "numerical (results?|experiments?|evaluation)", "case stud(y|ies)", "empirical (results?|evaluation|study)",
    ],
    "Discussion": [
        "discussion", "conclusion(s)?", "conclusions and future work", "summary( and conclusion(s)?)?", "future (work|directions?)", "limitations?",
        "discussion and (conclusion(s)?|future work|summary)", "concluding remarks?",
    ],
}


def pattern(label: str) -> str:
    """One alternation over a label's titles, for engines with or without look-around."""
    return "^(" + "|".join(TITLES[label]) + ")$"


def heuristic_label(title: Column) -> Column:
    """The label whose titles have this one, or null."""
    case = F
    for label in TITLES:
        case = case.when(title_norm(title).rlike(pattern(label)), label)
    return case.otherwise(F.lit(None).cast("string"))


def final_label(heuristic: Column, classified: Column, confidence: Column) -> Column:
    """struct(label, source, confidence): a skipped title, a known one, a classifier's, or none."""
    return (
        F.when(heuristic == "SKIP", F.struct(F.lit("SKIP").alias("label"), F.lit("skip").alias("source"), F.lit(None).cast("double").alias("confidence")))
        .when(heuristic.isNotNull(), F.struct(heuristic.alias("label"), F.lit("heuristic").alias("source"), F.lit(1.0).alias("confidence")))
        .when(classified.isNotNull(), F.struct(classified.alias("label"), F.lit("classifier").alias("source"), confidence.cast("double").alias("confidence")))
        .otherwise(F.struct(F.lit(None).cast("string").alias("label"), F.lit("unresolved").alias("source"), F.lit(None).cast("double").alias("confidence")))
    )


def rank_of(label: Column) -> Column:
    """0 to 3 in the usual order, else null."""
    case = F
    for name, i in ORDER.items():
        case = case.when(label == name, i)
    return case.otherwise(F.lit(None).cast("int"))


def collapse(labels: Column) -> Column:
    """Labels without those that equal the one before."""
    return F.filter(labels, lambda x, i: (i == 0) | (x != F.get(labels, i - 1)))


def in_order(labels: Column) -> Column:
    """Whether labels are some, all known, and strictly rise."""
    ranks = F.transform(labels, rank_of)
    return (F.size(labels) > 0) & F.forall(ranks, lambda r: r.isNotNull()) & F.forall(F.transform(ranks, lambda r, i: (i == 0) | (r > F.get(ranks, i - 1))), lambda x: F.coalesce(x, F.lit(False)))


def has_core(labels: Column) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, CORE)), labels)) == 0


def repaired(sections: Column, classes: list[str]) -> Column:
    """Sections in order, those that break the rise relabelled by their classifier.

    sections: array of struct(label, source, confidence, probs). One that does not rise over
    the greatest rank so far takes its likeliest label that does, the later name among
    ties; only classified sections with probabilities change. The state of the fold
    depends on repaired labels, which a window cannot see.
    """
    last = F.struct(F.lit(-1).alias("top"), F.filter(sections, lambda s: F.lit(False)).alias("done"))

    def step(state: Column, s: Column) -> Column:
        rank = rank_of(s["label"])
        rises = rank > state["top"]
        options = F.filter(
            F.transform(F.arrays_zip(s["probs"].alias("p"), F.array(*map(F.lit, classes)).alias("l")), lambda o: F.struct(o["p"].alias("p"), o["l"].alias("l"), rank_of(o["l"]).alias("r"))),
            lambda o: o["p"].isNotNull() & (o["r"] > state["top"]),
        )
        best = F.get(F.sort_array(options, False), F.lit(0))
        fixable = rank.isNotNull() & ~rises & (s["source"] == "classifier") & s["probs"].isNotNull() & best.isNotNull()
        new = F.struct(
            F.when(fixable, best["l"]).otherwise(s["label"]).alias("label"),
            F.when(fixable, "sequence_repair").otherwise(s["source"]).alias("source"),
            F.when(fixable, best["p"]).otherwise(s["confidence"]).alias("confidence"),
            s["probs"].alias("probs"),
        )
        top = F.when(F.coalesce(rises, F.lit(False)), rank).when(fixable, best["r"]).otherwise(state["top"])
        return F.struct(top.alias("top"), F.concat(state["done"], F.array(new)).alias("done"))

    return F.aggregate(sections, last, step, lambda s: s["done"])
