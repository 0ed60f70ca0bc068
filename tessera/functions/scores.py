"""Vectors, fused scores, weights and years as expressions."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

RRF_K = 60


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(_doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(v: Column) -> Column:
    """Zero vectors stay as they are."""
    n = norm(v)
    return F.when(n > 0, F.transform(_doubles(v), lambda x: x / n)).otherwise(_doubles(v))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def reciprocal_rank(rank: Column, k: int = RRF_K) -> Column:
    """A leg's share of the fused score; 0 where it has no hit."""
    return F.coalesce(1.0 / (k + rank), F.lit(0.0))


def min_max(score: Column, *keys: str) -> Column:
    """Score scaled to 0..1 within ``keys``; divided by 1 where all are equal."""
    w = Window.partitionBy(*keys)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return (score - low) / F.when(high > low, high - low).otherwise(1.0)


def evidence_blend(score: Column) -> Column:
    """An aggregate: 0.6 of the best and 0.4 of the mean."""
    return 0.6 * F.max(score) + 0.4 * F.avg(score)


def verdict(entail: Column, contradict: Column, has_evidence: Column) -> Column:
    return F.when(~has_evidence, "Not-Supported").when(entail > 0.65, "Supported").when(contradict > 0.70, "Contradicted").otherwise("Neutral")


def budget_weights(weight: Column, *keys: str) -> Column:
    """Weights over their sum within ``keys``; equal ones where the sum is not above 0. Rows without a text are to be left out before."""
    w = Window.partitionBy(*keys)
    total = F.sum(weight).over(w)
    return F.when(total > 0, F.coalesce(weight, F.lit(0.0)) / F.when(total > 0, total)).otherwise(1.0 / F.count(F.lit(1)).over(w))


def year_of(versions: Column, update_date: Column) -> Column:
    """The first version's year that has one, else the update's; null outside 1900..2100."""
    years = F.filter(F.transform(versions, lambda v: F.regexp_extract(v, r"\b((?:19|20)\d{2})\b", 1)), lambda y: y != "")
    year = F.coalesce(F.get(years, F.lit(0)), F.nullif(F.regexp_extract(update_date, r"^(\d{4})", 1), F.lit(""))).cast("int")
    return F.when(year.between(1900, 2100), year)


def arxiv_year(arxiv_id: Column) -> Column:
    """Year from the YYMM of an id, new or old style."""
    yy = F.nullif(F.regexp_extract(arxiv_id, r"(?:^|/)(\d{2})\d{2}", 1), F.lit("")).cast("int")
    return F.when(yy < 90, 2000 + yy).otherwise(1900 + yy)


def authors(parsed: Column, text: Column) -> Column:
    """``first last`` of parsed names, else the text split at commas and semicolons."""
    named = F.transform(parsed, lambda x: F.trim(F.concat_ws(" ", F.get(x, F.lit(1)), F.get(x, F.lit(0)))))
    split = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[,;]"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(parsed) > 0, F.filter(named, lambda x: x != "")).otherwise(split)


# Prefixes of categories, by domain in order of precedence.
DOMAINS = {
    "cs": ["cs."],
    "physics": ["hep-", "astro-", "quant-ph", "physics.", "cond-mat", "math-ph", "gr-qc", "nucl-"],
    "math": ["math."],
}
# Pairs of sections that a question may join.
SECTION_PAIRS = [
    ("introduction", "results"), ("methods", "results"), ("methods", "discussion"), ("introduction", "conclusion"), ("methodology", "results"),
    ("methodology", "discussion"), ("approach", "results"), ("approach", "evaluation"), ("experiments", "discussion"), ("experiments", "conclusion"),
]


def domain(categories: Column) -> Column:
    """cs, physics, math or other, by the first category that has one."""

    def of(category: Column) -> Column:
        case = F
        for name, prefixes in DOMAINS.items():
            case = case.when(F.lower(category).rlike("^(" + "|".join(p.replace(".", r"\.") for p in prefixes) + ")"), name)
        return case.otherwise(F.lit(None).cast("string"))

    return F.coalesce(F.get(F.filter(F.transform(categories, of), lambda x: x.isNotNull()), F.lit(0)), F.lit("other"))


def valid_pair(a: Column, b: Column) -> Column:
    """Whether two section labels, in either order, make a pair."""
    pair = F.concat_ws("|", F.array_sort(F.array(F.lower(a), F.lower(b))))
    return pair.isin(["|".join(sorted(p)) for p in SECTION_PAIRS])


def cache_key(query: Column, mode: Column, top_k: Column) -> Column:
    return F.sha2(F.concat_ws("\u0000", query, mode, top_k.cast("string")), 256)


def storage_gb(points: Column, dim: int, width: int = 4) -> Column:
    """Gigabytes of vectors with 30 % for their index."""
    return points * dim * width * 1.30 / 1e9


# Sections that a sub-query may ask for.
TARGETS = ["Introduction", "Methods", "Results", "Discussion"]


def target_sections(names: Column) -> Column:
    """The sections that the names stand for, in any case and with underscores for spaces; unknown names fall away."""
    wanted = F.create_map(*[F.lit(x) for t in ["Abstract", *TARGETS] for x in (t.lower(), t)])
    return F.filter(F.transform(names, lambda x: F.try_element_at(wanted, F.translate(F.lower(F.trim(x)), " ", "_"))), lambda x: x.isNotNull())


def section_name(imrad: Column, section: Column) -> Column:
    """The label of a chunk's section: the classified one, else its title; empty if it has neither."""
    return F.lower(F.trim(F.coalesce(imrad, section, F.lit(""))))


def cluster(title: Column, abstract: Column, keywords: dict[str, list[str]]) -> Column:
    """The first cluster with a keyword in the title or abstract; null if none has."""
    text = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(abstract, F.lit(""))))
    found = F
    for name, words in keywords.items():
        found = found.when(F.exists(F.array(*map(F.lit, words)), lambda w: text.contains(w)), name)
    return found.otherwise(F.lit(None).cast("string"))


def paper_meta(title: Column, doi: Column, arxiv_id: Column, versions: Column, update_date: Column, authors_parsed: Column, authors_text: Column, categories: Column) -> Column:
    """A paper's metadata in one struct."""
    parts = F.filter(F.split(F.coalesce(categories, F.lit("")), r"[\s,;]+"), lambda x: x != "")
    return F.struct(
        F.nullif(F.trim(F.regexp_replace(title, r"\s+", " ")), F.lit("")).alias("title"), doi.alias("doi"), arxiv_id.alias("arxiv_id"),
        year_of(versions, update_date).alias("year"), authors(authors_parsed, authors_text).alias("authors"), parts.alias("categories"),
    )


def projected(value: Column, sample: Column, whole: float, overhead: float = 1.1) -> Column:
    """A sample's cost carried on to the whole, with an overhead."""
    return F.when(sample > 0, value / sample * whole * overhead)


def task_of(index: Column, tasks: int) -> Column:
    """Round-robin assignment of numbered batches."""
    return F.pmod(index, F.lit(tasks)).cast("int")
