"""Text expressions: cleaning, normalising, tokenising and scoring titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and patterns that results depend on.
ANSWER_STOP_WORDS = "a an the is are was were be been being have has had do does did will would could should may might shall can of in on at to for with by from and or not".split()
TITLE_STOP_WORDS = "a an the of in on at to for and or by with from is it as".split()
HEDGES = ["may be related", "indirectly related", "not directly", "not explicitly", "loosely related", "potentially relevant", "marginally", "tangentially"]
SKIPPED_TITLES = (r"^acknowledg(e?ments?|ements?)$", r"^references$", r"^bibliography$", r"^index$", r"^table of contents$", r"^list of (figures|tables|algorithms)$")
ABBREVIATIONS = (
    "al. approx. art. assoc. cf. chap. co. corp. dept. dr. e.g. eq. eqs. esp. etc. fig. figs. i.e. inc. jr. mr. mrs. ms. no. nos. phys. pp. prof. ref. refs. rev. sec. secs. st. supp. vol. vs."
).split()
DOI_PREFIX = r"^https?://(dx\.)?doi\.org/"
SENTENCE_GAP = r"(?<=[.!?])\s+(?=[A-Z0-9(\\])"
ARXIV_ID = r"(?i)(?:\barxiv[:\s/]+|arxiv\.org/(?:abs|pdf)/)(\d{4}\.\d{4,5}(?:v\d+)?|[a-z\-]+/\d{7}(?:v\d+)?)"
DOI_ID = r"(?i)(?:https?://(?:dx\.)?doi\.org/|doi:\s*)(10\.\d{4,}/\S+)"
ATOMIC = r"\b\d+|\b[A-Z]{2}[A-Z0-9\-]*\b|\b[A-Z][a-z]+-\d+\b"
NOISE_TITLE = r"(?i)^(\d+\.?\s*)*$|^\s*$|^[ivx]+\.?\s*$|^\W+$|^(nan|none|null)$"
PLACEHOLDER = r"\{\{formula:[^}]+\}\}|\bREF\b"
TITLE_PLACES = [r"[\"“]([^\"”]{10,})[\"”]", r"'([^']{15,})'", r"^[^.]{3,}\.\s+([^.]{15,})\.", r"(?:[A-Z]\.\s*)+[A-Z][\w-]+,\s+([^,.]{15,})[,.]", r"^[^,]+,\s*([^,]{15,}),"]
NLI_NAMES = {"entails": ["entailment", "entails", "support", "supported"], "neutral": ["neutral"], "contradicts": ["contradiction", "contradicts", "contradictory"]}
FORMULA = r"\{\{formula:[^}]+\}\}"


def normalize_doi(raw: Column) -> Column:
    """The identifier without a resolver's address; null is empty."""
    return F.regexp_replace(F.trim(F.coalesce(raw, F.lit(""))), DOI_PREFIX, "")


def title_norm(title: Column) -> Column:
    """Trimmed, lower-cased, white space collapsed; null is empty."""
    return F.regexp_replace(F.lower(F.trim(F.coalesce(title, F.lit("")))), r"\s+", " ")


def profile_title(title: Column) -> Column:
    """``title_norm`` without the numbering ahead of it."""
    return F.regexp_replace(title_norm(title), r"^[\d.\s]+", "")


def paper_title(title: Column) -> Column:
    """White space collapsed; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(title, r"\s+", " ")), F.lit(""))


def fold_related_work(section: Column) -> Column:
    return F.when(section.rlike("(?i)related.work"), "Introduction").otherwise(section)


def skips_section(title: Column) -> Column:
    """Whether a section of that title is left out of an index."""
    return title_norm(title).rlike("|".join(SKIPPED_TITLES))


def section_title(title: Column) -> Column:
    """``Body`` for a missing, blank or literally null title."""
    return F.when(title_norm(title).isin("", "null", "none"), "Body").otherwise(F.trim(title))


def embed_text(text: Column) -> Column:
    """Commas left alone by removed citations collapse to one, runs of spaces to one; trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(\s*,)(\s*,)+", ","), "  +", " "))


def chunk_content(text: Column, title: Column, section: Column) -> Column:
    """The text under lines that say where it is from; formulas as a short mark."""
    named = lambda label, x: F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(label), x))
    head = F.concat_ws("\n", named("Paper: ", title), named("Section: ", section))
    return F.concat(F.when(head != "", F.concat(head, F.lit("\n\n"))).otherwise(""), F.regexp_replace(text, FORMULA, "[FORMULA]"))


def sentences(text: Column) -> Column:
    """Sentences by punctuation, white space and what may begin the next one; blank ones dropped."""
    return F.filter(F.transform(F.split(text, SENTENCE_GAP), lambda x: F.regexp_replace(x, r"\s+$", "")), lambda x: x != "")


def chunk_uid(paper: Column, section: Column, index: Column, text: Column) -> Column:
    """Content hash of a chunk: fields joined by the zero character."""
    return F.sha1(F.concat_ws("\u0000", paper, section, index.cast("string"), text))


def uuid5_oid(name: Column) -> Column:
    """Version-5 UUID in the object-id name space."""
    namespace = F.unhex(F.lit("6ba7b8129dad11d180b400c04fd430c8"))
    h = F.sha1(F.concat(namespace, F.encode(name, "utf-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def ids_in_text(raw: Column) -> Column:
    """struct(arxiv, doi) found in free text, without an arXiv version; empty where there is none.

    A text with an arXiv id alone gets the DOI made of it.
    """
    raw = F.coalesce(raw, F.lit(""))
    arxiv = F.regexp_replace(F.regexp_replace(F.regexp_extract(raw, ARXIV_ID, 1), r"[.,;)]+$", ""), r"v\d+$", "")
    doi = F.regexp_replace(F.regexp_extract(raw, DOI_ID, 1), r"[.,;)]+$", "")
    return F.struct(arxiv.alias("arxiv"), F.when((doi == "") & (arxiv != ""), F.concat(F.lit("10.48550/arxiv."), arxiv)).otherwise(doi).alias("doi"))


def title_hint(raw: Column) -> Column:
    """The likeliest title in a raw reference: quoted, else after the authors' part, else the first 120 characters."""
    return F.coalesce(*[F.nullif(F.trim(F.regexp_extract(raw, p, 1)), F.lit("")) for p in TITLE_PLACES], F.trim(F.substring(raw, 1, 120)))


def all_tokens(text: Column) -> Column:
    """Lower-cased runs of a-z and digits, repeats included."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))


def token_set(text: Column, stop: list[str] = ANSWER_STOP_WORDS) -> Column:
    return F.array_except(all_tokens(text), F.array(*map(F.lit, stop)))


def title_tokens(title: Column) -> Column:
    """Words of a title without mathematics, commands, mark-up and small words."""
    bare = F.coalesce(title, F.lit(""))
    for pattern in (r"\$[^$]*\$", r"\\[a-zA-Z]+\b", r"<[^>]+>", r"[^\p{L}\p{N}\s]"):
        bare = F.regexp_replace(bare, pattern, " ")
    return F.array_except(F.array_remove(F.split(F.lower(bare), r"\s+"), ""), F.array(*map(F.lit, TITLE_STOP_WORDS)))


def bound(value: Column, fn) -> Column:
    """``fn`` of a value that is made once a row, however often ``fn`` names it; within lambdas nothing else is."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token sets, each made once; 0 if either is empty."""
    share = lambda x, y: F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))).otherwise(0.0)
    return F.get(F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), lambda x: share(x["a"], x["b"])), F.lit(0))


def overlap(a: Column, b: Column) -> Column:
    """Share of the first set that the second has; 0 if it is empty."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(0.0)


def title_score(query: Column, candidate: Column, ratio: float = 1.5) -> Column:
    """The best of Jaccard, of the share that either word set has of the other where their sizes are alike,
    and of the candidate's share in the query if it has three words."""
    a, b = title_tokens(query), title_tokens(candidate)
    na, nb, both = F.size(a), F.size(b), F.size(F.array_intersect(a, b))
    alike = F.greatest(na, nb) <= F.least(na, nb) * ratio
    within = F.when(alike, both / F.least(na, nb)).otherwise(0.0)
    cover = F.when(nb >= 3, both / nb).otherwise(0.0)
    return F.when((na > 0) & (nb > 0), F.greatest(jaccard(a, b), within, cover)).otherwise(0.0)


def claim_type(text: Column) -> Column:
    """``atomic_factual`` with a number, an acronym or a versioned name; else ``inferential``."""
    return F.when(text.rlike(ATOMIC), "atomic_factual").otherwise("inferential")


def is_tangential(reason: Column) -> Column:
    """Whether the stated relevance hedges."""
    low = F.lower(F.coalesce(reason, F.lit("")))
    return F.exists(F.array(*map(F.lit, HEDGES)), lambda h: low.contains(h))


def is_noise_title(title: Column) -> Column:
    return F.coalesce(title, F.lit("")).rlike(NOISE_TITLE)


def judged_relation(verdict: Column) -> Column:
    return F.concat(F.lit("judged_"), F.translate(F.lower(verdict), "- ", "__"))


def usable_chunk(text: Column, most: float = 0.40) -> Column:
    """Whether placeholders take less than ``most`` of the characters that aren't space."""
    solid = F.length(F.regexp_replace(text, r"[ \n\t]+", ""))
    marks = F.length(text) - F.length(F.regexp_replace(text, PLACEHOLDER, ""))
    return F.coalesce((solid > 0) & (marks < solid * most), F.lit(False))


def golden_reason(question: Column, answer: Column) -> Column:
    """Why a question and its answer are unfit, or null."""
    return (
        F.when((F.length(question) < 60) | (F.length(question) > 400), "question_length")
        .when(F.length(answer) < 80, "answer_length")
        .when(question.contains("```") | answer.contains("```"), "fence")
        .when(question.contains("[FORMULA]") | answer.contains("[FORMULA]"), "formula")
        .when(answer.rlike(r"\bREF\b"), "reference")
    )


def chunk_estimate(words: Column) -> Column:
    """Chunks of a text of so many words: 1.30 tokens a word, 900 whole, then 870 each."""
    tokens = F.floor(words * 1.30)
    return F.when(tokens <= 900, 1).otherwise(F.ceil((tokens - 900) / 870) + 1).cast("long")


def metric_key(name: Column) -> Column:
    """A metric's name without the bracketed kind after it, in lower case, with underscores for spaces and hyphens."""
    bare = F.regexp_replace(name, r"\s*\[[^\]]*\]\s*$", "")
    bare = F.trim(F.regexp_replace(F.lower(F.replace(bare, F.lit("-"), F.lit(" "))), r"\s+", " "))
    return F.replace(bare, F.lit(" "), F.lit("_"))


def display_label(kind: Column, node: Column, text: Column, paper: Column, section: Column, index: Column, words: int = 6) -> Column:
    """What a graph's node is called: a paper's id, a chunk's section and index, a claim's first words; else part of its own id."""
    parts = F.array_remove(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+"), "")
    said = F.concat(F.array_join(F.slice(parts, 1, words), " "), F.when(F.size(parts) > words, "…").otherwise(""))
    filled = lambda x: F.nullif(F.coalesce(x, F.lit("")), F.lit(""))
    place = F.coalesce(F.substring(filled(section), 1, 22), F.lit("chunk"))
    return (
        F.when(kind == "paper", F.coalesce(filled(paper), F.substring(node, 1, 16)))
        .when(kind == "chunk", F.concat_ws(" · ", place, index.cast("string")))
        .when(kind == "claim", F.coalesce(filled(said), F.substring(node, -6, 6)))
        .otherwise(F.substring(node, 1, 20))
    )


def key_phrases(text: Column, n: int = 2) -> Column:
    """Of the first ``n`` pieces between full stops, those of over ten characters."""
    pieces = F.transform(F.slice(F.split(text, r"\."), 1, n), lambda x: F.trim(x))
    return F.filter(pieces, lambda x: F.length(x) > 10)


def escape_latex(text: Column) -> Column:
    return F.replace(text, F.lit("\\"), F.lit("\\\\"))


def unescape_latex(text: Column) -> Column:
    return F.replace(text, F.lit("\\\\"), F.lit("\\"))


def nli_label(raw: Column) -> Column:
    """The canonical label of an entailment model's one, or null."""
    low = F.translate(F.lower(F.trim(raw)), "_-", "  ")
    found = F
    for label, names in NLI_NAMES.items():
        found = found.when(low.isin(*names), label)
    return found.otherwise(F.lit(None).cast("string"))


def cite_spans(raw: Column, schema: str = "array<struct<raw:string,arxiv_id:string,doi:string>>") -> Column:
    """The spans of a payload's JSON object; empty where it is missing, no JSON or no object with spans."""
    held = F.try_parse_json(raw)
    spans = F.try_variant_get(held, "$.cite_spans", schema)
    return F.when(F.schema_of_variant(held).startswith("OBJECT"), F.coalesce(spans, F.array().cast(schema))).otherwise(F.array().cast(schema))


def citations_block(raws: Column) -> Column:
    """The raw references of a chunk for a prompt, each once, in order."""
    distinct = F.array_distinct(F.filter(F.transform(raws, lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != ""))
    listed = F.array_join(F.transform(distinct, lambda x: F.concat(F.lit('- "'), x, F.lit('"'))), "\n")
    return F.when(F.size(distinct) > 0, F.concat(F.lit("Available citations:\n"), listed)).otherwise("Available citations: none")


def cited_ids(ids: Column) -> Column:
    """Ids that aren't blank, each once, in order of first appearance."""
    return F.array_distinct(F.filter(F.transform(ids, lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != ""))


def main_categories(categories: Column, most: int = 3) -> Column:
    """What stands before the first full stop of the first ``most`` categories."""
    return F.transform(F.slice(F.filter(F.split(F.trim(categories), r"\s+"), lambda x: x != ""), 1, most), lambda x: F.substring_index(x, ".", 1))


def unwrapped(text: Column) -> Column:
    """The text inside a literal ``'text': '...'``, if it stands in one."""
    inner = F.regexp_extract(text, r"(?s)'text':\s*['\"](.+)", 1)
    return F.when(inner != "", F.regexp_replace(inner, "['\"}]+$", "")).otherwise(text)


def verdict_of(raw: Column) -> Column:
    """The verdict of a judge's JSON reply, with or without a fence; ``Inconclusive`` if it is no JSON."""
    bare = F.regexp_replace(F.trim(raw), r"^`+(?:json)?\s*|`+$", "")
    return F.coalesce(F.try_variant_get(F.try_parse_json(bare), "$.verdict", "string"), F.lit("Inconclusive"))
