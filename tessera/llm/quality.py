"""Quality rules as a short-circuit cascade of native expressions.

A rule is a predicate that rejects a text. Its cost and its selectivity are measured
on a sample, and the rules are nested in one CASE by rejections per cost: a text that
an early rule rejects is never looked at by a later one. The order changes only the
work done; what is kept is the same under any order.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
#: Rows of the sample on which rules are timed, about.
SAMPLE_ROWS = 400
SEED = 17


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def words_of(text: Column) -> Column:
    """Runs of what isn't ASCII white space; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def word_chars(words: Column) -> Column:
    return F.length(F.array_join(words, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return F.coalesce(F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", "")), F.lit(0)).cast("long")


def lines_of(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def n_dup_lines(text: Column) -> Column:
    return let(lines_of(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def n_repeat_words(words: Column, k: int = 3) -> Column:
    """Words inside windows of ``k`` words that the text holds twice or more.

    Windows are compared by a 64-bit hash of their words: within one text of a million
    words two differ unseen with a chance of about one in forty million.
    """

    def covered(windows: Column) -> Column:
        twice = F.transform(
            windows,
            lambda x, i: F.when((F.get(windows, i - 1)["h"] == x["h"]) | (F.get(windows, i + 1)["h"] == x["h"]), x["i"]),
        )
        spread = F.transform(F.filter(twice, lambda p: p.isNotNull()), lambda p: F.sequence(p, p + (k - 1)))
        return F.size(F.array_distinct(F.flatten(spread)))

    n = F.size(words)
    starts = F.sequence(F.lit(0), n - k)
    hashed = F.transform(starts, lambda i: F.struct(F.xxhash64(*[F.get(words, i + j) for j in range(k)]).alias("h"), i.alias("i")))
    return F.when(n >= k, let(F.sort_array(hashed), covered)).otherwise(0).cast("long")


@dataclass(frozen=True)
class Rule:
    """``rejects`` makes the predicate from the columns ``text`` and ``words``."""

    name: str
    rejects: Callable[[Column, Column], Column]


def _share(part: Column, whole: Column, percent: int) -> Column:
    return part * 100 > whole * percent


def _few_letters(text: Column, words: Column) -> Column:
    return F.size(F.filter(words, lambda w: w.rlike(r"\p{L}"))) * 100 < F.size(words) * 60


def _shouting(text: Column, words: Column) -> Column:
    upper = F.length(text) - F.length(F.regexp_replace(text, r"[A-Z]+", ""))
    lower = F.length(text) - F.length(F.regexp_replace(text, r"[a-z]+", ""))
    return upper > lower


#: Contract rules: few words, and many words in repeated windows.
BASE_RULES = [
    Rule("few_words", lambda t, w: F.size(w) < 50),
    Rule("repeats", lambda t, w: _share(n_repeat_words(w), F.size(w), 50)),
]
METHOD_RULES = [
    Rule("symbols", lambda t, w: _share(n_symbols(t), F.size(w), 10)),
    Rule("exclaims", lambda t, w: _share(F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit(""))), F.size(w), 10)),
    Rule("shouting", _shouting),
    Rule("word_length", lambda t, w: (word_chars(w) < F.size(w) * 2) | (word_chars(w) > F.size(w) * 15)),
    Rule("few_letters", _few_letters),
    Rule("dup_lines", lambda t, w: let(lines_of(t), lambda x: _share(F.size(x) - F.size(F.array_distinct(x)), F.size(x), 50))),
]


@dataclass(frozen=True)
class Measured:
    rule: Rule
    cost: float
    rejected: float

    @property
    def worth(self) -> float:
        return self.rejected / max(self.cost, 1e-9)


def measure(docs: DataFrame, rules: list[Rule], text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Measured]:
    """Seconds and share of rejected rows of each rule on about ``sample_rows`` rows.

    Each row of the table is drawn with the same chance, so the sample is as large at any
    size of the table and only its rows are moved. The whole table if that has fewer rows.
    """
    share = min(1.0, sample_rows / max(1, docs.count()))
    drawn = docs.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).where(F.rand(SEED) < share).repartition(1)
    sample = drawn.withColumn("words", words_of(F.col("text"))).persist()
    try:
        n = max(1, sample.count())
        found = []
        for rule in rules:
            query = sample.agg(F.count_if(rule.rejects(F.col("text"), F.col("words"))).alias("n"))
            query.collect()  # the first run compiles
            began = time.perf_counter()
            rejected = query.collect()[0]["n"]
            found.append(Measured(rule, time.perf_counter() - began, rejected / n))
        return found
    finally:
        sample.unpersist()


def plan(measured: list[Measured]) -> list[Rule]:
    """The rules by rejections per cost, the best first; ties by cost, then by name."""
    return [m.rule for m in sorted(measured, key=lambda m: (-m.worth, m.cost, m.rule.name))]


def rejected_by(rules: list[Rule], text: Column, words: Column) -> Column:
    """True where a rule rejects. CASE stops at the first that does."""
    case = F
    for rule in rules:
        case = case.when(F.coalesce(rule.rejects(text, words), F.lit(False)), F.lit(True))
    return case.otherwise(F.lit(False)) if rules else F.lit(False)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Counts of every whole text, whether the base rules reject it and whether it is kept.

    A null or empty text has no words and fails the base rules. A null id stays null;
    repeated rows give repeated rows; an empty table gives none. Other columns are not
    read.
    """
    rules = plan(measure(docs, METHOD_RULES, text_col, sample_rows))
    text, words = F.col("text"), F.col("words")
    found = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).withColumn("words", words_of(text))
    counted = found.withColumns({
        "n_words": F.size(words).cast("long"),
        "word_chars": word_chars(words),
        "n_symbols": n_symbols(text),
        "n_dup_lines": n_dup_lines(text),
        "n_repeat_words": n_repeat_words(words),
    })
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        F.when(failed, False).otherwise(~rejected_by(rules, text, words)).alias("kept"),
    )


def keep(docs: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows that no rule rejects, with all their columns, by one cascade of all rules.

    A null or empty text is rejected. Rows are judged one by one, so ids may be null or
    repeat; an empty table gives none. Columns of any name may stand beside the text.
    """
    rules = plan(measure(docs, [*BASE_RULES, *METHOD_RULES], text_col, sample_rows))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.where(let(words_of(text), lambda words: ~rejected_by(rules, text, words)))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d
), p AS (
  SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w
), x AS (
  SELECT r, i, word, lead(word, 1) OVER q AS b, lead(word, 2) OVER q AS c FROM p WINDOW q AS (PARTITION BY r ORDER BY i)
), t AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, word, b, c) AS n FROM x WHERE c IS NOT NULL
), v AS (
  SELECT r, count(DISTINCT i + k) AS n FROM t, (VALUES (0), (1), (2)) s(k) WHERE n > 1 GROUP BY r
), f AS (
  SELECT w.r, doc_id, text, lines, words, len(words)::BIGINT AS n_words,
    length(array_to_string(words, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(v.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN v USING (r)
), g AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed
    OR 100 * n_symbols > 10 * n_words
    OR 100 * length(regexp_replace(text, '[^!]', '', 'g')) > 10 * n_words
    OR length(regexp_replace(text, '[^A-Z]', '', 'g')) > length(regexp_replace(text, '[^a-z]', '', 'g'))
    OR word_chars < 2 * n_words OR word_chars > 15 * n_words
    OR 100 * len(list_filter(words, lambda x: regexp_matches(x, '\p{L}'))) < 60 * n_words
    OR 100 * n_dup_lines > 50 * len(lines)) AS kept
FROM g
"""
