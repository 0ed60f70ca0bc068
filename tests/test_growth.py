"""What grows with the input: rows that joins and windows give, and work that is done once."""

from __future__ import annotations

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import scores
from tessera.functions.text import bound
from tessera.operators import citations, classifier, hops, lookups, profile, retrieval
from tessera.plans import report_queries


def most_rows(df) -> int:
    """The most rows that a step of the plan gave when ``df`` was collected."""

    def walk(p) -> int:
        kind = p.getClass().getSimpleName()
        inner = [p.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [p.plan()] if kind.endswith("QueryStageExec") else [p.children().apply(i) for i in range(p.children().size())]
        own = p.metrics().get("numOutputRows")
        return max([own.get().value() if own.isDefined() else 0, *map(walk, inner)])

    return walk(df._jdf.queryExecution().executedPlan())


def test_titles_of_the_same_words_meet_once(spark):
    names = ["red ring", "blue ring", "ring red"]
    papers = spark.createDataFrame([(i, f"{names[i % 3]} part of all") for i in range(3000)] + [(None, "blue ring part"), (None, None)], "paper_id long, title string")
    asked = spark.createDataFrame([(i, f'Smith. "{names[i % 2]} part" 1999') for i in range(300)] + [(300, 'A. "green ring part" 1999'), (301, None)], "citation_id long, raw string")
    found = lookups.by_title(asked, papers)
    every = [tuple(r) for r in found.collect()]
    got = sorted((r for r in every if r[0] < 2 or r[0] > 299), key=lambda r: (r[0], r[2]))
    assert got == [(0, 0, 1), (0, 2, 2), (1, None, 1), (1, 1, 2)]
    assert len(every) == 600 and most_rows(found) <= 4 * 3002


def test_entries_are_parsed_once(spark, small):
    entries = spark.createDataFrame([('{"doi": 7, "DOI": null, "ids": {"doi": " D ", "arxiv": "cs/1"}, "raw": " W "}',), ("[1]",), ("no",), (None,)], "e string")
    ids = entries.select(citations.entry_ids(F.col("e")).alias("x"))
    assert [tuple(r) for r in ids.select("x.*").collect()] == [("D", "cs/1", None, None)] + 3 * [(None,) * 4]
    assert [r[0] for r in spark.range(3).select(bound(F.col("id") + 1, lambda x: x * x)).collect()] == [1, 4, 9]
    for made in (ids, profile.per_paper(report_queries._papers(spark, small))):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert 1 <= plan.count("parseJson") <= 2


def test_only_items_within_the_budget_are_kept(spark):
    rows = [(q, f"c{i}", i, "x", "whim" if i % 5 == 0 else "none" if i % 5 == 1 else hops.REASONS[0], "" if i % 5 == 2 else "m", None if i % 5 == 3 else [("r", 0.5)]) for q in range(3) for i in range(200)]
    items = spark.createDataFrame(rows + [(None, "n", 1, "x", "whim", "m", None)], "query_id int, claim_id string, pos int, chunk_uid string, hop_reason string, look_for string, linked array<struct<raw:string,alignment:double>>").repartition(5)
    within, over = hops.candidates(items, 7)
    got = sorted(tuple(r) for r in within.where("query_id = 1").select("pos", "wrong").collect())
    assert got == [(0, "no_hop_reason"), (2, "no_linked_citations"), (3, "no_linked_citations"), (4, None), (5, "no_hop_reason"), (7, "no_linked_citations"), (8, "no_linked_citations")]
    assert within.count() == 22 and over.count() == 3 * (160 - 7) and over.columns == hops.ITEM


def test_a_much_cited_paper_is_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "HOP_BLOCK", 16)
    rng = random.Random(4)
    some = [[float(rng.randint(-3, 3)) for _ in range(4)] for _ in range(40)] + [[0.0] * 4, [1.0, 2.0], None, [1.0, None, 2.0, 3.0]]
    cited = [(i, "p", "d" if i % 2 else "", some[i % 44]) for i in range(60)] + [(60, "", None, some[0]), (61, "none", None, some[0])]
    chunks = [(f"c{i:03d}", "p" if i % 3 else None, "d" if i % 2 else "", some[(7 * i) % 44]) for i in range(150)]
    a, b = spark.createDataFrame(cited, "citation_id long, arxiv string, doi string, vector array<double>"), spark.createDataFrame(chunks, "chunk_uid string, paper_arxiv string, paper_doi string, vector array<float>")
    found = retrieval.hop(a, b, 3)
    got = sorted(tuple(r) for r in found.collect())
    met = a.alias("a").join(b.alias("b"), F.expr("(a.arxiv != '' AND a.arxiv = b.paper_arxiv) OR (a.doi != '' AND a.doi = b.paper_doi)"))
    plain = met.select("citation_id", "chunk_uid", scores.cosine(F.col("a.vector"), F.col("b.vector")).alias("score"))
    w = Window.partitionBy("citation_id").orderBy(F.desc(F.round("score", 9)), "chunk_uid")
    want = plain.withColumn("rank", F.row_number().over(w)).where("rank <= 3")
    assert found.columns == ["citation_id", "chunk_uid", "score", "rank"] and got == sorted(tuple(r) for r in want.collect())
    assert retrieval.hop(a.limit(0), b).count() == 0 and most_rows(found) < plain.count()


def test_sections_of_usual_titles_are_not_classified(spark):
    class Whole(classifier.Classifier):
        def over(self, found):
            return found.withColumns({"class": F.lit("Methods"), "class_confidence": F.lit(0.9), "probs": F.array(F.lit(0.9))})

    folded = spark.createDataFrame([(t, t) for t in ("methods", "lattice models", "references", "results")] + [("none", None)], "paper_id string, title_norm string")
    got = Whole(None, ["Methods"]).classified(folded)
    assert sorted(r["paper_id"] for r in got.collect()) == ["lattice models", "none"]
