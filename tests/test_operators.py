"""Operators on small hand-made inputs."""

from __future__ import annotations

import datetime
import json
import random
import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import imrad, scores, text
from tessera.operators import answers, chunking, citations, evaluation, graph, retrieval, sections, tables
from tessera.plans import queries
from tessera.plans.engine import Config
from tessera.sources import readers, writers
from tessera.streaming import ingest


def one(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0]["x"]


def test_citation_sentences():
    known = {"abc123": {"doi": "10.1/x", "raw": "A"}, "def456": {}}
    clean, spans = chunking.citations("First sentence. Claim with support {{cite:abc123}} continues here. Last sentence.", known)
    assert len(spans) == 1 and clean[spans[0]["start"] : spans[0]["end"]] == "Claim with support  continues here." and spans[0]["doi"] == "10.1/x"
    clean, spans = chunking.citations("Same sentence {{cite:abc123}} and again {{cite:def456}}.", known)
    assert [clean[s["start"] : s["end"]] for s in spans] == ["Same sentence  and again ."] * 2
    clean, spans = chunking.citations("This follows Phys. Rev. Lett. closely {{cite:abc123}} and stays in one sentence. Next sentence.", known)
    assert clean[spans[0]["start"] : spans[0]["end"]].endswith("in one sentence.")


def test_markers_become_captions():
    assert chunking.substitute_markers("See {{figure:a-1}} and {{table:b}}.", {"a-1": "Loss"}) == "See [Figure: Loss] and ."


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=40))
def test_windows_cover_all_sentences(sizes):
    parts = ["W" + " w" * (n - 1) + "." for n in sizes]
    body = " ".join(parts)
    found = chunking.windows(body, 80, 80, 20)
    assert found[0][0] == 0 and found[-1][1] == len(body)
    assert all(b2 <= e1 + 1 for (_, e1), (b2, _) in zip(found, found[1:], strict=False))
    assert all(len(body[b:e].split()) <= 80 or body[b:e].count(".") == 1 for b, e in found)
    assert all(b1 < b2 for (b1, _), (b2, _) in zip(found, found[1:], strict=False))


def test_cleaning(spark):
    assert one(spark, text.embed_text(F.lit("NP-hard problem , , , and there is a vast literature."))) == "NP-hard problem, and there is a vast literature."
    assert one(spark, text.section_title(F.lit("  "))) == "Body" == one(spark, text.section_title(F.lit(None).cast("string")))
    assert one(spark, text.uuid5_oid(F.lit("abc"))) == str(uuid.uuid5(uuid.NAMESPACE_OID, "abc"))
    assert one(spark, text.judged_relation(F.lit("Not-Supported"))) == "judged_not_supported"


@pytest.mark.parametrize(
    "raw,arxiv,doi",
    [
        ("x in arXiv:1502.03167, 2015.", "1502.03167", "10.48550/arxiv.1502.03167"),
        ("x https://arxiv.org/abs/2005.14165, 2020.", "2005.14165", "10.48550/arxiv.2005.14165"),
        ("x arXiv:1706.03762v5, 2017.", "1706.03762", "10.48550/arxiv.1706.03762"),
        ("x doi:10.1109/CVPR.2016.90, 2016.", "", "10.1109/CVPR.2016.90"),
        ("doi:10.1/xx? doi:10.1234/abc and arXiv:2101.00001", "2101.00001", "10.1234/abc"),
        ("x arXiv:cs/0705001, 2011.", "cs/0705001", "10.48550/arxiv.cs/0705001"),
        (None, "", ""),
    ],
)
def test_ids_in_text(spark, raw, arxiv, doi):
    assert tuple(one(spark, text.ids_in_text(F.lit(raw).cast("string")))) == (arxiv, doi)


def test_blend_and_weights(spark):
    rows = [(1, 0.8), (2, 0.8), (2, 0.1), (2, 0.15), (3, 0.7), (3, 0.05), (3, 0.05), (4, None)]
    got = {r["claim_id"]: r for r in graph.verdicts(spark.createDataFrame(rows, "claim_id int, entails double").withColumns({"contradicts": F.lit(0.0), "neutral": F.lit(0.0)})).collect()}
    assert got[1]["entail"] == pytest.approx(0.8) and got[2]["entail"] == pytest.approx(0.62)
    assert [got[i]["verdict"] for i in (1, 2, 3, 4)] == ["Supported", "Neutral", "Neutral", "Not-Supported"]
    w = spark.createDataFrame([(1, 0.3), (1, 0.3), (2, 0.0), (2, 0.0)], "q int, w double").select(scores.budget_weights(F.col("w"), "q").alias("w"))
    assert [r["w"] for r in w.collect()] == [0.5] * 4


def test_boost_and_best(spark):
    hits = spark.createDataFrame([(1, "a", "Methods", 5.0), (1, "b", "Introduction", 4.8), (1, "c", "Results", 4.6)], "query_id int, doc_id string, section string, score double").withColumn("targets", F.array(F.lit("Methods"), F.lit("Results")))
    assert {r["doc_id"]: round(r["score"], 6) for r in retrieval.section_boost(hits).collect()} == {"a": 5.5, "b": 4.8, "c": 5.1}
    dup = spark.createDataFrame([("uid1", "A", 3.2, 0), ("uid1", "A", 7.8, 1), ("uid2", "A", 5.0, 2), ("uid1", "B", 5.0, 3)], "chunk_uid string, paper_id string, score double, pos int")
    assert {(r["chunk_uid"], r["paper_id"]): r["score"] for r in retrieval.keep_best(dup).collect()} == {("uid1", "A"): 7.8, ("uid2", "A"): 5.0, ("uid1", "B"): 5.0}


def test_repair(spark):
    rows = [("p", 0, "Introduction", "heuristic", None), ("p", 1, "Introduction", "classifier", [0.05, 0.6, 0.2, 0.1, 0.05]), ("p", 2, "Results", "heuristic", None)]
    df = spark.createDataFrame([(p, i, f"t{i}", label, s, 0.9, x) for p, i, label, s, x in rows], "paper_id string, chunk_index_min int, title_norm string, label string, source string, confidence double, probs array<double>")
    got = {r["chunk_index_min"]: (r["label"], r["source"]) for r in sections.repair(df).collect()}
    assert got == {0: ("Introduction", "heuristic"), 1: ("Methods", "sequence_repair"), 2: ("Results", "heuristic")}
    order = lambda *x: one(spark, imrad.in_order(F.array(*map(F.lit, x))))
    assert order("Introduction", "Methods", "Discussion") and not order("Methods", "Introduction")


def test_links_of_claims(spark):
    linked = spark.createDataFrame([(1, 0, "c", " Smith et al. BEIR 2021. "), (2, 0, "c", "Smith et al BEIR 2021"), (3, 0, "c", "arXiv:2101.00001 only"), (4, 0, "c", "nothing like it")], "claim_id int, link_pos int, chunk_uid string, raw string")
    spans = spark.createDataFrame([("c", 0, "Smith et al. BEIR 2021.", "P1"), ("c", 1, "Smith et al. BEIR 2021.", "P2")], "chunk_uid string, cite_index int, raw string, paper_id string")
    got = {r["claim_id"]: (r["paper_id"], r["how"]) for r in citations.link_claims(linked, spans).collect()}
    assert got == {1: ("P1", "equal"), 2: ("P1", "similar"), 3: ("2101.00001", "in_text")}


def test_items_of_answers(spark):
    said = ['```json\n[{"a": 1}, 2]\n```', 'Here: [{"a": 2}] done', "not json", '{"a": 3}', None]
    got = answers.parse_items(spark.createDataFrame(list(enumerate(said)), "i int, t string"), "i", "t").collect()
    assert [(r["id"], json.loads(r["item"])["a"]) for r in sorted(got)] == [(0, 1), (1, 2), (3, 3)]


def test_readers_and_writers(spark, tmp_path):
    assert readers.jsonl(spark, f"{tmp_path}/missing.jsonl", "a int").count() == 0
    df = spark.createDataFrame([(i, i % 3, f"t{i}") for i in range(30)], "id int, shard int, text string")
    assert writers.write_shards(df.where("shard < 2"), f"{tmp_path}/shards").count() == 20
    assert writers.write_shards(df, f"{tmp_path}/shards").count() == 30
    for k in range(7):
        writers.upsert_table(df.where(f"id <= {k}").withColumn("text", F.lit(f"v{k}")), f"{tmp_path}/t", ["id"], keep=3)
    assert len(writers.versions(spark, f"{tmp_path}/t")) == 3
    assert {r["text"] for r in writers.read_version(spark, f"{tmp_path}/t").collect()} == {"v6"}
    writers.write_batches(df, f"{tmp_path}/b", 10, "id")
    assert spark.read.json(f"{tmp_path}/b").groupBy("batch").count().count() == 3


def test_registry_match(spark):
    refs = spark.createDataFrame([(1, 'Smith, "Attention is all you need again", 2017'), (2, "Nobody. Unheard words entirely here. 1999")], "source_ref_id int, raw string")
    known = spark.createDataFrame([(0, 0, "Attention Is All You Need Again", "10.1/a"), (0, 1, "Other Words Altogether", "10.1/b")], "priority int, rank int, title string, doi string")
    assert [(r["source_ref_id"], r["doi"]) for r in citations.match_registry(refs, known).collect()] == [(1, "10.1/a")]


def test_upsert_and_config(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    assert sorted(map(tuple, tables.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "B"), (3, "C")]
    with pytest.raises(ValueError):
        Config(top_k=0)


def test_sentence_ends():
    cut = lambda t: [t[b:e] for b, e in chunking.sentence_spans(t)]
    assert cut("") == cut("  \n ") == []
    assert cut(" One here.  Two (see Fig. 3) there! ") == ["One here.", "Two (see Fig. 3) there!"]
    assert cut("The rate is 3.14 in all. By J. R. Smith et al. It holds.") == ["The rate is 3.14 in all.", "By J. R. Smith et al. It holds."]
    assert cut('He said "no." Then left.') == ['He said "no."', "Then left."]
    assert cut("Why? (Because.) [1] says so") == ["Why?", "(Because.)", "[1] says so"]
    assert cut("end. lower goes on, e.g. This! Not i.e. That") == ["end. lower goes on, e.g. This!", "Not i.e. That"]
    assert cut("! Odd start. And so on...") == ["!", "Odd start.", "And so on..."]
    assert chunking.enclosing([(2, 5), (8, 9)], 0, 12) == (2, 5) and chunking.enclosing([(2, 5), (8, 9)], 6, 12) == (8, 9) == chunking.enclosing([(2, 5), (8, 9)], 8, 12)
    assert chunking.enclosing([(2, 5), (8, 9), (10, 12)], 6, 12) == (10, 12) and chunking.enclosing([], 3, 7) == (0, 7)


def test_titles_score_by_word_sets(spark):
    pairs = [
        ("BERT: Pre-training of Deep Bidirectional Transformers", "BERT: Pre-training of Deep Bidirectional Transformers for Language Understanding", 1.0),
        ("deep learning", "deep learning of many unrelated graph problems at scale", 2 / 7), ("Attention", "Attention is all you need", 0.25), ("", "x", 0.0), ("$x$ energy gl_2", "energy gl 2", 1.0),
    ]
    df = spark.createDataFrame([(a, b, x) for a, b, x in pairs], "a string, b string, x double")
    for r in df.withColumn("got", text.title_score(F.col("a"), F.col("b"))).collect():
        assert r["got"] == pytest.approx(r["x"]), r


def plain_selection(claims: list[tuple], n_sub: int, most: int, least: int) -> list[str]:
    """claims: (id, text, sub-queries, score)."""
    floor, full, chosen, said = max(least, most // max(n_sub, 1)), {}, [], set()
    best_first = sorted(claims, key=lambda c: (-c[3], c[0]))
    for c in best_first:
        room = [q for q in (c[2] or [0]) if full.get(q, 0) < floor]
        if c[1] not in said and room:
            full[room[0]] = full.get(room[0], 0) + 1
            chosen.append(c[0])
            said.add(c[1])
    for c in best_first:
        if len(chosen) < most and c[1] not in said:
            chosen.append(c[0])
            said.add(c[1])
    return chosen


def test_claims_fill_their_sub_queries(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for q in range(40):
        n_sub, own = rng.randrange(0, 6), []
        for i in range(rng.randrange(1, 40)):
            own.append((f"c{i:03d}", f"text {rng.randrange(30)}", [rng.randrange(max(n_sub, 1)) for _ in range(rng.randrange(0, 4))], round(rng.random(), 1)))
        want[q] = plain_selection(own, n_sub, 12, 2)
        rows += [(q, *c, n_sub) for c in own]
    df = spark.createDataFrame([(q, i, t, s, n, x) for q, i, t, s, x, n in rows], "query_id long, claim_id string, text string, sub_queries array<int>, n_sub_queries int, claim_score double")
    got: dict = {}
    for r in answers.select_claims(df).orderBy("query_id", "ordinal").collect():
        got.setdefault(r["query_id"], []).append(r["claim_id"])
    assert got == want


def test_registry_matches_are_those_of_all_pairs(spark):
    rng = random.Random(5)
    common, rare = ["model", "data", "learning", "deep", "system"], [f"term{i}" for i in range(60)]
    titles = [" ".join(rng.choice(common if rng.random() < 0.6 else rare) for _ in range(rng.randrange(2, 9))) for _ in range(150)]
    refs = []
    for i in range(120):
        t = rng.choice(titles).split()
        if rng.random() < 0.5:
            t = [rng.choice(rare) for _ in range(rng.randrange(0, 6))] + t
        refs.append((i, '"' + " ".join(t) + ' and more words"' if rng.random() < 0.3 else '"' + " ".join(t).ljust(12) + '"'))
    a = spark.createDataFrame(refs, "source_ref_id long, raw string")
    b = spark.createDataFrame([(i % 3, i, t, f"10.1/{i}") for i, t in enumerate(titles)], "priority int, rank int, title string, doi string")
    every = a.withColumn("hint", text.title_hint(F.col("raw"))).crossJoin(b).where(text.title_score(F.col("hint"), F.col("title")) >= 0.85)
    want = {r["source_ref_id"]: r["x"]["doi"] for r in every.groupBy("source_ref_id").agg(F.min(F.struct("priority", "rank", "doi")).alias("x")).collect()}
    assert {r["source_ref_id"]: r["doi"] for r in citations.match_registry(a, b).collect()} == want and len(want) > 60


def test_cycles_are_strong_components(spark):
    rng = random.Random(7)
    edges = {(q, f"n{rng.randrange(25):02d}", f"n{rng.randrange(25):02d}") for q in range(6) for _ in range(10 + 8 * q)}
    edges |= {(9, f"m{i:02d}", f"m{(i + 1) % 30:02d}") for i in range(30)} | {(10, f"m{i:02d}", f"m{i + 1:02d}") for i in range(30)} | {(11, "a", "a")}
    reach = {(q, a, b) for q, a, b in edges}
    while True:
        more = {(q, a, d) for q, a, b in reach for p, c, d in edges if p == q and b == c} - reach
        if not more:
            break
        reach |= more
    df = spark.createDataFrame([(q, a, b, "supports") for q, a, b in edges], "query_id int, src string, dst string, relation string")
    assert {(r["query_id"], r["node_id"]) for r in graph.cyclic_nodes(df).collect()} == {(q, a) for q, a, b in reach if a == b}


def test_items_are_held_whole(spark):
    docs = spark.createDataFrame([(1, "one two three four five"), (2, "xone two threex"), (3, None), (4, "two"), (5, "one\ntwo three")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "one two three"), (2, "two"), (3, " "), (4, "two three"), (5, "e two t"), (6, "absent word here")], "query_id long, text string")
    got = {(r["query_id"], r["doc_id"]) for r in evaluation.holders(docs, items).collect()}
    rows = {1: "one two three four five", 2: "xone two threex", 4: "two", 5: "one\ntwo three"}
    want = {(q, d) for q, t in [(1, "one two three"), (2, "two"), (4, "two three"), (5, "e two t"), (6, "absent word here")] for d, x in rows.items() if t in x}
    assert got == want


def test_labels_of_nodes_and_metrics(spark):
    label = lambda *v: one(spark, text.display_label(*[F.lit(x).cast("string") for x in v[:5]], F.lit(v[5]).cast("int")))
    assert label("paper", "paper:1234567890123456", "", "", "", None) == "paper:1234567890" and label("paper", "p", "", "1706.03762", "", None) == "1706.03762"
    assert label("chunk", "c", "", "", "Methods", 3) == "Methods · 3" and label("chunk", "c", "", "", None, None) == "chunk"
    assert label("claim", "claim:abcdef", "a b c d e f g", "", "", None) == "a b c d e f…" and label("claim", "claim:abcdef", " ", "", "", None) == "abcdef"
    assert one(spark, text.metric_key(F.lit("Claim-Coverage  score [GEval]"))) == "claim_coverage_score"
    assert one(spark, text.key_phrases(F.lit("short. This one is long enough. Third piece here"))) == ["This one is long enough"]


def test_claim_queries_are_those_of_a_plain_choice(spark, small):
    scored: dict = {}
    for r in queries._scored(spark, small).collect():
        scored.setdefault(r["query_id"], []).append((r["claim_id"], r["text"], r["sub_queries"], r["claim_score"]))
    want = {q: plain_selection(own, 5, 12, 2) for q, own in scored.items()}
    got: dict = {}
    for r in queries.claim_selection(spark, small).orderBy("query_id", "ordinal").collect():
        got.setdefault(r["query_id"], []).append(r["claim_id"])
    assert got == want
    # A sentence cites its own claim and the one before; numbers follow first appearance.
    cited = {(r["query_id"], r["sentence_pos"], r["chunk_uid"]): r["number"] for r in queries.citation_numbering(spark, small).collect()}
    plain = {}
    for q, ids in want.items():
        seen: dict = {}
        for pos in range(1, len(ids) + 1):
            for ordinal in (pos, pos - 1):
                if 1 <= ordinal <= len(ids):
                    plain[q, pos, ids[ordinal - 1]] = seen.setdefault(ids[ordinal - 1], len(seen) + 1)
    assert cited == plain


def test_windows_over_several_batches_and_late_rows(spark, tmp_path):
    schema = "ts timestamp, kind string"
    at = lambda h, m: datetime.datetime(2024, 1, 1, h, m)
    batches = [[(at(1, 5), "a"), (at(1, 50), "a"), (at(2, 1), "b")], [(at(1, 59), "a"), (at(9, 0), "a")], [(at(1, 30), "a"), (at(9, 30), "a")]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
        counts = ingest.windowed_counts(ingest.file_stream(spark, str(tmp_path / "in"), schema), "ts", "kind")
        ingest.keep_updates(counts, str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    got = {(r["start"].hour, r["kind"]): r["n"] for r in ingest.latest_updates(spark, str(tmp_path / "out"), ["start", "kind"], "n").collect()}
    # The last row of one o'clock comes after the watermark has passed its window.
    assert got == {(1, "a"): 3, (2, "b"): 1, (9, "a"): 2}


def test_sections_are_given_when_their_paper_has_ended(spark, tmp_path):
    schema = "paper_id string, title_norm string, chunk_index int, text string, time timestamp"
    at = lambda h, m: datetime.datetime(2024, 1, 1, h, m)
    rows = [("p", "intro", 1, "second", at(1, 10)), ("p", "intro", 0, "first", at(1, 0)), ("q", "intro", 0, "other", at(8, 0))]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = ingest.sections_when_complete(ingest.file_stream(spark, str(tmp_path / "in"), schema), "time")
    out, log = str(tmp_path / "out"), str(tmp_path / "log")
    for _ in range(2):
        stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
        spark.createDataFrame([("r", "end", 0, "x", at(20, 0))], schema).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    got = {(r["paper_id"], r["chunk_index_min"], r["n_chunks"], r["text"]) for r in spark.read.parquet(out).collect()}
    assert ("p", 0, 2, "first") in got
