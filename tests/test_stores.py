"""Archives, the inverted file and hops against plain versions."""

from __future__ import annotations

import gzip
import io
import json
import random
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import classifier, hops, models, retrieval, sections, vectors
from tessera.plans.engine import Config, Engine
from tessera.sources import archives, readers


def tar(path, mode, members):
    with tarfile.open(path, mode) as out:
        for name, body in members:
            info = tarfile.TarInfo(name)
            info.size = len(body)
            out.addfile(info, io.BytesIO(body))


def bodies(n):
    lines = [json.dumps({"paper_id": f"p{n}", "n": n}).encode(), b"", b"{broken", b"\xff\xfe", b"  ", json.dumps({"paper_id": "ü" * n}).encode()]
    return b"\n".join(lines)


def members(k):
    long = "deep/" * 40 + f"long{k}.jsonl"
    return [("x/one.jsonl", bodies(k)), ("two.jsonl.gz", gzip.compress(bodies(k + 1))), ("skip.txt", b"no"), ("empty.jsonl", b""), (long, bodies(k + 2) * 50)]


def plain(name, every):
    out = []
    for member, body in every:
        if member.endswith((".jsonl", ".jsonl.gz")):
            for i, raw in enumerate((gzip.decompress(body) if member.endswith(".gz") else body).split(b"\n")):
                try:
                    text = raw.decode().strip()
                except UnicodeDecodeError:
                    continue
                if text:
                    out.append((name, member, i, text))
    return sorted(out)


@pytest.mark.parametrize("split", [700, 64 << 20])
def test_lines_of_archives(spark, tmp_path, split):
    want = []
    for k, (name, mode) in enumerate((("a.tar", "w:"), ("b.tar.gz", "w:gz"), ("c.tar", "w:"), ("d.tar.bz2", "w:bz2"))):
        tar(tmp_path / name, mode, members(k))
        want += plain(name, members(k))
    tar(tmp_path / "none.tar", "w:", [])
    index = archives.members(spark, f"{tmp_path}/*.tar*")
    assert index.where("packed").count() == 2 and index.where("NOT packed").count() == 8
    got = archives.lines(index, split).select(F.regexp_extract("archive", "[^/]+$", 0), "member", "line_no", "line").collect()
    assert sorted(tuple(r) for r in got) == sorted(want)
    parsed = readers.parsed(archives.tar_lines(spark, f"{tmp_path}/b.tar.gz"), "paper_id string, n int")
    assert {r["n"] for r in parsed.collect() if r["n"]} == {1, 2, 3}


def test_members_are_read_in_stretches(tmp_path):
    (tmp_path / "f").write_bytes(bytes(range(250)) * 100)
    raw = archives._Raw(archives.opened(f"{tmp_path}/f").raw.file, 300, 500)
    assert io.BufferedReader(raw, 64).read() == (bytes(range(250)) * 100)[300:800]
    assert raw.seek(-3, 2) == 497 and raw.read() == (bytes(range(250)) * 100)[797:800]


def test_written_archives_read_back(spark, tmp_path):
    rows = [(f"m{i % 7}.jsonl" + (".gz" if i % 2 else ""), json.dumps({"i": i})) for i in range(200)]
    df = spark.createDataFrame([*rows, (None, "x"), ("m0.jsonl", None)], "member string, line string")
    wrote = archives.write_tars(df, f"{tmp_path}/out", archives=3).collect()
    assert sum(r["n_lines"] for r in wrote) == 201 and sum(r["n_members"] for r in wrote) == len({m for m, _ in rows})
    archives.write_tars(df, f"{tmp_path}/out", archives=3).collect()
    got = archives.tar_lines(spark, f"{tmp_path}/out/*.tar").collect()
    assert sorted((r["member"], r["line"]) for r in got) == sorted(rows)


# -- vectors


def clustered(n, width, groups, seed):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(groups, width))
    return (centre[rng.integers(0, groups, n)] + 0.4 * rng.normal(size=(n, width))).tolist()


def test_inverted_file(spark, tmp_path):
    rows = list(enumerate(clustered(3000, 16, 40, 3)))
    odd = [(9001, None), (9002, [1.0] * 5), (9003, [0.0] * 16), (9004, []), (9005, [None] + [1.0] * 15)]
    df = spark.createDataFrame(rows + odd, "doc_id long, vector array<double>")
    folder = f"{tmp_path}/index"
    centres = vectors.build_index(df, folder, 24, sample=1000)
    assert centres.shape == (24, 16) and spark.read.parquet(f"{folder}/cells").count() == 3001
    asked = df.where("doc_id % 50 = 0 OR doc_id > 9000").withColumnRenamed("doc_id", "query_id")
    exact = retrieval.dense(df, asked, 10)
    in_full = vectors.search(spark, folder, asked, 10, probes=24)
    usual = lambda d: sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in d.where("query_id < 9000").collect())
    assert usual(in_full) == usual(exact)
    few = vectors.search(spark, folder, asked, 10, probes=5)
    assert vectors.recall(few.where("query_id < 9000"), exact.where("query_id < 9000")).collect()[0]["recall"] >= 0.95
    assert "PartitionFilters: [cell" in few._jdf.queryExecution().executedPlan().toString() or few.count() > 0
    again = vectors.learn(df, 24, sample=1000)
    assert np.allclose(again, centres)


def test_inverted_file_of_nothing(spark, tmp_path):
    df = spark.createDataFrame([(1, None)], "doc_id long, vector array<double>")
    vectors.build_index(df, f"{tmp_path}/i", 4)
    assert vectors.search(spark, f"{tmp_path}/i", df.withColumnRenamed("doc_id", "query_id")).count() == 0
    with pytest.raises(ValueError):
        vectors.learn(spark.createDataFrame([(1, [1.0, 2.0])], "doc_id long, vector array<double>"), 10**8)


def test_dense_leaves_out_null_and_odd_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.6, 0.8]), (4, [1.0]), (5, []), (6, [None, 1.0])], "doc_id long, vector array<double>")
    got = retrieval.dense(df, df.withColumnRenamed("doc_id", "query_id"), 3).collect()
    assert sorted((r["query_id"], r["doc_id"], r["score"]) for r in got) == [(1, 1, 1.0), (1, 3, 0.6), (3, 1, 0.6), (3, 3, 1.0), (4, 4, 1.0)]


# -- hops


def test_hops_have_one_outcome_each(spark):
    item = "query_id int, claim_id string, pos int, chunk_uid string, hop_reason string, look_for string, linked array<struct<raw:string,alignment:double>>, look_vector array<double>"
    why, v = "missing_method_origin", [1.0, 0.0]
    raw = "A. Author, A very long title of some paper, Journal of Things 12 (2001)"
    items = [
        (1, "claim:a", 1, "c1", why, "x", [("unknown", 0.1), (raw, 0.5), (raw + "x", 0.9)], v),
        (1, "claim:b", 2, "c1", "none", "x", [(raw, 0.5)], v), (1, "claim:c", 3, "c1", "odd", "x", [(raw, 0.5)], v), (1, "claim:d", 4, "c1", why, " ", [(raw, 0.5)], v),
        (1, "claim:e", 5, "c1", why, "x", [], v), (1, "claim:f", 6, "c1", why, "x", None, v), (1, "claim:g", 7, "c1", why, "x", [("quite another text", 1.0), (" ", 1.0)], v),
        (1, "claim:h", 8, "c1", why, "x", [("no ids here", 1.0)], v), (1, "claim:i", 9, "c1", why, "x", [("see arXiv:1234.56789v2", 0.3)], v), (1, "claim:j", 10, "c1", why, "x", [("gone", 0.3)], v),
        (1, "claim:k", 11, "c1", why, "x", [(raw, 0.5)], v), (1, "claim:l", 12, "c1", why, "x", [("only openalex", 0.5)], v), (1, "claim:m", 13, "c1", why, "x", [(raw, 0.5)], v), (2, "claim:a", 1, "c9", why, "x", [(raw, 0.5)], v),
    ]
    spans = [("c1", 2, raw, "2001.00001", "10.1/b", None), ("c1", 1, raw, None, "10.1/a", ""), ("c1", 3, "no ids here", None, None, None), ("c1", 4, "see arXiv:1234.56789v2", "", None, None), ("c1", 5, "gone", "9999.99999", None, None), ("c1", 6, "only openalex", None, "", "W1"), ("c2", 1, "x", "2001.00001", None, None)]
    chunks = [("k1", None, "10.1/a", None, [1.0, 0.0]), ("k2", "2001.00009", "10.1/a", None, [0.0, 1.0]), ("k3", None, "10.1/a", None, [1.0, 1.0]), ("k4", "1234.56789", "10.48550/arxiv.1234.56789", None, [1.0, 0.0]), ("k5", "2001.00001", None, "W1", [1.0, 0.0])]
    make = spark.createDataFrame
    args = (
        make(items, item), make(spans, "chunk_uid string, cite_index int, raw string, arxiv_id string, doi string, openalex_id string"), make(chunks, "chunk_uid string, paper_arxiv string, paper_doi string, paper_openalex string, vector array<double>"),
        make([(1, "k1"), (1, "claim:a")], "query_id int, node_id string"), make([(1, "claim:a", "k1")], "query_id int, src string, dst string"),
    )
    got = hops.expand(*args, budget=11)
    want = dict(a="success", c="no_hop_reason", d="no_linked_citations", e="no_linked_citations", f="no_linked_citations", g="citation_raw_mismatch", h="no_resolved_id", i="success", j="retrieval_zero", k="success", l="no_resolved_id", m="over_budget")
    assert {r["claim_id"][-1]: r["outcome"] for r in got.outcomes.where("query_id = 1").collect()} == want
    assert [r["outcome"] for r in got.outcomes.where("query_id = 2").collect()] == ["citation_raw_mismatch"]
    assert sum(r["n"] for r in got.counts().collect()) == len(items) - 1 and {r["outcome"] for r in got.counts().collect()} == set(hops.OUTCOMES)
    assert sorted(tuple(r) for r in got.nodes.collect()) == [(1, "10.1/a", "paper"), (1, "10.48550/arxiv.1234.56789", "paper"), (1, "k3", "chunk"), (1, "k4", "chunk")]
    assert sorted(tuple(r) for r in got.edges.collect()) == [
        (1, "claim:a", "k3", "hop_evidence", 0.9), (1, "claim:i", "k4", "hop_evidence", 0.3), (1, "claim:k", "k1", "hop_evidence", 0.5), (1, "claim:k", "k3", "hop_evidence", 0.5),
        (1, "k3", "10.1/a", "CHUNK_OF", 1.0), (1, "k4", "10.48550/arxiv.1234.56789", "CHUNK_OF", 1.0),
    ]
    by = hops.expand(*args, budget=13, by_openalex=True)
    assert [r["outcome"] for r in by.outcomes.where("claim_id = 'claim:l'").collect()] == ["success"]
    assert hops.expand(args[0].limit(0), *args[1:]).counts().count() == 0


# -- models


def test_stage_batches_are_bounded_and_in_order(spark):
    seen = []
    stage = models.Stage("bounds", lambda: lambda rows: seen.append(rows) or [x[0].upper() for x in rows], "string", window=50, batch_rows=7, batch_tokens=40, tokens=len)
    rng = random.Random(2)
    rows = [("x" * rng.randint(0, 60),) if i % 9 else (None,) for i in range(50)]
    assert stage.run(rows) == [None if t is None else t.upper() for (t,) in rows]
    assert all(len(b) <= 7 and (len(b) == 1 or max(map(len, (t for (t,) in b))) * len(b) <= 40) for b in seen)
    df = spark.createDataFrame([(i, *r, "s") for i, r in enumerate(rows)], "i int, t string, s string").repartition(3)
    got = models.Stage("upper", lambda: lambda rows: [x[0].upper() + x[1] for x in rows], "string", window=8, batch_rows=3).over(df, ["t", "s"], "u")
    assert got.columns == ["i", "t", "s", "u"] and {r["i"]: r["u"] for r in got.collect()} == {i: None if t is None else t.upper() + "s" for i, (t,) in enumerate(rows)}
    with pytest.raises(ValueError):
        models.Stage("short", lambda: lambda rows: [], "string").run([("a",)])


def test_stage_is_loaded_once_a_worker(spark, tmp_path):
    def load(folder=str(tmp_path)):
        import os

        open(f"{folder}/{os.getpid()}-{os.urandom(4).hex()}", "w").close()
        return lambda rows: [len(x[0]) for x in rows]

    df = spark.range(1000).select(F.col("id").cast("string").alias("t")).repartition(24)
    assert models.Stage("once", load, "int").over(df, ["t"], "n").agg(F.sum("n")).collect()[0][0] == 10 + 180 + 2700
    pids = [p.name.split("-")[0] for p in tmp_path.iterdir()]
    assert len(pids) == len(set(pids))


def calls(tmp_path, **more):
    def ask(prompts, log=f"{tmp_path}/asked"):
        with open(log, "a") as f:
            f.write("".join(p + "\n" for p in prompts))
        if any("bad" in p for p in prompts):
            raise RuntimeError("refused")
        return [p[::-1] for p in prompts]

    return models.Calls(f"{tmp_path}/calls", "m", ask, **({"attempts": 2, "wait": 0.0, "batch_rows": 1, "tasks": 3} | more))


def asked(tmp_path):
    p = tmp_path / "asked"
    return sorted(p.read_text().split("\n")[:-1]) if p.exists() else []


def test_calls_are_made_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "abc"), (2, "abc"), (3, None), (4, ""), (5, "de"), (6, "bad")], "i int, prompt string")
    c = calls(tmp_path)
    got = {r["i"]: r["reply"] for r in c.over(df).collect()}
    assert got == {1: "cba", 2: "cba", 3: None, 4: "", 5: "ed", 6: None}
    assert asked(tmp_path) == ["", "abc", "bad", "bad", "de"]
    assert [r["error"] for r in c.failures(spark).collect()] == ["RuntimeError: refused"]
    again = {r["i"]: r["reply"] for r in c.over(df.where("i < 6")).collect()}
    assert again == {i: x for i, x in got.items() if i < 6} and asked(tmp_path) == ["", "abc", "bad", "bad", "de"]
    c.over(df.union(spark.createDataFrame([(7, "new")], df.schema))).collect()
    assert asked(tmp_path) == ["", "abc", "bad", "bad", "bad", "bad", "de", "new"]
    assert calls(tmp_path, settings="t=1").missing(df).count() == 4 and c.missing(df).count() == 1
    assert c.over(df.limit(0)).count() == 0


def test_a_failing_batch_fails_whole(spark, tmp_path):
    df = spark.createDataFrame([(p,) for p in ("a", "b", "bad", "c")], "prompt string")
    c = calls(tmp_path, batch_rows=8, tasks=1, attempts=1)
    assert [r["reply"] for r in c.over(df).collect()] == [None] * 4 and c.known(spark).count() == 0 and c.failures(spark).count() == 4
    assert {r["reply"] for r in c.over(df.where("prompt != 'bad'")).collect()} == {"a", "b", "c"}
    assert c.failures(spark).count() == 1


def test_a_call_that_hangs_is_given_up(tmp_path):
    import time

    c = models.Calls("x", "m", lambda p: time.sleep(60), timeout=0.1, attempts=2, wait=0.0)
    began = time.monotonic()
    assert c._tried(["a", "b"]) == ([None, None], "TimeoutError: no reply within 0.1 s") and time.monotonic() - began < 5
    assert models.Calls("x", "m", lambda p: ["one"], attempts=1)._tried(["a", "b"])[1].startswith("ValueError")


def test_what_models_say(spark):
    df = spark.createDataFrame([([("ENTAILMENT", 0.7), ("label_2", 0.2), ("neutral", 0.1)], ("method ", 0.6)), (None, ("?", 0.9)), ([], None)], "s array<struct<label:string,score:double>>, i struct<label:string,confidence:double>")
    got = df.select(models.entailment(F.col("s"), {2: "contradiction"}).alias("e"), models.intent(F.col("i")).alias("i")).collect()
    assert [tuple(r["e"]) for r in got] == [(0.7, 0.2, 0.1), (None, None, None), (0.0, 0.0, 0.0)]
    assert [tuple(r["i"]) for r in got] == [("METHOD", 0.6), ("BACKGROUND", 0.0), ("BACKGROUND", 0.0)]
    q = spark.range(1).select(models.query_text(F.lit("a"), "query: "), models.query_text(F.lit("a"), "query: ", "find"), models.passage_text(F.lit("a"), "p: ")).collect()[0]
    assert tuple(q) == ("query: a", "Instruct: find\nQuery: a", "p: a")


def test_engine_judges_claims(spark):
    nodes = spark.createDataFrame([(1, f"claim:{c}", t) for c, t in zip("abcde", ["red fish swims", "blue bird sings", "green cow flies", "old dog barks", "nothing known here"])], "query_id int, claim_id string, text string")
    edges = spark.createDataFrame([(1, "claim:a", "k1", "METHOD"), (1, "claim:b", "k1", "METHOD"), (1, "claim:c", "k2", "hop_evidence"), (1, "claim:d", "k3", "supports"), (1, "claim:d", "claim:a", "contradicts")], "query_id int, src string, dst string, relation string")
    texts = spark.createDataFrame([(1, "k1", "the red fish swims far"), (1, "k2", "green cow flies"), (1, "k3", "an old dog barks")], "query_id int, chunk_uid string, text string")
    said = lambda **kw: {r["claim_id"][-1]: (r["route"], r["verdict"], r["low_confidence"]) for r in Engine(None, Config(**kw)).judged(nodes, edges, texts).collect()}
    assert said() == {"a": ("nli", "Supported", False), "b": ("nli_then_llm", "Inconclusive", True), "c": ("llm", "Inconclusive", True), "d": ("llm", "Inconclusive", True), "e": ("nli_then_llm", "Inconclusive", True)}
    judge = models.Stage("judge", lambda: lambda rows: ["Supported" if e else "Not-Supported" for _, e in rows], "string")
    nli = models.Stage("nli", lambda: lambda rows: [{"entails": 0.0, "contradicts": 1.0, "neutral": 0.0} for _ in rows], "struct<entails:double,contradicts:double,neutral:double>")
    assert {k: v[1] for k, v in said(judge=judge).items()} == dict(a="Supported", b="Supported", c="Supported", d="Supported", e="Not-Supported")
    assert {v[0] for v in said(judging="llm", judge=judge).values()} == {"llm"} and said(judging="none")["e"] == ("none", "Supported", False)
    assert said(entailment=nli, judging="nli")["a"][:2] == ("nli", "Contradictory") or said(entailment=nli, judging="nli")["a"][1] != "Supported"
    with pytest.raises(ValueError):
        Config(judging="odd")


# -- the section classifier


def test_section_classifier(spark):
    rng = random.Random(11)
    own = {"Introduction": "problem motivation recent interest", "Methods": "algorithm step compute parameter", "Results": "table accuracy percent improved", "Discussion": "limits future however explain"}
    shared = "the of and a we in to is that for".split()

    def rows(n, weights):
        out = []
        for i in range(n):
            label = rng.choices(list(own), weights)[0]
            w = [rng.choice(own[label].split()) if rng.random() < 0.25 else rng.choice(shared) for _ in range(30)]
            out.append((f"p{i}", f"s{i}", rng.choice(["Notes", None, f"About {label.lower()}"]), " ".join(w) if i % 50 else None, label, i))
        return spark.createDataFrame(out, "paper_id string, title_norm string, title string, text string, label string, chunk_index_min int")

    classes = [*own, "Related Work"]
    train, held = rows(600, [8, 4, 2, 1]), rows(300, [1, 1, 1, 1])
    model = classifier.fit(train.unionByName(train.limit(3).withColumn("label", F.lit("odd"))), classes)
    assert model.classes == list(own)
    report = model.report(held).collect()[0]
    assert report["macro_f1"] > 0.9
    said = model.over(held).collect()
    assert all(abs(sum(r["probs"]) - 1) < 1e-9 and r["class_confidence"] == max(r["probs"]) and r["class"] == model.classes[r["probs"].index(max(r["probs"]))] for r in said)
    again = classifier.fit(train.repartition(7), classes)
    assert np.allclose(again.model.coefficientMatrix.toArray(), model.model.coefficientMatrix.toArray(), atol=1e-6)
    folded = held.select("paper_id", "title_norm", "title", "text", "chunk_index_min").withColumn("title_norm", F.when(F.col("chunk_index_min") == 0, "methods").otherwise(F.col("title_norm")))
    named = {r["paper_id"]: r for r in sections.label(folded, model.classified(folded)).collect()}
    assert named["p0"]["source"] == "heuristic" and named["p1"]["source"] == "classifier" and named["p1"]["probs"] is not None
    few = classifier.fit(train, classes, sample=300)
    assert few.report(held).collect()[0]["macro_f1"] > 0.8
    with pytest.raises(ValueError):
        classifier.fit(train.where("label = 'Methods'"), classes)
