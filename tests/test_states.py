"""Running sums, samples that merge, resumable aggregates, prepared batches and merge-on-read tables against plain versions."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import answers, evaluation, graph, profile, ranks, resume, sampling, tables
from tessera.plans import report_queries
from tessera.sources import deltas, ranges
from tessera.streaming import ingest


def rows(d, *by):
    return sorted((tuple(r) for r in d.collect()), key=repr)


def no_global_window(df):
    return "Exchange SinglePartition" not in df._jdf.queryExecution().executedPlan().toString()


def test_running_sums_and_places(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(i, rng.choice("abc"), rng.randint(0, 9)) for i in range(500)], "i int, c string, n long").repartition(7)
    got = ranks.running(df, ["c", F.desc("i")], {"before": F.col("n"), "place": F.lit(1).cast("long")})
    w = Window.orderBy("c", F.desc("i")).rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumns({"before": F.coalesce(F.sum("n").over(w), F.lit(0)), "place": F.count("*").over(w)})
    assert rows(got) == rows(want) and got.columns == want.columns
    assert rows(ranks.placed(df, ["i"]).select("i", "place")) == sorted(((i, i) for i in range(500)), key=repr)
    assert ranks.placed(df.limit(0), ["i"]).count() == 0


def test_percentiles_and_concentration(spark):
    rng = random.Random(2)
    v = [int(rng.paretovariate(1)) for _ in range(3000)]
    df = spark.createDataFrame([(x,) for x in v] + [(None,)], "v long").repartition(5)
    got = {r["p"]: r["value"] for r in evaluation.percentile_by_index(df, "v", [0, 5, 50, 95, 100]).collect()}
    assert got == {p: sorted(v)[min(int(len(v) * p / 100), len(v) - 1)] for p in (0, 5, 50, 95, 100)}
    share = {r["p"]: r["share"] for r in evaluation.concentration(df.where("v IS NOT NULL"), "v", [1, 10, 100]).collect()}
    assert share == {p: pytest.approx(sum(sorted(v)[-max(1, len(v) * p // 100) :]) / sum(v)) for p in (1, 10, 100)}
    spread = sampling.styles(spark.range(300).select("id", F.concat(F.lit("c"), F.col("id") % 3).alias("category")), "category", "id", 5)
    ids = [r["golden_id"] for r in spread.orderBy("category", "id").collect()]
    assert ids == [f"g_{i:04d}" for i in range(105)] and no_global_window(spread)


def test_samples_merge(spark):
    df = spark.range(5000).select(F.col("id"), (F.col("id") * 3).alias("x"))
    whole = ranks.bottom(df, ["id"], 200)
    parts = [ranks.bottom(df.where(F.col("id") % 3 == k), ["id"], 200) for k in range(3)]
    assert rows(ranks.merged(parts, ["id"], 200)) == rows(whole) and whole.count() == 200
    assert rows(ranks.merged([whole, *parts, whole], ["id"], 200)) == rows(whole)
    mean = np.mean([r["id"] for r in whole.collect()])
    assert abs(mean - 2500) < 400 and rows(ranks.bottom(df, ["id"], 200, seed=1)) != rows(whole)


def test_a_run_that_was_stopped_goes_on(spark, small, tmp_path):
    papers = report_queries._papers(spark, small)
    one = profile.paper_profile(papers)
    read = []

    def partial(some):
        read.append(sorted(r[0] for r in some.select("shard").distinct().collect()))
        if len(read) == 3:
            raise RuntimeError("stopped")
        return profile.paper_profile(some, ("shard",))

    held = resume.Resumable(f"{tmp_path}/state", "shard", partial, resume.sums(one.columns), per_run=2)
    with pytest.raises(RuntimeError):
        held.run(papers)
    assert held.pending(papers).count() == 7
    assert rows(held.run(papers)) == rows(one)
    assert read == [[0, 1], [2, 3], [4, 5], [4, 5], [6, 7], [8, 9], [10]] and rows(held.run(papers)) == rows(one) and len(read) == 7
    none = resume.Resumable(f"{tmp_path}/none", "shard", lambda d: profile.paper_profile(d, ("shard",)), resume.sums(one.columns))
    assert rows(none.run(papers.limit(0))) == rows(profile.paper_profile(papers.limit(0)))


def test_prepared_batches_are_made_once(spark, tmp_path):
    df = tables.batches(spark.range(95).select("id"), 10, "id")
    made = resume.Prepared(f"{tmp_path}/p")
    assert made.reuse(df, 10, sample=25).count() == 30
    stamp = {p: p.stat().st_mtime_ns for p in tmp_path.glob("p/batch=*/*.parquet")}
    assert made.reuse(df, 10).count() == 95 and made.reuse(df, 10, sample=11).count() == 20
    assert all(p.stat().st_mtime_ns == t for p, t in stamp.items()) and len(stamp) == 3


def test_updates_are_merged_when_read(spark, tmp_path):
    rng, want = random.Random(7), {}
    t = deltas.DeltaTable(f"{tmp_path}/t", ("k",), buckets=4, most=3)
    assert t.read(spark, "k int, v string").count() == 0
    for n in range(9):
        new = {rng.randint(0, 60): f"v{n}" for _ in range(15)}
        gone = {rng.randint(0, 60) for _ in range(5)}
        t.update(spark.createDataFrame(list(new.items()), "k int, v string"), spark.createDataFrame([(k,) for k in gone], "k int"))
        want = {k: v for k, v in want.items() if k not in gone} | new
        assert rows(t.read(spark)) == sorted(want.items(), key=repr)
        assert len(t.versions(spark)) <= 4
    fresh = t.absent(spark.createDataFrame([(k,) for k in range(70)], "k int"))
    assert {r["k"] for r in fresh.collect()} == set(range(70)) - set(want)
    (tmp_path / "t" / "v=0000000099-delta").mkdir()
    assert rows(t.read(spark)) == sorted(want.items(), key=repr)
    few = t.absent(spark.createDataFrame([(1,)], "k int"))
    assert "_bucket" in few._jdf.queryExecution().optimizedPlan().toString()
    size = sum(p.stat().st_size for p in tmp_path.glob("t/*base/**/*.parquet"))
    before = set(tmp_path.glob("t/**/*.parquet"))
    t.update(spark.createDataFrame([(1, "x")], "k int, v string"))
    new = set(tmp_path.glob("t/**/*.parquet")) - before
    assert len(new) == 1 and sum(p.stat().st_size for p in new) < size


def test_ingest_reads_the_buckets_of_its_batch(spark, tmp_path):
    schema = "id int, t int"
    for n, ids in enumerate(([1, 2, 2, 3], [3, 4, 1], [5, 4])):
        spark.createDataFrame([(i, 10 * n + k) for k, i in enumerate(ids)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        ingest.ingest(stream, f"{tmp_path}/table", f"{tmp_path}/log", ["id"], ["t"]).awaitTermination()
    assert rows(spark.read.parquet(f"{tmp_path}/table").select("id", "t")) == [(1, 0), (2, 1), (3, 3), (4, 11), (5, 20)]


def test_ranges_cover_every_key_once(spark, tmp_path):
    rng = random.Random(3)
    keys = [rng.choice([7, 7, 7, rng.randint(0, 500)]) for _ in range(2000)] + [None] * 9
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k int, i int")
    t = ranges.RangeTable(f"{tmp_path}/t", "k")
    assert 2 < t.write(df, 8) <= 8
    every = [r["i"] for part in t.readers(spark) for r in part.collect()]
    assert sorted(every) == list(range(len(keys)))
    for low, high in ((7, 8), (None, 100), (250, None), (None, None), (90, 90), (-5, 7), (501, 900)):
        want = sorted(i for i, k in enumerate(keys) if (k is None and low is None) or (k is not None and (low is None or k >= low) and (high is None or k < high)))
        assert sorted(r["i"] for r in t.scan(spark, low, high).collect()) == want
    some = t.scan(spark, 300, 310)
    assert len(some.inputFiles()) > 0 and "_range" in some._jdf.queryExecution().executedPlan().toString()
    read = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_range" in read and "GreaterThanOrEqual(k,300)" in read
    t.export(spark, f"{tmp_path}/out", ["i", "k"], most=50)
    got = sorted(r["k"] for r in spark.read.schema("i int, k int").json(f"{tmp_path}/out").collect() if r["k"] is not None)
    assert got == sorted(k for k in keys if k is not None)[: len(got)] and len(got) == 41
    t.export(spark, f"{tmp_path}/all", ["k"])
    assert spark.read.schema("k int").json(f"{tmp_path}/all").count() == len(keys)
    assert ranges.RangeTable(f"{tmp_path}/e", "k").write(df.limit(0), 4) == 1


def test_weights_of_blank_and_negative_sub_queries(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (1, " ", 5.0), (1, "b", -1.0), (1, "c", 6.0), (2, "d", 0.0), (2, "e", None), (3, None, 1.0)], "query_id int, text string, weight double")
    assert sorted((r["query_id"], r["text"], r["weight"]) for r in answers.weighed(df).collect()) == [(1, "a", 0.25), (1, "b", 0.0), (1, "c", 0.75), (2, "d", 0.5), (2, "e", 0.5)]


def test_texts_of_a_trail(spark):
    trail = spark.createDataFrame([(1, "k1"), (2, "k2"), (3, "k3")], "place int, node_id string")
    chunks = spark.createDataFrame([("k1", "  " + "x" * 500), ("k2", None)], "node_id string, text string")
    assert sorted((r["place"], r["text"]) for r in graph.trail_texts(trail, chunks).collect()) == [(1, "x" * 400), (2, ""), (3, "")]
