"""Near-duplicates, repeated windows and benchmark items against plain versions."""

from __future__ import annotations

import hashlib
import itertools
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tessera.llm import decontaminate, simhash, substrings
from tessera.llm.common import stored, table
from tessera.llm.components import roots

from .helpers import LOREM, components, edge_docs, edge_rows, lower, words


def plain_fingerprint(text: str | None, k: int = 4) -> int:
    w = words(lower(text))
    runs = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(r.encode(), seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, small):
    rows = [(r[0], r[1]) for r in table(spark, small, "documents").select("doc_id", "text").collect()]
    rows += [(9000 + i, r[1]) for i, r in enumerate(edge_rows())]
    fps = [plain_fingerprint(t) for _, t in rows]
    pairs = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if (fps[i] ^ fps[j]).bit_count() <= 4]
    order = sorted(range(len(rows)), key=lambda i: rows[i][0])
    place = {i: k for k, i in enumerate(order)}
    root = components(len(rows), [(place[i], place[j]) for i, j in pairs])
    want = sorted((rows[i][0], f"{fps[i]:016x}", rows[order[root[place[i]]]][0]) for i in range(len(rows)))
    got = simhash.near_duplicates(edge_docs(spark, [(i, t, None, None, None) for i, t in rows]))
    assert sorted(map(tuple, got.collect())) == want
    assert simhash.near_duplicates(edge_docs(spark).limit(0)).count() == 0


def test_tiles_lose_no_link(spark):
    rng = random.Random(3)
    fps = {0, (1 << 64) - 1}
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(30):
            fps.add(x)
            x ^= 1 << rng.randrange(64)
    fps = sorted(fps)
    pairs = [(i, j) for i, j in itertools.combinations(range(len(fps)), 2) if (fps[i] ^ fps[j]).bit_count() <= 4]
    want = components(len(fps), pairs)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    for tile in (8, 512):
        got = simhash.links(df, 4, tile).collect()
        at = {signed(x): i for i, x in enumerate(fps)}
        assert components(len(fps), [(at[r[0]], at[r[1]]) for r in got]) == want


def test_null_ids_and_repeats_in_simhash(spark):
    got = simhash.near_duplicates(edge_docs(spark)).collect()
    assert len(got) == len(edge_rows())
    assert {r["component_id"] for r in got if r["doc_id"] in (1, 2)} == {1}
    assert {r["component_id"] for r in got if r["doc_id"] in (4, 5, 6)} == {4}


def test_components(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(200)] + [(500, 500)] + [(1000, rng.randrange(1001, 1100)) for _ in range(80)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(110)]
    got = {r["node"]: r["root"] for r in roots(spark.createDataFrame(pairs, "u long, v long")).collect()}
    want = components(3000, pairs)
    nodes = {x for p in pairs if p[0] != p[1] for x in p}
    assert got == {x: want[x] for x in nodes}


def sets_of(text: str | None) -> set:
    w = words(lower(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_buckets_are_not_broadcast(spark):
    rng = random.Random(8)
    fps = [rng.getrandbits(63) for _ in range(200)]
    nodes = stored(spark.createDataFrame([(x ^ (1 << k),) for x in fps for k in range(3)], "fp long"))
    found = simhash.links(nodes)
    assert found.count() == len(found.collect()) >= 400
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan
    sizes = stored(nodes.groupBy("fp").agg(F.count("*").alias("n")))
    both = simhash.joined(nodes, sizes, ["fp"], "fp", "n")
    assert both.count() == 600 and both._jdf.queryExecution().optimizedPlan().toString().count("strategy=merge") == 1


def test_one_of_each_group_stays(spark, small):
    docs = table(spark, small, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    sets = [sets_of(t) for _, t in rows]
    like = lambda a, b: (not a and not b) or len(a & b) >= 0.8 * len(a | b)
    root = components(len(rows), [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if like(sets[i], sets[j])])
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()}
    groups: dict[int, list[int]] = {}
    for (i, _), r in zip(rows, root, strict=True):
        groups.setdefault(r, []).append(i)
    assert kept == {min(g) for g in groups.values()}
    again = simhash.drop_near_duplicates(edge_docs(spark))
    assert again.columns == edge_docs(spark).columns
    assert sorted(r["doc_id"] for r in again.collect() if r["doc_id"] is not None) == [1, 4, 7, 10, 11, 12]
    assert simhash.drop_near_duplicates(edge_docs(spark).limit(0)).count() == 0


def test_near_copies_off_the_hub_are_joined(spark):
    # A and B are at 0.85, each with a nearer copy; a larger group holds the tile's hub.
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(5000)]
    rows: list[tuple[int, str]] = []
    for _ in range(30):
        a = [rng.choice(vocab) for _ in range(300)]
        b = list(a)
        for k in (40, 90, 140, 190, 240):
            b[k] = rng.choice(vocab)
        for x in (a, b):
            near = list(x)
            near[5] = rng.choice(vocab)
            rows += [(len(rows), " ".join(x)), (len(rows) + 1, " ".join(near))]
    base = [rng.choice(vocab) for _ in range(300)]
    for i in range(12):
        x = list(base)
        x[100 + i] = rng.choice(vocab)
        rows.append((len(rows), " ".join(x)))
    sets = [sets_of(t) for _, t in rows]
    want = components(len(rows), [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(edge_docs(spark, [(i, t, None, None, None) for i, t in rows])).collect()}
    assert len(set(want)) == 31 and kept == set(want)


def borderline_rows(groups: int, large: int) -> list[tuple[int, str]]:
    """Groups of six texts with one or two changed words of 110, around the similarity of 0.8, and one large group of such."""
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(5000)]
    rows: list[tuple[int, str]] = []
    for size in [6] * groups + [large]:
        base = [rng.choice(vocab) for _ in range(110)]
        for _ in range(size):
            x = list(base)
            for _ in range(rng.choice((1, 2))):
                x[rng.randrange(110)] = rng.choice(vocab)
            rows.append((len(rows), " ".join(x)))
    return rows


def test_borderline_groups_and_hot_buckets(spark, monkeypatch):
    rows = borderline_rows(100, 300)
    sets = [sets_of(t) for _, t in rows]
    holders: dict = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    shared: dict = {}
    for own in holders.values():
        for p in itertools.combinations(own, 2):
            shared[p] = shared.get(p, 0) + 1
    linked = [p for p, k in shared.items() if k >= 0.8 * (len(sets[p[0]]) + len(sets[p[1]]) - k)]
    want = components(len(rows), linked)
    monkeypatch.setattr(simhash, "HOT_ROWS", 20)
    for weight in (simhash.TILE_WEIGHT, 32):
        got = {r["id"]: r["root"] for r in simhash.groups(edge_docs(spark, [(i, t, None, None, None) for i, t in rows]), weight=weight).collect()}
        assert sum(got[a] == got[b] for a, b in linked) >= 0.98 * len(linked)
        assert all(want[i] == want[r] for i, r in got.items())
    assert 150 < len(set(want)) < 600 and len(linked) > 10_000


def test_tiles_by_population_count_lose_no_pair():
    rng = np.random.default_rng(2)
    x, y = (rng.integers(0, 1 << 63, n, np.uint64) & rng.integers(0, 1 << 63, n, np.uint64) for n in (300, 200))
    y[:100] = x[:100] ^ (np.uint64(1) << rng.integers(0, 63, 100).astype(np.uint64))
    want = {(i, j) for i in range(300) for j in range(200) if int(x[i] ^ y[j]).bit_count() <= 8}
    for tile in (7, 256):
        found = [z for i, j, _ in simhash.tiled((x,), (y,), 8, tile) for z in zip(i.tolist(), j.tolist(), strict=True)]
        assert len(found) == len(set(found)) and set(found) == want


def plain_dedup(rows: list[tuple], k: int = 20) -> list[tuple]:
    seen, out = set(), []
    for key, text in rows:
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            x = tuple(w[i : i + k])
            if x in seen:
                gone[i : i + k] = [True] * k
            seen.add(x)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((key, len(w), sum(gone), hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest()))
    return out


def test_substrings(spark, small):
    rows = sorted((r[0], r[1]) for r in table(spark, small, "documents").select("doc_id", "text").collect() if r[1] is not None)
    assert sorted(map(tuple, substrings.dedup(table(spark, small, "documents")).collect())) == plain_dedup(rows)


def test_substrings_that_branch(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(40)]
    common = [[rng.choice(vocab) for _ in range(rng.randrange(18, 90))] for _ in range(12)]
    rows = []
    for i in range(150):
        parts = []
        for _ in range(rng.randrange(0, 7)):
            c = rng.choice(common)
            a = rng.randrange(0, len(c) - 5)
            parts += c[a : a + rng.randrange(5, len(c))] if rng.random() < 0.7 else [rng.choice(vocab) for _ in range(rng.randrange(1, 30))]
        rows.append((i - 50, " ".join(parts)))
    rows += [(200, "same " * 500), (201, "same " * 30), (202, "a b " * 60), (203, "a b " * 60), (204, None), (205, "")]
    got = substrings.dedup(edge_docs(spark, [(i, t, None, None, None) for i, t in rows]))
    assert sorted(map(tuple, got.collect())) == plain_dedup(rows)


def test_substrings_of_edge_rows(spark):
    got = substrings.dedup(edge_docs(spark)).collect()
    assert len(got) == len(edge_rows())
    by: dict = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[1][0]["n_removed"] == 0 and by[2][0]["n_removed"] == by[2][0]["n_words"] == len(LOREM)
    assert by[8][0] == by[8][1] and substrings.dedup(edge_docs(spark).limit(0)).count() == 0


def test_repeats_compact_and_are_verified_at_their_sources(spark):
    found = [(1, 10, 3, 0, 5), (1, 13, 2, 0, 8), (1, 15, 4, 0, 11), (1, 19, 1, 2, 12), (1, 20, 1, 2, 13), (3, 0, 5, 1, 0)]
    spans = substrings.compact(spark.createDataFrame(found, "key long, start long, windows long, src_key long, src_start long"))
    assert sorted(map(tuple, spans.select("key", "start", "windows", "src_key", "src_start").collect())) == [(1, 10, 5, 0, 5), (1, 15, 4, 0, 11), (1, 19, 2, 2, 12), (3, 0, 5, 1, 0)]
    one, other = [b"a%d" % i for i in range(60)], [b"a%d" % (i + 7) for i in range(53)]
    at = lambda what, start: {"start": start, "windows": 9, "what": what, "src_key": 4, "src_start": 10}
    for words, wrong in ((other, False), ([*other[:20], b"x", *other[21:]], True)):
        rows = [(substrings.checks(one, [at(substrings.SOURCE, 10)]),), (substrings.checks(words, [at(substrings.REMOVE, 3), at(substrings.SPELL, 0)]),), (None,)]
        assert substrings.differ(spark.createDataFrame(rows, "checks binary")) == wrong
    assert substrings.differ(spark.createDataFrame([], "checks binary")) is False


def plain_chains(found: list[tuple]) -> list[tuple]:
    """Spans of (key, start, windows, src_key, src_start) places, chained where no place goes on otherwise."""
    first = {(k, s): (a, b) for k, s, _, a, b in found}
    path = {(k, s): first.get(src, src) for (k, s), src in first.items()}
    width = {path[k, s]: n for k, s, n, _, _ in found}
    path |= {p: p for p in width}
    places: dict = {}
    for at, p in path.items():
        places.setdefault(p, []).append(at)
    then = {p: {path.get((k, s + width[p])) for k, s in at} for p, at in places.items()}
    link = {p: q for p, (q, *more) in then.items() if not more and q is not None and len(places[q]) == len(places[p])}
    spans = []
    for p in set(places) - set(link.values()):
        n, q = width[p], p
        while q in link:
            q = link[q]
            n += width[q]
        spans += [(k, s, n, *p) for k, s in places[p] if (k, s) != p]
    return sorted(spans)


def test_chains_of_paths(spark):
    rng = random.Random(8)
    passages = [[(i, j) for j in range(rng.randrange(1, 40))] for i in range(9)]
    texts = []
    for _ in range(60):
        text: list = []
        for _ in range(rng.randrange(1, 6)):
            c = rng.choice(passages)
            text += c[: rng.randrange(1, len(c) + 1)] if rng.random() < 0.5 else c
        texts.append(text)
    widths = {w: 1 + sum(w) % 5 for c in passages for w in c}
    seen, near, found = {}, {}, []
    for k, text in enumerate(texts):
        s = 0
        for w in text:
            if w in seen:  # a repeat names the first of its ten texts, which names the first of all
                found.append((k, s, widths[w], *near.get((k // 10, w), seen[w])))
            seen.setdefault(w, (k, s))
            near.setdefault((k // 10, w), (k, s))
            s += widths[w]
    schema = "key long, start long, windows long, src_key long, src_start long"
    got = substrings.compact(spark.createDataFrame(found, schema)).select("key", "start", "windows", "src_key", "src_start")
    want = plain_chains(found)
    assert sorted(map(tuple, got.collect())) == want and len(want) < len(found)
    assert substrings.compact(spark.createDataFrame([], schema)).count() == 0
    copy = [(1, 2 * i, 2, 0, 2 * i) for i in range(3000)]
    assert [tuple(r) for r in substrings.compact(spark.createDataFrame(copy, schema)).select("key", "start", "windows", "src_key", "src_start").collect()] == [(1, 0, 6000, 0, 0)]


def plain_edits(item: list[str], text: list[str]) -> int:
    cost = [0] * (len(text) + 1)
    for x in item:
        new = [cost[0] + 1]
        for j, y in enumerate(text):
            new.append(min(cost[j] + (x != y), cost[j + 1] + 1, new[j] + 1))
        cost = new
    return min(cost)


def test_decontamination(spark, small):
    items = [(r[0], r[1]) for r in table(spark, small, "benchmark").select("item_id", "text").collect()]
    docs = [(r[0], r[1]) for r in table(spark, small, "documents").select("doc_id", "text").orderBy("doc_id").limit(60).collect()]
    rng = random.Random(2)
    for i, (item, text) in enumerate(items):
        w = text.split()
        for _ in range(rng.randrange(0, max(1, len(decontaminate.words_of(text)) // 8))):
            k = rng.randrange(len(w))
            w[k : k + rng.randrange(0, 2)] = [] if rng.random() < 0.4 else ["changed"]
        docs.append((100_000 + i, " ".join([*LOREM[: rng.randrange(30)], *w, *LOREM[: rng.randrange(30)]])))
    df = edge_docs(spark, [(i, t, None, None, None) for i, t in docs])
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontaminate.matches(df, table(spark, small, "benchmark")).collect()}
    want = {}
    tokens = {i: decontaminate.words_of(t) for i, t in items}
    for d, text in docs:
        w = decontaminate.words_of(text)
        for i, item in tokens.items():
            allowed = int(len(item) * 0.2 + 1e-9)
            if len(set(item) & set(w)) + allowed >= len(set(item)) and (e := plain_edits(item, w)) <= allowed:
                want[d, i] = e
    assert set(got) <= set(want) and len(got) >= 0.99 * len(want) and len(want) >= 0.8 * len(items)
    assert all(got[k] >= want[k] for k in got) and sum(got[k] == want[k] for k in got) >= 0.95 * len(got)
    clean = decontaminate.drop_contaminated(df, table(spark, small, "benchmark"))
    assert clean.columns == df.columns
    assert {r["doc_id"] for r in clean.collect()} == {d for d, _ in docs} - {d for d, _ in got}


def test_recall_holds_for_each_size_of_item():
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range((10, 150)[i % 2]))) for i in range(110)]
    texts, want = [], []
    for i, text in items * 4:
        w = text.split()
        for _ in range(len(w) // 5):
            k = rng.randrange(len(w))
            w[k : k + rng.randrange(0, 2)] = [] if rng.random() < 0.4 else ["changed"]
        texts.append(" ".join([*LOREM[: rng.randrange(30)], *w, *LOREM[: rng.randrange(30)]]))
        want.append((i, plain_edits(text.split(), texts[-1].split())))
    got = decontaminate.Matcher(items).find(texts)
    for odd in (0, 1):
        have = [next((m[3] for m in ms if m[0] == i), None) for ms, (i, _) in zip(got, want, strict=True) if i % 2 == odd]
        due = [e for i, e in want if i % 2 == odd]
        assert sum(h is not None for h in have) >= 0.99 * len(due)
        assert all(h is None or h >= e for h, e in zip(have, due, strict=True))


def test_decontamination_of_edge_rows(spark):
    bench = spark.createDataFrame([(1, " ".join(LOREM[:20])), (2, None), (3, ""), (4, "word"), (4, "word")], "item_id long, text string").withColumn("doc_id", F.lit("x"))
    got = decontaminate.matches(edge_docs(spark), bench)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == {(i, 1) for i in (1, 2, 3, 8, 9, None)} | {(7, 4)}
    assert decontaminate.matches(edge_docs(spark), bench.limit(0)).count() == 0 == decontaminate.matches(edge_docs(spark).limit(0), bench).count()
    assert decontaminate.drop_contaminated(edge_docs(spark), bench.limit(0)).count() == len(edge_rows())


def test_edit_distance():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a, b = rng.integers(0, 4, rng.integers(1, 9)), rng.integers(0, 4, rng.integers(1, 25))
        edits, s, e = decontaminate.edit_distance_within(a, b)
        assert edits == plain_edits(a.tolist(), b.tolist()) and 0 <= s <= e <= b.size
        assert plain_edits(a.tolist(), b[s:e].tolist()) == edits


def test_walks_find_items_of_every_size():
    rng = np.random.default_rng(6)
    words = [f"w{k}" for k in range(3000)]
    drawn = lambda n: [words[k] for k in rng.zipf(1.25, n) % 3000]
    for n in (10, 40, 100, 300, 1000):
        items = [(i, drawn(n)) for i in range(3)]
        matcher = decontaminate.Matcher([(i, " ".join(w)) for i, w in items])
        assert (matcher.walks > 0).all() and (matcher.sampled > 0).all()
        texts, met = [], 0
        for k in range(100 if n < 100 else 12):
            copy, d = list(items[k % 3][1]), int(0.2 * n)
            for _ in range(d):
                at, kind = int(rng.integers(0, len(copy))), rng.integers(0, 3)
                copy[at : at + (kind != 1)] = [] if kind == 2 else ["changed"]
            texts.append(" ".join(drawn(60) + copy + drawn(60)))
        for k, got in enumerate(matcher.find(texts)):
            met += any(i == k % 3 and e <= 0.2 * n for i, _, _, e in got)
        assert met >= 0.99 * len(texts), (n, met, matcher.walks.tolist(), matcher.sampled.tolist())
