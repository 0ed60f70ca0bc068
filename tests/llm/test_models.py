"""Pieces, the language model, language identification and the pipeline."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import langid, lm, pieces
from tessera.llm.common import table

from .helpers import crc, edge_docs, edge_rows, lower, words


def test_pieces_round_trip(spark, small):
    docs = edge_docs(spark, [(r[0], r[1], None, None, None) for r in table(spark, small, "documents").select("doc_id", "text").collect()] + edge_rows())
    got = pieces.encode(docs)
    rows = got.collect()
    assert all(r["lossless"] for r in rows) and len(rows) == docs.count()
    back = pieces.decode_column(got.where("doc_id is not null").dropDuplicates(["doc_id"]))
    want = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    assert all(want[r["doc_id"]] == r["text"] for r in back.where("doc_id not in (1,2,3,4,5,6,7,8,9,10,11,12)").collect())
    assert {r["n_ids"] for r in rows if r["ids"] is None} == {None}
    assert pieces.encode(docs.limit(0)).count() == 0


def test_pieces_without_dropout_are_the_usual_ones(spark, small):
    usual = sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)
    enc = pieces.Encoder(pieces.Vocabulary.load(pieces.DEFAULT_MODEL))
    checked = 0
    for r in table(spark, small, "documents").limit(80).collect():
        for line in (r["text"] or "").split("\n"):
            ids = usual.encode(line)
            if line and line == " ".join(line.split()) and usual.decode(ids) == line:
                assert enc.encode(line) == ids
                checked += 1
    assert checked > 50


def test_dropout_varies_and_is_keyed():
    v = pieces.Vocabulary.load(pieces.DEFAULT_MODEL)
    text = "Several sentences are encoded in several ways, all of them without loss. " * 3
    a, b = (pieces.Encoder(v, 1, 0.2) for _ in range(2))
    found = {tuple(a.encode(text, k)) for k in range(40)}
    assert len(found) > 3 and all(pieces.decode(v, x) == text for x in found)
    assert [a.encode(text, k) for k in range(9)] == [b.encode(text, k) for k in range(9)]
    assert len(pieces.Encoder(v, 1, 1.0).encode(text, 1)) > len(pieces.Encoder(v).encode(text))


def plain_merges(v, segment: str, skip) -> list[int]:
    """One agenda a segment: the candidate of the best level, leftmost, merged or skipped, until none is left."""
    symbols = [(i, c.replace(" ", pieces.SPACE) if c != pieces.SPACE else None, c) for i, c in enumerate(segment)]
    judged: set = set()
    while True:
        best = None
        for k in range(len(symbols) - 1):
            (at, a, _), (to, b, _) = symbols[k], symbols[k + 1]
            made = v.ids.get(a + b) if a and b else None
            if made is not None and a in v.ids and b in v.ids and (at, to, made) not in judged and (best is None or v.level[made] < best[0]):
                best = (v.level[made], k, made, (at, to, made))
        if best is None:
            break
        _, k, made, this = best
        if skip(made, symbols[k][0]):
            judged.add(this)
            continue
        symbols[k : k + 2] = [(symbols[k][0], symbols[k][1] + symbols[k + 1][1], symbols[k][2] + symbols[k + 1][2])]
    return [y for _, a, raw in symbols for y in ([v.ids[a]] if a in v.ids else [v.byte_ids[b] for b in raw.encode()])]


def test_dropout_is_that_of_a_plain_agenda():
    v = pieces.Vocabulary.load(pieces.DEFAULT_MODEL)
    texts = [" international co-operation, 3.14159 and  more", "            deep\n\n   ", " ﷽☃ naïve ▁mark▁ 🜚x", "x" * 60 + " " + "ab" * 40, "the " * 30, "", None]
    for rate in (0.0, 0.1, 0.5, 1.0):
        enc = pieces.Encoder(v, 5, rate)
        for turn in range(2):  # the second time from what is held
            ids, sizes = enc.encode_all(texts, [7 * i + turn for i in range(len(texts))])
            ends = [0, *sizes.cumsum().tolist()]
            for i, text in enumerate(texts):
                key, at, want = enc.key_of(7 * i + turn), 0, []
                for x in pieces.SEGMENT.findall(" " + text) if text else []:
                    limit = min(int(rate * 2.0**64), (1 << 64) - 1)
                    skip = lambda made, k, at=at: bool(rate) and (rate >= 1 or pieces.mixed(key ^ (at + k << 24 | made)) < limit)  # noqa: E731, B023
                    want += plain_merges(v, x, skip)
                    at += len(x)
                assert ids[ends[i] : ends[i + 1]].tolist() == want
                assert pieces.decode(v, want) == (text or "")


def test_dropout_varies_with_place_and_document():
    v = pieces.Vocabulary.load(pieces.DEFAULT_MODEL)
    enc = pieces.Encoder(v, 17, 0.1)
    word = " international"

    def cuts(text: str, key: int) -> list[tuple[int, ...]]:
        out, own, have = [], (), ""
        for i in enc.encode(text, key):
            own, have = (*own, i), have + pieces.decode(v, [v.ids["a"], i])[1:]
            if have == word:
                out.append(own)
                own, have = (), ""
        return out

    one = cuts((word * 400)[1:], 3)
    assert len(one) == 400 and len(set(one)) > 4
    assert len({tuple(enc.encode(word[1:] * 3, k)) for k in range(400)}) > 4


def plain_base(rows: list[tuple]) -> dict:
    tokens = {i: [*words(lower(t)), None] for i, t in rows}
    count = Counter(x for i, w in tokens.items() if crc(i) != 1 for x in w)
    n, v = sum(count.values()), len(count)
    return {i: (crc(i) == 1, len(w), sum(count[x] > 0 for x in w), n, sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)) for i, w in tokens.items()}


def test_lm(spark, small):
    rows = [(r[0], r[1]) for r in table(spark, small, "documents").select("doc_id", "text").collect()] + [(90_000, None), (90_001, ""), (90_002, "x" * 100_000), (90_003, "zz " * 20_000)]
    want = plain_base(rows)
    df = edge_docs(spark, [(i, t, None, None, None) for i, t in rows])
    for chunk, bucket in ((lm.CHUNK_BYTES, lm.BUCKET_NGRAMS), (20_000, 2_000)):
        got = {r["doc_id"]: r for r in lm.score(df, chunk_bytes=chunk, bucket_ngrams=bucket).collect()}
        assert set(got) == set(want)
        for i, w in want.items():
            r = got[i]
            assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:4]
            assert r["base_score"] == pytest.approx(w[4], rel=1e-9) and r["score"] < 0
        held = [i for i in want if want[i][0] and i < 90_000]
        assert sum(got[i]["score"] for i in held) > sum(got[i]["base_score"] for i in held)
    assert lm.score(df.limit(0)).count() == 0


def test_lm_of_edge_rows(spark):
    got = lm.score(edge_docs(spark)).collect()
    assert len(got) == len(edge_rows()) and all(math.isfinite(r["score"]) for r in got)


def test_language_is_found(spark, small):
    docs = table(spark, small, "documents")
    truth = {r["doc_id"]: r for r in docs.collect()}
    got = langid.identify(docs).collect()
    assert len(got) == len(truth)
    held = [r for r in got if r["held_out"] and truth[r["doc_id"]]["lang"] is not None and words(truth[r["doc_id"]]["text"])]
    assert all(r["held_out"] == (crc(r["doc_id"]) == 0) for r in got)
    assert sum(r["lang_pred"] == truth[r["doc_id"]]["lang"] for r in held) >= 0.9 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_mixtures_have_several_languages(spark):
    en, fr = "the house and the garden of the children with their mother", "la maison et le jardin des enfants avec leur mère dans les rues"
    rows = [(i, f"{en} {i}", "en", None, None) for i in range(1, 40)] + [(i, f"{fr} {i}", "fr", None, None) for i in range(40, 80)]
    model = langid.fit_table(edge_docs(spark, rows), "doc_id", "text", "lang", 100)
    both = langid.predict(edge_docs(spark, [(1, f"{en} " * 5 + f"{fr} " * 4, None, None, None), (2, en, None, None, None), (3, "12 34", None, None, None)]), model)
    got = {r["doc_id"]: r for r in both.collect()}
    assert {x.split(":")[0] for x in got[1]["langs"].split(",")} == {"en", "fr"} and got[2]["langs"] == "en:1.000"
    assert got[3]["lang_pred"] == "und" and got[3]["score"] == 0
    none = langid.identify(edge_docs(spark, [(1, "some words", None, None, None)])).collect()
    assert none[0]["lang_pred"] == "und" and langid.identify(edge_docs(spark).limit(0)).count() == 0
    assert langid.identify(edge_docs(spark)).count() == len(edge_rows())


def test_letters_are_those_of_any_script(spark):
    rows = [(i, "the cat sat on the mat with words", "en", None, None) for i in range(20)] + [(100 + i, "le chat est sur la table avec mots", "fr", None, None) for i in range(20)]
    model = langid.fit_table(edge_docs(spark, rows), "doc_id", "text", "lang", 100)
    texts = ["12 ½", "² Ⅷ ☃", "", None, "é", "я", "the", "12 the ½"]
    got = {r["doc_id"]: r for r in langid.predict(edge_docs(spark, [(i, t, None, None, None) for i, t in enumerate(texts)]), model).collect()}
    assert [got[i]["lang_pred"] == "und" for i in range(8)] == [True] * 4 + [False] * 4
    # Of languages that fit alike the first by name leads.
    twins = langid.fit_table(edge_docs(spark, [(i, "same words here", "ba"[i % 2], None, None) for i in range(40)]), "doc_id", "text", "lang", 100)
    tie = langid.predict(edge_docs(spark, [(1, "same words", None, None, None)]), (twins[0], np.repeat(twins[1][:, :1], 2, axis=1))).collect()
    assert tie[0]["lang_pred"] == "a"


def plain_mixture(scores: list[list[float]]) -> list[float]:
    """One document's words, one step at a time."""
    n, langs = len(scores), len(scores[0])

    def fit(pi: list[float]) -> tuple[list[float], float]:
        like = [[math.exp(max(x - max(row), -60)) for x in row] for row in scores]
        for _ in range(langid.EM_STEPS):
            sums = [0.0] * langs
            for row in like:
                z = sum(p * x for p, x in zip(pi, row, strict=True))
                sums = [s + p * x / z for s, p, x in zip(sums, pi, row, strict=True)]
            pi = [s / n for s in sums]
        return pi, sum(max(row) + math.log(sum(p * x for p, x in zip(pi, r, strict=True))) for row, r in zip(scores, like, strict=True))

    full, _ = fit([1 / langs] * langs)
    order = sorted(range(langs), key=lambda k: (-full[k], k))
    alone = [sum(row[k] for row in scores) for k in range(langs)]
    best = max(range(langs), key=lambda k: (alone[k], -k))
    found, value = [float(k == best) for k in range(langs)], alone[best]
    for k in range(2, langs + 1):
        start = [full[x] + 1e-6 if x in order[:k] else 0.0 for x in range(langs)]
        pi, v = fit([x / sum(start) for x in start])
        if v - langid.PENALTY * (k - 1) * math.log(n + 1) > value:
            found, value = pi, v - langid.PENALTY * (k - 1) * math.log(n + 1)
    return found


def test_mixtures_are_those_of_a_plain_version():
    rng = np.random.default_rng(3)
    langs, docs = 7, 40
    sizes = rng.integers(1, 90, docs)
    scores, doc = [], np.repeat(np.arange(docs), sizes)
    for n in sizes:
        spoken = rng.choice(langs, rng.integers(1, 7), replace=False)
        rows = rng.normal(-30, 2, (n, langs))
        rows[np.arange(n), rng.choice(spoken, n)] += 15
        scores.append(rows.astype(np.float32))
    got = langid.mixtures(np.concatenate(scores), doc, docs)
    for have, rows in zip(got, scores, strict=True):
        assert have == pytest.approx(plain_mixture(rows.tolist()), abs=2e-3)
    assert max((x > 0).sum() for x in got) >= 5


def test_lm_score_is_that_of_plain_counts(spark, small):
    docs = table(spark, small, "documents").select("doc_id", "text")
    got = {r["doc_id"]: r["score"] for r in lm.score(docs, chunk_bytes=20_000, bucket_ngrams=2_000).collect()}
    seen = docs.agg(F.sum(F.octet_length("text") + 1).alias("b")).collect()[0]["b"]
    chunks = max(lm.HELD_OUT, -(-seen // 20_000))
    rows = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.lit(None).cast("string")), F.lit(chunks)).cast("int")).collect()
    role = {r["doc_id"]: "test" if crc(r["doc_id"]) == 1 else "dev" if r["chunk"] % lm.HELD_OUT == 0 else "train" for r in rows}
    tokens = {r["doc_id"]: [*words(lower(r["text"])), None] for r in rows}

    def counted(roles: tuple[str, ...]) -> tuple[Counter, Counter, int]:
        own = [i for i in tokens if role[i] in roles]
        return Counter(x for i in own for x in tokens[i]), Counter(p for i in own for p in zip([0, *tokens[i]], tokens[i], strict=False)), len(own)

    def parts(w: list, one: Counter, two: Counter, n_docs: int) -> list[tuple[float, float, int]]:
        total, out = sum(one.values()), []
        for a, b in zip([0, *w], w, strict=False):
            before = n_docs if a == 0 else one[a]
            out.append((two[a, b] / before if before else 0.0, one[b] / total, min(int(math.log2(before)) + 1, lm.CONTEXTS - 1) if before else 0))
        return out

    one, two, n = counted(("train",))
    held = [x for i in tokens if role[i] == "dev" for x in parts(tokens[i], one, two, n)]
    assert held
    weights = [[0.4, 0.5, 0.1] for _ in range(lm.CONTEXTS)]
    for _ in range(lm.EM_STEPS):
        sums = [[0.0] * 3 for _ in range(lm.CONTEXTS)]
        for a, b, c in held:
            r = [w * x for w, x in zip(weights[c], (a, b, 1 / (len(one) + 1)), strict=True)]
            sums[c] = [s + x / sum(r) for s, x in zip(sums[c], r, strict=True)]
        weights = [[x / sum(s) for x in s] if sum(s) else w for s, w in zip(sums, weights, strict=True)]
    weights = [[w[0], w[1], max(w[2], lm.LEAST_UNIFORM)] for w in weights]
    weights = [[x / sum(w) for x in w] for w in weights]
    one, two, n = counted(("train", "dev"))
    for i, w in tokens.items():
        want = sum(math.log10(weights[c][0] * a + weights[c][1] * b + weights[c][2] / (len(one) + 1)) for a, b, c in parts(w, one, two, n))
        assert got[i] == pytest.approx(want, rel=2e-3)


def test_pipeline(spark, small):
    docs = table(spark, small, "documents")
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = left
        left = spark.createDataFrame(stage(spark, before, small).collect(), before.schema)
        assert left.columns == docs.columns, name
        assert left.join(before, "doc_id", "left_anti").count() == 0
    got = corpus_pipeline.run(spark, small)
    assert {r["doc_id"] for r in got.select("doc_id").collect()} == {r["doc_id"] for r in left.select("doc_id").collect()}
    assert got.where(~F.col("lossless")).count() == 0


def test_pipeline_of_edge_rows(spark, small):
    left = edge_docs(spark)
    for _, stage in corpus_pipeline.STAGES:
        left = stage(spark, left, small)
        rows = left.collect()
    assert len(rows) >= 1
    empty = edge_docs(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, small).count() == 0


def test_mixtures_do_not_depend_on_neighbours():
    rng = np.random.default_rng(8)
    for n_lang in (2, 5, 9):
        sizes = rng.integers(1, 60, 40)
        home = rng.integers(0, n_lang, (40, 3))
        scores = [(rng.normal(-20, 4, (n, n_lang)) + 9 * np.eye(n_lang)[home[d][rng.integers(0, 3, n)]]).astype(np.float32) for d, n in enumerate(sizes)]
        # A document of evenly mixed words over all languages, which a small set does not suit.
        scores.append((np.full((4 * n_lang, n_lang), -40.0) + 39.0 * np.eye(n_lang)[np.arange(4 * n_lang) % n_lang]).astype(np.float32))
        alone = [langid.mixtures(s, np.zeros(len(s), np.int64), 1)[0] for s in scores]
        assert (alone[-1] > 0).sum() == n_lang
        for batch in (2, 7, 41):
            order = rng.permutation(41)
            for lo in range(0, 41, batch):
                part = order[lo : lo + batch]
                got = langid.mixtures(np.concatenate([scores[i] for i in part]), np.repeat(np.arange(part.size), [len(scores[i]) for i in part]), part.size)
                for i, pi in zip(part, got, strict=True):
                    assert np.array_equal(pi, alone[i])
