"""Spelling variants and collocations against plain versions."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import collocations, queries, variants
from tessera.llm.common import table
from tests.llm.helpers import edge_docs, edge_rows, lower


def plain_words(rows, slip=199, least=5, shortest=6):
    found = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if slip and h % slip == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            found[word] += 1
    return {w: n for w, n in found.items() if n >= least and len(w) >= shortest}


def plain_near(words):
    near, holes = defaultdict(set), defaultdict(list)
    for w in words:
        for k in range(len(w)):
            holes[w[:k], w[k + 1 :]].append(w)
            cut = w[:k] + w[k + 1 :]
            if cut in words:
                near[w].add(cut)
                near[cut].add(w)
    for same in holes.values():
        for w in same:
            near[w] |= {x for x in same if x != w}
    return near


def plain_group(words):
    near, form = plain_near(words), {}
    for w, n in words.items():
        best = min(near.get(w, ()), key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= 5 * n:
            form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near.get(w, ())), words[form[w]] if w in form else None))
    return sorted(map(repr, out))


def grouped(df):
    return sorted(repr(tuple(r)) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def pairs(df):
    got = [(r.word, r.near) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("block", [2, 5, 64])
def test_near_words_of_skewed_blocks(spark, block):
    rng = random.Random(block)
    words = {"prefix" + "".join(rng.choice("abc") for _ in range(rng.randint(0, 7))) for _ in range(500)}
    words |= {"".join(rng.choice("ab") for _ in range(rng.randint(2, 9))) + "suffix" for _ in range(400)}
    words |= {"aaaaaaa" + "a" * k for k in range(40)} | {"ÿ" * 6, "ÿ" * 5 + "é", "ÿ" * 7}
    words = {w: rng.randint(5, 9) for w in words if len(w) >= 6}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    want = {(w, x) for w, near in plain_near(words).items() for x in near}
    assert pairs(variants.near(df, block)) == want and len(want) > 1000


def test_near_words_of_any_length(spark):
    rng = random.Random(1)
    long = "".join(rng.choice("abcdefgh") for _ in range(20_000))
    words = [long, long[:-1], long[1:], long[:9000] + "z" + long[9000:], long[:17] + "z" + long[18:], long[:17] + "y" + long[18:], *(("x" * k) for k in range(28, 40)), *("y" * 33 + c for c in "abcdef")]
    df = spark.createDataFrame([(w, 5) for w in words], "word string, n long")

    def one(x, y):
        x, y = sorted((x, y), key=len)
        k = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), len(x))
        return x != y and len(y) - len(x) <= 1 and x[k + (len(x) == len(y)) :] == y[k + 1 :]

    assert pairs(variants.near(df, 3)) == {(x, y) for x in words for y in words if one(x, y)}


def test_one_edit():
    assert variants.one_edit("abcd", "abxd") == 2 and variants.one_edit("abcd", "abcde") == 4 and variants.one_edit("abcd", "xabcd") == 0
    assert variants.one_edit("abcd", "axyd") is None and variants.one_edit("abcd", "abdce") is None


def test_forms_lead_to_roots(spark):
    chain = [("aaaaaa", 5), ("aaaaab", 25), ("aaaabb", 125), ("aaabbb", 625), ("aabbbb", 3125), ("abbbbb", 15625), ("bbbbbb", 78125)]
    words = dict(chain) | {"tiehere": 7, "tieher": 40, "tieheres": 40, "tooweak": 9, "tooweaks": 44}
    assert grouped(variants.group(spark.createDataFrame(list(words.items()), "word string, n long"))) == plain_group(words)


def test_variants_query(spark, small):
    rows = [(r.doc_id, r.text) for r in table(spark, small, "documents").collect()]
    assert grouped(queries.op11_variants(spark, small)) == plain_group(plain_words(rows))


def test_variants_of_edge_rows(spark, monkeypatch):
    monkeypatch.setattr(variants, "HELD", 7)
    rows = edge_rows() * 2
    words = plain_words([(r[0], r[1]) for r in rows], slip=3)
    got = {r.word: r.n for r in variants.dictionary(edge_docs(spark, rows), slip=3).collect()}
    assert got == words and len(words) > 5
    assert variants.group(variants.dictionary(edge_docs(spark).limit(0))).count() == 0


# -- collocations


def plain_phrases(rows, least=30, top=2000):
    f, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text)):
            w = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    found = {g: a for g, a in f.items() if len(g) > 2 and a >= least}
    over = defaultdict(int)
    for (lang, *w), a in found.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                over[lang, *w[i : i + k]] = max(over[lang, *w[i : i + k]], a)
    best = defaultdict(list)
    for g, a in found.items():
        if 100 * over[g] >= 80 * a:
            continue
        lang, *w = g
        score, _, left, right = min((2_000_000 * a // (f[lang, *w[:k]] + f[lang, *w[k:]]), k, f[lang, *w[:k]], f[lang, *w[k:]]) for k in range(1, len(w)))
        best[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, i, p.decode(), -a, x, y, totals[lang], -s) for lang, every in best.items() for i, (s, a, p, x, y) in enumerate(sorted(every)[:top], 1))


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize(("chunk", "top", "groups"), [(1, 2000, 64), (7, 5, 3), (collocations.CHUNK, 2000, 64)])
def test_phrases_of_random_texts(spark, monkeypatch, chunk, top, groups):
    monkeypatch.setattr(collocations, "RANK_GROUPS", groups)
    monkeypatch.setattr(collocations, "BUCKET", 1 << chunk.bit_length())
    rng = random.Random(chunk)
    texts = [(i, "".join(rng.choice(["a ", "B ", "é\t", "c, ", "d d ", "e\n", "a b c ", " ", "😀 ", "x\x00\x85y "]) for _ in range(rng.randint(0, 400))), rng.choice(["en", "fr", None]), None, None) for i in range(40)]
    want = plain_phrases([(r[2], r[1]) for r in texts], top=top)
    assert rows_of(collocations.mine(edge_docs(spark, texts), chunk=chunk, top=top)) == want and len(want) > 9


def test_phrases_of_edge_rows(spark):
    rows = edge_rows() * 3
    assert rows_of(collocations.mine(edge_docs(spark, rows))) == plain_phrases([(r[2], r[1]) for r in rows])
    assert rows_of(collocations.mine(edge_docs(spark).limit(0))) == []
    with pytest.raises(ValueError):
        collocations.mine(edge_docs(spark), chunk=0)


def test_scores_pass_64_bits(spark):
    from pyspark.sql import functions as F

    n = 9 * 10**17
    got = spark.range(1).select(collocations._scored(F.lit(n), (F.lit(n), F.lit(n + 7)), (F.lit(n), F.lit(n + 7))).alias("cut")).collect()[0]["cut"]
    assert (got.score, got.k) == (2_000_000 * n // (2 * n + 7), 1)


def test_collocations_query(spark, small, duck, compare):
    got = queries.op12_collocations(spark, small)
    want = duck.execute(collocations.ORACLE)
    compare([tuple(r) for r in got.collect()], got.columns, want.fetchall(), [c[0] for c in want.description])
    rows = [(r.lang, r.text) for r in table(spark, small, "documents").collect()]
    assert rows_of(got) == plain_phrases(rows)


def test_pairs_within_a_chunk():
    at, found, which = collocations._pairs(np.array([1, 2, 1, 2, 0, 2, 1], np.int32))
    assert at.tolist() == [0, 1, 2, 5] and found.tolist() == [1 << 32 | 2, 2 << 32 | 1] and which.tolist() == [0, 1, 0, 1]
