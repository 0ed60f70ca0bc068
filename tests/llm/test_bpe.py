"""Byte-level BPE against the library whose vocabulary it reads."""

from __future__ import annotations

import hashlib
import random

import pytest
from tokenizers import Tokenizer

from tessera.llm import bpe, queries
from tests.llm.helpers import edge_docs, edge_rows

PIECES = [*" '’stmdrevlaAxX01 \n\t é中文😀.,!?\x85  \x1c", "<|endoftext|>", "<|endof", "'s", "'re", "'ll", "  ", "'S", "ʼs", "ﬁ", "٣", "Ⅷ", "Ᲊ"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.DEFAULT_MODEL)


@pytest.fixture(scope="module")
def model():
    return bpe.Merges.load(bpe.DEFAULT_MODEL)


def test_random_texts(model, library):
    rng, enc = random.Random(5), bpe.Encoder(model)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 30))) for _ in range(5000)]
    ids, sizes = enc.encode_all(texts)
    ends = [0, *sizes.cumsum().tolist()]
    for text, b, e in zip(texts, ends, ends[1:]):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids[b:e].tolist() == want == enc.encode(text), text
        assert bpe.decode(model, want) == library.decode(want, skip_special_tokens=False)
        assert bpe.decode(model, want, skip_special=True) == library.decode(want, skip_special_tokens=True)


def test_every_character(model, library):
    every = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    text = "".join(f"a{chr(c)}1{chr(c)}'{chr(c)} " for c in every)
    assert bpe.Encoder(model).encode(text) == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["x" * 50_000, "!?" * 40_000, "aab" * 30_000, "".join(map(chr, range(0x4E00, 0x9000))), " " * 9_999 + "x", "<|endoftext|>" * 99])
def test_long_words(model, library, text):
    assert bpe.Encoder(model).encode(text) == library.encode(text, add_special_tokens=False).ids


def test_held_words_are_let_go(model, library, monkeypatch):
    monkeypatch.setattr(bpe, "HELD", 10)
    enc = bpe.Encoder(model)
    for text in ("one two three four five six seven", "eight nine ten eleven twelve", "one two three"):
        assert enc.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_merge_of_lower_rank_is_refused():
    names = {c: i for i, c in enumerate(bpe._byte_names())}
    ids = names | {"abc": 256, "ab": 257}
    with pytest.raises(ValueError):
        bpe.Merges(ids, [("ab", "c"), ("a", "b")], {}, None)


def test_bytes_that_are_no_text(model, library):
    for ids in ([model.of_byte[b].item() for b in b"\xe4\xb8"], [model.of_byte[0xFF].item(), 50256, 40], [10**9, 40]):
        assert bpe.decode(model, ids) == library.decode(ids, skip_special_tokens=False)


def test_edge_rows(spark, library):
    docs = edge_docs(spark)
    want = []
    for i, text, *_ in edge_rows():
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append(repr((i, len(ids), ids, text or "")))
    assert sorted(repr(tuple(r)) for r in bpe.encode(docs, decoded=True).collect()) == sorted(want)
    back = {repr((r.doc_id, r.text)) for r in bpe.decode_column(bpe.encode(docs)).collect()}
    assert back == {repr((i, text or "")) for i, text, *_ in edge_rows()}
    assert bpe.encode(docs.limit(0)).count() == 0


def test_query(spark, small, library):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = set()
    for r in spark.read.parquet(f"{small}/documents.parquet").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.add((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert {tuple(r) for r in queries.op13_bpe(spark, small).collect()} == want
