"""JSON in what a model wrote: read in one pass, closing what is left open and dropping what is astray."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Levels beyond which a value counts as null: what reads it again may not follow farther.
DEEPEST = 200
FENCE = re.compile(r"```(?:json)?")
STRING = re.compile(r'"([^"\\]*(?:\\.[^"\\]*)*)("|\\?$)', re.DOTALL)
NUMBER = re.compile(r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?")
WORD = re.compile(r"[A-Za-z_]\w*")
BARE_KEY = re.compile(r'\s*"?\s*:')
WORDS = {"true": True, "false": False, "null": None, "True": True, "False": False, "None": None}
_ABSENT = object()


def unquoted(raw: str) -> str:
    """A string's text. Where it is no JSON, a backslash is its own (as in formulas), but for those before quotes and backslashes."""
    try:
        return json.loads(f'"{raw}"', strict=False)
    except ValueError:
        return re.sub(r'\\(["\\])', r"\1", raw)


class Reader:
    """Values of a text, one after the other, from a single scan with a stack of what is open."""

    def __init__(self, text: str):
        self.text = text
        #: Open containers, each with the key that waits for a value, and the key that was set last.
        self.open: list[list] = []
        self.skipped = 0
        self.done: list[Any] = []

    def put(self, value: Any) -> None:
        if not self.open:
            self.done.append(value)
            return
        top = self.open[-1]
        if isinstance(top[0], list):
            top[0].append(value)
        elif top[1] is not _ABSENT:
            top[0][top[1]] = value
            top[1], top[2] = _ABSENT, top[1]
        elif isinstance(value, str):
            top[1] = value

    def begin(self, value: Any) -> None:
        if len(self.open) >= DEEPEST:
            self.skipped += 1
            return
        # A container where a key should be has no place.
        self.open.append([value, _ABSENT, _ABSENT])

    def end(self, kind: type) -> None:
        if self.skipped:
            self.skipped -= 1
        elif any(isinstance(x[0], kind) for x in self.open[-2:]) or (self.open and isinstance(self.open[0][0], kind) and len(self.open) < 8):
            while not isinstance(self.open[-1][0], kind):
                self.close()
            self.close()

    def close(self) -> None:
        value = self.open.pop()[0]
        self.put(value)

    def colon(self) -> None:
        """A colon after a string that was a value: the string's end mark was left out, and its last part is a key."""
        top = self.open[-1] if self.open else None
        if top is None or not isinstance(top[0], dict) or top[1] is not _ABSENT or top[2] is _ABSENT:
            return
        value = top[0].get(top[2])
        if isinstance(value, str) and "," in value:
            head, _, tail = value.rpartition(",")
            top[0][top[2]], top[1] = head, tail.strip(' \n\t"')

    def values(self) -> Iterator[Any]:
        text, at, n = self.text, 0, len(self.text)
        while at < n:
            c = text[at]
            if c in "{[":
                self.begin({} if c == "{" else [])
                at += 1
            elif c in "}]":
                self.end(dict if c == "}" else list)
                at += 1
            elif not self.open:
                # Prose: on to the next bracket.
                nexts = [i for i in (text.find("{", at), text.find("[", at)) if i >= 0]
                at = min(nexts, default=n)
            elif self.skipped:
                m = STRING.match(text, at) if c == '"' else None
                at = m.end() if m else at + 1
            elif c == '"':
                m = STRING.match(text, at)
                self.put(unquoted(m[1]))
                at = m.end()
            elif c == ":":
                self.colon()
                at += 1
            elif c == ",":
                self.open[-1][2] = _ABSENT
                if isinstance(self.open[-1][0], dict) and self.open[-1][1] is not _ABSENT:
                    self.put(None)  # a key without a value
                    self.open[-1][2] = _ABSENT
                at += 1
            elif m := NUMBER.match(text, at):
                self.put(float(m[0]) if not m[0].lstrip("-").isdigit() else int(m[0]) if len(m[0]) < 4000 else float("inf"))
                at = m.end()
            elif m := WORD.match(text, at):
                at = self.word(m)
            else:
                at += 1
            if self.done and not self.open:
                yield self.done.pop()
        while self.open:
            self.close()
        yield from self.done

    def word(self, m: re.Match) -> int:
        top = self.open[-1]
        if isinstance(top[0], dict) and top[1] is _ABSENT and (colon := BARE_KEY.match(self.text, m.end())):
            top[1], top[2] = m[0], _ABSENT
            return colon.end()
        if m[0] in WORDS and (isinstance(top[0], list) or top[1] is not _ABSENT):
            self.put(WORDS[m[0]])
        return m.end()


def values(text: str | None) -> Iterator[Any]:
    """The JSON values in a text, fences left out: as they are if the text is JSON, else repaired."""
    bare = FENCE.sub("", text or "").strip()
    if bare[:1] in ("{", "["):
        try:
            got = json.loads(bare)
            if _within(got):
                yield got
                return
        except (ValueError, RecursionError):
            pass
    yield from Reader(bare).values()


def _within(value: Any) -> bool:
    level = [value]
    for _ in range(DEEPEST + 1):
        level = [x for v in level if isinstance(v, (dict, list)) for x in (v.values() if isinstance(v, dict) else v)]
        if not level:
            return True
    return False


def items(text: str | None) -> list[dict]:
    """The objects of the first value that is one or holds some."""
    for value in values(text):
        found = [x for x in (value if isinstance(value, list) else [value]) if isinstance(x, dict)]
        if found:
            return found
    return []


def mapped(value: Any, fn: Callable[[str], str]) -> Any:
    """``fn`` of every string of a value at any level; keys stay."""
    if isinstance(value, str):
        return fn(value)
    if isinstance(value, dict):
        return {k: mapped(v, fn) for k, v in value.items()}
    return [mapped(v, fn) for v in value] if isinstance(value, list) else value


def _rewritten(fn: Callable[[str], str]) -> Callable[[pd.Series], pd.Series]:
    def one(text: str | None) -> str | None:
        if text is None:
            return None
        found = next(values(text), _ABSENT)
        return text if found is _ABSENT else json.dumps(mapped(found, fn), ensure_ascii=False)

    @F.pandas_udf(StringType())
    def rewritten(s: pd.Series) -> pd.Series:
        return pd.Series([one(x) for x in s], dtype=object)

    return rewritten


#: A JSON text with the backslashes of its strings doubled, at any level, and back; what holds no JSON stays.
escaped_json = _rewritten(lambda s: s.replace("\\", "\\\\"))
unescaped_json = _rewritten(lambda s: s.replace("\\\\", "\\"))
