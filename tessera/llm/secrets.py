"""Secrets: patterns find strong ones; weak parts count when complementary ones share a scope."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import DataFrame

from tessera.llm.common import map_rows

#: Order of kinds among spans that start together.
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "weak_endpoint")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
#: Parts that say little alone. Each group 1 is the value.
WEAK = {
    "weak_id": re.compile(r"""(?:user(?:_?name)?|login|client_?id|account(?:_?id)?|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@+/_.-]{3,})""", re.I | re.A),
    "weak_secret": re.compile(r"""(?:pass(?:word|wd|phrase)?|pwd|secret|token|api_?key|credential|auth)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=!#$%&*-]{4,})""", re.I | re.A),
    "weak_endpoint": re.compile(r"""((?:https?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|ssh)://[A-Za-z0-9._~:@/?#&=%+-]{4,}|(?:host(?:name)?|endpoint|server|url)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]+\.[A-Za-z]{2,})""", re.I | re.A),
}
#: A bare run of the base64 letters that is long and mixed enough to be a key.
BARE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
MARKS = re.compile(r"[:=]")
#: From the end of a part to the start of the other, at most.
SCOPE_CHARS = 400


class Part(NamedTuple):
    role: str
    start: int
    end: int


def entropy(text: str) -> float:
    """Bits a character, from the text's own letter counts."""
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values())


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the three base kinds, by start and then kind."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def scopes(text: str) -> list[tuple[int, int]]:
    """Intervals within which parts belong together: paragraphs."""
    out, at = [], 0
    for m in re.finditer(r"\n[\x20\t\r]*\n\s*|\Z", text):
        if m.start() > at:
            out.append((at, m.start()))
        at = m.end()
    return out


def parts(text: str, base: list[tuple[str, int, int]]) -> list[Part]:
    """Every part, weak ones included, in order of start."""
    role = {"access": "id", "assign": "secret", "hex": "secret"}
    found = [Part(role[k], s, e) for k, s, e in base]
    if MARKS.search(text):
        for kind, pattern in WEAK.items():
            found += [Part(kind, m.start(1), m.end(1)) for m in pattern.finditer(text)]
    found += [Part("weak_secret", m.start(), m.end()) for m in BARE.finditer(text) if re.search("[0-9]", m[0]) and re.search("[A-Z]", m[0]) and entropy(m[0]) >= 3.5]
    return sorted(set(found), key=lambda x: (x.start, x.end, x.role))


def link(found: list[Part], within: list[tuple[int, int]], reach: int = SCOPE_CHARS) -> list[Part]:
    """Interval-join parts with scopes; the weak parts that a complementary one joins.

    An identifier completes a secret and a secret an identifier or an endpoint, when from
    the end of one to the start of the other are ``reach`` characters at most, all in one
    scope. Parts that overlap do not complete each other.
    """
    begins = [s for s, _ in within]
    starts: dict[str, list[int]] = {}
    ends: dict[str, list[int]] = {}
    for p in found:
        starts.setdefault(p.role.removeprefix("weak_"), []).append(p.start)
        ends.setdefault(p.role.removeprefix("weak_"), []).append(p.end)
    for x in ends.values():
        x.sort()
    mates = {"id": ("secret",), "secret": ("id", "endpoint"), "endpoint": ("secret",)}
    kept = set()
    for p in found:
        at = bisect_right(begins, p.start) - 1
        if not p.role.startswith("weak_") or at < 0 or p.end > within[at][1]:
            continue
        s, e = within[at]
        for other in mates[p.role.removeprefix("weak_")]:
            # The nearest that ends before it and the nearest that starts after it.
            before = bisect_right(ends.get(other, []), p.start) - 1
            after = bisect_left(starts.get(other, []), p.end)
            if before >= 0 and ends[other][before] > max(s, p.start - reach - 1) or after < len(starts.get(other, [])) and starts[other][after] < min(e, p.end + reach + 1):
                kept.add(p)
    return sorted(kept, key=lambda x: (x.start, x.end, x.role))


def find(text: str | None, reach: int = SCOPE_CHARS) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans: the base ones and weak parts that complementary ones confirm."""
    text = text or ""
    base = base_spans(text)
    found = parts(text, base)
    weak = []
    if any(p.role.startswith("weak_") for p in found) and len({p.role.removeprefix("weak_") for p in found}) > 1:
        starts, furthest = [s for _, s, _ in base], list(accumulate((e for _, _, e in base), max))
        weak = [(p.role, p.start, p.end) for p in link(found, scopes(text), reach) if not _covered(p, starts, furthest)]
    return base, sorted(base + weak, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _covered(p: Part, starts: list[int], furthest: list[int]) -> bool:
    """Whether a base span holds part of it. starts: of base spans, in order; furthest: the greatest end up to each."""
    before = bisect_left(starts, p.end)
    return before > 0 and furthest[before - 1] > p.start


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = SCOPE_CHARS) -> DataFrame:
    """One row per document with the secrets in its whole text.

    Offsets are code points, end exclusive. A null or empty text has no spans and the
    digest of the empty string; a null id stays null; repeated rows give repeated rows;
    an empty table gives none. Other columns are not read.
    """

    def rows(ids: list, texts: list) -> dict[str, list]:
        out: dict[str, list] = {c.split()[0]: [] for c in SCHEMA.split(", ")}
        for i, text in zip(ids, texts, strict=True):
            base, spans = find(text, reach)
            out["doc_id"].append(i)
            for kind in KINDS[:3]:
                out[f"n_{kind}"].append(sum(k == kind for k, _, _ in base))
            out["base_sha256"].append(hashlib.sha256(listed(base).encode()).hexdigest())
            out["spans"].append(listed(spans))
            out["n_linked"].append(len(spans) - len(base))
        return out

    return map_rows(docs, [id_col, text_col], rows, SCHEMA)
