"""Personal data: patterns propose spans, validators confirm them, context scores them."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import SLICE_ROWS, map_rows, release

#: Order of kinds among spans that start together.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")

LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match that begins inside a run of digits would also begin ahead of it.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
DIGIT = re.compile(r"[0-9]")
WORD = re.compile(r"[^\W\d_]+")

#: Words that raise a span's score when they stand nearby, by kind.
CONTEXT = {
    "email": {"email", "mail", "contact", "write", "address", "correo", "courriel", "kontakt"},
    "ip": {"ip", "host", "server", "address", "login", "addr", "client"},
    "card": {"card", "visa", "credit", "debit", "mastercard", "amex", "payment", "tarjeta", "carte", "karte"},
    "phone": {"phone", "tel", "call", "mobile", "fax", "telefon", "telefono", "telephone"},
    "iban": {"iban", "bank", "account", "bic", "konto", "cuenta", "compte"},
    "ssn": {"ssn", "social", "security", "taxpayer", "identity"},
}
#: Score of a span whose pattern and validator agree, before context.
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.4}
CONTEXT_GAIN = 0.3
CONTEXT_CHARS = 48


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    """The mod-10 check of payment card numbers."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The mod-97 check of account numbers: country and check digits move to the end."""
    text = iban.replace(" ", "")
    number = "".join(str(int(c, 36)) for c in text[4:] + text[:4])
    return 15 <= len(text) <= 34 and int(number) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, in time linear in the text.

    The local class lacks ``@``, so a match's local part is the whole run before
    the sign, as far as the previous match lets it reach.
    """
    found, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append((start, m.end()))
            floor = m.end()
        else:
            floor = at + 1
        at = text.find("@", floor)
    return found


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the four base kinds, by start and then kind."""
    found = [("email", s, e) for s, e in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        if "." in text:
            found += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(map(_octet, m[0].split(".")))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    found.append(("phone", m.start(), m.end()))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def more_spans(text: str) -> list[tuple[str, int, int]]:
    """Candidates of the other kinds that their validators confirm."""
    if not DIGIT.search(text):
        return []
    return ibans(text) + [("ssn", m.start(), m.end()) for m in SSN.finditer(text)]


def ibans(text: str) -> list[tuple[str, int, int]]:
    """Account numbers, by the longest end at a word boundary that passes the check.

    A match also takes in upper-case words after a number. Where no end of it holds, the
    search goes on right after its start.
    """
    found, at = [], 0
    while m := IBAN.search(text, at):
        ends = [m.end(), *(i for i in range(m.end() - 1, m.start(), -1) if text[i] == " ")]
        end = next((e for e in ends if mod97(text[m.start() : e])), None)
        if end is not None:
            found.append(("iban", m.start(), end))
        at = end or m.start() + 2
    return found


def context_score(text: str, kind: str, start: int, end: int) -> float:
    """The kind's prior, raised when one of its words stands within reach of the span."""
    near = text[max(0, start - CONTEXT_CHARS) : start] + "\n" + text[end : end + CONTEXT_CHARS]
    hit = any(w.lower() in CONTEXT[kind] for w in WORD.findall(near))
    return round(min(1.0, PRIOR[kind] + CONTEXT_GAIN * hit), 4)


def find(text: str | None, threshold: float = 0.6) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans: the base ones and others that score ``threshold``."""
    text = text or ""
    base = [Span(k, s, e, context_score(text, k, s, e)) for k, s, e in base_spans(text)]
    more = [Span(k, s, e, p) for k, s, e in more_spans(text) if (p := context_score(text, k, s, e)) >= threshold]
    return base, sorted(base + more, key=lambda x: (x.start, KINDS.index(x.kind)))


def listed(spans: list[Span]) -> str:
    return ",".join(f"{x.kind}:{x.start}:{x.end}" for x in spans)


def redact(text: str | None, threshold: float = 0.6) -> str | None:
    """The text with each span, overlapping ones merged, replaced by its first kind in brackets."""
    spans = find(text, threshold)[1] if text else []
    out, at = [], 0
    for x in spans:
        if x.start >= at:
            out += [text[at : x.start], f"[{x.kind.upper()}]"]
        at = max(at, x.end)
    return "".join([*out, text[at:]]) if spans else text


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, scores array<double>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.6) -> DataFrame:
    """One row per document with the personal data in its whole text.

    Offsets are code points, end exclusive. A null or empty text has no spans and the
    digest of the empty string; a null id stays null; repeated rows give repeated rows;
    an empty table gives none. Other columns are not read.
    """

    def rows(ids: list, texts: list) -> dict[str, list]:
        out: dict[str, list] = {c.split()[0]: [] for c in SCHEMA.split(", ")}
        for i, text in zip(ids, texts, strict=True):
            base, spans = find(text, threshold)
            out["doc_id"].append(i)
            for kind in KINDS[:4]:
                out[f"n_{kind}"].append(sum(x.kind == kind for x in base))
            out["base_sha256"].append(hashlib.sha256(listed(base).encode()).hexdigest())
            out["spans"].append(listed(spans))
            out["n_added"].append(len(spans) - len(base))
            out["scores"].append([x.score for x in spans])
        return out

    return map_rows(docs, [id_col, text_col], rows, SCHEMA)


def redact_column(docs: DataFrame, text_col: str = "text", threshold: float = 0.6) -> DataFrame:
    """The documents with personal data in ``text_col`` replaced; all columns and rows stay.

    A null text stays null and an empty one empty; whole texts of any length are searched;
    rows are changed one by one, so ids may be null or repeat; an empty table gives none.
    """

    place = docs.columns.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                texts = pa.array([redact(t, threshold) for t in part.column(place).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([texts if i == place else c for i, c in enumerate(part.columns)], schema=part.schema)
        release()

    # Columns go by place, so that names of any kind may stand beside the text.
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(clean, plain.schema).toDF(*docs.columns)
