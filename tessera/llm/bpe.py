"""Byte-level BPE: encoding in batched merge rounds, and decoding.

The symbols of many words lie end to end in one flat array. A round finds, for each word,
the lowest rank among its adjacent pairs (ranks come from a binary search over the sorted
keys of all merges) and merges every place where the word has that pair, left to right.
That is what an agenda does one merge at a time, as a merge never makes a pair of a lower
rank than its own, which loading checks. Only the pairs beside a merge are searched again.

Words (no merge reaches over their ends) are cut by classes of characters. What a word
gives never depends on where it stands, so it is held, up to a bound.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import map_rows
from tessera.llm.pieces import Cells, spread

DEFAULT_MODEL = "/opt/tokenizers/byte_bpe_50k.json"
#: Held words, and their ids; beyond that all begin anew.
HELD, HELD_CELLS = 200_000, 2_000_000
#: Characters whose words are encoded together.
AT_ONCE = 1 << 20
OTHER, LETTER, NUMBER, SPACE = range(4)
#: Endings that an apostrophe takes with it.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
_NEVER = np.iinfo(np.int32).max


def _byte_names() -> dict[str, int]:
    """The character that stands for each byte in a vocabulary file: itself where it prints, else one from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(prints)]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=1)
def char_classes(model: str) -> np.ndarray:
    """The class of every code point.

    Two tables of different age must agree on it; where they don't (a character assigned
    between the two), the model's own reader says which it is.
    """
    import regex

    every = "".join(" " if 0xD800 <= c < 0xE000 else chr(c) for c in range(0x110000))
    old, new = np.zeros(len(every), np.uint8), np.zeros(len(every), np.uint8)
    first = np.array([x[0] for x in map(unicodedata.category, every)])
    for kind, letter, pattern in ((LETTER, "L", r"\p{L}+"), (NUMBER, "N", r"\p{N}+"), (SPACE, "", r"\s+")):
        for m in regex.finditer(pattern, every):
            new[m.start() : m.end()] = kind
        old[first == letter] = kind
    old[new == SPACE] = SPACE
    odd = np.flatnonzero(old != new)
    if odd.size:
        from tokenizers import Tokenizer

        split = Tokenizer.from_file(model).pre_tokenizer.pre_tokenize_str
        for kind, beside in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "@")):
            # The character stays with one of its own class: two words a line, else three.
            lines = split("".join(f"{beside}{chr(c)}\n" for c in odd.tolist()))
            starts = {begin for _, (begin, _) in lines}
            new[[c for i, c in enumerate(odd.tolist()) if 3 * i + 1 not in starts]] = kind
    return new


class Merges:
    """A vocabulary of byte symbols and the pairs that make more of them, keys sorted."""

    def __init__(self, ids: dict[str, int], merges: list[tuple[str, str]], special: dict[str, int], classes: np.ndarray):
        names = _byte_names()
        self.special, self.classes = special, classes
        self.out = {i: bytes(names[c] for c in s) for s, i in ids.items()} | {i: s.encode() for s, i in special.items()}
        self.of_byte = np.zeros(256, np.int32)
        for c, b in names.items():
            self.of_byte[b] = ids[c]
        left, right, made = (np.array([ids[s] for s in part], np.int64) for part in (*zip(*merges, strict=True), [a + b for a, b in merges]))
        self.span = np.int64(max(ids.values()) + 1)
        key = left * self.span + right
        # The first of equal pairs counts.
        order = np.argsort(key, kind="stable")
        first = order[np.append(True, key[order][1:] != key[order][:-1])]
        self.keys, self.rank, self.made = key[first], first.astype(np.int32), made[first].astype(np.int32)
        born = np.full(self.span, -1, np.int64)
        born[made[::-1]] = np.arange(made.size)[::-1]
        if (born[left] >= np.arange(made.size)).any() or (born[right] >= np.arange(made.size)).any():
            raise ValueError("a merge makes a pair of a lower rank than its own")

    @classmethod
    def load(cls, path: str) -> Merges:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["model"]["merges"]]
        return cls(model["model"]["vocab"], pairs, {t["content"]: t["id"] for t in model["added_tokens"]}, char_classes(path))

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair and the symbol it makes; pairs that make none have no rank."""
        key = left * self.span + right
        at = np.minimum(np.searchsorted(self.keys, key), self.keys.size - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.rank[at], _NEVER), np.where(hit, self.made[at], 0)


def merged(model: Merges, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """How many ids each word has, and the ids end to end; no word is empty."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    counts, parts, rows = np.zeros(size.size, np.int64), [], []
    word = np.arange(size.size)
    symbol = model.of_byte[np.frombuffer(b"".join(words), np.uint8)].astype(np.int64)
    while word.size:
        # Positions of words that may still merge, without gaps; a mark follows each word.
        n = symbol.size
        end = np.cumsum(size)
        begin = end - size
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[end - 1], before[begin] = n, n
        symbol = np.append(symbol, -1)
        rank, made = np.full(n + 1, _NEVER, np.int32), np.zeros(n + 1, np.int32)
        inner = np.flatnonzero(after[:n] < n)
        rank[inner], made[inner] = model.find(symbol[inner], symbol[inner + 1])
        live = n
        while True:
            low = np.minimum.reduceat(rank[:n], begin)
            busy = low < _NEVER
            if 2 * live < n or 2 * np.count_nonzero(busy) < busy.size:
                break
            place = np.flatnonzero(rank[:n] == np.repeat(np.where(busy, low, -1), size))
            # Of places that overlap every second one merges, from the left.
            run = np.append(True, after[place[:-1]] != place[1:])
            nth = np.arange(place.size)
            place = place[(nth - np.maximum.accumulate(np.where(run, nth, 0))) % 2 == 0]
            gone = after[place]
            symbol[place], symbol[gone], rank[gone] = made[place], -1, _NEVER
            follows = after[gone]
            after[place], rank[place] = follows, _NEVER
            inside = follows < n
            before[follows[inside]] = place[inside]
            left = before[place]
            live -= place.size
            again = np.concatenate([left[left < n], place[inside]])
            rank[again], made[again] = model.find(symbol[again], symbol[after[again]])
        alive = np.flatnonzero(symbol[:n] >= 0)
        of = np.repeat(np.arange(word.size), size)[alive]
        symbol, size = symbol[alive], np.bincount(of, minlength=word.size)
        done = ~busy
        counts[word[done]] = size[done]
        parts.append(symbol[done[of]])
        rows.append(word[of[done[of]]])
        symbol, size, word = symbol[busy[of]], size[busy], word[busy]
    if not parts:
        return counts, np.zeros(0, np.int32)
    order = np.argsort(np.concatenate(rows), kind="stable")
    return counts, np.concatenate(parts)[order].astype(np.int32)


def cuts(classes: np.ndarray, code: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where words begin, in characters of texts end to end; ``first``: where the texts begin, none of them empty.

    A word is a run of one class, with the single space before it; an apostrophe at the
    start of a word takes one of its endings. A run of white space leaves its last
    character to what follows in its text.
    """
    n = code.size
    kind = classes[code]
    starts = np.zeros(n + 1, bool)
    starts[1:n] = kind[1:] != kind[:-1]
    starts[first], starts[n] = True, True
    opens = np.zeros(n + 1, bool)
    opens[first], opens[n] = True, True
    begin = np.flatnonzero(starts[:n])
    end = np.append(begin[1:], n)
    own = kind[begin]
    out = starts.copy()
    gap = np.flatnonzero((own == SPACE) & ~opens[end])
    out[end[gap] - 1] = True
    out[end[gap[code[end[gap] - 1] == 32]]] = False
    mark = np.flatnonzero((end - begin == 1) & (code[begin] == 39) & out[begin] & ~opens[end])
    mark = mark[own[np.minimum(mark + 1, own.size - 1)] == LETTER]
    at, room = end[mark], end[np.minimum(mark + 1, own.size - 1)] - end[mark]
    code = np.append(code, [0, 0])
    taken = np.zeros(mark.size, np.int64)
    for ending in reversed(ENDINGS):
        fits = (code[at] == ord(ending[0])) & (room >= len(ending))
        if len(ending) > 1:
            fits &= code[at + 1] == ord(ending[1])
        taken[fits] = len(ending)
    at, taken = at[taken > 0], taken[taken > 0]
    out[at], out[at + taken] = False, True
    return np.flatnonzero(out[:n])


class Encoder:
    """Encodes texts; the ids of words are held, up to a bound."""

    def __init__(self, model: Merges):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.places: dict[str, int] = {}
        self.end, self.ids = Cells("i8"), Cells("i4")
        self.end.add(np.zeros(1, np.int64))

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts end to end, and how many each has; none of a null or empty one."""
        out: list[np.ndarray] = []
        sizes = np.zeros(len(texts), np.int64)
        plain: list[str] = []
        of: list[int] = []
        waiting = 0

        def settle() -> None:
            nonlocal waiting
            if plain:
                ids, n = self._plain(plain)
                np.add.at(sizes, of, n)
                out.append(ids)
            plain.clear()
            of.clear()
            waiting = 0

        for i, text in enumerate(texts):
            for part, mark in self._split(text or ""):
                if mark is not None:
                    settle()
                    out.append(np.array([mark], np.int32))
                    sizes[i] += 1
                elif part:
                    plain.append(part)
                    of.append(i)
                    waiting += len(part)
                    if waiting >= AT_ONCE:
                        settle()
        settle()
        return np.concatenate(out) if out else np.zeros(0, np.int32), sizes

    def _split(self, text: str) -> list[tuple[str, int | None]]:
        """The parts of a text between special tokens, and those; the first to begin counts."""
        parts: list[tuple[str, int | None]] = [(text, None)]
        for token, i in self.model.special.items():
            if token in text:
                parts = [x for part, mark in parts for x in ([(part, mark)] if mark is not None else _around(part, token, i))]
        return parts

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        whole = "".join(texts)
        length = np.fromiter(map(len, texts), np.int64, len(texts))
        first = np.cumsum(length) - length
        begin = cuts(self.model.classes, np.frombuffer(whole.encode("utf-32-le"), np.uint32), first)
        ends = np.append(begin[1:], len(whole)).tolist()
        words = [whole[b:e] for b, e in zip(begin.tolist(), ends, strict=True)]
        if len(self.places) >= HELD or self.ids.size >= HELD_CELLS:
            self._forget()
        new = [w for w in dict.fromkeys(words) if w not in self.places]
        if new:
            counts, ids = merged(self.model, [w.encode() for w in new])
            self.places.update(zip(new, range(len(self.places), len(self.places) + len(new)), strict=True))
            self.end.add(np.cumsum(counts) + self.ids.size)
            self.ids.add(ids)
        place = np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))
        start = self.end.held[place]
        count = self.end.held[place + 1] - start
        return self.ids.held[spread(start, count)], np.add.reduceat(count, np.searchsorted(begin, first))


def _around(text: str, token: str, i: int) -> list[tuple[str, int | None]]:
    out: list[tuple[str, int | None]] = []
    for part in text.split(token):
        out += [("", i), (part, None)]
    return out[1:]


def decode(model: Merges, ids: Iterable[int], skip_special: bool = False) -> str:
    """The text of ids; bytes that are no UTF-8 become the replacement mark, ids out of the vocabulary nothing."""
    skip = set(model.special.values()) if skip_special else ()
    return b"".join(model.out.get(i, b"") for i in ids if i not in skip).decode("utf-8", "replace")


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = DEFAULT_MODEL, decoded: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids) of every whole text, and with ``decoded`` the text that the ids give.

    A null or empty text has no ids; a very long one is encoded whole, its words in rounds
    as all others. Special tokens that stand in a text are one id each. Null ids
    stay null, repeated rows give repeated rows, an empty table gives none. Other columns
    are not read. ``model`` must be at that path on every executor.
    """
    held: dict[str, Encoder] = {}

    def rows(keys: list, texts: list) -> dict[str, list]:
        if not held:
            held["encoder"] = Encoder(Merges.load(model))
        enc = held["encoder"]
        ids, sizes = enc.encode_all(texts)
        ends = np.append(0, np.cumsum(sizes))
        out = {"doc_id": keys, "n_tokens": sizes, "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))}
        if decoded:
            spans = zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)
            out["decoded"] = [decode(enc.model, ids[b:e].tolist()) for b, e in spans]
        return out

    return map_rows(docs, [id_col, text_col], rows, "doc_id long, n_tokens long, ids array<int>" + (", decoded string" if decoded else ""))


def decode_column(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str = DEFAULT_MODEL, skip_special: bool = False) -> DataFrame:
    """(doc_id, text) from ids, row by row.

    Null ids give a null text, none an empty one; a null id stays null, repeated rows give
    repeated rows, an empty table gives none. Other columns are not read.
    """
    held: dict[str, Merges] = {}

    def rows(keys: list, ids: list) -> dict[str, list]:
        if not held:
            held["model"] = Merges.load(model)
        return {"doc_id": keys, "text": [None if x is None else decode(held["model"], x, skip_special) for x in ids]}

    return map_rows(df, [id_col, ids_col], rows, "doc_id long, text string")
