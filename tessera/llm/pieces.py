"""Merge-type sentence pieces: encoding with seeded merge dropout, and decoding.

The encoder keeps an agenda of adjacent symbol pairs whose concatenation is a piece
and merges the best one, leftmost among ties, until none is left. With dropout, a
candidate that comes up is skipped when the keyed hash of (seed, document, piece,
start in the whole text) falls under the rate; the pieces left over are still pieces
of the same text, so every segmentation decodes to it.

Segments (no piece reaches over their ends) are merged many at a time, one step of every
agenda at once. A segment of which nothing is skipped always comes out alike, so its
candidates and ids are held; the hashes of its candidates are taken anew wherever
it stands, and where one of them says to skip, the segment is merged again.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import map_rows

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
ID_BITS = 24
#: Segments longer than this go through a heap of their own, shorter ones into the tables of these widths.
WIDTHS = (2, 4, 6, 8, 11, 16, 24, 48)
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
#: A segment ends with a run of letters, or before a space or a line end: no piece reaches over those.
SEGMENT = re.compile(rf" *[^{LETTERS} \n]*[{LETTERS}]+| *[^{LETTERS} \n]+|\n| +")
#: Held segments, and their candidates and ids; beyond that all begin anew.
HELD, HELD_CELLS = 100_000, 1_500_000
#: Segments encoded at once, and rows of a table merged at once.
AT_ONCE, TABLE_ROWS = 1 << 15, 1 << 13
_M = (1 << 64) - 1
_NEVER = np.iinfo(np.int32).max
_EMPTY = -1


class Vocabulary:
    """What the encoder needs of a model file: pieces, scores, byte pieces and which pairs of pieces make one."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[str]):
        """kinds: "piece", "byte" or "other" (control and unknown) for each id."""
        self.byte_ids = {int(p[1:-1], 16): i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == "byte"}
        self.ids = {p: i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == "piece"}
        self.size = len(pieces)
        #: Ids beyond the pieces: no symbol, and a character that is no piece.
        self.none, self.unknown = self.size, self.size + 1
        # Levels order pieces by score; equal scores share one, so that the leftmost wins.
        self.level = np.full(self.size + 2, _NEVER, np.int32)
        level, last = -1, None
        for i in sorted(self.ids.values(), key=lambda i: -scores[i]):
            if scores[i] != last:
                level, last = level + 1, scores[i]
            self.level[i] = level
        self.out = [p.replace(SPACE, " ").encode() if k == "piece" else b"" for p, k in zip(pieces, kinds, strict=True)]
        for b, i in self.byte_ids.items():
            self.out[i] = bytes([b])
        # Segments are encoded apart, so no piece may reach over a boundary between them.
        if any("\n" in p or re.search(f"[^{SPACE}]{SPACE}|[{LETTERS}][^{LETTERS}{SPACE}]", p) for p in self.ids):
            raise ValueError("the vocabulary has pieces that cross a segment boundary")
        self.byte_of = np.array([self.byte_ids.get(b, 0) for b in range(256)], np.int32)
        # The literal mark is no piece of a text: it merges with nothing and is spelt in bytes.
        self.of_char = np.full(0x110000, self.unknown, np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        self.of_char[ord(SPACE)], self.of_char[32] = self.unknown, self.ids.get(SPACE, self.unknown)
        self._pairs()

    def _pairs(self) -> None:
        """A table of open addressing from (left, right) to the piece they make."""
        get = self.ids.get
        made = {a << 32 | b: i for p, i in self.ids.items() for k in range(1, len(p)) if (a := get(p[:k])) is not None and (b := get(p[k:])) is not None}
        bits = max(4, (4 * len(made)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys, self.values = np.full(1 << bits, _EMPTY, np.int64), np.full(1 << bits, self.none, np.int32)
        key, value = np.array(list(made), np.int64), np.array(list(made.values()), np.int32)
        at = self._slot(key)
        while key.size:
            free = np.flatnonzero(self.keys[at] == _EMPTY)
            _, one = np.unique(at[free], return_index=True)
            won = free[one]
            self.keys[at[won]], self.values[at[won]] = key[won], value[won]
            left = np.ones(key.size, bool)
            left[won] = False
            key, value, at = key[left], value[left], (at[left] + 1) & (self.keys.size - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each two symbols make, or ``none``."""
        key = left.astype(np.int64) << 32 | right
        at = self._slot(key)
        found = self.keys[at]
        out = np.where(found == key, self.values[at], self.none)
        open_ = np.flatnonzero((found != key) & (found != _EMPTY))
        while open_.size:
            at[open_] = (at[open_] + 1) & (self.keys.size - 1)
            found, wanted = self.keys[at[open_]], key[open_]
            hit = found == wanted
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (found != _EMPTY)]
        return out

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(model.get_piece_size())
        kinds = ["byte" if model.is_byte(i) else "other" if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else "piece" for i in every]
        return cls([model.id_to_piece(i) for i in every], [model.get_score(i) for i in every], kinds)


def mixed(x: int) -> int:
    """A 64-bit hash of a number."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> shift)) * factor & _M
    return x ^ (x >> 31)


def dropped(key: np.ndarray, piece: np.ndarray, start: np.ndarray, rate: float) -> np.ndarray:
    """Whether the keyed hash says to skip the merge into ``piece`` at ``start`` of the text with ``key``."""
    if rate >= 1:
        return np.ones(piece.size, bool)
    x = key ^ (start.astype(np.uint64) << np.uint64(ID_BITS) | piece.astype(np.uint64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31)) < np.uint64(min(int(rate * 2.0**64), _M))


class Cells:
    """A growing array of numbers."""

    def __init__(self, kind: str):
        self.held, self.size = np.zeros(1024, kind), 0

    def add(self, values: np.ndarray) -> None:
        if self.size + values.size > self.held.size:
            self.held = np.concatenate([self.held[: self.size], np.zeros(self.held.size + values.size, self.held.dtype)])
        self.held[self.size : self.size + values.size] = values
        self.size += values.size


def spread(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers begin .. begin + count - 1 of each, end to end."""
    return np.repeat(begin - np.cumsum(count) + count, count) + np.arange(int(count.sum()))


class Ragged:
    """Lists of numbers end to end, gathered in parts and put in order of their rows."""

    def __init__(self) -> None:
        self.rows: list[np.ndarray] = []
        self.columns: list[tuple[np.ndarray, ...]] = []

    def add(self, rows: np.ndarray, *columns: np.ndarray) -> None:
        self.rows.append(rows)
        self.columns.append(columns)

    def ordered(self, n: int, width: int) -> tuple[np.ndarray, ...]:
        """The count of each of ``n`` rows, and the columns in order of rows."""
        if not self.rows:
            return (np.zeros(n, np.int64), *[np.zeros(0, np.int64)] * width)
        rows = np.concatenate(self.rows)
        order = np.argsort(rows, kind="stable")
        return (np.bincount(rows, minlength=n), *(np.concatenate([c[k] for c in self.columns])[order] for k in range(width)))


class Encoder:
    """Encodes texts; what segments give when nothing is skipped is held, up to a bound."""

    def __init__(self, vocabulary: Vocabulary, seed: int = 0, rate: float = 0.0):
        self.v, self.seed, self.rate = vocabulary, seed, rate
        self._forget()

    def _forget(self) -> None:
        self.places: dict[str, int] = {}
        #: Of each held segment where its candidates and ids end; they begin where the one before ends.
        self.end, self.id_end = Cells("i8"), Cells("i8")
        #: Of each candidate the piece and its start within the segment.
        self.piece, self.start, self.ids = Cells("i4"), Cells("i4"), Cells("i4")
        for cells in (self.end, self.id_end):
            cells.add(np.zeros(1, np.int64))

    def key_of(self, key: int | None) -> int:
        """What a document's candidates are hashed with, from the seed and its id. A null id has that of zero."""
        return mixed(mixed(self.seed * 0xD1B54A32D192ED03 + 1 & _M) + (key or 0) * 0x9E3779B97F4A7C15 & _M)

    def encode(self, text: str, key: int | None = None) -> list[int]:
        """Ids of the text; with dropout, those of the document ``key``."""
        return self.encode_all([text], [key])[0].tolist()

    def encode_all(self, texts: list[str | None], keys: list[int | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts end to end, and how many each has; none of a null or empty one."""
        out: list[np.ndarray] = []
        sizes = np.zeros(len(texts), np.int64)
        segments: list[str] = []
        parts: list[tuple[int, int, int]] = []  # text, segments of it here, place of the first in its text

        def settle() -> None:
            if not segments:
                return
            text, count, at = np.array(parts, np.int64).T
            length = np.fromiter(map(len, segments), np.int64, len(segments))
            start = np.cumsum(length) - length
            first = np.cumsum(count) - count
            start += np.repeat(at - start[first], count)
            hashed = np.array([self.key_of(keys[t]) for t in text.tolist()], np.uint64)
            ids, n = self._part(segments, length, start, np.repeat(hashed, count))
            out.append(ids)
            np.add.at(sizes, text, np.add.reduceat(n, first))
            segments.clear()
            parts.clear()

        for i, text in enumerate(texts):
            every, at = SEGMENT.findall(" " + text) if text else [], 0
            for lo in range(0, len(every), AT_ONCE):
                part = every[lo : lo + AT_ONCE]
                parts.append((i, len(part), at))
                segments.extend(part)
                at += sum(map(len, part)) if len(every) > AT_ONCE else 0
                if len(segments) >= AT_ONCE:
                    settle()
        settle()
        return np.concatenate(out) if out else np.zeros(0, np.int32), sizes

    def _part(self, segments: list[str], length: np.ndarray, start: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of segments end to end, and the count of each."""
        if len(self.places) >= HELD or self.piece.size + self.ids.size >= HELD_CELLS:
            self._forget()
        new = [x for x in dict.fromkeys(segments) if x not in self.places]
        if new:
            n, ids, m, piece, at = self.merged(new)
            self.places.update(zip(new, range(len(self.places), len(self.places) + len(new)), strict=True))
            self.id_end.add(np.cumsum(n) + self.ids.size)
            self.ids.add(ids)
            self.end.add(np.cumsum(m) + self.piece.size)
            self.piece.add(piece)
            self.start.add(at)
        place = np.fromiter(map(self.places.__getitem__, segments), np.int64, len(segments))
        again = np.zeros(place.size, bool)
        if self.rate:
            begin = self.end.held[place]
            count = self.end.held[place + 1] - begin
            cell, of = spread(begin, count), np.repeat(np.arange(place.size), count)
            again[of[dropped(key[of], self.piece.held[cell], self.start.held[cell] + start[of], self.rate)]] = True
        begin = self.id_end.held[place]
        count = self.id_end.held[place + 1] - begin
        if not again.any():
            return self.ids.held[spread(begin, count)], count
        other = np.flatnonzero(again)
        n, ids = self.merged([segments[i] for i in other.tolist()], start[other], key[other])[:2]
        held = np.flatnonzero(~again)
        kept = spread(begin[held], count[held])
        count[other] = n
        at, out = np.cumsum(count) - count, np.empty(int(count.sum()), np.int32)
        out[spread(at[held], count[held])] = self.ids.held[kept]
        out[spread(at[other], n)] = ids
        return out, count

    def merged(self, segments: list[str], start: np.ndarray | None = None, key: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """Counts and ids of segments; without ``key`` nothing is skipped, and counts, pieces and starts of candidates follow."""
        length = np.fromiter(map(len, segments), np.int64, len(segments))
        ids, candidates = Ragged(), Ragged()
        low = 0
        for width in WIDTHS:
            rows = np.flatnonzero((length > low) & (length <= width))
            low = width
            for at in range(0, rows.size, TABLE_ROWS):
                own = rows[at : at + TABLE_ROWS]
                self._table([segments[i] for i in own.tolist()], length[own], own, width, None if key is None else (start[own], key[own]), ids, candidates)
        for i in np.flatnonzero(length > low).tolist():
            came: list[tuple[int, int]] = []
            ids_of = np.array(self.agenda(segments[i], self._judge(key, start, i, came)), np.int32)
            ids.add(np.full(ids_of.size, i), ids_of)
            candidates.add(np.full(len(came), i), np.array([p for p, _ in came], np.int32), np.array([x for _, x in came], np.int32))
        return *ids.ordered(len(segments), 1), *candidates.ordered(len(segments), 2)

    def _judge(self, key: np.ndarray | None, start: np.ndarray | None, i: int, came: list[tuple[int, int]]) -> Callable[[int, int], bool]:
        """Says of a candidate of segment i whether to skip it, or notes it."""
        if key is None:
            return lambda piece, at: came.append((piece, at))
        limit, own, begin = min(int(self.rate * 2.0**64), _M), int(key[i]), int(start[i])
        return lambda piece, at: self.rate >= 1 or mixed(own ^ (begin + at << ID_BITS | piece)) < limit

    def _table(self, segments: list[str], length: np.ndarray, rows: np.ndarray, width: int, drop: tuple[np.ndarray, np.ndarray] | None, ids: Ragged, candidates: Ragged) -> None:
        """Steps all agendas of a table of symbols until none has a candidate.

        Column 0 and the last hold no symbol. A merged symbol stands where its first part
        stood; ``after`` and ``before`` lead over the places left empty.
        """
        v, w, n = self.v, width + 2, len(segments)
        code = np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32)
        symbol = np.full(n * w, v.none, np.int32)
        where = spread(np.arange(n) * w + 1, length)
        symbol[where] = v.of_char[code]
        piece = np.full((n, w), v.none, np.int32)
        grid = symbol.reshape(n, w)
        piece[:, 1:width] = v.pair(grid[:, 1:width].ravel(), grid[:, 2 : width + 1].ravel()).reshape(n, width - 1)
        level = v.level[piece]
        piece, worth = piece.ravel(), level.ravel()
        after, before = np.arange(1, n * w + 1), np.arange(-1, n * w - 1)
        open_ = np.flatnonzero(level.min(axis=1) < _NEVER)
        while open_.size:
            at = open_ * w + level[open_].argmin(axis=1)
            go = worth[at] < _NEVER
            open_, at = open_[go], at[go]
            made, of = piece[at], open_
            if drop is None:
                candidates.add(rows[of], made, (at - of * w - 1).astype(np.int32))
            else:
                skip = dropped(drop[1][of], made, drop[0][of] + at - of * w - 1, self.rate)
                worth[at[skip]] = _NEVER
                at, made = at[~skip], made[~skip]
            gone = after[at]
            right, left = after[gone], before[at]
            symbol[at], symbol[gone], worth[gone] = made, v.none, _NEVER
            after[at], before[right] = right, at
            for place, x in ((at, v.pair(made, symbol[right])), (left, v.pair(symbol[left], made))):
                piece[place], worth[place] = x, v.level[x]
        alive = np.flatnonzero(symbol != v.none)
        found, of = symbol[alive], rows[alive // w]
        if (odd := found == v.unknown).any():
            # A character that is no piece is spelt in bytes.
            char = np.zeros(n * w, np.uint32)
            char[where] = code
            spelt = char[alive[odd]].tobytes().decode("utf-32-le").encode()
            first = char[alive]
            times = np.where(odd, 1 + (first >= 0x80) + (first >= 0x800) + (first >= 0x10000), 1)
            found, of, odd = np.repeat(found, times), np.repeat(of, times), np.repeat(odd, times)
            found[odd] = v.byte_of[np.frombuffer(spelt, np.uint8)]
        ids.add(of, found)

    def agenda(self, segment: str, drop: Callable[[int, int], bool]) -> list[int]:
        """Ids of a segment of any length, by a heap over linked symbols; drop: gets a candidate's piece and start."""
        v = self.v
        symbols = v.of_char[np.frombuffer(segment.encode("utf-32-le"), np.uint32)].tolist()
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(begin: list[int]) -> None:
            begin = [i for i in begin if i >= 0 and after[i] >= 0]
            made = v.pair(np.array([symbols[i] for i in begin], np.int64), np.array([symbols[after[i]] for i in begin], np.int64))
            for i, x, worth in zip(begin, made.tolist(), v.level[made].tolist(), strict=True):
                if x != v.none:
                    heapq.heappush(heap, (worth, i, x, symbols[i], symbols[after[i]]))

        offer(list(range(n)))
        while heap:
            _, i, made, left, right = heapq.heappop(heap)
            j = after[i]
            # An offer is void once either side has grown or gone.
            if j < 0 or symbols[i] != left or symbols[j] != right or drop(made, i):
                continue
            symbols[i], symbols[j], after[i] = made, v.none, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer([before[i], i])
        return [y for s, x in zip(segment, symbols, strict=True) if x != v.none for y in ([x] if x != v.unknown else [v.byte_ids[b] for b in s.encode()])]


def decode(vocabulary: Vocabulary, ids: Iterable[int]) -> str:
    """The text of ids: pieces joined, byte pieces as bytes, the leading space dropped."""
    joined = b"".join(map(vocabulary.out.__getitem__, ids))
    return (joined[1:] if joined[:1] == b" " else joined).decode("utf-8", "replace")


SCHEMA = "doc_id long, n_ids long, ids array<int>, lossless boolean"


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = DEFAULT_MODEL, seed: int = 17, rate: float = 0.1) -> DataFrame:
    """Ids of every whole text, with whether they decode to it.

    The dropout hash takes the document's id and the place in its whole text, so the same
    id, text and seed give the same ids on every run, whatever executor does the work. A
    null text has null ids and count and is lossless; an empty one has no ids; a very long
    one is encoded in stretches of segments. A null id hashes like zero; repeated rows give
    repeated rows; an empty table gives none. Other columns are not read. ``model`` must
    be at that path on every executor.
    """
    held: dict[str, Encoder] = {}

    def rows(keys: list, texts: list) -> dict[str, list]:
        if not held:
            held["encoder"] = Encoder(Vocabulary.load(model), seed, rate)
        enc = held["encoder"]
        ids, sizes = enc.encode_all(texts, keys)
        ends = np.append(0, np.cumsum(sizes))
        null = [t is None for t in texts]
        spans = zip(ends[:-1].tolist(), ends[1:].tolist(), texts, strict=True)
        return {
            "doc_id": keys,
            "n_ids": [None if t is None else n for t, n in zip(texts, sizes.tolist(), strict=True)],
            "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids), mask=pa.array(null)),
            "lossless": [t is None or decode(enc.v, ids[b:e].tolist()) == t for b, e, t in spans],
        }

    return map_rows(docs, [id_col, text_col], rows, SCHEMA)


def decode_column(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str = DEFAULT_MODEL) -> DataFrame:
    """(doc_id, text) from ids, row by row.

    Null ids give a null text, none an empty one; a null id stays null, repeated rows give
    repeated rows, an empty table gives none. Other columns are not read.
    """
    held: dict[str, Vocabulary] = {}

    def rows(keys: list, ids: list) -> dict[str, list]:
        if not held:
            held["v"] = Vocabulary.load(model)
        return {"doc_id": keys, "text": [None if x is None else decode(held["v"], x) for x in ids]}

    return map_rows(df, [id_col, ids_col], rows, "doc_id long, text string")
