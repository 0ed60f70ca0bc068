"""Benchmark decontamination under edit distance.

A random walk over a word sequence (a step repeats or consumes the word under it, as a
hash of step and word says) embeds edit distance into Hamming distance. Item-sized
windows of a document and the items of that size meet when sampled coordinates of their
embeddings agree; walks are repeated until the chance to miss falls under the target,
as often as the size's own rate of meeting asks. Longer items are edited in more places
and agree in fewer coordinates, so they sample fewer: the most of three that USUAL_WALKS
repetitions bring to the target, and one coordinate with as many as it asks for otherwise.
What meets is verified by exact edit distance.

Windows are taken where an item may stand at all: an item of n words within d edits
shares a run of n // (d + 1) words with the text, so a text without one of its runs
holds no match and needs no walk.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SLICE_ROWS, map_rows

WORD = re.compile(r"\w+")
#: Edits allowed as a share of an item's words, and the longest shared run looked for.
EDITS, RUN = 0.2, 4
#: Coordinates that must agree, at most, and the recall that repetitions are chosen for.
SAMPLED, RECALL = 3, 0.99
#: Repetitions up to which a size samples more than one coordinate, and that its rate of meeting is taken from.
USUAL_WALKS = 96
#: Edited copies that a size's rate of meeting is taken from; the lowest counts.
COPIES = 12
#: Items and bytes of items looked for at once; larger benchmarks go in blocks.
BLOCK_BYTES = 8 << 20
_P = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters, digits and underscores."""
    return WORD.findall(text.lower()) if text else []


def edit_distance_within(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(edits, start, end) of the part of ``text`` nearest to ``item``; the shortest of the first among ties."""
    m = text.size
    ramp = np.arange(m + 1)
    cost, origin = np.zeros(m + 1, np.int64), ramp.copy()
    for x in item:
        diagonal = cost[:-1] + (text != x)
        up = cost + 1
        best = np.concatenate([up[:1], np.minimum(diagonal, up[1:])])
        source = np.concatenate([origin[:1], np.where(diagonal <= up[1:], origin[:-1], origin[1:])])
        # A run of insertions: the least of what stands left of here, one more a step.
        level = best - ramp
        low = np.minimum.accumulate(level)
        at = np.maximum.accumulate(np.where(level == low, ramp, 0))
        cost, origin = low + ramp, source[at]
    end = int(cost.argmin())
    return int(cost[end]), int(origin[end]), end


class Matcher:
    """Finds items in texts. items: (item_id, text) pairs; those without words are left out."""

    def __init__(self, items: Iterable[tuple[int, str | None]], edits: float = EDITS, recall: float = RECALL, seed: int = 7):
        vocabulary: dict[str, int] = {}
        self.ids, self.items = [], []
        for item_id, text in items:
            if w := words_of(text):
                self.ids.append(item_id)
                self.items.append(np.array([vocabulary.setdefault(x, len(vocabulary) + 1) for x in w], np.int64))
        self.vocabulary, self.seed = vocabulary, seed
        self.sizes = np.array([x.size for x in self.items], np.int64)
        self.allowed = (self.sizes * edits + 1e-9).astype(np.int64)
        self.runs = np.minimum(RUN, self.sizes // (self.allowed + 1))
        self.widest = int(self.sizes.max(initial=0))
        self._seeds()
        #: Of each item: repetitions, and coordinates that must agree in each.
        self.walks, self.sampled = self._walks(recall)
        self._index()

    # -- where an item may stand

    def _seeds(self) -> None:
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for q in sorted(set(self.runs.tolist())):
            key, item, offset = [], [], []
            for i in np.flatnonzero(self.runs == q):
                k = self._rolled(self.items[i], q)
                key.append(k)
                item.append(np.full(k.size, i))
                offset.append(np.arange(k.size))
            key, item, offset = map(np.concatenate, (key, item, offset))
            order = np.argsort(key, kind="stable")
            unique, first = np.unique(key[order], return_index=True)
            self.seeds[q] = (unique, np.append(first, key.size), item[order], offset[order])

    @staticmethod
    def _rolled(x: np.ndarray, q: int) -> np.ndarray:
        n = x.size - q + 1
        h = np.zeros(max(n, 0), np.uint64)
        for i in range(q):
            h = (h + x[i : i + n].astype(np.uint64)) * _P
            h ^= h >> np.uint64(29)
        return h

    def _windows(self, x: np.ndarray, doc: np.ndarray, floor: np.ndarray, ceiling: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, size) of windows near the diagonals of shared runs. doc, floor, ceiling: each word's document and its bounds."""
        found = []
        for q, (unique, first, item, offset) in self.seeds.items():
            n = x.size - q + 1
            if n <= 0:
                continue
            known = x[:n] > 0
            for i in range(1, q):
                known &= x[i : i + n] > 0
            at = np.flatnonzero(known)
            if not at.size:
                continue
            key = np.zeros(at.size, np.uint64)
            for i in range(q):
                key = (key + x[at + i].astype(np.uint64)) * _P
                key ^= key >> np.uint64(29)
            place = np.minimum(np.searchsorted(unique, key), unique.size - 1)
            hit = unique[place] == key
            at, place = at[hit], place[hit]
            if not at.size:
                continue
            count = first[place + 1] - first[place]
            posting = np.repeat(first[place] - np.cumsum(count) + count, count) + np.arange(count.sum())
            at = np.repeat(at, count)
            which = item[posting]
            start = at - offset[posting]
            found.append(self._starts(which, start, at, doc, floor, ceiling))
        return tuple(np.unique(np.concatenate(found, axis=1), axis=1)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _starts(self, item: np.ndarray, start: np.ndarray, at: np.ndarray, doc: np.ndarray, floor: np.ndarray, ceiling: np.ndarray) -> np.ndarray:
        """(start, size) of windows about runs, given by item, diagonal and place, where enough of an item's runs lie near each other."""
        order = np.lexsort((start, doc[at], item))
        item, start, at = item[order], start[order], at[order]
        d, n = self.allowed[item], self.sizes[item]
        # An indel before a run moves the true start by one each.
        lo, hi = np.maximum(floor[at], start - d), np.minimum(ceiling[at] - 1, start + d)
        begins = np.flatnonzero(np.append(True, (item[1:] != item[:-1]) | (doc[at[1:]] != doc[at[:-1]]) | (lo[1:] > hi[:-1] + 1)))
        # Within d edits all but q each of an item's runs of q words stand in the text.
        q, d, n = self.runs[item[begins]], d[begins], n[begins]
        counts = np.diff(np.append(begins, item.size))
        enough = counts >= n - q + 1 - q * d
        low = np.minimum(lo[begins], ceiling[at[begins]] - 1)[enough]
        count = np.maximum(np.maximum.reduceat(hi, begins)[enough], low) - low + 1
        s = np.repeat(low - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
        return np.stack([s, np.repeat(n[enough], count)])

    # -- walks

    def _random(self, *shape: int) -> np.ndarray:
        """Odd numbers; fewer rows are the first ones of more."""
        return np.random.default_rng([self.seed, *shape[1:]]).integers(0, 1 << 63, shape, np.uint64) * np.uint64(2) + np.uint64(1)

    def keys(self, x: np.ndarray, start: np.ndarray, size: np.ndarray, end: np.ndarray, walks: int, sampled: np.ndarray) -> np.ndarray:
        """(walks, windows) hashes of the ``sampled`` coordinates of each window's embedding under each walk.

        end: where each window's document ends; words from there on, or beyond the size,
        are the padding word 0.
        """
        steps = 2 * self.widest
        step_key = self._random(walks, steps)
        chosen = np.random.default_rng([self.seed, 1]).random((walks, SAMPLED))
        at = np.zeros((walks, start.size), np.int64)
        out = np.broadcast_to(size.astype(np.uint64) * _P, at.shape).copy()
        # A walk has consumed a window after about two steps a word.
        coordinate = np.floor(chosen[:, :, None] * (1.8 * size)[None, None, :]).astype(np.int64)
        coordinate[:, np.arange(SAMPLED)[:, None] >= sampled] = -1
        last = np.minimum(size, end - start)
        for j in range(min(steps, int(coordinate.max(initial=-1)) + 1)):
            word = np.where(at < last, x[np.minimum(start + at, x.size - 1)], 0).astype(np.uint64)
            times = (coordinate == j).sum(axis=1)
            mixed = (out ^ (word + np.uint64(j * 2654435761 + 1))) * _P
            out = np.where(times > 0, mixed ^ (mixed >> np.uint64(32)), out)
            at += (((word + np.uint64(1)) * step_key[:, j : j + 1]) >> np.uint64(63)).astype(np.int64)
        return out

    def _walks(self, recall: float) -> tuple[np.ndarray, np.ndarray]:
        """Repetitions and coordinates by size, from the lowest rate at which edited copies of its items meet them."""
        walks, sampled = np.zeros(self.sizes.size, np.int64), np.zeros(self.sizes.size, np.int64)
        for n in np.unique(self.sizes).tolist():
            own = np.flatnonzero(self.sizes == n)
            rng = np.random.default_rng([self.seed, 2, n])
            rows, d = [], int(self.allowed[own[0]])
            for i in np.resize(rng.permutation(own), COPIES):
                copy = self.items[i].tolist()
                for _ in range(d):
                    k = int(rng.integers(0, len(copy)))
                    kind = rng.integers(0, 3)
                    copy[k : k + (kind != 1)] = [] if kind == 2 and len(copy) > 1 else [0]
                rows += [self.items[i], np.array((copy + [0] * n)[:n], np.int64)]
            start = np.arange(2 * COPIES) * n
            for c in range(SAMPLED, 0, -1):
                got = self.keys(np.concatenate(rows), start, np.full(start.size, n), start + n, USUAL_WALKS, np.full(start.size, c))
                # A copy that never met in so many walks counts as if it had in the next.
                p = min(0.999, max(1 / (USUAL_WALKS + 1), float((got[:, ::2] == got[:, 1::2]).mean(axis=0).min())))
                walks[own], sampled[own] = math.ceil(math.log(1 - recall) / math.log(1 - p)), c
                if walks[own[0]] <= USUAL_WALKS:
                    break
        return walks, sampled

    def _index(self) -> None:
        self.table: list[tuple[np.ndarray, np.ndarray]] = []
        if not self.items:
            return
        flat = np.concatenate(self.items)
        start = np.cumsum(self.sizes) - self.sizes
        for w, row in enumerate(self.keys(flat, start, self.sizes, start + self.sizes, int(self.walks.max()), self.sampled)):
            own = np.flatnonzero(self.walks > w)
            order = np.argsort(row[own], kind="stable")
            self.table.append((row[own][order], own[order]))
        self.walks_of_size, self.sampled_of_size = (np.zeros(self.widest + 1, np.int64) for _ in range(2))
        self.walks_of_size[self.sizes], self.sampled_of_size[self.sizes] = self.walks, self.sampled

    # -- texts

    def find(self, texts: list[str | None]) -> list[list[tuple[int, int, int, int]]]:
        """For each text (item_id, start, end, edits) of every item in it: the best place, the first among ties, in words."""
        found: list[dict[int, tuple[int, int, int]]] = [{} for _ in texts]
        get = self.vocabulary.get
        rows, sizes = [], []
        for text in texts:
            x = [get(w, 0) for w in words_of(text)] if self.items else []
            rows.append(np.array(x, np.int64))
            sizes.append(len(x))
        x = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        if not x.any():
            return [[] for _ in texts]
        ends = np.cumsum(sizes)
        doc = np.repeat(np.arange(len(texts)), sizes)
        floor, ceiling = (ends - sizes)[doc], ends[doc]
        start, size = self._windows(x, doc, floor, ceiling)
        met: list[np.ndarray] = []
        order = np.argsort(self.walks_of_size[size], kind="stable")
        start, size = start[order], size[order]
        for lo in range(0, start.size, 4096):
            s, n = start[lo : lo + 4096], size[lo : lo + 4096]
            walks = int(self.walks_of_size[n].max())
            for (sorted_keys, order), row in zip(self.table[:walks], self.keys(x, s, n, ceiling[s], walks, self.sampled_of_size[n]), strict=True):
                left = np.searchsorted(sorted_keys, row)
                count = np.searchsorted(sorted_keys, row, "right") - left
                which = np.repeat(left - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
                met.append(np.unique(np.stack([order[which], np.repeat(s, count)]), axis=1))
        if not met:
            return [[] for _ in texts]
        item, s = np.unique(np.concatenate(met, axis=1), axis=1)
        # Places of an item whose texts overlap are verified as one stretch.
        d = self.allowed[item]
        begins = np.flatnonzero(np.append(True, (item[1:] != item[:-1]) | (doc[s[1:]] != doc[s[:-1]]) | (s[1:] - d[1:] > s[:-1] + self.sizes[item[:-1]] + 3 * d[:-1])))[: item.size]
        for i, first, last in zip(item[begins].tolist(), s[begins].tolist(), s[np.append(begins[1:], item.size) - 1].tolist(), strict=True):
            d, n, low = int(self.allowed[i]), int(self.sizes[i]), int(floor[first])
            lo, hi = max(low, first - d), min(int(ceiling[first]), last + n + 3 * d)
            edits, b, e = edit_distance_within(self.items[i], x[lo:hi])
            if edits <= d:
                k, best = int(doc[first]), (edits, lo + b - low, lo + e - low)
                found[k][i] = min(found[k].get(i, best), best)
        return [[(self.ids[i], b, e, edits) for i, (edits, b, e) in sorted(f.items())] for f in found]


def matchers(benchmark: DataFrame, id_col: str, text_col: str, edits: float, block_bytes: int = BLOCK_BYTES) -> list[Matcher]:
    """Matchers for blocks of the benchmark, each of a bounded size."""
    items = benchmark.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("t")).where(F.col("t").isNotNull())
    size = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("n")).collect()[0]["n"]
    blocks = max(1, -(-size // block_bytes))
    out = []
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).distinct().orderBy("i", "t").collect()
        out.append(Matcher([(r["i"], r["t"]) for r in rows], edits))
    return out


SCHEMA = "doc_id long, item_id long, start_word int, end_word int, edits int, similarity double"


def matches(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document and item that stands in it within ``edits`` of its word count.

    The place is that of fewest edits, the first among ties, counted in words, end
    exclusive. A document without a match, a null or an empty text gives no row, an item
    without words matches nothing, an item of few words (under five at 0.2) matches only
    unedited. A null id stays null; repeated rows give repeated rows; an empty table gives
    none. Other columns are not read. The benchmark is held in blocks of bounded size,
    each looked for in every text.
    """
    out = None
    for matcher in matchers(benchmark, item_col, item_text_col, edits):

        def rows(ids: list, texts: list, matcher: Matcher = matcher) -> dict[str, list]:
            found = [(i, *m) for i, ms in zip(ids, matcher.find(texts), strict=True) for m in ms]
            size = dict(zip(matcher.ids, matcher.sizes.tolist(), strict=True))
            return {
                "doc_id": [x[0] for x in found], "item_id": [x[1] for x in found],
                "start_word": [x[2] for x in found], "end_word": [x[3] for x in found],
                "edits": [x[4] for x in found], "similarity": [1 - x[4] / size[x[1]] for x in found],
            }

        part = map_rows(docs, [id_col, text_col], rows, SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents in which no item stands, with all their columns; judged row by row, so ids may be null or repeat."""
    def judge(matcher: Matcher) -> Callable[[Column], Column]:
        @F.arrow_udf("boolean")
        def clean(texts: pa.Array) -> pa.Array:
            parts = (texts.slice(at, SLICE_ROWS).to_pylist() for at in range(0, len(texts), SLICE_ROWS))
            return pa.array([not m for part in parts for m in matcher.find(part)], pa.bool_())

        return clean

    for matcher in matchers(benchmark, item_col, item_text_col, edits):
        docs = docs.where(judge(matcher)(F.col(f"`{text_col}`")))
    return docs
