"""Repeated substrings by compacting a De Bruijn graph of word windows.

An edge of the graph is a window of ``k`` words. Consecutive windows that share their
least ``m``-word run (their anchor) form a path, and a path is one record: the hash of
its words and where it starts. A path that repeats whole does not branch, so all its
edges are settled at once, by the coordinates of its first source. Paths that share an
anchor but not all words branch somewhere: the first source of each is spelt out into
edges, and those are settled one by one in the same way. Only the branching part of
the repeated part of the graph is ever handled edge by edge.

Of the repeated paths and edges a join of their places finds which follows which, and
the degree of the node between. Where it does not branch they are linked, and joins of
doubling reach compact each chain of links into one long span. Paths and edges are found
equal by 64-bit hashes; then both texts are read at the coordinates of each span, and 128-bit
digests of the words that stand there are compared. Should one differ, all is done again
under another seed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count as numbers
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SLICE_ROWS, checkpoint, discard, stored

K, M = 20, 8
#: Words whose paths are found and pre-aggregated at once.
CHUNK_WORDS = 1_000_000
REMOVE, SPELL, SOURCE = 1, 2, 3
#: Bits of a record's last number that hold the windows of a path, which are k - m + 1 at most.
WINDOW_BITS = 8
_P = 0x9E3779B97F4A7C15
_PI = pow(_P, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes:
    """Hashes of any run of words, from prefix sums of powers modulo 2^64."""

    def __init__(self, words: list[bytes], seed: int = 0):
        n = len(words)
        w = np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(seed)), np.uint64, n)
        powers = np.full(n, _P, np.uint64)
        inverse = np.full(n + 1, _PI, np.uint64)
        inverse[0] = 1
        self.inverse = np.multiply.accumulate(inverse)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w * np.multiply.accumulate(powers), dtype=np.uint64)])

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return _mix((self.sums[start + length] - self.sums[start]) * self.inverse[start])


def paths(h: Hashes, sizes: np.ndarray, k: int = K, m: int = M) -> tuple[np.ndarray, ...]:
    """(anchor hash, path hash, text, start, windows) of every path of texts of ``sizes`` words laid end to end."""
    ends = np.cumsum(sizes)
    begins = ends - sizes
    total = int(ends[-1]) if sizes.size else 0
    if total < k:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    run = h.of(np.arange(total - m + 1), m)
    # The place of the least run among the k - m + 1 of each window, leftmost among ties, by doubling.
    at, width, span = np.arange(run.size), 1, k - m + 1
    while width * 2 <= span:
        a, b = at[: at.size - width], at[width:]
        at, width = np.where(run[b] < run[a], b, a), width * 2
    if width < span:
        a, b = at[: at.size - (span - width)], at[span - width :]
        at = np.where(run[b] < run[a], b, a)
    text = np.repeat(np.arange(sizes.size), sizes)[: at.size]
    inside = np.arange(at.size) + k <= ends[text]
    s = np.flatnonzero(inside)
    if not s.size:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    anchor = at[s]
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[s[1:]] != text[s[:-1]])]))
    count = np.diff(np.append(first, s.size))
    s, anchor = s[first], anchor[first]
    whole = h.of(s, count + (k - 1)) ^ _mix(count.astype(np.uint64))
    return run[anchor], whole, text[s], s - begins[text[s]], count


def _rows(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64)) for c in columns], names=list("abcdef")[: len(columns)])


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[list[bytes]]]]:
    """Keys and words of (key, text) rows, about CHUNK_WORDS at a time; a longer text stays whole."""
    keys, texts, n = [], [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(at, SLICE_ROWS)
            for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                words = text.encode().split() if text else []
                keys.append(key)
                texts.append(words)
                n += len(words)
                if n >= CHUNK_WORDS:
                    yield keys, texts
                    keys, texts, n = [], [], 0
    if keys:
        yield keys, texts


def first_of(classes: np.ndarray, key: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by (class, key, start), a mask in it of each class's first, and the place of that in it."""
    order = np.lexsort((start, key, classes))
    ordered = classes[order]
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if ordered.size else np.zeros(0, bool)
    return order, first, np.maximum.accumulate(np.where(first, np.arange(first.size), 0))


def _record(anchor: np.ndarray, path: np.ndarray, key: np.ndarray, start: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    """Records (anchor, path, key, start, windows), the first of each path; any other as settled.

    A settled one goes under an anchor of its own; it holds the key of its source for the
    path, and below zero the source's start with the windows.
    """
    order, first, source = first_of(path, key, start)
    anchor, path, key, start, count = (x[order] for x in (anchor, path, key, start, count))
    own = _mix(key.view(np.uint64) + start.astype(np.uint64))
    return _rows(np.where(first, anchor, own), np.where(first, path.view(np.int64), key[source]), key, start, np.where(first, count, -(start[source] << WINDOW_BITS | count)))


def scan(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    """Path records (anchor, path, key, start, windows).

    What is not the first of its path within a chunk cannot be it elsewhere: it is sent
    on as settled. So a path with a great share of all sources costs one shuffled record a chunk.
    """
    for keys, texts in chunks(batches):
        h = Hashes([w for t in texts for w in t], seed)
        anchor, whole, text, start, count = paths(h, np.array([len(t) for t in texts], np.int64))
        yield _record(anchor, whole, np.array(keys, np.int64)[text], start, count)


def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, start, windows, what, source key, source start) from path records in order of (anchor, path, key, start).

    A path's later sources are to be removed; its first one is spelt out if the anchor
    has another path. One record at most is held over from batch to batch.
    """
    last: tuple[int, int] | None = None  # anchor and path of the row before
    source = (0, 0)  # key and start of that path's first
    several, held = False, None  # whether that anchor has several paths; else its first source
    for batch in batches:
        anchor, path, key, start, count = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        done = count < 0
        packed = -count[done]
        out = [np.stack([key[done], start[done], packed & ((1 << WINDOW_BITS) - 1), np.full(packed.size, REMOVE), path[done], packed >> WINDOW_BITS])]
        anchor, path, key, start, count = (x[~done] for x in (anchor, path, key, start, count))
        if anchor.size:
            before = last or (~anchor[0], path[0])
            new_anchor = np.concatenate([[anchor[0] != before[0]], anchor[1:] != anchor[:-1]])
            new_path = new_anchor | np.concatenate([[path[0] != before[1]], path[1:] != path[:-1]])
            group = np.cumsum(new_anchor)  # group 0 goes on from the batch before
            classes = np.bincount(group, new_path, minlength=int(group[-1]) + 1)
            one = lambda x: np.stack([x[0], x[1], x[2], np.full(x[0].size, SPELL), x[0], x[1]])
            rows = np.stack([key, start, count])
            first = np.maximum.accumulate(np.where(new_path, np.arange(key.size), -1))
            from_key, from_start = np.where(first >= 0, key[first], source[0]), np.where(first >= 0, start[first], source[1])
            again = ~new_path
            out.append(np.concatenate([rows[:, again], np.full((1, int(again.sum())), REMOVE), np.stack([from_key, from_start])[:, again]]))
            goes_on = not new_anchor[0]
            if goes_on and classes[0] > 0:
                if held is not None:
                    out.append(one(held))
                several, held = True, None
            spelt = new_path & ((classes > 1)[group] | ((group == 0) & goes_on))
            end = int(group[-1])
            out.append(one(rows[:, spelt]))
            if end > 0:
                several = classes[end] > 1
                held = None if several else rows[:, new_path & (group == end)]
            last, source = (anchor[-1], path[-1]), (int(from_key[-1]), int(from_start[-1]))
        yield _rows(*np.concatenate(out, axis=1))


RANGE = "struct<start:int,windows:int,what:int,src_key:bigint,src_start:int>"


def sources(found: DataFrame) -> DataFrame:
    """(src_key, src_start, windows, ck, cs): each source that repeats (key, start, windows, src_key, src_start) name, with the first source of its path in all texts.

    A task names the first that it saw itself, which may be a repeat of an earlier one elsewhere.
    So a path of many repeats meets its first source once a chunk of texts, not once a repeat.
    """
    elsewhere = found.select(F.col("key").alias("src_key"), F.col("start").alias("src_start"), F.col("src_key").alias("ck"), F.col("src_start").alias("cs"))
    named = found.groupBy("src_key", "src_start").agg(F.max("windows").alias("windows")).join(elsewhere, ["src_key", "src_start"], "left")
    return named.select("src_key", "src_start", "windows", F.coalesce("ck", "src_key").alias("ck"), F.coalesce("cs", "src_start").alias("cs"))


def degrees(places: DataFrame) -> DataFrame:
    """(ck, cs, windows, n, m, least, most) of each repeated path (ck, cs): its places, and what follows there.

    places: (key, start, windows, ck, cs), first sources included. Of the ``m`` followers whose
    first source lies in the same text, it holds the least and the greatest start of that.
    """
    after = places.select("key", "start", F.col("ck").alias("nk"), F.col("cs").alias("ns"))
    steps = places.withColumn("start", F.col("start") + F.col("windows")).join(after, ["key", "start"], "left")
    near = F.when(F.col("nk") == F.col("ck"), F.col("ns"))
    return steps.groupBy("ck", "cs").agg(F.max("windows").alias("windows"), F.count("*").alias("n"), F.count(near).alias("m"), F.min(near).alias("least"), F.max(near).alias("most"))


def links(degree: DataFrame) -> DataFrame:
    """(ck, cs, to): paths with the one path that they always follow and that nothing else follows.

    All places of the one lead to the other, and both have as many: the node between them
    does not branch. Their first sources then follow each other in one text.
    """
    leads = degree.where("m = n AND least = most").select("ck", F.col("least").alias("cs"), F.col("cs").alias("to"), "n")
    return leads.join(degree.select("ck", "cs", "n"), ["ck", "cs", "n"]).select("ck", "cs", "to")


def heads(linked: DataFrame) -> DataFrame:
    """(ck, cs, to) with the first path of each chain of links in ``to``, by joins that double their reach each round.

    Until it is done, no two paths point to the same one: no join key is hot.
    """
    now = stored(linked.withColumn("done", F.lit(False)))
    while not now.where("NOT done").isEmpty():
        ahead = now.select("ck", F.col("cs").alias("to"), F.col("to").alias("far"), F.col("done").alias("end"))
        moved = now.where("NOT done").join(ahead, ["ck", "to"], "left").select("ck", "cs", F.coalesce("far", "to").alias("to"), F.coalesce("end", F.lit(True)).alias("done"))
        before, now = now, stored(moved.unionByName(now.where("done")))
        discard(before)
    return now


def compact(found: DataFrame) -> DataFrame:
    """Spans (key, start, windows, src_key, src_start): the places of repeated paths, nonbranching chains of them as one.

    found: places of repeated paths. Every place of a chain is a place of its first path.
    """
    named = stored(sources(found))
    again = found.select("key", "start", "src_key", "src_start")
    once = named.groupBy("ck", "cs").agg(F.max("windows").alias("windows")).select(F.col("ck").alias("key"), F.col("cs").alias("start"), "windows", "ck", "cs")
    places = stored(again.join(named, ["src_key", "src_start"]).select("key", "start", "windows", "ck", "cs").unionByName(once))
    degree = stored(degrees(places))
    discard(places)
    chained = heads(links(degree))
    members = degree.select("ck", "cs", "windows").join(chained.select("ck", "cs", "to"), ["ck", "cs"], "left")
    chains = members.select("ck", F.coalesce("to", "cs").alias("head"), (F.col("cs") + F.col("windows")).alias("end")).groupBy("ck", "head").agg(F.max("end").alias("end"))
    chains = chains.select("ck", F.col("head").alias("cs"), (F.col("end") - F.col("head")).alias("windows"))
    spans = again.join(named.select("src_key", "src_start", "ck", "cs").join(chains, ["ck", "cs"]), ["src_key", "src_start"])
    out = stored(spans.select("key", "start", "windows", F.col("ck").alias("src_key"), F.col("cs").alias("src_start")))
    discard(named, degree, chained)
    return out


def ranges_of(settled: DataFrame, spans: DataFrame) -> DataFrame:
    """(key, ranges): what is done with each text: its spans, the paths to spell, and the places where it is a source."""
    own = spans.withColumn("what", F.lit(REMOVE)).unionByName(settled.where(F.col("what") == SPELL))
    asked = spans.select(F.col("src_key").alias("key"), F.col("src_start").alias("start"), "windows", F.lit(SOURCE).alias("what"), "src_key", "src_start").distinct()
    return own.unionByName(asked).groupBy("key").agg(F.collect_list(F.struct("start", "windows", "what", "src_key", "src_start").cast(RANGE)).alias("ranges"))


def checks(words: list[bytes], ranges: list[dict]) -> bytes | None:
    """Rows (source key, source start, windows, digest in two) of the spans of a text and of its places as a source."""
    found = []
    for x in ranges or []:
        if x["what"] != SPELL:
            d = xxhash.xxh3_128_intdigest(b" ".join(words[x["start"] : x["start"] + x["windows"] + K - 1]))
            found.append((x["src_key"], x["src_start"], x["windows"], (d >> 64) - (1 << 63), (d & ((1 << 64) - 1)) - (1 << 63)))
    return np.array(found, np.int64).tobytes() if found else None


def differ(step: DataFrame) -> bool:
    """Whether the words of a span differ from those at its source's coordinates. step: (..., checks)."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                yield _rows(*np.frombuffer(b"".join(batch.column(0).slice(at, SLICE_ROWS).to_pylist()), np.int64).reshape(-1, 5).T)

    rows = step.select("checks").where("checks IS NOT NULL").mapInArrow(spread, "a long, b long, c long, d long, e long")
    sides = rows.groupBy("a", "b", "c").agg(*[f(c).alias(f"{n}{c}") for c in "de" for n, f in (("least_", F.min), ("most_", F.max))])
    return not sides.where("least_d <> most_d OR least_e <> most_e").isEmpty()


def _pack(ranges: list[dict]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    both: dict[int, list] = {REMOVE: [], SPELL: [], SOURCE: []}
    for r in ranges or []:
        both[r["what"]].append((r["start"], r["windows"]))
    return both[REMOVE], both[SPELL]


def _cover(mask: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
    edges = np.zeros(mask.size + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + lengths, -1)
    mask |= np.cumsum(edges)[:-1] > 0


def _digest(words: list[bytes], mask: np.ndarray | None) -> str:
    kept = words if mask is None else [w for w, gone in zip(words, mask.tolist(), strict=True) if not gone]
    return hashlib.sha256(b" ".join(kept)).hexdigest()


FIRST = "key long, n_words long, n_removed long, kept_sha256 string, z binary, mask binary, hashes binary, starts binary, checks binary"


def apply_paths(batches: Iterator[pa.RecordBatch], out: pa.Schema, seed: int) -> Iterator[pa.RecordBatch]:
    """Removes whole paths from (key, z, ranges) rows.

    A text with paths to spell keeps its words (compressed), its mask and its edges for
    the next step; any other is done.
    """
    codec = pa.Codec("zstd")
    for batch in batches:
        for at in range(0, batch.num_rows, 32):
            got: list[tuple] = []
            for row in batch.slice(at, 32).to_pylist():
                words = _unzip(row["z"], codec)
                remove, spell = _pack(row["ranges"])
                check = checks(words, row["ranges"])
                if not remove and not spell:
                    got.append((row["key"], len(words), 0, _digest(words, None), None, None, None, None, check))
                    continue
                mask = np.zeros(len(words), bool)
                if remove:
                    s, n = np.array(remove, np.int64).T
                    _cover(mask, s, n + (K - 1))
                if not spell:
                    got.append((row["key"], len(words), int(mask.sum()), _digest(words, mask), None, None, None, None, check))
                    continue
                s, n = np.array(sorted(spell), np.int64).T
                starts = np.repeat(s - np.cumsum(n) + n, n) + np.arange(n.sum())
                hashes = Hashes(words, seed).of(starts, K)
                got.append((row["key"], len(words), None, None, row["z"], np.packbits(mask).tobytes(), hashes.tobytes(), starts.astype(np.int32).tobytes(), check))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got, strict=True), out, strict=True)], schema=out)


def _unzip(z: bytes, codec: pa.Codec) -> list[bytes]:
    size = int.from_bytes(z[:8], "little")
    return codec.decompress(z[8:], size).to_pybytes().split() if size else []


def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, z): texts compressed for the shuffle, their size ahead."""
    codec = pa.Codec("zstd")
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(at, SLICE_ROWS)
            data = [(t or "").encode() for t in part.column(1).to_pylist()]
            z = [len(x).to_bytes(8, "little") + (codec.compress(x, asbytes=True) if x else b"") for x in data]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(z, pa.binary())], names=["key", "z"])


def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edge records (edge, edge, key, start, 1) of the texts to go on with, pre-aggregated like paths."""
    for batch in batches:
        rows = [r for r in batch.to_pylist() if r["hashes"]]
        if not rows:
            continue
        edge = np.concatenate([np.frombuffer(r["hashes"], np.uint64) for r in rows])
        start = np.concatenate([np.frombuffer(r["starts"], np.int32).astype(np.int64) for r in rows])
        key = np.repeat(np.array([r["key"] for r in rows], np.int64), [len(r["starts"]) // 4 for r in rows])
        yield _record(edge, edge, key, start, np.ones(key.size, np.int64))


def apply_edges(batches: Iterator[pa.RecordBatch], out: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Removes spans of edges from (key, z, mask, ranges) rows."""
    codec = pa.Codec("zstd")
    for batch in batches:
        for at in range(0, batch.num_rows, 32):
            got = []
            for row in batch.slice(at, 32).to_pylist():
                words = _unzip(row["z"], codec)
                mask = np.unpackbits(np.frombuffer(row["mask"], np.uint8), count=len(words)).astype(bool)
                remove, _ = _pack(row["ranges"])
                if remove:
                    s, n = np.array(remove, np.int64).T
                    _cover(mask, s, n + (K - 1))
                got.append((row["key"], len(words), int(mask.sum()), _digest(words, mask), checks(words, row["ranges"])))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got, strict=True), out, strict=True)], schema=out)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """(key, doc_id, text) with a unique key that orders like the id, and whether it is the id.

    The key is the id itself, unless ids repeat or are null. Then rows are numbered in
    order of id (null last) and text; equal rows share one number, so that neither of
    two copies of one row counts as earlier.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    seen = rows.agg(F.count("*").alias("n"), F.count("doc_id").alias("i"), F.count_distinct("doc_id").alias("d")).collect()[0]
    if seen["n"] == seen["d"] == seen["i"]:
        return rows.withColumn("key", F.col("doc_id")), True
    order = [F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_first()]
    return checkpoint(rows.distinct().orderBy(*order).withColumn("key", F.monotonically_increasing_id())), False


RECORD = "a long, b long, c long, d long, e long"


def _settled(records: DataFrame) -> DataFrame:
    found = records.repartition("a").sortWithinPartitions("a", "b", "c", "d").mapInArrow(settle, f"{RECORD}, f long")
    return found.toDF("key", "start", "windows", "what", "src_key", "src_start")


def _attempt(own: DataFrame, seed: int) -> DataFrame | None:
    """(key, n_words, n_removed, kept_sha256) of the (key, text) rows, or None where words at two ends of a repeat differ."""
    from tessera.llm.common import _arrow_schema

    spark = own.sparkSession
    settled = stored(_settled(own.mapInArrow(lambda b: scan(b, seed), RECORD)))
    spans = compact(settled.where(F.col("what") == REMOVE).drop("what"))
    first = _arrow_schema(spark, FIRST)
    joined = own.mapInArrow(squeeze, "key long, z binary").join(ranges_of(settled, spans), "key", "left").select("key", "z", "ranges")
    step = checkpoint(joined.mapInArrow(lambda b: apply_paths(b, first, seed), FIRST))
    discard(settled, spans)
    spelt = step.where(F.col("hashes").isNotNull())
    more = stored(_settled(spelt.select("key", "hashes", "starts").mapInArrow(edges, RECORD)).where(F.col("what") == REMOVE))
    spans = compact(more.drop("what"))
    last = "key long, n_words long, n_removed long, kept_sha256 string, checks binary"
    last_schema = _arrow_schema(spark, last)
    rest = spelt.select("key", "z", "mask").join(ranges_of(more, spans), "key", "left").select("key", "z", "mask", "ranges")
    end = stored(rest.mapInArrow(lambda b: apply_edges(b, last_schema), last))
    discard(more, spans)
    if differ(step) or differ(end):
        return None
    out = ["key", "n_words", "n_removed", "kept_sha256"]
    return step.where(F.col("hashes").isNull()).select(*out).unionByName(end.select(*out))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its words, how many are removed and a digest of the rest.

    A word is removed if a window of K words over it also starts earlier: in a document
    of smaller id, or in the same one further ahead. A null or empty text has no words. A
    null id comes after all others; rows that share an id come in order of their texts, and
    equal rows share one fate. Texts below K words stay whole. An empty table gives none.
    Other columns are not read.
    """
    own, by_id = keyed(docs, id_col, text_col)
    tries = (_attempt(own.select("key", "text"), seed) for seed in numbers())
    done = next(x for x in tries if x is not None)
    if by_id:
        return done.select(F.col("key").alias("doc_id"), "n_words", "n_removed", "kept_sha256")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    same = rows.join(own.withColumnsRenamed({"doc_id": "i", "text": "t"}), F.col("doc_id").eqNullSafe(F.col("i")) & F.col("text").eqNullSafe(F.col("t")))
    return same.select("doc_id", "key").join(done, "key").select("doc_id", "n_words", "n_removed", "kept_sha256")
