"""Spelling variants: words one edit apart, from forward and reversed sorted dictionaries.

One edit leaves a half of the word intact. So words of ``m`` code points and those of one more
stand in two dictionaries, sorted forward and in reverse, and those that share the first or
the last ``m // 2`` code points are a block: a range of a dictionary, scanned by one task. A block
that is too large is divided in the same way: the edit is in what its words don't
share yet, and leaves a half of that intact. Blocks shrink until each is small or all but
one code point is shared, which leaves no more words than the alphabet gives. A pair is reported
from one block only, the one that a shared first half leads to wherever there is one.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SLICE_ROWS, _arrow_schema, discard, release, stored
from tessera.llm.simhash import joined

RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Distinct words, and their code points, that a task counts before it sends them on.
HELD, HELD_CHARS = 400_000, 1 << 24
#: Words of a block; larger ones are divided.
BLOCK = 64
#: Rows of whole blocks that are compared at once, and code points up to which words are rows of one matrix.
SCAN_ROWS, WIDE = 4096, 32
#: Pairs that are compared at once.
PAIRS = 1 << 15
KEY = ["m", "a", "b", "cap", "head", "tail"]


def words_of(doc_id: int | None, text: str | None, slip: int) -> Counter:
    """How often each word stands in a text.

    Where ``slip`` divides the hash of document and word, the word loses the letter that
    the hash points to. A null id hashes as an empty one.
    """
    low: Counter = Counter()
    for run, n in Counter(RUN.findall(text or "")).items():
        low[run.lower() if run.isascii() else run.translate(_LOWER)] += n
    if not slip:
        return low
    seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    out: Counter = Counter()
    for word, n in low.items():
        h = zlib.crc32(word.encode(), seed)
        if h % slip == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        out[word] += n
    return out


def dictionary(docs: DataFrame, least: int = 5, shortest: int = 6, slip: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): words of ``shortest`` code points or more that occur ``least`` times or more in all texts.

    A null text has no words; repeated rows count again; an empty table gives none.
    """
    ddl = "word string, n long"
    schema = _arrow_schema(docs.sparkSession, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        chars = 0

        def sent() -> Iterator[pa.RecordBatch]:
            rows = list(held.items())
            for at in range(0, len(rows), 1 << 16):
                word, n = zip(*rows[at : at + (1 << 16)], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(n, pa.int64())], schema=schema)
            held.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                for doc_id, text in zip(*(part.column(i).to_pylist() for i in range(2)), strict=True):
                    for word, n in words_of(doc_id, text, slip).items():
                        if len(word) >= shortest:
                            chars += len(word) if word not in held else 0
                            held[word] += n
                    if len(held) >= HELD or chars >= HELD_CHARS:
                        yield from sent()
                        chars = 0
        yield from sent()
        release()

    counts = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(run, ddl)
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def divided(entries: DataFrame) -> DataFrame:
    """Each entry twice: in the block of the first half of what its block does not share yet, and of the last.

    A block's words share ``a`` code points in front and ``b`` behind, of ``m`` that the shorter ones
    have. Pairs that share ``cap`` or more in front come from another block.
    """
    half = F.expr("(m - a - b) div 2").cast("int")
    first = F.struct((F.col("a") + half).alias("a"), F.col("b"), F.col("cap"))
    last = F.struct(F.col("a"), (F.col("b") + half).alias("b"), F.least("cap", F.col("a") + half).alias("cap"))
    both = entries.select("word", "n", "m", F.explode(F.array(first, last)).alias("x")).select("word", "n", "m", "x.a", "x.b", "x.cap")
    head, tail = F.expr("substring(word, 1, a)"), F.expr("substring(reverse(word), 1, b)")
    return both.withColumn("head", head).withColumn("tail", tail)


def blocks(words: DataFrame, block: int = BLOCK) -> list[DataFrame]:
    """Entries of the two dictionaries in blocks of ``block`` words, or with all but one code point shared."""
    start = F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(2**31 - 1).alias("cap"))
    size = F.length("word")
    open_ = stored(divided(words.select("word", "n", F.explode(F.array(size, size - 1)).alias("m"), start.alias("x")).where("m > 1").select("word", "n", "m", "x.*")))
    done: list[DataFrame] = []
    while True:
        sizes = stored(open_.groupBy(*KEY).agg(F.count("*").alias("size")).where("size > 1"))
        if not sizes.where(F.col("size") > block).take(1):
            done.append(open_)
            discard(sizes)
            return done
        rows = stored(joined(open_, sizes, KEY, "word", "size"))
        discard(open_, sizes)
        large = (F.col("size") > block) & (F.expr("m - a - b") > 1)
        done.append(rows.where(~large))
        open_ = stored(divided(rows.where(large)))


def one_edit(x: str, y: str) -> int | None:
    """How many code points two different words share in front, if one edit makes one of the other; x is no longer than y."""
    low, high = 0, len(x)
    while low < high:
        mid = (low + high + 1) // 2
        if x[low:mid] == y[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low if x[low + (len(x) == len(y)) :] == y[low + 1 :] else None


def compared(words: list[str], block: np.ndarray, base: np.ndarray, shared: np.ndarray, behind: np.ndarray, cap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The near pairs within blocks that stand end to end; base: the lesser length of a block."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    core = [w[a : n - b] for w, a, n, b in zip(words, shared.tolist(), size.tolist(), behind.tolist(), strict=True)]
    length = size - shared - behind
    small = length <= WIDE
    wide = int(length[small].max(initial=0)) + 1
    code = np.zeros((len(words), wide), np.uint32)
    flat = np.frombuffer("".join(c for c, s in zip(core, small.tolist(), strict=True) if s).encode("utf-32-le"), np.uint32)
    code[np.arange(wide) < np.where(small, length, 0)[:, None]] = flat
    longer = size > base
    column = np.arange(wide - 1)
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def take(i: np.ndarray, j: np.ndarray, share: np.ndarray) -> None:
        keep = shared[i] + share < cap[i]
        found.append((i[keep], j[keep]))

    for apart in range(1, len(words)):
        every = np.flatnonzero(block[:-apart] == block[apart:])
        if not every.size:
            break
        for at in range(0, every.size, PAIRS):
            i = every[at : at + PAIRS]
            i = i[~(longer[i] & longer[i + apart])]
            j = i + apart
            i, j = np.where(longer[i], j, i), np.where(longer[i], i, j)  # the shorter first
            for x, y in zip(i[~(small[i] & small[j])].tolist(), j[~(small[i] & small[j])].tolist(), strict=True):
                share = one_edit(core[x], core[y])
                if share is not None:
                    take(np.array([x]), np.array([y]), np.array([share]))
            fits = small[i] & small[j]
            i, j = i[fits], j[fits]
            other = code[i] != code[j]
            share = other.argmax(axis=1)
            rest = (code[i][:, :-1] != code[j][:, 1:]) & (column >= share[:, None])
            near = np.where(longer[j], ~rest.any(axis=1), other.sum(axis=1) == 1)
            take(i[near], j[near], share[near])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def near(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, near, near_n): every two words that one edit makes of each other, both ways round.

    words: (word, n), each word once; no pair is left out or comes twice.
    """
    ddl = "word string, near string, near_n long"
    schema = _arrow_schema(words.sparkSession, ddl)

    def scanned(rows: list[tuple]) -> pa.RecordBatch:
        keys, block_of = {}, np.empty(len(rows), np.int64)
        for k, (word, _, m, a, b, cap) in enumerate(rows):
            block_of[k] = keys.setdefault((m, a, b, cap, word[:a], word[len(word) - b :]), len(keys))
        word = [r[0] for r in rows]
        n, m, a, b, cap = (np.array([r[c] for r in rows], np.int64) for c in range(1, 6))
        i, j = compared(word, block_of, m, a, b, cap)
        x, y = np.concatenate([i, j]), np.concatenate([j, i])
        word = pa.array(word, pa.string())
        return pa.RecordBatch.from_arrays([word.take(pa.array(x)), word.take(pa.array(y)), pa.array(n[y])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            held += zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True)
            if len(held) < SCAN_ROWS:
                continue
            word, _, m, a, b, cap = held[-1]
            last = (m, a, b, cap, word[:a], word[len(word) - b :])
            at = len(held)
            while at and (held[at - 1][2:6], held[at - 1][0][:a], held[at - 1][0][len(held[at - 1][0]) - b :]) == (last[:4], *last[4:]):
                at -= 1
            if at:
                yield scanned(held[:at])
                held = held[at:]
        if held:
            yield scanned(held)
        release()

    parts = []
    for entries in blocks(words, block):
        sorted_ = entries.repartitionByRange(*KEY).sortWithinPartitions(*KEY)
        parts.append(sorted_.select("word", "n", "m", "a", "b", "cap").mapInArrow(run, ddl))
    out = parts[0]
    for other in parts[1:]:
        out = out.unionByName(other)
    return out


def group(words: DataFrame, factor: int = 5, least: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of (word, n).

    A word's form is its near word of largest n, the first in code-point order among equal
    ones, if that is ``factor`` times the word's n or more; root follows forms to the last. An
    empty table gives none.
    """
    words = stored(words)
    best = near(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    form_n = -F.col("best.less")
    named = F.when(form_n >= factor * F.col("n"), F.col("best.near"))
    known = stored(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), named.alias("form"), F.when(named.isNotNull(), form_n).alias("form_n")))
    links = stored(known.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    # Each step multiplies n by the factor at least, and every round doubles the steps that are taken.
    most = words.agg(F.max("n").alias("n")).collect()[0]["n"] or 1
    steps = int(math.log(max(most / least, 1), factor)) + 1
    for _ in range(math.ceil(math.log2(max(steps, 1)))):
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        before, links = links, stored(links.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root")))
        discard(before)
    return known.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
