"""Phrase collocations by hierarchical pair naming.

Texts become chunks of word codes. On each level the adjacent names of a chunk are counted
there as pairs, one entry a distinct pair and chunk; entries travel packed by a bucket of the
pair, where all chunks that hold it agree on its name, and the names of pairs that are
frequent go back to those chunks and take the place of the pairs' left parts. A phrase of k words is thus a pair of phrases of k - 1 words, its first and
its last ones, and those pointers lead to the counts of every cut and to the phrases
that a longer one covers. Nothing of the corpus is on the driver, and a pair that is
everywhere is one entry a chunk.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import _arrow_schema, discard, release, stored

#: Words that a task holds in open chunks, about; beyond it the largest is closed.
CHUNK = 1 << 21
#: Bits of a place within a chunk, of a chunk within its task.
PLACE_BITS, SERIAL_BITS = 23, 16
#: Words whose pairs meet in one bucket, about, and rows that leave a task at once.
BUCKET, ROWS = 1 << 20, 256
LONGEST = 4
#: Groups that rank their own rows before a language's best are ranked together.
RANK_GROUPS = 64
_P = np.uint64(0x9E3779B97F4A7C15)
_BREAK = b"\xff"  # no byte of UTF-8
_BYTES = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + _BREAK * 10)


def tokens(text: str | None) -> list[bytes]:
    """Words in order, with a mark where a piece ends."""
    return (text or "").encode().translate(_BYTES).replace(_BREAK, b" \xff ").split()


def _packed(*columns: np.ndarray, kind: str = "<i4") -> bytes:
    """Columns of numbers byte by byte, low bytes first: the high ones are nearly all zero or alike."""
    rows = np.stack(columns).astype(kind)
    return zstandard.compress(np.ascontiguousarray(rows.view(np.uint8).reshape(len(columns), -1, rows.itemsize).transpose(0, 2, 1)).tobytes(), 3)


def _unpacked(data: bytes, columns: int = 1, kind: str = "<i4") -> np.ndarray:
    """(columns, numbers)."""
    size = np.dtype(kind).itemsize
    rows = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(columns, size, -1)
    return np.ascontiguousarray(rows.transpose(0, 2, 1)).view(kind).reshape(columns, -1)


class _Chunk:
    """Words of one language, as codes; 0 is a mark."""

    def __init__(self) -> None:
        self.code: defaultdict[bytes, int] = defaultdict(count(1).__next__, {_BREAK: 0})
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, words: list[bytes]) -> None:
        self.parts.append(np.fromiter(map(self.code.__getitem__, words), np.int32, len(words)))
        self.size += len(words)


def chunks(docs: DataFrame, size: int, text_col: str, lang_col: str) -> DataFrame:
    """Words of whole texts in chunks of one language: (chunk, lang, own, n, words, counts, codes).

    A text longer than ``size`` words goes on in the next chunk, and the one before ends with as many words of
    what follows as a phrase may reach into: those beyond ``own`` are counted there.
    """
    ddl = "chunk long, lang string, own int, n long, words array<string>, counts array<long>, codes binary"
    schema = _arrow_schema(docs.sparkSession, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, serial, open_ = TaskContext.get().partitionId(), count(), {}

        def closed(lang: str, own: int) -> pa.RecordBatch:
            held, nth = open_.pop(lang), next(serial)
            if nth >> SERIAL_BITS:
                raise ValueError("too many chunks in one task: read the table in more partitions")
            codes = np.concatenate(held.parts)
            words = [w.decode() for w in held.code if w != _BREAK]
            counts = np.bincount(codes[:own], minlength=len(words) + 1)[1:]
            # Frequent words get low codes, which pack well.
            order = np.argsort(-counts, kind="stable")
            rank = np.zeros(counts.size + 1, np.int32)
            rank[order + 1] = np.arange(1, counts.size + 1)
            row = {"chunk": task << SERIAL_BITS | nth, "lang": lang, "own": own, "n": int(counts.sum()), "words": [words[i] for i in order.tolist()], "counts": counts[order].tolist(), "codes": _packed(rank[codes])}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                every = [*tokens(text), _BREAK]
                for at in range(0, len(every), size):
                    held = open_.setdefault(lang, _Chunk())
                    held.add(every[at : at + size])
                    own, rest = held.size, every[at + size : at + size + LONGEST - 1]
                    held.add(rest)
                    if rest:
                        yield closed(lang, own)
                    elif sum(x.size for x in open_.values()) >= size:
                        largest = max(open_, key=lambda x: open_[x].size)
                        yield closed(largest, open_[largest].size)
        for lang in list(open_):
            yield closed(lang, open_[lang].size)
        release()

    return docs.select(F.coalesce(F.col(f"`{lang_col}`"), F.lit("und")), F.col(f"`{text_col}`")).mapInArrow(run, ddl)


def place(chunk: Column | str, at: Column | str) -> Column:
    return F.shiftleft(chunk, PLACE_BITS) + at


def named(rows: DataFrame, key: list[str], least: int) -> DataFrame:
    """Keys counted over all chunks, and one name for each: the first place that has it.

    rows: the key, its place (one row a chunk at most) and its count ``c`` there. Keys of
    fewer than ``least`` are left out.
    """
    same = Window.partitionBy(*key)
    every = rows.select("place", *key, F.sum("c").over(same).alias("f"), F.min("place").over(same).alias("id"))
    return stored(every.where(F.col("f") >= least))


def entries(names: DataFrame) -> DataFrame:
    """One row a name of ``named_pairs``."""
    return names.select(F.explode(F.arrays_zip("left", "right", "f", "id")).alias("x")).select("x.*")


def _pairs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of two adjacent names, their distinct pairs, and which of them stands at each."""
    at = np.flatnonzero((codes[:-1] > 0) & (codes[1:] > 0))
    pairs, which = np.unique(codes[at].astype(np.int64) << 32 | codes[at + 1], return_inverse=True)
    return at, pairs, which


def grams(level: DataFrame, buckets: int) -> DataFrame:
    """(bucket, chunk, data): each chunk's distinct pairs of adjacent names with how often each begins in it, packed by bucket of the pair."""
    ddl = "bucket int, chunk long, data binary"
    schema = _arrow_schema(level.sparkSession, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                chunk, own, ids, data = (batch.column(i)[row] for i in range(4))
                names = np.append(0, ids.values.to_numpy())
                at, pairs, which = _pairs(_unpacked(data.as_py())[0])
                c = np.bincount(which[at < own.as_py()], minlength=pairs.size)
                left, right = names[pairs >> 32], names[pairs & 0xFFFFFFFF]
                mixed = (left.astype(np.uint64) * _P + right.astype(np.uint64)) * _P
                bucket = (((mixed ^ (mixed >> np.uint64(31))) * _P >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                ends = np.flatnonzero(np.append(bucket[order][1:] != bucket[order][:-1], True)) + 1 if order.size else order
                begins = np.append(0, ends[:-1])
                for lo in range(0, ends.size, ROWS):
                    parts = [order[b:e] for b, e in zip(begins[lo : lo + ROWS], ends[lo : lo + ROWS], strict=True)]
                    # Places rise within a bucket, so their steps are small.
                    packed = [_packed(left[p], right[p], np.diff(p, prepend=0), c[p], kind="<i8") for p in parts]
                    yield pa.RecordBatch.from_arrays([pa.array([bucket[p[0]] for p in parts], pa.int32()), pa.array([chunk.as_py()] * len(parts), pa.int64()), pa.array(packed, pa.binary())], schema=schema)
        release()

    return level.select("chunk", "own", "ids", "codes").mapInArrow(run, ddl)


def named_pairs(rows: DataFrame, least: int) -> DataFrame:
    """Names of the pairs that are frequent over all chunks: (chunk, data, left, right, f, id).

    A row is what one chunk has of a bucket's frequent pairs: in ``data`` their places there and names, packed,
    and in the arrays those that are named after a place of this chunk. A bucket is the pairs of about BUCKET
    words, and one entry a chunk of a pair that is in all of them.
    """
    ddl = "chunk long, data binary, left array<long>, right array<long>, f array<long>, id array<long>"
    schema = _arrow_schema(rows.sparkSession, ddl)

    def one(bucket: pa.Table) -> pa.Table:
        parts = []
        for chunk, data in zip(bucket.column("chunk").to_pylist(), bucket.column("data").to_pylist(), strict=True):
            left, right, step, c = _unpacked(data, 4, "<i8")
            parts.append(np.stack([left, right, np.cumsum(step) + (chunk << PLACE_BITS), c]))
        left, right, where, c = np.concatenate(parts, axis=1)
        order = np.lexsort((where, right, left))
        left, right, where, c = left[order], right[order], where[order], c[order]
        begins = np.flatnonzero(np.append(True, (left[1:] != left[:-1]) | (right[1:] != right[:-1])))
        size = np.diff(np.append(begins, left.size))
        f = np.add.reduceat(c, begins)
        keep = np.flatnonzero(np.repeat(f >= least, size))
        keep = keep[np.argsort(where[keep], kind="stable")]
        left, right, where, f, name = left[keep], right[keep], where[keep], np.repeat(f, size)[keep], np.repeat(where[begins], size)[keep]
        chunk, first = np.unique(where >> PLACE_BITS, return_index=True)
        out = []
        for k, lo, hi in zip(chunk.tolist(), first.tolist(), np.append(first[1:], where.size)[: first.size].tolist(), strict=True):
            own = lo + np.flatnonzero(where[lo:hi] == name[lo:hi])
            data = _packed(where[lo:hi] & ((1 << PLACE_BITS) - 1), name[lo:hi], kind="<i8")
            out.append({"chunk": k, "data": data, "left": left[own], "right": right[own], "f": f[own], "id": name[own]})
        return pa.Table.from_pylist(out, schema=schema)

    return stored(rows.groupBy("bucket").applyInArrow(one, ddl))


def renamed(level: DataFrame, names: DataFrame, words: bool) -> DataFrame:
    """The next level: names of what begins at each position, 0 where it is not frequent. (chunk, own, ids, codes)"""
    ddl = "chunk long, own int, ids array<long>, codes binary"
    schema = _arrow_schema(level.sparkSession, ddl)

    def one(mine: pa.Table, found: pa.Table) -> pa.Table:
        if not mine.num_rows or not found.num_rows:
            return schema.empty_table()
        chunk, own, data = (mine.column(c)[0].as_py() for c in ("chunk", "own", "codes"))
        codes = _unpacked(data)[0]
        if words:
            at, which, n = np.arange(codes.size), codes, int(codes.max(initial=0)) + 1
            local, ids = found.column("at").to_numpy(), found.column("id").to_numpy()
        else:
            at, pairs, which = _pairs(codes)
            n = pairs.size
            local, ids = np.concatenate([_unpacked(x, 2, "<i8") for x in found.column("data").to_pylist()], axis=1)
        order = np.argsort(-np.bincount(which, minlength=n)[local], kind="stable")
        local, ids = local[order], ids[order]
        code = np.zeros(n, np.int32)
        code[local] = np.arange(1, ids.size + 1)
        out = np.zeros(codes.size, np.int32)
        out[at] = code[which]
        return pa.Table.from_pylist([{"chunk": chunk, "own": own, "ids": ids, "codes": _packed(out)}], schema=schema)

    at_word = F.col("place").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).alias("at")
    replies = names.select(F.shiftright("place", PLACE_BITS).alias("chunk"), at_word, "id") if words else names.select("chunk", "data")
    return stored(level.select("chunk", "own", "codes").groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(one, ddl))


def _scored(f: Column, *cuts: tuple[Column, Column]) -> Column:
    """The lowest-scoring cut, the first of equal ones; whole numbers of any size."""
    wide = "decimal(38,0)"
    return F.array_min(F.array(*[F.struct(F.call_function("div", F.lit(2_000_000).cast(wide) * f.cast(wide), (left + right).cast(wide)).alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r")) for k, (left, right) in enumerate(cuts, 1)]))


def phrases(names: DataFrame, parts: DataFrame, k: int) -> DataFrame:
    """Frequent phrases of k words with their words and best cut; parts: those of k - 1, or words."""
    first, last = (parts.select(*[F.col(c).alias(f"{side}_{c}") for c in parts.columns]) for side in ("x", "y"))
    both = names.join(first, F.col("left") == F.col("x_id")).join(last, F.col("right") == F.col("y_id"))
    ends = (F.col("x_first_f"), F.col("y_f")), (F.col("x_f"), F.col("y_last_f"))
    cuts = {2: ends[:1], 3: ends, 4: (ends[0], (F.col("x_left_f"), F.col("y_right_f")), ends[1])}[k]
    return stored(both.select(
        "id", "left", "right", "f", F.col("x_lang").alias("lang"), F.concat_ws(" ", "x_phrase", "y_last").alias("phrase"), F.col("y_last").alias("last"),
        F.col("x_first_f").alias("first_f"), F.col("y_last_f").alias("last_f"), F.col("x_f").alias("left_f"), F.col("y_f").alias("right_f"), _scored(F.col("f"), *cuts).alias("cut"),
    ))


def uncovered(found: DataFrame, longer: DataFrame | None, share: int) -> DataFrame:
    """Phrases that no phrase one word longer covers; one that is longer still has such a one within, as frequent at least."""
    if longer is None:
        return found
    over = longer.select(F.explode(F.array_distinct(F.array("left", "right"))).alias("id"), F.col("f").alias("over")).groupBy("id").agg(F.max("over").alias("over"))
    wide = "decimal(38,0)"
    covered = F.lit(100).cast(wide) * F.col("over").cast(wide) >= F.lit(share).cast(wide) * F.col("f").cast(wide)
    return found.join(over, "id", "left").where(~F.coalesce(covered, F.lit(False))).drop("over")


def ranked(found: DataFrame, by: list[str], order: list[Column], top: int) -> DataFrame:
    """The first rows of each group, with their rank; each part of a group ranks its own first."""
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_GROUPS)).alias("part")
    best = found.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy(*by, "part").orderBy(*order))).where(F.col("rank") <= top)
    return best.drop("part").withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col("rank") <= top)


def mine(docs: DataFrame, least: int = 30, share: int = 80, top: int = 2000, text_col: str = "text", lang_col: str = "lang", chunk: int = CHUNK) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of two to four words.

    ``a``: occurrences of the phrase, ``least`` or more; ``l`` and ``r``: of the two parts of its
    lowest-scoring cut; ``n``: words of the language. A phrase within a longer one of ``share``
    per cent of its count is left out. All texts are read whole and all counts
    are exact. A null text has no words, a null language is ``und``; repeated rows count again; ties
    go by count, then phrase. An empty table gives none. Other columns are not read.
    """
    if not 0 < chunk < 1 << (PLACE_BITS - 1):
        raise ValueError(f"a chunk holds 1 to {(1 << (PLACE_BITS - 1)) - 1} words")
    level = stored(chunks(docs, chunk, text_col, lang_col))
    totals = stored(level.groupBy("lang").agg(F.sum("n").alias("n")))
    buckets = max(1, -(-(totals.agg(F.sum("n").alias("n")).collect()[0]["n"] or 0) // BUCKET))
    word = F.posexplode(F.arrays_zip("words", "counts")).alias("at", "w")
    words = level.select("chunk", "lang", word).select("lang", F.col("w.words").alias("word"), place(F.col("chunk"), F.col("at") + 1).alias("place"), F.col("w.counts").alias("c"))
    names = named(words, ["lang", "word"], least)
    parts = stored(names.where("place = id").select("id", "f", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), F.col("f").alias("first_f"), F.col("f").alias("last_f")))
    made: list[DataFrame] = [parts]
    for k in range(2, LONGEST + 1):
        below, level = level, renamed(level, names, words=k == 2)
        discard(below, names)
        names = named_pairs(grams(level, buckets), least)
        made.append(phrases(entries(names), made[-1], k))
    discard(level, names)
    kept = [uncovered(found, longer, share) for found, longer in zip(made[1:], [*made[2:], None], strict=True)]
    every = kept[0].select("lang", "phrase", "f", "cut")
    for other in kept[1:]:
        every = every.unionByName(other.select("lang", "phrase", "f", "cut"))
    every = every.select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score")
    best = ranked(every, ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH docs AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM docs),
spans AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, (VALUES (1), (2), (3), (4)) AS sizes(k)),
counted AS (SELECT lang, k, phrase, count(*) AS a FROM (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM spans) GROUP BY ALL),
found AS (SELECT *, string_split(phrase, ' ') AS w FROM counted WHERE k > 1 AND a >= 30),
halves AS (SELECT lang, phrase, a, j, array_to_string(w[1:j], ' ') AS head, array_to_string(w[j + 1:], ' ') AS tail FROM (SELECT *, unnest(range(1, k)) AS j FROM found)),
cuts AS (SELECT c.lang, c.phrase, c.a, c.j, x.a AS l, y.a AS r, (2000000 * c.a::HUGEINT) // (x.a + y.a) AS score
  FROM halves c JOIN counted x ON x.lang = c.lang AND x.phrase = c.head JOIN counted y ON y.lang = c.lang AND y.phrase = c.tail),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS over
  FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM found)) GROUP BY ALL),
kept AS (SELECT o.* FROM lowest o LEFT JOIN inside i ON i.lang = o.lang AND i.phrase = o.phrase WHERE i.over IS NULL OR 100 * i.over::HUGEINT < 80 * o.a::HUGEINT),
totals AS (SELECT lang, sum(a)::BIGINT AS n FROM counted WHERE k = 1 GROUP BY lang)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN totals USING (lang) WHERE rank <= 2000
"""
