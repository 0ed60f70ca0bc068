"""A bigram language model by deleted interpolation, counted over the whole corpus.

The probability of a word after another mixes three estimates: of the pair, of the
word, and uniform. The mixture weights depend on how often the context was seen, in
buckets of powers of two, and expectation-maximisation learns them on held-out counts:
tokens of training documents that the estimates leave out.

Counts never gather in one place. Documents fall into chunks of bounded size by a hash
of their id; what a chunk holds of an n-gram bucket is sent there as one sorted block,
and what comes back is the block of corpus counts in the same order, without the keys:
the chunk finds them again in its texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SLICE_ROWS, _arrow_schema, checkpoint

#: Bytes of text a chunk holds, about; n-grams a bucket holds.
CHUNK_BYTES, BUCKET_NGRAMS = 12 << 20, 3_000_000
#: One chunk in so many is held out of the estimates on which the weights are learned.
HELD_OUT = 20
#: Context buckets: unseen, once, up to 3, up to 7 and so on.
CONTEXTS = 24
EM_STEPS = 12
LEAST_UNIFORM = 1e-5
TRAIN, DEV, TEST = 0, 1, 2
#: No word hashes to these but by a chance of 2^-64.
END, BEGIN = np.uint64(0), np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fold(id_col: str, of: int = 5) -> Column:
    """crc32 of the id as text modulo ``of``. A null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % of, F.lit(0))


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of texts end to end, each text's end among them, and the counts."""
    words, sizes = [], np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        w = t.lower().split()
        sizes[i] = len(w) + 1
        words += w
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    return np.insert(hashed, np.cumsum(sizes - 1), END), sizes


def ngram_keys(token: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each token (even) and of each with the one before (odd)."""
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[np.cumsum(sizes) - sizes] = BEGIN
    one = np.uint64(1)
    return _mix(token + np.uint64(0x9E3779B97F4A7C15)) & ~one, _mix(before * np.uint64(0xD1B54A32D192ED03) + token) | one


def pack(*columns: np.ndarray) -> bytes:
    """Columns of integers by byte planes, compressed; high planes of small numbers cost nothing."""
    n = columns[0].size
    planes = b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(n, c.itemsize).T).tobytes() for c in columns)
    return len(planes).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(planes, asbytes=True)


def unpack(blob: bytes, n: int, *types: type) -> list[np.ndarray]:
    planes = np.frombuffer(pa.Codec("zstd").decompress(blob[8:], int.from_bytes(blob[:8], "little")), np.uint8)
    out, at = [], 0
    for t in types:
        size = np.dtype(t).itemsize
        out.append(np.ascontiguousarray(planes[at : at + n * size].reshape(size, n).T).view(t).ravel())
        at += n * size
    return out


def _sums(sorted_by: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct of a sorted array and the sums of values over equal ones."""
    first = np.flatnonzero(np.concatenate([[True], sorted_by[1:] != sorted_by[:-1]]))
    return sorted_by[first], [np.add.reduceat(v, first) for v in values]


BLOCK = "bucket int, chunk int, n int, blob binary"


def count(group: pa.Table, bits: int) -> pa.Table:
    """Blocks of a chunk's (chunk, doc_id, role, z) rows, one a bucket: sorted keys with their training and held-out counts."""
    chunk = group["chunk"][0].as_py()
    token, sizes = tokens([unzip(z) for z in group["z"].to_pylist()])
    role = np.repeat(np.array(group["role"].to_pylist(), np.int8), sizes)
    key = np.concatenate(ngram_keys(token, sizes))
    order = np.argsort(key)
    role = np.concatenate([role, role])[order]
    key, (train, dev) = _sums(key[order], (role == TRAIN).astype(np.uint32), (role == DEV).astype(np.uint32))
    bucket = key >> np.uint64(64 - bits) if bits else np.zeros(key.size, np.uint64)
    cuts = np.searchsorted(bucket, np.arange((1 << bits) + 1, dtype=np.uint64))
    rows = [(k, chunk, int(hi - lo), pack(np.diff(key[lo:hi], prepend=np.uint64(0)), train[lo:hi].astype(np.uint32), dev[lo:hi].astype(np.uint32))) for k, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if hi > lo]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["bucket", "chunk", "n", "blob"])


TOTAL = "chunk int, bucket int, n int, blob binary, types long, train_types long, train_tokens long, dev_tokens long"


def total(group: pa.Table) -> pa.Table:
    """Corpus counts of a bucket, for each chunk in the order of its keys.

    A row of chunk -1 has the bucket's own words: types in all and in training alone,
    training and held-out tokens.
    """
    chunk, keys, train, dev = [], [], [], []
    for row_chunk, n, blob in zip(group["chunk"].to_pylist(), group["n"].to_pylist(), group["blob"].to_pylist(), strict=True):
        k, t, d = unpack(blob, n, np.uint64, np.uint32, np.uint32)
        chunk.append(np.full(n, row_chunk, np.int32))
        keys.append(np.cumsum(k, dtype=np.uint64))
        train.append(t)
        dev.append(d)
    chunk, key, train, dev = (np.concatenate(x) for x in (chunk, keys, train, dev))
    order = np.lexsort((chunk, key))
    chunk, key, train, dev = chunk[order], key[order], train[order].astype(np.uint64), dev[order].astype(np.uint64)
    first = np.concatenate([[True], key[1:] != key[:-1]])
    which = np.cumsum(first) - 1
    starts = np.flatnonzero(first)
    train, dev = np.add.reduceat(train, starts), np.add.reduceat(dev, starts)
    word = (key[starts] & np.uint64(1)) == 0
    own_words = [int((word & (train + dev > 0)).sum()), int((word & (train > 0)).sum()), int(train[word].sum()), int(dev[word].sum())]
    own = np.concatenate([[True], (key[1:] != key[:-1]) | (chunk[1:] != chunk[:-1])])
    chunk, which = chunk[own], which[own]
    order = np.argsort(chunk, kind="stable")
    chunk, which = chunk[order], which[order]
    cuts = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1], [True]])) if chunk.size else np.zeros(1, int)
    bucket = group["bucket"][0].as_py()
    rows = [(-1, bucket, 0, b"", *own_words)]
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        at = which[lo:hi]
        rows.append((int(chunk[lo]), bucket, int(hi - lo), pack(train[at].astype(np.uint64), dev[at].astype(np.uint64)), *[None] * 4))
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), *[pa.int64()] * 4)
    names = [c.split()[0] for c in TOTAL.split(", ")]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _counts(texts: list[bytes], totals: pa.Table) -> tuple[np.ndarray, ...]:
    """Sizes, then the corpus counts (training, held out) of each token, of its context and of the pair."""
    token, sizes = tokens(texts)
    one, two = ngram_keys(token, sizes)
    unique, at = np.unique(np.concatenate([one, two]), return_inverse=True)
    order = sorted(zip(totals["bucket"].to_pylist(), totals["n"].to_pylist(), totals["blob"].to_pylist(), strict=True))
    parts = [unpack(blob, n, np.uint64, np.uint64) for _, n, blob in order]
    train, dev = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    assert train.size == unique.size, "a chunk's texts changed between its two readings"
    word, pair = at[: token.size], at[token.size :]
    return sizes, word, pair, train, dev


def context_bucket(count: np.ndarray) -> np.ndarray:
    return np.minimum(np.where(count > 0, np.floor(np.log2(np.maximum(count, 1))) + 1, 0), CONTEXTS - 1).astype(np.int64)


def estimates(sizes: np.ndarray, word: np.ndarray, pair: np.ndarray, count: np.ndarray, n: int, docs: int) -> tuple[np.ndarray, ...]:
    """Pair and word estimates of each token, and the bucket of its context. docs: those that the counts are of."""
    c = count[word].astype(np.float64)
    before = np.empty_like(c)
    before[1:] = c[:-1]
    before[np.cumsum(sizes) - sizes] = docs
    return np.where(before > 0, count[pair] / np.maximum(before, 1), 0.0), c / max(n, 1), context_bucket(before)


def learn(samples: DataFrame, uniform: float) -> np.ndarray:
    """(CONTEXTS, 3) weights of pair, word and uniform, by EM over blocks of held-out estimates.

    A round is one pass over the blocks; the driver receives a row a context.
    """
    weights = np.full((CONTEXTS, 3), [0.4, 0.5, 0.1])
    for _ in range(EM_STEPS):

        def expect(batches: Iterator[pa.RecordBatch], weights: np.ndarray = weights) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((CONTEXTS, 3))
            for batch in batches:
                for n, blob in zip(batch["n"].to_pylist(), batch["blob"].to_pylist(), strict=True):
                    pair, word, context = unpack(blob, n, np.float32, np.float32, np.uint8)
                    r = weights[context] * np.stack([pair, word, np.full(n, uniform)], axis=1)
                    r /= np.maximum(r.sum(axis=1, keepdims=True), 1e-300)
                    for i in range(3):
                        sums[:, i] += np.bincount(context, r[:, i], CONTEXTS)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(CONTEXTS), pa.int32()), *(pa.array(sums[:, i]) for i in range(3))], names=["context", "a", "b", "c"])

        rows = samples.mapInArrow(expect, "context int, a double, b double, c double").groupBy("context").agg(*(F.sum(x).alias(x) for x in "abc")).collect()
        new = weights.copy()
        for r in rows:
            if (s := r["a"] + r["b"] + r["c"]) > 0:
                new[r["context"]] = np.array([r["a"], r["b"], r["c"]]) / s
        moved, weights = np.abs(new - weights).max(), new
        if moved < 1e-4:
            break
    weights[:, 2] = np.maximum(weights[:, 2], LEAST_UNIFORM)
    return weights / weights.sum(axis=1, keepdims=True)


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, bucket_ngrams: int = BUCKET_NGRAMS) -> DataFrame:
    """One row per document: base and model log10 probability of its whole text.

    Documents whose fold is not 1 are counted; the others only scored. A null or empty
    text is its end alone. A null id is in fold 0; repeated rows are counted each and give
    repeated rows; an empty table gives none. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    seen = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0)).alias("b")).collect()[0]
    chunks = max(HELD_OUT, -(-seen["b"] // chunk_bytes))
    bits = max(0, math.ceil(math.log2(max(1, seen["b"] / 3 / bucket_ngrams))))
    spread = F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text"))), F.lit(chunks)).cast("int")
    test = fold("doc_id") == 1
    dealt = rows.select("doc_id", spread.alias("chunk"), "text", test.alias("test"))
    dealt = dealt.select("doc_id", "chunk", F.when(F.col("test"), TEST).when(F.col("chunk") % HELD_OUT == 0, DEV).otherwise(TRAIN).alias("role"), "text")
    packed = _arrow_schema(spark, "chunk int, doc_id long, role int, z binary")
    texts = dealt.select("chunk", "doc_id", "role", "text")
    squeezed = lambda df: df.mapInArrow(lambda b: squeeze(b, packed), "chunk int, doc_id long, role int, z binary").groupBy("chunk")
    # A chunk is counted as a whole, so it sends one block a bucket however many tasks read its texts.
    blocks = squeezed(texts).applyInArrow(lambda g: count(g, bits), BLOCK)
    totals = checkpoint(blocks.groupBy("bucket").applyInArrow(total, TOTAL))
    sums = totals.where("chunk < 0").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("types", "train_types", "train_tokens", "dev_tokens")]).collect()[0]
    held = {r["role"]: r["count"] for r in dealt.groupBy("role").count().collect()}
    train_docs, dev_docs = held.get(TRAIN, 0), held.get(DEV, 0)
    back = totals.where("chunk >= 0").select("chunk", "bucket", "n", "blob")

    def held_out(group: pa.Table, totals: pa.Table) -> pa.Table:
        if not group.num_rows:
            return pa.table([pa.array([], pa.int32()), pa.array([], pa.binary())], names=["n", "blob"])
        sizes, word, pair, train, _ = _counts([unzip(z) for z in group["z"].to_pylist()], totals)
        use = np.repeat(np.array(group["role"].to_pylist()) == DEV, sizes)
        a, b, c = (x[use] for x in estimates(sizes, word, pair, train, sums["train_tokens"], train_docs))
        return pa.table([pa.array([a.size], pa.int32()), pa.array([pack(a.astype(np.float32), b.astype(np.float32), c.astype(np.uint8)) if a.size else b""], pa.binary())], names=["n", "blob"])

    dev = squeezed(texts.where(F.col("chunk") % HELD_OUT == 0)).cogroup(back.where(F.col("chunk") % HELD_OUT == 0).groupBy("chunk"))
    samples = checkpoint(dev.applyInArrow(held_out, "n int, blob binary").where("n > 0"))
    weights = learn(samples, 1 / (sums["train_types"] + 1))
    n, d, v = sums["train_tokens"] + sums["dev_tokens"], train_docs + dev_docs, sums["types"]

    def scored(group: pa.Table, totals: pa.Table) -> pa.Table:
        if not group.num_rows:
            return pa.table([pa.array([], f.type) for f in out], schema=out)
        sizes, word, pair, train, left = _counts([unzip(z) for z in group["z"].to_pylist()], totals)
        every = train + left
        a, b, context = estimates(sizes, word, pair, every, n, d)
        w = weights[context]
        p = w[:, 0] * a + w[:, 1] * b + w[:, 2] / (v + 1)
        c = every[word].astype(np.float64)
        begins = np.cumsum(sizes) - sizes
        base = np.add.reduceat(np.log10((c + 0.5) / (n + 0.5 * (v + 1))), begins)
        return pa.table([
            group["doc_id"], pa.array(np.array(group["role"].to_pylist()) == TEST), pa.array(sizes),
            pa.array(np.add.reduceat((c > 0).astype(np.int64), begins)), pa.array(np.full(sizes.size, n)),
            pa.array(base), pa.array(np.add.reduceat(np.log10(p), begins)),
        ], schema=out)

    out = _arrow_schema(spark, SCORED)
    return squeezed(texts).cogroup(back.groupBy("chunk")).applyInArrow(scored, SCORED)


def squeeze(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Compresses the texts of (chunk, doc_id, role, text) rows for the shuffle."""
    codec = pa.Codec("zstd")
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(at, SLICE_ROWS)
            data = [(t or "").encode() for t in part.column(3).to_pylist()]
            z = [len(x).to_bytes(8, "little") + (codec.compress(x, asbytes=True) if x else b"") for x in data]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(z, pa.binary())], schema=schema)


def unzip(z: bytes) -> bytes:
    size = int.from_bytes(z[:8], "little")
    return pa.Codec("zstd").decompress(z[8:], size).to_pybytes() if size else b""
