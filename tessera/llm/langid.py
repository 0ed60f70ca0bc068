"""Language identification as mixture inference.

Each word of a document is taken to come from one of the learned languages, with a
likelihood from byte-trigram frequencies. Expectation-maximisation estimates the
document's language proportions, and the set of languages that it is written in is
the one of greatest penalised likelihood among its leading ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SLICE_ROWS, map_rows

#: Trigrams are counted in so many hash buckets: the bound on a language's model.
BUCKETS = 1 << 15
#: Labelled documents a language that the model is fitted on, about.
SAMPLE_PER_LANGUAGE = 2000
SMOOTHING = 0.1
EM_STEPS = 8
#: Nats that each further language must earn, times the log of the word count.
PENALTY = 1.5
#: Bytes scored at once; only the words' scores of longer texts are held whole.
PIECE_BYTES = 1 << 20
LETTER = regex.compile(r"\p{L}")
_WHITE = np.zeros(256, bool)
_WHITE[[32, *range(9, 14)]] = True
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5. A null id is in fold 1."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 5, F.lit(1))


def trigrams(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams of words, each word between two spaces, and where words begin among them.

    A word of n bytes has n trigrams. Words without a letter are left out.
    """
    a = np.frombuffer(b" " + data.lower() + b" ", np.uint8)
    white = _WHITE[a]
    a = np.where(white, np.uint8(32), a).astype(np.uint32)
    code = (a[:-2] << np.uint32(16)) | (a[1:-1] << np.uint32(8)) | a[2:]
    inside = ~white[1:-1]
    if not inside.any():
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    bucket = (code[inside] * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
    begins = np.flatnonzero(white[:-2][inside])
    lettered = np.logical_or.reduceat(_LETTER[a[1:-1][inside]], begins)
    if not lettered.all():
        lengths = np.diff(np.append(begins, bucket.size))
        bucket = bucket[np.repeat(lettered, lengths)]
        lengths = lengths[lettered]
        begins = np.cumsum(lengths) - lengths
    return bucket, begins


def pieces(data: bytes) -> Iterator[bytes]:
    """Cuts at white space, about PIECE_BYTES long; a longer word stays whole."""
    at = 0
    while at < len(data):
        end = at + PIECE_BYTES
        if end < len(data):
            m = re.compile(rb"[\x20\x09-\x0d]").search(data, end)
            end = m.start() if m else len(data)
        yield data[at:end]
        at = end


def word_scores(data: bytes, table: np.ndarray) -> np.ndarray:
    """Log likelihood of each word in each language. table: (BUCKETS, languages)."""
    found = []
    for part in pieces(data):
        bucket, begins = trigrams(part)
        if begins.size:
            found.append(np.add.reduceat(table[bucket], begins, axis=0))
    return np.concatenate(found) if found else np.zeros((0, table.shape[1]), np.float32)


def mixtures(scores: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """(n_docs, languages) proportions, zero outside each document's chosen set.

    scores: words by languages, in order of ``doc``, which says whose they are; each
    document has a word at least. Every size of set is tried for every document, so what
    stands beside a document does not matter.
    """
    n_lang = scores.shape[1]
    begins = np.searchsorted(doc, np.arange(n_docs))
    count = np.diff(np.append(begins, doc.size)).astype(np.float64)
    top = scores.max(axis=1, keepdims=True)
    like = np.exp(np.maximum(scores - top, -60.0))
    base = np.add.reduceat(top[:, 0].astype(np.float64), begins)

    def fit(start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pi = start
        for step in range(EM_STEPS + 1):
            r = like * pi[doc].astype(np.float32)
            z = r.sum(axis=1, keepdims=True)
            if step == EM_STEPS:
                break
            pi = np.add.reduceat(r / np.maximum(z, 1e-30), begins, axis=0) / count[:, None]
        return pi, base + np.add.reduceat(np.log(np.maximum(z[:, 0], 1e-30)).astype(np.float64), begins)

    full, _ = fit(np.full((n_docs, n_lang), 1.0 / n_lang))
    order = np.argsort(-full, axis=1, kind="stable")
    place = np.argsort(order, axis=1, kind="stable")
    best, best_value = np.zeros_like(full), np.full(n_docs, -np.inf)
    # One language alone: the likeliest, which need not lead the mixture.
    alone = np.add.reduceat(scores.astype(np.float64), begins, axis=0)
    best[np.arange(n_docs), alone.argmax(axis=1)] = 1.0
    best_value = alone.max(axis=1)
    for k in range(2, n_lang + 1):
        start = np.where(place < k, full + 1e-6, 0.0)
        pi, value = fit(start / start.sum(axis=1, keepdims=True))
        value = value - PENALTY * (k - 1) * np.log(count + 1.0)
        better = value > best_value
        best[better], best_value[better] = pi[better], value[better]
    return best


def fit_table(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int) -> tuple[list[str], np.ndarray]:
    """Log trigram probabilities, counted over about ``per_language`` training documents a language.

    The sample is chosen by hash, so it is the same on every run. The driver receives
    at most BUCKETS rows a language.
    """
    train = docs.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("t"), F.col(f"`{lang_col}`").alias("l")).where((fold("i") != 0) & F.col("t").isNotNull() & F.col("l").isNotNull())
    sizes = {r["l"]: r["n"] for r in train.groupBy("l").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((BUCKETS, 0), np.float32)
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, per_language / n))])
    part = train.where(F.pmod(F.xxhash64("i", "t"), F.lit(1 << 20)) < share[F.col("l")] * (1 << 20)).select("t", "l")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                for text, lang in zip(*(c.to_pylist() for c in batch.slice(at, SLICE_ROWS).columns), strict=True):
                    own = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    for piece in pieces(text.encode()):
                        own += np.bincount(trigrams(piece)[0], minlength=BUCKETS)
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * at.size, pa.string()), pa.array(at, pa.int32()), pa.array(own[at], pa.int64())], names=["l", "b", "n"])

    counted = part.mapInArrow(count, "l string, b int, n long").groupBy("l", "b").agg(F.sum("n").alias("n")).collect()
    table = np.full((BUCKETS, len(langs)), SMOOTHING)
    at = {k: i for i, k in enumerate(langs)}
    for r in counted:
        table[r["b"], at[r["l"]]] += r["n"]
    return langs, np.log(table / table.sum(axis=0)).astype(np.float32)


SCHEMA = "doc_id long, lang_pred string, score double, langs string"


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Predictions of a fitted table: the leading language, its share and the chosen set.

    A null or empty text, or one without a letter (of any script), is ``und`` with score 0,
    and so is every text without a learned language. Of equal shares the first language by
    name leads. A very long text is scored in pieces, its words' scores held. Null and
    repeated ids keep their rows; an empty table gives none.
    """
    langs, table = model

    def rows(keys: list, texts: list) -> dict[str, list]:
        found: list[tuple[str, float, str]] = [("und", 0.0, "")] * len(keys)
        held: list[tuple[int, np.ndarray]] = []

        def settle() -> None:
            if not held:
                return
            doc = np.repeat(np.arange(len(held)), [s.shape[0] for _, s in held])
            for (k, _), pi in zip(held, mixtures(np.concatenate([s for _, s in held]), doc, len(held)), strict=True):
                order = sorted((x for x in range(len(langs)) if pi[x] > 0), key=lambda x: (-pi[x], x))
                found[k] = (langs[order[0]], float(min(1.0, pi[order[0]])), ",".join(f"{langs[x]}:{pi[x]:.3f}" for x in order))
            held.clear()

        words = 0
        for k, text in enumerate(texts):
            if langs and text and LETTER.search(text):
                scores = word_scores(text.encode(), table)
                if scores.shape[0]:
                    held.append((k, scores))
                    words += scores.shape[0]
                    if words > 100_000:
                        settle()
                        words = 0
        settle()
        return {"doc_id": keys, "lang_pred": [x[0] for x in found], "score": [x[1] for x in found], "langs": [x[2] for x in found]}

    return map_rows(docs, [id_col, text_col], rows, SCHEMA)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """One row per document with its held_out flag, language, its share and the whole mixture.

    Documents whose fold is not 0 and whose text and language are not null teach the
    model; language, source and id are no inputs of a prediction. A text that is null or
    without a letter is ``und`` with score 0, as is every text if nothing could be
    learned. A null id is in no held-out fold; repeated rows give repeated rows; an empty
    table gives none. Words without a letter are skipped. A very long text is scored in
    pieces, its words' scores held; of equal shares the first language by name leads.
    """
    model = fit_table(docs, id_col, text_col, lang_col, per_language)
    return predict(docs, model, id_col, text_col).withColumn("held_out", fold("doc_id") == 0)
