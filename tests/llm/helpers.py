"""Small tables and plain versions that these tests compare with."""

from __future__ import annotations

import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOREM = "the quick brown fox jumps over the lazy dog while seven small birds watch from a tall old tree near the river bank and nobody in town seems to mind the noise that they make every single morning before the market opens its doors to farmers who come from far away with apples and cheese".split()


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def crc(i: int) -> int:
    return zlib.crc32(str(i).encode()) % 5


def lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def edge_rows() -> list[tuple]:
    """(doc_id, text, lang, source, n_chars): nulls, empty and long texts, ties, repeats."""
    base = " ".join(LOREM)
    texts = [
        (1, base, "en"), (2, base, "en"), (3, base.replace("river", "lake"), "en"), (4, "", "en"), (5, None, "en"), (6, "   \n\t ", None),
        (7, "word", "fr"), (8, " ".join(LOREM * 300), "en"), (8, " ".join(LOREM * 300), "en"), (9, base + "\n" + base, None), (None, base, "en"), (None, None, None),
        (10, "Ünï cödé ☃ 🜚 \x00 text \u2028 with\u00a0odd spaces", "de"), (11, "x" * 300_000, "en"), (12, "a b c d e f g h i j k l m n o p q r s t u v w x y z", "en"),
    ]
    return [(i, t, lang, "s", len(t) if t is not None else None) for i, t, lang in texts]


def edge_docs(spark, rows: list[tuple] | None = None):
    """The rows as documents, with further columns whose names the operators use within."""
    df = spark.createDataFrame(rows if rows is not None else edge_rows(), "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("key", "id", "fp", "words", "chunk", "root", "item_id", "held_out", "a", "n", "pop", "bits", "doc.id"):
        df = df.withColumn(c, df["source"])
    return df


def components(n: int, pairs) -> list[int]:
    up = list(range(n))

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]
