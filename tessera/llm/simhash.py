"""SimHash near-duplicates by tiled exact comparison of fingerprints.

Fingerprints are dealt into tiles by population count. Tiles whose counts differ beyond
the radius hold no link, so their pair is never made; the others are compared whole, by
numpy exclusive-or and bit counts. Before that, fingerprints meet only in buckets: of
``blocks`` blocks of bits, two within the radius agree on ``blocks - radius`` at least, so
a bucket for each such choice loses nothing. More blocks make longer keys, which keeps
buckets small as the corpus grows.

Near-duplicates of texts by the similarity of their shingle sets compare fingerprints of
128 bits in the same way, within buckets of texts that share a key of least hashes: keys
of sampled bits would have to grow in number as the corpus to the power of a quarter.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import checkpoint, discard, map_rows, shuffled, stored
from tessera.llm.components import roots

SEED = 42
#: Fingerprints a tile holds, about.
TILE = 512
#: Shingles whose bits are counted at once.
COUNT_AT_ONCE = 1 << 16
#: Fingerprints that a bucket should hold on average, at most.
BUCKET = 64
#: Fingerprints of the tiles that are compared within a task.
SUB_TILE = 256
#: Keys of a text for near-duplicates, and least shingle hashes that a key joins.
BANDS, JOINED = 9, 3
#: Standard deviations above the mean distance of texts of just the wanted similarity up to which pairs are looked at.
DEVIATIONS = 5
#: Weight of a tile of texts, and shingles that weigh one beside the text itself.
TILE_WEIGHT, SHINGLES = 2048, 1024
#: Members of a large bucket's main group that its other texts are tried with in a round.
HUBS = 4
#: A key is hot, and dealt over several tasks, from so many rows on, and from a thousandth of all.
HOT_ROWS = 8192
#: Ids that a broadcast may hold; beyond it the join is shuffled.
BROADCAST_IDS = 1_000_000


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each run of ``words`` words, repeats included; of all words if there are fewer."""
    w = (text or "").encode().lower().split()
    if len(w) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), SEED)] if w else [], np.uint64)
    runs = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False))
    return np.fromiter(map(xxhash.xxh64_intdigest, runs, itertools.repeat(SEED)), np.uint64, len(w) - words + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits that are set in over half the hashes; zero for none."""
    counts = np.zeros(64, np.int64)
    for at in range(0, hashes.size, COUNT_AT_ONCE):
        part = np.unpackbits(hashes[at : at + COUNT_AT_ONCE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += part.sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > hashes.size, bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every whole text; fp holds the unsigned fingerprint in a signed long."""

    def rows(ids: list, texts: list) -> dict[str, list]:
        fps = np.array([fingerprint(shingle_hashes(t, words)) for t in texts], np.uint64)
        return {"doc_id": ids, "fp": fps.view(np.int64)}

    return map_rows(docs, [id_col, text_col], rows, "doc_id long, fp long")


def block_count(n: int, radius: int) -> int:
    """Blocks for ``n`` fingerprints: the fewest whose keys make buckets of BUCKET on average."""
    for blocks in range(radius + 1, 64):
        if n <= BUCKET << (64 * (blocks - radius) // blocks):
            return blocks
    return 64


def block_keys(fp: Column, radius: int, blocks: int) -> Column:
    """One key for each choice of ``blocks - radius`` blocks, as (choice, bits)."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    keys = []
    for k, chosen in enumerate(itertools.combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << cuts[i + 1]) - (1 << cuts[i])) for i in chosen)
        keys.append(F.struct(F.lit(k).alias("k"), fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("bits")))
    return F.array(*keys)


def tiled(x: tuple[np.ndarray, ...], y: tuple[np.ndarray, ...], radius: int, tile: int = SUB_TILE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, distance) of the pairs of x and y within the radius, tile by tile.

    x, y: the 64-bit halves of fingerprints. Both are put in order of population count and cut
    into tiles; a pair of tiles whose counts differ beyond the radius is skipped, any other is
    compared whole by exclusive-or and bit counts.
    """
    sides = []
    for z in (x, y):
        pop = sum(np.bitwise_count(h).astype(np.int64) for h in z)
        order = np.argsort(pop, kind="stable")
        sides.append([(order[at : at + tile], int(pop[order[at]]), int(pop[order[min(at + tile, pop.size) - 1]])) for at in range(0, pop.size, tile)])
    for p, low, high in sides[0]:
        for q, least, most in sides[1]:
            if least - high > radius or low - most > radius:
                continue
            d = sum(np.bitwise_count(h[p][:, None] ^ k[q][None, :]).astype(np.int16) for h, k in zip(x, y, strict=True))
            i, j = np.nonzero(d <= radius)
            if i.size:
                yield p[i], q[j], d[i, j]


def _spans(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is linked in a tile (b is None) or across two, one fewer than the members of each component.

    Labels fall to the least index along links until none changes, so a tile of
    mutually linked fingerprints gives one link each and not one for every pair.
    """
    every = a if b is None else np.concatenate([a, b])
    found = [(i, j if b is None else j + a.size) for i, j, _ in tiled((a,), (a if b is None else b,), radius)]
    i, j = (np.concatenate([f[c] for f in found]) if found else np.zeros(0, np.int64) for c in (0, 1))
    keep = i != j
    i, j = i[keep], j[keep]
    if not i.size:
        return every[:0], every[:0]
    label = np.arange(every.size)
    while True:
        low = label.copy()
        np.minimum.at(low, i, label[j])
        np.minimum.at(low, j, label[i])
        low = low[low]
        if (low == label).all():
            break
        label = low
    at = np.flatnonzero(label != np.arange(every.size))
    return every[at], every[label[at]]


def compare(batches: Iterator[pa.RecordBatch], spans: Callable[..., tuple], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Links within each run of rows (k, bits, pair, side, ...) of one (k, bits, pair).

    spans: gets k, the further columns of a tile and, for a pair of tiles, of the other (else
    None), and returns columns ``names`` of links.
    """
    held: list[np.ndarray] = []

    def settle(block: np.ndarray) -> tuple | None:
        k, side, rest = int(block[0, 0]), block[3], block[4:]
        if side.size < 2:
            return None
        if side[0] == 0:
            return spans(k, rest, None)
        a, b = rest[:, side == 1], rest[:, side == 2]
        return spans(k, a, b) if a.size and b.size else None

    def emit(found: list[tuple | None]) -> pa.RecordBatch:
        full = [x for x in found if x is not None]
        columns = [np.concatenate([x[i] for x in full]).astype(np.int64) if full else np.zeros(0, np.int64) for i in range(len(names))]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    for batch in batches:
        rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
        if not rows.shape[1]:
            continue
        rows = np.concatenate([*held, rows], axis=1)
        change = np.flatnonzero((rows[:3, 1:] != rows[:3, :-1]).any(axis=0)) + 1
        ends = np.append(change, rows.shape[1])
        begins = np.append(0, change)
        held = [rows[:, begins[-1] :]]  # may go on in the next batch
        yield emit([settle(rows[:, b:e]) for b, e in zip(begins[:-1], ends[:-1], strict=True) if e - b > 1])
    if held:
        yield emit([settle(held[0])])


def deal(nodes: DataFrame, keys: Column, radius: int, tile: int, columns: list[str]) -> DataFrame:
    """Rows (k, bits, pair, side, *columns) so that those to compare lie together, in order.

    nodes: (*columns, pop), pop the population count. A bucket of more than ``tile`` nodes
    is dealt into tiles by population count, a count with many of them into several; each
    row goes to every pair of tiles that may hold a link of its own, and pairs are compared
    on their own, so no bucket lands in one task.
    """
    spread = nodes.select(*columns, "pop", F.explode(keys).alias("x")).select(*columns, "pop", "x.k", "x.bits")
    by_pop = spread.groupBy("k", "bits", "pop").agg(F.count("*").alias("n"))
    # A map of population counts has 129 entries at most.
    sizes = by_pop.groupBy("k", "bits").agg(
        F.sum("n").alias("size"), F.map_from_entries(F.collect_list(F.struct("pop", F.ceil(F.col("n") / tile).cast("int").alias("t")))).alias("tiles"))
    row = spread.join(shuffled(sizes.where(F.col("size") > 1)), ["k", "bits"])
    small = row.where(F.col("size") <= tile).select("k", "bits", F.lit(0).cast("long").alias("pair"), F.lit(0).alias("side"), *columns)
    tiles_of = lambda p: F.coalesce(F.try_element_at("tiles", p), F.lit(0))
    large = row.where(F.col("size") > tile).withColumn("salt", F.pmod(F.xxhash64(columns[0]), tiles_of(F.col("pop"))).cast("int"))
    pops = F.sequence(F.greatest(F.lit(0), F.col("pop") - radius), F.least(F.lit(128), F.col("pop") + radius))
    met = F.flatten(F.transform(pops, lambda p: F.transform(F.filter(F.sequence(F.lit(0), tiles_of(p)), lambda s: s < tiles_of(p)), lambda s: F.struct(p.alias("pop"), s.alias("salt")))))
    large = large.withColumn("met", F.explode(met))
    own = F.struct(F.col("pop").cast("int").alias("pop"), "salt")
    met = F.struct(F.col("met.pop").cast("int").alias("pop"), F.col("met.salt").alias("salt"))
    side = F.when(own == met, 0).when(own < met, 1).otherwise(2)
    large = large.select("k", "bits", F.xxhash64(F.least(own, met), F.greatest(own, met)).alias("pair"), side.alias("side"), *columns)
    return small.unionByName(large).repartition("k", "bits", "pair").sortWithinPartitions("k", "bits", "pair")


def links(fps: DataFrame, radius: int = 4, tile: int = TILE) -> DataFrame:
    """Links (u, v) that connect what a chain of distances up to ``radius`` connects.

    fps: distinct (fp).
    """
    keys = block_keys(F.col("fp"), radius, block_count(fps.count(), radius))
    dealt = deal(fps.select("fp", F.bit_count("fp").alias("pop")), keys, radius, tile, ["fp"])

    def spans(_: int, a: np.ndarray, b: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        u, v = _spans(a[0].view(np.uint64), None if b is None else b[0].view(np.uint64), radius)
        return u.view(np.int64), v.view(np.int64)

    return dealt.mapInArrow(lambda x: compare(x, spans, ["u", "v"]), "u long, v long").distinct()


def joined(rows: DataFrame, single: DataFrame, on: list[str], spread: str, size: str) -> DataFrame:
    """Inner join of ``rows`` with ``single``, which has one row a key and the count of the key's rows in ``size``.

    A key of HOT_ROWS rows and a thousandth of all is hot: at most a thousand keys are. Those
    are broadcast, rows of theirs are salted by a hash of ``spread``, and their single rows
    are repeated once a salt; so no key lands in one task, and rows are repeated in proportion.
    """
    total = single.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).collect()[0]["n"]
    most = max(HOT_ROWS, total // 1000)
    parts = F.ceil(F.col(size) / most).cast("int")
    hot = single.where(F.col(size) > most).select(*on, parts.alias("_parts"))
    salted = rows.join(F.broadcast(hot), on, "left").withColumn("_salt", F.pmod(F.xxhash64(spread), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    repeated = single.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(F.col(size) > most, parts).otherwise(1) - 1)))
    return salted.join(shuffled(repeated), [*on, "_salt"]).drop("_salt")


def hexed(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: fingerprint in hex and the least id of its component.

    Documents of one fingerprint are one node from the start, so a large group of copies
    costs one comparison. A null or empty text has fingerprint zero and links like any
    other. A null id gets its component's least id, or null if that has none; repeated rows
    give repeated rows; an empty table gives none. Other columns are not read.
    """
    own = stored(fingerprints(docs, words, id_col, text_col))
    nodes = stored(own.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")))
    root = roots(links(nodes.select("fp"), radius))
    labelled = nodes.join(shuffled(root), nodes["fp"] == root["node"], "left").select("fp", "least", "copies", F.coalesce("root", "fp").alias("root"))
    component = labelled.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("size"))
    named = stored(joined(labelled, component, ["root"], "fp", "size").select("fp", "component_id", "copies"))
    return joined(own, named, ["fp"], "doc_id", "copies").select("doc_id", hexed(F.col("fp")).alias("fingerprint"), "component_id")


# -- texts by the similarity of their shingle sets


def shingle_set(text: str | None, words: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, words))


def _again(x: np.ndarray) -> np.ndarray:
    """A second hash of hashes, for the second half of a signature."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def bits_apart(similarity: float) -> float:
    """The chance that a bit differs between sets of a Jaccard similarity and like size."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def reach(similarity: float) -> int:
    """Differing bits of 128 up to which a pair is looked at."""
    p = bits_apart(similarity)
    return math.ceil(128 * p + DEVIATIONS * math.sqrt(128 * p * (1 - p)))


def bands(hashes: np.ndarray, seed: int = 5) -> np.ndarray:
    """BANDS keys of a set, each of its least hashes under JOINED permutations; none for an empty one.

    Two sets share a key of similarity**JOINED chance, so at 0.8 all keys miss about 1 pair in 640.
    """
    if not hashes.size:
        return np.zeros(0, np.uint64)
    salt, odd = np.random.default_rng(seed).integers(0, 1 << 63, (2, BANDS * JOINED), np.uint64)
    odd = odd * np.uint64(2) + np.uint64(1)
    least = np.full(BANDS * JOINED, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, hashes.size, COUNT_AT_ONCE):
        least = np.minimum(least, ((hashes[at : at + COUNT_AT_ONCE, None] ^ salt) * odd).min(axis=0))
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(JOINED):
        key = _again(key * np.uint64(0x9E3779B97F4A7C15) + least[j::JOINED])
    return key


def sketches(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(id, a, b, h, n, keys): 128 bits over the distinct shingles of each text, a digest of them, their count and their keys."""

    def rows(ids: list, texts: list) -> dict[str, list]:
        sets = [shingle_set(t, words) for t in texts]
        a, b = (np.array([fingerprint(x) for x in z], np.uint64).view(np.int64) for z in (sets, [_again(x) for x in sets]))
        digest = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64)
        return {"id": ids, "a": a, "b": b, "h": digest, "n": [x.size for x in sets], "keys": [bands(x).view(np.int64) for x in sets]}

    return map_rows(docs, [id_col, text_col], rows, "id long, a long, b long, h long, n int, keys array<long>")


def small_join(df: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Join on ``id``, by broadcast if a count shows that the ids are few enough."""
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", how)


def alike(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have the Jaccard similarity."""
    shared = np.intersect1d(x, y, assume_unique=True).size
    return bool(shared >= similarity * (x.size + y.size - shared))


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v), one a u, whose shingle sets have the Jaccard similarity. Many may share a v."""
    pairs = stored(pairs)
    left = pairs.join(shuffled(sets.select(F.col("id").alias("u"), F.col("z").alias("zu"))), "u")
    right = pairs.groupBy("v").agg(F.count("*").alias("size")).join(shuffled(sets.select(F.col("id").alias("v"), F.col("z").alias("zv"))), "v")
    both = joined(left, right, ["v"], "u", "size")

    def judge(us: list, vs: list, zu: list, zv: list) -> dict[str, list]:
        same = [alike(np.frombuffer(p, np.uint32), np.frombuffer(q, np.uint32), similarity) for p, q in zip(zu, zv, strict=True)]
        return {"u": us, "v": vs, "same": same}

    return stored(map_rows(both, ["u", "v", "zu", "zv"], judge, "u long, v long, same boolean").where("same").select("u", "v"))


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of each run of equal leading ``keys`` columns, which may go over several batches."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(i).to_numpy() for i in range(keys)])
        begins = np.append(0, np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1)
        for b, e in zip(begins.tolist(), np.append(begins[1:], batch.num_rows).tolist(), strict=True):
            if held and tuple(k[:, b].tolist()) != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(b, e - b))
            last = tuple(k[:, b].tolist())
    if held:
        yield pa.Table.from_batches(held)


PLACE = "key long, p int, q int, side int"
NODE = "id long, a long, b long, n int, g long"


def _open_pairs(t: pa.Table, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, distance) of the rows of a tile, or of one and the other of a pair of tiles, that may be alike and are not of one group."""
    side, n, g = (t[c].to_numpy() for c in ("side", "n", "g"))
    a, b = (t[c].to_numpy().view(np.uint64) for c in ("a", "b"))
    x, y = (np.arange(side.size),) * 2 if side[0] == 0 else (np.flatnonzero(side == 1), np.flatnonzero(side == 2))
    none = np.zeros(0, np.int64)
    found = [(none, none, none)]
    for i, j, d in tiled((a[x], b[x]), (a[y], b[y]), reach(similarity)):
        i, j = x[i], y[j]
        keep = (g[i] != g[j]) & (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j])) & ((side[i] != 0) | (i < j))
        found.append((i[keep], j[keep], d[keep]))
    return tuple(np.concatenate([f[c] for f in found]) for c in range(3))


def flag(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """The rows of tiles that may be alike with another of theirs."""
    for t in runs(batches, 3):
        if t.num_rows > 1:
            i, j, _ = _open_pairs(t, similarity)
            if i.size:
                yield from t.take(np.unique(np.concatenate([i, j]))).combine_chunks().to_batches()


def confirm(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Links (u, v) of like texts that join the groups of each tile, nearest pairs first; a pair of what is joined already is passed over."""
    for t in runs(batches, 3):
        i, j, d = _open_pairs(t, similarity)
        ids, sets = t["id"].to_numpy(), [np.frombuffer(z, np.uint32) for z in t["z"].to_pylist()]
        _, group = np.unique(t["g"].to_numpy(), return_inverse=True)
        found = []
        for k in np.argsort(d, kind="stable").tolist():
            x, y = int(i[k]), int(j[k])
            if group[x] != group[y] and alike(sets[x], sets[y], similarity):
                found.append(k)
                group[group == group[y]] = group[x]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(ids[i[found]]), pa.array(ids[j[found]])], names=["u", "v"])


def tiles(rows: DataFrame, radius: int, weight: int) -> DataFrame:
    """Rows of large buckets, once for each pair of tiles that may hold a link of theirs: (*PLACE, *NODE).

    rows: (key, main, w, pop, *NODE). A bucket's tiles are stretches of its rows in order of
    population count, of ``weight`` each, those of its main group apart from the others; two
    tiles of the main group are never compared, nor are tiles whose counts differ beyond the radius.
    """
    # At most 129 counts for each of the two.
    pops = rows.groupBy("key", "main", "pop").agg(F.sum("w").alias("w")).groupBy("key").agg(F.collect_list(F.struct("main", "pop", "w")).alias("pops"), F.sum("w").alias("size"))
    both = joined(rows, stored(pops), ["key"], "id", "size")

    def before(main: Column, pop: Column) -> Column:
        return F.aggregate("pops", F.lit(0).cast("long"), lambda s, x: s + F.when((x["main"] == main) & (x["pop"] < pop), x["w"]).otherwise(0))

    at = before(F.col("main"), F.col("pop"))
    own = at + F.pmod(F.xxhash64("id"), before(F.col("main"), F.col("pop") + 1) - at)

    def met(main: int) -> Column:
        low, high = before(F.lit(main), F.col("pop") - radius), before(F.lit(main), F.col("pop") + radius + 1)
        place = lambda x: F.floor(x / weight).cast("int") * 2 + main
        every = F.sequence(place(low), F.greatest(place(low), place(high - 1)), F.lit(2))
        return F.when((low < high) & (F.lit(main) + F.col("main") < 2), every).otherwise(F.array().cast("array<int>"))

    both = both.withColumn("own", F.floor(own / weight).cast("int") * 2 + F.col("main")).withColumn("met", F.explode(F.concat(met(0), met(1))))
    side = F.when(F.col("own") == F.col("met"), 0).when(F.col("own") < F.col("met"), 1).otherwise(2)
    return both.select("key", F.least("own", "met").alias("p"), F.greatest("own", "met").alias("q"), side.alias("side"), "id", "a", "b", "n", "g")


def groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", weight: int = TILE_WEIGHT) -> DataFrame:
    """(id, root) of the texts that are joined, by chains of similarities, to another; ids must be unique.

    Texts of one shingle set are one node. Nodes that share a key of least hashes are a
    bucket. Each node is first tried with the least id of a bucket of its own; what holds makes groups.
    A bucket whose nodes are all of one group is done. In large buckets, nodes outside the
    main group are tried with members of it, as long as a round still joins a tenth of them.
    What is left open is compared in tiles by fingerprint, and pairs within reach, of like
    size and of two groups are confirmed by their sets (32 bits a shingle), in the tile. So
    every pair that shares a key is looked at or joined by others; a link is lost only where
    two texts share no key, about 1 in 640 of those at just 0.8.
    """
    radius = reach(similarity)
    own = stored(sketches(docs, words, id_col, text_col))
    nodes = stored(own.groupBy("a", "b", "h").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("keys").alias("keys")))
    keyed = nodes.select("id", "a", "b", "n", F.explode("keys").alias("key"))
    sizes = stored(keyed.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct("id", "a", "b", "n")).alias("hub")).where("size > 1"))
    met = stored(joined(keyed, sizes, ["key"], "id", "size"))
    far = lambda x: F.bit_count(F.col("a").bitwiseXOR(x["a"])) + F.bit_count(F.col("b").bitwiseXOR(x["b"]))
    near = lambda x: (far(x) <= radius) & (F.least(F.col("n"), x["n"]) >= similarity * F.greatest(F.col("n"), x["n"]))

    def rows(ids: list, texts: list) -> dict[str, list]:
        return {"id": ids, "z": [np.unique(shingle_set(t, words).astype(np.uint32)).tobytes() for t in texts]}

    wanted = small_join(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), met.select("id").distinct(), "left_semi")
    sets = stored(map_rows(wanted, ["id", "text"], rows, "id long, z binary"))
    discard(sizes)
    hub = F.col("hub")
    first = met.where((F.col("id") != hub["id"]) & near(hub)).groupBy("id").agg(F.min(F.struct(far(hub).alias("d"), hub["id"].alias("id"))).alias("x"))
    root = roots(verified(first.select(F.col("id").alias("u"), F.col("x.id").alias("v")), sets, similarity))
    turn, trying = 0, True
    while True:
        labelled = met.join(shuffled(root.withColumnRenamed("node", "id")), "id", "left").select("key", "id", "a", "b", "n", F.coalesce("root", "id").alias("g"), (1 + F.floor(F.col("n") / SHINGLES)).alias("w"))
        now = stored(labelled)
        by = now.groupBy("key", "g").agg(F.count("*").alias("n"), F.sum("w").alias("w")).groupBy("key")
        state = by.agg(F.count("*").alias("labels"), F.sum("n").alias("size"), F.sum("w").alias("weight"), F.max(F.struct("n", "g")).alias("most")).where("labels > 1")
        state = stored(state.select("key", "size", "weight", F.col("most.g").alias("most")))
        rest = stored(joined(now, state, ["key"], "id", "size").withColumn("main", (F.col("g") == F.col("most")).cast("int")))
        large = rest.where(F.col("weight") > weight)
        outside = large.where("main = 0").select("id").distinct().count()
        if not (trying and outside):
            break
        order = F.xxhash64("id", F.lit(turn))
        hubs = large.where("main = 1").groupBy("key", F.pmod(order, F.lit(HUBS))).agg(F.min(F.struct(order.alias("o"), "id", "a", "b", "n")).alias("x"))
        hubs = hubs.groupBy("key").agg(F.collect_list("x").alias("hubs")).join(state.where(F.col("weight") > weight).select("key", "size"), "key")
        tried = joined(large.where("main = 0").drop("size"), stored(hubs), ["key"], "id", "size")
        best = F.array_min(F.transform(F.filter("hubs", near), lambda x: F.struct(far(x).alias("d"), x["id"].alias("id"))))
        pairs = tried.select("id", best.alias("x")).where("x is not null").groupBy("id").agg(F.min("x").alias("x"))
        good = verified(pairs.select(F.col("id").alias("u"), F.col("x.id").alias("v")), sets, similarity)
        joins = good.count()
        if joins:
            root = roots(good.unionByName(root.select(F.col("node").alias("u"), F.col("root").alias("v"))))
        turn, trying = turn + 1, joins * 10 >= outside
        discard(now, state, rest)
    # Tiles, those of small buckets being the buckets.
    small = rest.where(F.col("weight") <= weight).select("key", F.lit(0).alias("p"), F.lit(0).alias("q"), F.lit(0).alias("side"), "id", "a", "b", "n", "g")
    every = small if not outside else small.unionByName(tiles(large.select("key", "main", "w", (F.bit_count("a") + F.bit_count("b")).alias("pop"), "id", "a", "b", "n", "g"), radius, weight))
    dealt = every.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
    flagged = stored(dealt.mapInArrow(lambda x: flag(x, similarity), f"{PLACE}, {NODE}"))
    full = flagged.join(shuffled(sets), "id").select("key", "p", "q", "side", "id", "a", "b", "n", "g", "z").repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
    good = stored(full.mapInArrow(lambda x: confirm(x, similarity), "u long, v long"))
    if not good.isEmpty():
        root = roots(good.unionByName(root.select(F.col("node").alias("u"), F.col("root").alias("v"))))
    discard(met, now, state, rest, flagged, sets)
    of_node = stored(nodes.join(shuffled(root), nodes["id"] == root["node"], "left").select("a", "b", "h", "copies", F.coalesce("root", "id").alias("root")))
    return joined(own.select("id", "a", "b", "h"), of_node, ["a", "b", "h"], "id", "copies").select("id", "root")


def drop_near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, that of least id, with all its columns.

    Where ids repeat or are null, rows are numbered in order of id (null last) and text,
    and the number stands for the id; so of equal rows one stays. Null and empty texts
    have no shingles and are one group. An empty table gives none.
    """
    seen = docs.agg(F.count("*").alias("n"), F.count(F.col(f"`{id_col}`")).alias("i"), F.count_distinct(F.col(f"`{id_col}`")).alias("d")).collect()[0]
    rows, key = docs, id_col
    if not seen["n"] == seen["i"] == seen["d"]:
        key = "_" * (max(map(len, docs.columns)) + 1)
        rows = checkpoint(docs.orderBy(F.col(f"`{id_col}`").asc_nulls_last(), F.col(f"`{text_col}`")).withColumn(key, F.monotonically_increasing_id()))
    gone = stored(groups(rows, words, similarity, key, text_col).where("id != root").select("id"))
    few = gone.count() <= BROADCAST_IDS
    kept = rows.join(F.broadcast(gone) if few else gone, F.col(f"`{key}`") == gone["id"], "left_anti")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
