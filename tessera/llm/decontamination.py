"""Benchmark decontamination with SimHash of item-sized windows.

Words are runs of letters, digits and _ in lower case; shingles are five words (all words of a shorter item). For every
benchmark item of n words, every window of n words of a document is a query (the whole document, if it is shorter). A
window whose shingles cannot weigh enough for any item of its size is passed over, which loses nothing: similarity t
needs at least the share t of the window's weight in shingles of such items, and running sums give that share for all
windows at once. All others are fingerprinted: a `BITS`-bit SimHash of the shingle multiset, rolled along the document. A
multi-index cuts fingerprints into `blocks` blocks; fingerprints within `radius` agree in one block up to
radius // blocks bits, so looking up every such neighbour of each block finds all items within the radius, and about
6 % of the others. The exact weighted Jaccard similarity of the two shingle multisets decides. A shingle weighs
1 + ln(1 + items / items that hold it), counted over the whole benchmark.

At similarity 0.8 the distance averages about 19 of 128 bits; the recall of radius 26 over brute force is tested.

Items are held by the workers block by block (`block_items` at a time; the default is some 30 MB of text), so a
benchmark of any size is covered with bounded memory: each block is one pass over the documents, is broadcast alone and
gives the same answers as any other division. Where there are several blocks, weights of window shingles that only other
blocks know are joined to the candidates at the end.

Defined results: null and empty texts or items match nothing; equal hits of one document and item are one row with the
best window (ties: the first); rows that repeat a doc_id count as one document in `find_hits`, and rows without a doc_id
likewise; `decontaminate` judges each row by its own text; rows that repeat an item_id are items of their own, and the
best hit among them is shown; rows without an item_id are left out; empty tables give no rows.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter, defaultdict
from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_flat, kept, prepare, stage, unstage

WORD = re.compile(r"\w+")
SHINGLE = 5
BITS = 128
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(ids: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all runs of k word ids."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    return mix(reduce(np.add, (ids[j : j + n] * _ODD[j] for j in range(k))) + np.uint64(k))


def word_ids(words: list[str]) -> np.ndarray:
    """64-bit hashes of words."""
    return np.fromiter((xxhash.xxh3_64_intdigest(w.encode()) for w in words), np.uint64, len(words))


def signs(hashes: np.ndarray) -> np.ndarray:
    """The shared random directions: a row of BITS numbers 1 or -1 for each shingle."""
    words = np.stack([mix(hashes + step) for step in np.arange(1, BITS // 64 + 1, dtype=np.uint64) * _ODD[0]], axis=1)
    bits = np.unpackbits(words.astype("<u8").view(np.uint8).reshape(len(hashes), BITS // 8), axis=1, bitorder="little")
    return 2 * bits.astype(np.int32) - 1


def window_fingerprints(hashes: np.ndarray, size: int, starts: np.ndarray) -> list[int]:
    """SimHash of the `size` shingles from each start (ascending): differences of running sums."""
    out: list[int] = []
    step, at = BITS // 8, 0
    while at < len(starts):
        # Windows that lie close together share their running sums.
        low = int(starts[at])
        end = int(np.searchsorted(starts, low + size + 1024))
        some = starts[at:end] - low
        part = signs(hashes[low : low + int(some[-1]) + size])
        sums = np.concatenate([np.zeros((1, BITS), np.int32), np.cumsum(part, axis=0, dtype=np.int32)])
        packed = np.packbits(sums[some + size] > sums[some], axis=1, bitorder="little").tobytes()
        out += [int.from_bytes(packed[i : i + step], "little") for i in range(0, len(packed), step)]
        at = end
    return out


def simhash(hashes: np.ndarray) -> int:
    return window_fingerprints(hashes, len(hashes), np.zeros(1, np.int64))[0]


class MultiIndex:
    """Finds every fingerprint within a Hamming radius through blocks that nearly agree."""

    def __init__(self, fingerprints: list[int], radius: int, blocks: int):
        self.fingerprints, self.radius = fingerprints, radius
        edges = [round(BITS * i / blocks) for i in range(blocks + 1)]
        self.cuts = [(a, (1 << (b - a)) - 1) for a, b in zip(edges, edges[1:])]
        self.flips = [
            [sum(1 << x for x in some) for m in range(min(radius // blocks, b - a) + 1) for some in combinations(range(b - a), m)]
            for a, b in zip(edges, edges[1:])
        ]
        self.tables: list[dict[int, list[int]]] = [defaultdict(list) for _ in self.cuts]
        for at, f in enumerate(fingerprints):
            for table, (shift, mask) in zip(self.tables, self.cuts):
                table[f >> shift & mask].append(at)

    def near(self, fingerprint: int) -> set[int]:
        """Items that share a block up to the flips: what the index lets through."""
        found: set[int] = set()
        for table, (shift, mask), flips in zip(self.tables, self.cuts, self.flips):
            own = fingerprint >> shift & mask
            for x in table.keys() & {own ^ f for f in flips}:
                found.update(table[x])
        return found

    def within(self, fingerprint: int) -> list[int]:
        return [at for at in self.near(fingerprint) if (fingerprint ^ self.fingerprints[at]).bit_count() <= self.radius]


class Items:
    """A block of benchmark items, ready for lookup; built once in each worker."""

    def __init__(self, items: list[tuple[int, str]], counts: dict[int, int], total: int, whole: bool, radius: int, blocks: int, threshold: float):
        self.threshold = threshold
        self.word_id = {w: xxhash.xxh3_64_intdigest(w.encode()) for _, t in items for w in WORD.findall(t.lower())}
        self.rare = 1 + math.log(1 + total)
        # The least weight that a shingle of another block can have.
        self.least = self.rare if whole else 1 + math.log(2)
        self.items: list[tuple[int, int, Counter, float]] = []  # id, words, shingles, their weight
        self.weight: dict[int, float] = {}
        fingerprints, sizes = [], set()
        for name, text in items:
            ids = word_ids(WORD.findall(text.lower()))
            if not len(ids):
                continue
            k = min(SHINGLE, len(ids))
            h = shingles(ids, k)
            listed = h.tolist()
            for x in listed:
                self.weight[x] = 1 + math.log(1 + total / counts.get(x, 1))
            self.items.append((name, len(ids), Counter(listed), sum(map(self.weight.__getitem__, listed))))
            fingerprints.append(simhash(h))
            sizes.add((k, len(ids)))
        self.sizes = sorted(sizes)
        self.keys = np.sort(np.fromiter(self.weight, np.uint64, len(self.weight)))
        self.values = np.array([self.weight[x] for x in self.keys.tolist()])
        # The sizes of the items that hold each shingle: those of keys[i] are own_sizes[first[i] : first[i + 1]].
        place = {x: i for i, x in enumerate(self.keys.tolist())}
        number = {n: i for i, (_, n) in enumerate(self.sizes)}
        pairs = np.unique(np.array([(place[x], number[n]) for _, n, own, _ in self.items for x in own], np.int64).reshape(-1, 2), axis=0)
        self.first, self.own_sizes = np.searchsorted(pairs[:, 0], np.arange(len(self.keys) + 1)), pairs[:, 1]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        self.index = MultiIndex(fingerprints, radius, blocks)
        self.known: dict[tuple[int, bytes], list] = {}

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in h, places among keys) of the shingles that some item of the block holds."""
        maybe = np.flatnonzero(self.seen[(h >> np.uint64(44)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.keys, h[maybe]), max(0, len(self.keys) - 1))
        right = self.keys[place] == h[maybe] if len(maybe) else np.zeros(0, bool)
        return maybe[right], place[right]

    def judge(self, h: np.ndarray, n: int, fingerprint: int) -> list[tuple[int, int, float, float, list[int]]]:
        """(item, distance, shared weight, weight of both known here, shingles unknown here) of a window's matches."""
        key = (n, h.tobytes())
        if key in self.known:
            return self.known[key]
        out, window = [], None
        for at in self.index.within(fingerprint):
            _, words, item, own = self.items[at]
            if words != n:
                continue
            if window is None:
                window = Counter(h.tolist())
                unknown = [x for x, c in window.items() if x not in self.weight for _ in range(c)]
                mine = sum(self.weight[x] * c for x, c in window.items() if x in self.weight)
            both = sum(self.weight[x] * min(c, window[x]) for x, c in item.items() if x in window)
            if both >= self.threshold * (own + mine + self.least * len(unknown) - both) - 1e-9:
                out.append((at, (fingerprint ^ self.index.fingerprints[at]).bit_count(), both, own + mine - both, unknown))
        if len(self.known) < 20_000:
            self.known[key] = out
        return out

    def hits(self, text: str) -> list[tuple]:
        """(item id, first word, words, distance, shared weight, known weight, unknown shingles) of a text's windows."""
        words = WORD.findall(text.lower())
        out: list[tuple] = []
        made: dict[int, tuple] = {}
        # Words that no item has are 0 at first: their shingles are no item's.
        ids = np.fromiter(map(self.word_id.get, words, repeat(0)), np.uint64, len(words))
        found = {k: self.look_up(shingles(ids, k)) for k in {k for k, _ in self.sizes}}
        if not any(len(at) for at, _ in found.values()):
            return out
        ids = word_ids(words)
        for k, (at, place) in found.items():
            if not len(at):
                continue
            h = shingles(ids, k)
            # Running sums of the least weight that shingles can have.
            low = np.full(len(h), self.least)
            low[at] = self.values[place]
            counts = self.first[place + 1] - self.first[place]
            number = self.own_sizes[np.repeat(self.first[place] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())]
            made[k] = h, np.concatenate([[0.0], np.cumsum(low)]), np.repeat(at, counts), np.repeat(self.values[place], counts), number
        for i, (k, n) in enumerate(self.sizes):
            if k not in made:
                continue
            h, low, at, value, number = made[k]
            mine = number == i
            if not mine.any():
                continue
            # A window of n words needs its share of weight in shingles of items of n words.
            own = np.zeros(len(h))
            own[at[mine]] = value[mine]
            own = np.concatenate([[0.0], np.cumsum(own)])
            size = min(n, len(ids)) - k + 1
            weight = own[size:] - own[:-size]
            starts = np.flatnonzero((weight > 0) & (weight >= self.threshold * (low[size:] - low[:-size]) - 1e-6))
            for start, fingerprint in zip(starts.tolist(), window_fingerprints(h, size, starts)):
                for item, *match in self.judge(h[start : start + size], n, fingerprint):
                    out.append((self.items[item][0], start, n, *match))
        return out


def item_counts(items: DataFrame) -> DataFrame:
    """(h, held): shingles by the number of items that hold them, over the whole benchmark."""

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        own = [word_ids(WORD.findall(t.lower())) for t in batch.column(0).to_pylist()]
        made = [np.unique(shingles(w, min(SHINGLE, len(w)))).view(np.int64) for w in own if len(w)]
        return {"h": pa.array(np.concatenate([np.zeros(0, np.int64), *made]))}

    found = arrow_flat(items.select("text"), run, T.StructType([T.StructField("h", T.LongType())]))
    return found.groupBy("h").agg(F.count(F.lit(1)).alias("held"))


def with_words(batch: pa.RecordBatch) -> dict[str, pa.Array]:
    """A row for each item that has a word."""
    sizes = [len(WORD.findall(t.lower())) for t in batch.column(0).to_pylist()]
    return {"n": pa.array([n for n in sizes if n], pa.int64())}


def unsigned(x: int) -> int:
    return x & ((1 << 64) - 1)


def search(docs: DataFrame, row: list[str], benchmark: DataFrame, threshold: float, radius: int, blocks: int, block_items: int) -> DataFrame:
    """(*row, item_id, start, n_words, similarity, distance) of every window that matches an item; row names a text."""
    spark = docs.sparkSession
    prepare(spark)
    items = benchmark.select("item_id", "text").where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).distinct()
    total = arrow_flat(items.select("text"), with_words, T.StructType([T.StructField("n", T.LongType())])).count()
    divided = max(1, -(-total // block_items))
    counts = item_counts(items)
    if divided > 1:
        counts = stage(counts, "item-shingles")
    made = [("item_id", T.LongType()), ("start", T.LongType()), ("n_words", T.LongType()), ("distance", T.LongType()), ("both", T.DoubleType()), ("known", T.DoubleType()), ("unknown", T.ArrayType(T.LongType()))]
    schema = T.StructType([docs.schema[c] for c in row] + [T.StructField(n, t) for n, t in made])
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64())]
    parts = []
    for number in range(divided):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(divided)) == number) if divided > 1 else items
        held = sorted((int(r[0]), r[1]) for r in own.collect())  # about block_items rows by construction
        often = counts.where("held > 1") if divided == 1 else counts.where("held > 1").join(item_counts(own).select("h"), "h", "left_semi")
        shared = spark.sparkContext.broadcast((held, {unsigned(r[0]): r[1] for r in often.collect()}))
        token = uuid.uuid4().hex

        def find(batch: pa.RecordBatch, shared=shared, token=token) -> dict[str, pa.Array]:
            look = kept(token, lambda: Items(*shared.value, total, divided == 1, radius, blocks, threshold))
            rows, found = [], []
            for i, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                for hit in look.hits(text) if text else ():
                    rows.append(i)
                    found.append((*hit[:-1], [x - (1 << 64) if x >> 63 else x for x in hit[-1]]))
            columns = list(zip(*found)) if found else [[]] * len(kinds)
            index = pa.array(rows, pa.int64())
            return {c: batch.column(j).take(index) for j, c in enumerate(row)} | {n: pa.array(v, k) for (n, _), v, k in zip(made, columns, kinds)}

        hits = arrow_flat(docs.select(*row, "text"), find, schema, keeps=True)
        if divided > 1:
            hits = stage(hits, "window-hits")
            shared.destroy()
        parts.append(hits)
    hits = reduce(DataFrame.unionByName, parts)
    rare = F.lit(1 + math.log(1 + total))
    if divided > 1:
        # Shingles that the hit's own block does not know may be known, and so weigh less, in another.
        hits = hits.withColumn("_hit", F.monotonically_increasing_id())
        hits = stage(hits, "numbered-hits")
        lost = hits.select("_hit", F.explode("unknown").alias("h")).join(counts.where("held > 1"), "h")
        less = lost.groupBy("_hit").agg(F.sum(rare - (1 + F.log(1 + F.lit(float(total)) / F.col("held")))).alias("_less"))
        hits = hits.join(less, "_hit", "left")
        weight = F.col("known") + rare * F.size("unknown") - F.coalesce("_less", F.lit(0.0))
        for part in parts:
            unstage(part)
    else:
        weight = F.col("known") + rare * F.size("unknown")
    hits = hits.withColumn("similarity", F.col("both") / weight).where(F.col("similarity") >= threshold - 1e-9)
    return hits.select(*row, "item_id", "start", "n_words", "similarity", "distance")


def find_hits(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, radius: int = 26, blocks: int = 9, block_items: int = 20_000) -> DataFrame:
    """(doc_id, item_id, start, n_words, similarity, distance) of every benchmark item found in a document."""
    hits = search(docs, ["doc_id"], benchmark, threshold, radius, blocks, block_items)
    best = F.max_by(F.struct("start", "n_words", "similarity", "distance"), F.struct("similarity", -F.col("start"))).alias("b")
    return hits.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, radius: int = 26, blocks: int = 9, block_items: int = 20_000) -> DataFrame:
    """docs without rows whose text holds a benchmark item."""
    # A row is named by its id and its text, so rows of one doc_id, or without one, are judged apart.
    name = [F.xxhash64("text"), F.xxhash64(F.lit(1), "text")]
    named = docs.select("doc_id", name[0].alias("_leak1"), name[1].alias("_leak2"), "text")
    found = search(named, ["doc_id", "_leak1", "_leak2"], benchmark, threshold, radius, blocks, block_items)
    found = found.select(F.col("doc_id").alias("_leak"), "_leak1", "_leak2").distinct()
    hit = docs["doc_id"].eqNullSafe(found["_leak"]) & (F.xxhash64(docs["text"]) == found["_leak1"]) & (F.xxhash64(F.lit(1), docs["text"]) == found["_leak2"])
    return docs.join(found, hit, "left_anti")
