"""Document fingerprints by randomised edit embedding.

All texts share one random walk: at output step j the walk writes the current character and moves on when the
shared random bit of (step, character) is 1. A local edit shifts the walk of one text only until the two walks
meet again, so a small edit distance becomes a small Hamming distance of the outputs. A fingerprint samples
`SAMPLES` output positions, nested by length, and keeps one hashed bit of the character at each: the text's
walk length and the bits. Likeness is 2 * agreement - 1 over the positions that either walk reached.

`neighbours` pairs each document with an edit of itself and with the next document; `near_documents` finds
near-equal texts by banding the sampled bits and verifying candidates with a bounded edit distance. There equal texts
are one class, bands that a walk does not reach make no bucket, and texts too short to be within the distance of any
other are not banded.

Defined results: a null text is empty; the empty text has the fingerprint of walk length 0; equal texts have
equal fingerprints and likeness 1; rows that repeat a doc_id are ordered by text; rows without a doc_id come
first, are nobody's next document but each other's, and the last of them is followed by the first numbered
document; a single document is its own next one; an empty table gives an empty result. In `near_documents` each row is
a document of its own; rows without a doc_id link with nothing (component null).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, components, hot_join, prepare, slices, stage, tidy, unstage

SAMPLES, PERIOD = 512, 4096
#: Lanes below which stepping text by text beats stepping all texts at once.
FEW = 40


@lru_cache(maxsize=1)
def _walk_table() -> np.ndarray:
    """Steps that a character of each of 256 classes is written for when met at step j modulo PERIOD."""
    bits = np.random.default_rng(20240229).integers(0, 2, (256, PERIOD), dtype=np.uint8)
    bits[:, -1] = 1
    out = np.zeros((256, PERIOD), np.int64)
    run = np.zeros(256, np.int64)
    for j in range(PERIOD - 1, -1, -1):
        run = np.where(bits[:, j] == 1, 1, run + 1)
        out[:, j] = run
    return out


def classes(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return ((code ^ (code >> np.uint32(8)) * np.uint32(151)) & np.uint32(255)).astype(np.uint8)


def walk(texts: list[np.ndarray], begin: list[int]) -> list[np.ndarray]:
    """For each text the output step at which each character starts, and the step after the last one."""
    table = _walk_table()
    flat_table = table.ravel()
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    sizes = np.array([len(texts[i]) for i in order], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    flat = np.zeros(int((sizes + 1).sum()), np.int64)
    for s, i in zip(starts, order):
        flat[s : s + len(texts[i])] = texts[i]
    flat <<= 12
    steps = np.zeros(len(flat), np.int64)
    j = np.array([begin[i] for i in order], np.int64)
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(longest), side="left") if longest else np.zeros(0, int)
    at = 0
    while at < longest and active[at] >= FEW:
        m = int(active[at])
        place = starts[:m] + at
        now = j[:m]
        steps[place] = now
        j[:m] = now + flat_table[flat[place] | (now & (PERIOD - 1))]
        at += 1
    for lane in range(int(active[at]) if at < longest else 0):
        rows = _walk_rows()
        here, k, out = int(j[lane]), int(starts[lane]), []
        for c in texts[order[lane]][at:].tobytes():
            out.append(here)
            here += rows[c][here & 4095]
        steps[k + at : k + int(sizes[lane])] = out
        j[lane] = here
    steps[starts + sizes] = j
    result: list[np.ndarray] = [None] * len(texts)  # type: ignore[list-item]
    for s, n, i in zip(starts, sizes, order):
        result[i] = steps[s : s + n + 1]
    return result


@lru_cache(maxsize=1)
def _walk_rows() -> list[bytes]:
    return [np.minimum(row, 255).astype(np.uint8).tobytes() for row in _walk_table()]


def _priority(p: np.ndarray) -> np.ndarray:
    h = (p.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


@lru_cache(maxsize=40)
def positions(level: int) -> np.ndarray:
    """The SAMPLES output positions below 2^level of lowest priority, ascending; nested from level to level."""
    if 1 << level <= SAMPLES:
        return np.arange(1 << level)
    below = positions(level - 1)
    rest = [below]
    for a in range(1 << (level - 1), 1 << level, 1 << 20):
        p = np.arange(a, min(a + (1 << 20), 1 << level))
        rest.append(p[np.argsort(_priority(p), kind="stable")[:SAMPLES]])
    p = np.concatenate(rest)
    return np.sort(p[np.argsort(_priority(p), kind="stable")[:SAMPLES]])


def level_of(end: int) -> int:
    return max(9, (max(end, 1) - 1).bit_length())


@lru_cache(maxsize=1)
def _char_bits() -> np.ndarray:
    return np.random.default_rng(77).integers(0, 2, (256, 64), dtype=np.uint8)


def sample_bits(end: int, text: np.ndarray, steps: np.ndarray, level: int | None = None) -> np.ndarray:
    """The sampled bits of a walk that has its characters at `steps`; positions from `end` on are 0."""
    p = positions(level_of(end) if level is None else level)
    out = np.zeros(SAMPLES, np.uint8)
    inside = p < end
    q = p[inside]
    if len(q):
        at = np.searchsorted(steps[:-1], q, side="right") - 1
        out[: len(q)] = _char_bits()[text[at], q & 63]
    return out


def render(end: int, bits: np.ndarray) -> str:
    return f"{end:08x}" + np.packbits(bits).tobytes().hex()


def likeness(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
    """Likeness of two (walk length, bits), 0 to 1."""
    if a[0] == b[0] and np.array_equal(a[1], b[1]):
        return 1.0
    if a[0] > b[0]:
        a, b = b, a
    pa_, pb = positions(level_of(a[0])), positions(level_of(b[0]))
    reached = pb < b[0]
    p, bits = pb[reached], b[1][: int(reached.sum())]
    if not len(p):
        return 0.0
    both = p < a[0]
    agree = float((a[1][np.searchsorted(pa_, p[both])] == bits[both]).sum()) + 0.5 * float((~both).sum())
    return max(0.0, min(1.0, 2 * agree / len(p) - 1))


def parse(fingerprint: str) -> tuple[int, np.ndarray]:
    return int(fingerprint[:8], 16), np.unpackbits(np.frombuffer(bytes.fromhex(fingerprint[8:]), np.uint8))


def embed_texts(texts: list[str]) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(walk length, sampled bits, classes, steps) of each text."""
    own = [classes(t) for t in texts]
    return [(int(s[-1]), sample_bits(int(s[-1]), c, s), c, s) for c, s in zip(own, walk(own, [0] * len(own)))]


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint)."""
    prepare(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        made = embed_texts([t or "" for t in batch.column(1).to_pylist()])
        return {"fingerprint": pa.array([render(m[0], m[1]) for m in made], pa.string())}

    return arrow_map(docs.select("doc_id", "text"), run, T.StructType([T.StructField("fingerprint", T.StringType())]), keep=["doc_id"])


def with_next(docs: DataFrame, rows_per_range: int = 256, most_ranges: int = 20_000, range_bytes: int = 1 << 30) -> DataFrame:
    """(range, head, doc_id, text) sorted so that the row after each document (head 0) is its next one.

    The ids are cut into ranges at quantiles; each range ends with a copy of the next range's first document
    (head 1), so no task needs more than its own rows and nothing orders the whole table. A range is sorted with spilling
    and read as a stream, so it may be large: 100 TB make 100,000 ranges of one GB, one row each on the driver.
    """
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("b")).first()
    ranges = max(1, min(most_ranges, size.n // rows_per_range), (size.b or 0) // range_bytes)
    cuts = sorted(set(docs.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.2 / ranges))) if ranges > 1 else []
    if cuts:
        splits = [float("-inf"), *cuts, float("inf")]
        numbered = Bucketizer(splits=splits, inputCol="_place", outputCol="_range", handleInvalid="keep").transform(
            docs.select("doc_id", "text", F.col("doc_id").cast("double").alias("_place"))
        )
        number = F.when(F.col("doc_id").isNull(), -1).otherwise(F.col("_range").cast("int"))
    else:
        numbered, number = docs, F.when(F.col("doc_id").isNull(), -1).otherwise(0)
    dealt = numbered.select(number.alias("range"), F.lit(0).alias("head"), "doc_id", "text")
    firsts = sorted((r[1], r[0]) for r in dealt.where("doc_id is not null").groupBy("range").agg(F.min("doc_id")).collect())
    if firsts:
        follow = [(firsts[(k + 1) % len(firsts)][0], firsts[k][1]) for k in range(len(firsts))] + [(firsts[0][0], -1)]
        kind = docs.schema["doc_id"].dataType.simpleString()
        heads = docs.sparkSession.createDataFrame(follow, f"doc_id {kind}, range int")  # one row a range
        copies = docs.select("doc_id", "text").join(F.broadcast(heads), "doc_id").select("range", F.lit(1).alias("head"), "doc_id", "text")
        dealt = dealt.union(copies)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, "range").sortWithinPartitions("range", "head", "doc_id", "text")


def neighbours(docs: DataFrame) -> DataFrame:
    """Each document with the fingerprints of itself and of its edited text, and their likenesses."""
    prepare(docs.sparkSession)
    outputs = T.StructType(
        [docs.schema["doc_id"], T.StructField("n_chars", T.LongType())]
        + [T.StructField(n, T.StringType()) for n in ("edited_sha256", "fingerprint", "edited_fingerprint")]
        + [T.StructField(n, T.DoubleType()) for n in ("near_edited", "near_next")]
    )
    names = [f.name for f in outputs]

    def pairs(ranges: list, heads: list, ids: list, texts: list[str]) -> tuple[list, list[list]]:
        whole = embed_texts(texts)
        rows = [i for i in range(len(ids)) if not heads[i]]
        after = []
        for i in rows:
            follows = i + 1 < len(ids) and ranges[i + 1] == ranges[i]
            after.append(i + 1 if follows else i)
        half = [len(texts[i]) // 2 for i in rows]
        tails = [whole[k][2][:h] for k, h in zip(after, half)]
        begins = [int(whole[i][3][len(texts[i]) - h]) for i, h in zip(rows, half)]
        moved = walk(tails, begins)
        columns: list[list] = [[] for _ in names[1:]]
        for i, k, h, tail, steps in zip(rows, after, half, tails, moved):
            n = len(texts[i])
            edited = texts[i][: n - h] + texts[k][:h]
            end = int(steps[-1])
            body = np.concatenate([whole[i][2][: n - h], tail])
            bits = sample_bits(end, body, np.concatenate([whole[i][3][: n - h], steps]))
            own = whole[i][:2]
            made = (n, hashlib.sha256(edited.encode()).hexdigest(), render(*own), render(end, bits), likeness(own, (end, bits)), likeness(own, whole[k][:2]))
            for column, value in zip(columns, made):
                column.append(value)
        return [ids[i] for i in rows], columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list, list] = ([], [], [], [])

        def flush(last: bool) -> pa.RecordBatch:
            ranges, heads, ids, texts = held
            # The last row waits for its successor.
            done, columns = pairs(ranges, heads, ids, texts) if last else pairs(ranges, [*heads[:-1], 1], ids, texts)
            kept = ([], [], [], []) if last else tuple([x[-1]] for x in held)
            for old, new in zip(held, kept):
                old[:] = new
            return pa.RecordBatch.from_arrays([pa.array(done, id_type)] + [pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        id_type = pa.int64()
        for whole in batches:
            id_type = whole.schema.field("doc_id").type
            for batch in slices(whole, "text"):
                for old, column in zip(held, batch.columns):
                    old.extend(column.to_pylist())
                held[3][:] = [t or "" for t in held[3]]
                if len(held[0]) > 1:
                    yield flush(False)
        if held[0]:
            yield flush(True)

    return with_next(docs).mapInArrow(tidy(run), outputs)


#: Length of the grams that rule unlike texts out.
GRAMS = 8


def gram_counts(text: np.ndarray, bits: int) -> np.ndarray:
    """How many grams of a text (code points) fall to each of 2^bits counters."""
    n = max(0, len(text) - GRAMS + 1)
    h = np.zeros(n, np.uint64)
    for j in range(GRAMS):
        h = h * np.uint64(0x9E3779B97F4A7C15) + text[j : j + n]
    return np.bincount(((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)


def run_end(x: np.ndarray, y: np.ndarray, i: int, j: int) -> int:
    """Where in x the common run of x from i and y from j ends."""
    block = 64
    while i < len(x) and j < len(y):
        size = min(block, len(x) - i, len(y) - j)
        apart = np.flatnonzero(x[i : i + size] != y[j : j + size])
        if len(apart):
            return i + int(apart[0])
        i, j, block = i + size, j + size, min(2 * block, 1 << 20)
    return i


def edit_distance_within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance is at most `most`.

    One edit changes at most GRAMS grams on either side, so texts whose gram counts differ by more are apart. The others
    are walked along furthest-reaching diagonals, all diagonals of a round at once, long common runs block by block.
    """
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return False
    x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (a, b))
    bits = min(20, (n + m).bit_length())
    if int(np.abs(gram_counts(x, bits) - gram_counts(y, bits)).sum()) > 2 * GRAMS * most:
        return False
    # A closing sign that differs on the two sides ends every run inside the arrays.
    left, right = np.append(x, np.uint32(0xFFFFFFFF)), np.append(y, np.uint32(0xFFFFFFFE))
    reach = np.zeros(1, np.int64)
    for d in range(most + 1):
        k = np.arange(-d, d + 1)
        if d:
            before = np.full(2 * d + 3, -(1 << 40))
            before[2:-2] = reach
            reach = np.minimum(np.maximum(np.maximum(before[:-2], before[1:-1]) + 1, before[2:]), np.minimum(n, m + k))
        going = np.arange(len(k))
        for _ in range(16):
            going = going[left[reach[going]] == right[reach[going] - k[going]]]
            if not len(going):
                break
            reach[going] += 1
        for g in going.tolist():
            reach[g] = run_end(x, y, int(reach[g]), int(reach[g] - k[g]))
        if abs(n - m) <= d and reach[n - m + d] == n:
            return True
    return False


#: Consecutive walk bits that make a band, counters of a sketch, and the length of the grams it counts.
WIDTH, COUNTERS, PAIRED = 32, 256, 2
#: Members of a bucket that one piece holds at most on average; pieces of larger buckets meet pair by pair.
PIECE = 2000


@lru_cache(maxsize=40)
def band_starts(level: int, bands: int) -> np.ndarray:
    """Where the bands of a level begin: one in each of `bands` equal stretches, at a place chosen by hash."""
    stretch = max(1, (1 << level) // bands)
    first = np.arange(bands, dtype=np.int64) * stretch
    return first + (_priority(first + (level << 40)) % np.uint64(max(1, stretch - WIDTH + 1))).astype(np.int64)


def length_groups(n: int, distance: float) -> list[int]:
    """Groups of lengths that texts of length n and texts within `distance` of them share."""
    step = math.log(max(1 + 5 * distance, 1 / (1 - distance)))
    return sorted({int(math.log(n) / step), int(math.log((n + 1) / (1 - distance)) / step)})


def bands_of(end: int, text: np.ndarray, steps: np.ndarray, bands: int, distance: float) -> list[int]:
    """Hashed bands that the walk reaches, each with a group of lengths; a walk that a few edits could carry over the next
    power of two is banded at both levels.

    A band is WIDTH consecutive bits, so it holds as long as the two walks agree in that one place, and unlike texts
    rarely meet in it, however many there are.
    """
    found = []
    groups = length_groups(len(text), distance)
    for level in sorted({level_of(end), level_of(int(end * (1 + 4 * distance)) + 1)}):
        starts = band_starts(level, bands)
        reached = np.flatnonzero(starts + WIDTH <= end)
        places = (starts[reached, None] + np.arange(WIDTH)).ravel()
        at = np.searchsorted(steps[:-1], places, side="right") - 1
        parts = np.packbits(_char_bits()[text[at], places & 63]).reshape(len(reached), -1)
        for b, part in zip(reached.tolist(), parts):
            found += [xxhash.xxh3_64_intdigest(b"%d %d %d " % (level, b, g) + part.tobytes()) - (1 << 63) for g in groups]
    return found


def sketch(text: str) -> bytes:
    """How many grams of PAIRED code points fall to each of COUNTERS counters, 255 for more. One edit moves the sum of
    differences of two sketches by 2 * PAIRED at most."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = code[:-1] * np.uint64(0x9E3779B97F4A7C15) + code[1:]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(56)
    return np.minimum(np.bincount(h.astype(np.int64), minlength=COUNTERS), 255).astype(np.uint8).tobytes()


def sketched(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, COUNTERS).astype(np.int16)


def sketches_allow(x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Which pairs of sketches may belong to texts within `most` edits; summed counters tell most of the others."""
    coarse = lambda s: s.reshape(len(s), 32, -1).sum(axis=2)
    allow = np.abs(coarse(x) - coarse(y)).sum(axis=1) <= 2 * PAIRED * most
    left = np.flatnonzero(allow)
    allow[left] = np.abs(x[left] - y[left]).sum(axis=1) <= 2 * PAIRED * most[left]
    return allow


def band_cells(docs: DataFrame, bands: int, distance: float) -> DataFrame:
    """(doc_id, t1, t2, n_chars, cells, sketch): t1, t2 name the text, cells are its hashed bands (a short text has neither
    bands nor a sketch)."""
    prepare(docs.sparkSession)
    least = 1 / distance - 1  # a shorter text is within the distance of equal ones only

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        long = [i for i, t in enumerate(texts) if len(t) >= least]
        cells: list[list[int]] = [[] for _ in texts]
        sketches: list[bytes | None] = [None] * len(texts)
        for i, (end, _, own, steps) in zip(long, embed_texts([texts[i] for i in long])):
            cells[i], sketches[i] = bands_of(end, own, steps, bands, distance), sketch(texts[i])
        return {"n_chars": pa.array([len(t) for t in texts], pa.int64()), "cells": pa.array(cells, pa.list_(pa.int64())), "sketch": pa.array(sketches, pa.binary())}

    body = F.coalesce("text", F.lit(""))
    named = docs.select("doc_id", "text", F.xxhash64(body).alias("t1"), F.xxhash64(F.lit(1), body).alias("t2"))
    outputs = T.StructType([T.StructField("n_chars", T.LongType()), T.StructField("cells", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType())])
    return arrow_map(named, run, outputs, keep=["doc_id", "t1", "t2"])


def verified(texts: DataFrame, pairs: DataFrame, distance: float) -> DataFrame:
    """The pairs (a, b) whose texts (rep, text) are within `distance` edits per character of the longer."""
    both = (
        pairs.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("_one")), "a")
        .join(texts.select(F.col("rep").alias("b"), "text"), "b")
        .select("a", "b", "_one", "text")
    )

    def verify(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        out = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            out.append(edit_distance_within(x, y, int(distance * max(len(x), len(y)))))
        return {"near": pa.array(out, pa.bool_())}

    outputs = T.StructType([T.StructField("near", T.BooleanType())])
    return stage(arrow_map(both, verify, outputs, keep=["a", "b"]).where("near").select("a", "b"), "near")


def allowed(pairs: DataFrame, classes: DataFrame, distance: float) -> DataFrame:
    """The pairs (a, b) that lengths and sketches do not rule out."""
    side = lambda key, i: classes.select(F.col("rep").alias(key), F.col("n_chars").alias(f"_n{i}"), F.col("sketch").alias(f"_s{i}"))
    both = pairs.join(side("a", 0), "a").join(side("b", 1), "b").where(F.abs(F.col("_n0") - F.col("_n1")) <= distance * F.greatest("_n0", "_n1"))

    def judge(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        most = (distance * np.maximum(*(batch.column(i).to_numpy() for i in (2, 3)))).astype(np.int64)
        return {"may": pa.array(sketches_allow(sketched(batch.column(4)), sketched(batch.column(5)), most))}

    made = arrow_map(both.select("a", "b", "_n0", "_n1", "_s0", "_s1"), judge, T.StructType([T.StructField("may", T.BooleanType())]), keep=["a", "b"], text="_s0")
    return made.where("may").select("a", "b")


def bucket_pairs(cell: np.ndarray, first: np.ndarray, second: np.ndarray, piece: np.ndarray, n_chars: np.ndarray, rep: np.ndarray, comp: np.ndarray, held: np.ndarray, distance: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (a, b) of whole buckets, sorted by (cell, first, second, n_chars), in different components and allowed by
    their sketches; pieces first and second of a bucket meet each other, or a piece itself."""
    group = np.concatenate([[0], np.cumsum((np.diff(cell) != 0) | (np.diff(first) != 0) | (np.diff(second) != 0))])
    top = (n_chars / (1 - distance)).astype(np.int64) + 1
    later = np.searchsorted((group << 40) + n_chars, (group << 40) + top, side="right") - np.arange(len(group)) - 1
    ends = np.cumsum(later)
    start = 0
    while start < len(group):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + 200_000, side="right")))
        count = later[start:stop]
        i = np.repeat(np.arange(start, stop), count)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
        most = (distance * n_chars[j]).astype(np.int64)
        keep = (comp[i] != comp[j]) & ((first[i] == second[i]) | (piece[i] != piece[j])) & (n_chars[j] - n_chars[i] <= most)
        i, j, most = i[keep], j[keep], most[keep]
        for at in range(0, len(i), 20_000):
            x, y = i[at : at + 20_000], j[at : at + 20_000]
            may = sketches_allow(held[x], held[y], most[at : at + 20_000])
            x, y = rep[x[may]], rep[y[may]]
            if len(x):
                yield np.minimum(x, y), np.maximum(x, y)
        start = stop


def open_pairs(members: DataFrame, distance: float) -> DataFrame:
    """Distinct pairs (a, b) that share a bucket, lie in different components and pass their sketches.

    members (cell, rep, n_chars, sketch, comp, k), k members in the bucket. Tasks compare the members of a bucket by their
    sketches and hand out only the pairs left; a bucket of over PIECE members is dealt in pieces, two of which meet at a
    time, so that no task holds more.
    """
    pieces = F.ceil(F.col("k") / PIECE).cast("long")
    cut = members.withColumn("pieces", pieces).withColumn("piece", F.pmod(F.xxhash64("rep"), "pieces"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
    cut = cut.select("cell", F.least("piece", "other").alias("first"), F.greatest("piece", "other").alias("second"), "piece", "n_chars", "rep", "comp", "sketch")
    key = ["cell", "first", "second"]
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut.repartition(parts, *key).sortWithinPartitions(*key, "n_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(table: pa.Table) -> Iterator[pa.RecordBatch]:
            columns = [table.column(i).to_numpy() for i in range(7)]
            for a, b in bucket_pairs(*columns, sketched(table.column(7)), distance):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= 2 * PIECE:
                table = pa.Table.from_batches(held)
                # The last bucket may go on.
                last = [table.column(i).to_numpy() for i in range(3)]
                whole = np.flatnonzero(np.any([c != c[-1] for c in last], axis=0))
                at = int(whole[-1]) + 1 if len(whole) else 0
                yield from flush(table.slice(0, at)) if at else ()
                held = table.slice(at).to_batches()
        if held:
            yield from flush(pa.Table.from_batches(held))

    return dealt.mapInArrow(tidy(run), "a long, b long").distinct()


def near_documents(docs: DataFrame, bands: int = 32, distance: float = 0.02) -> DataFrame:
    """(doc_id, component): documents linked through texts within `distance` edits per character; component is the
    smallest doc_id reachable.

    Bands of the walk's bits name buckets. Every class of equal texts is first compared with its bucket's first class; then
    classes of one bucket that are still in different components are compared. Lengths and sketches, which no texts within
    the distance fail, are compared before any text travels, and the second time inside tasks, so that a crowded bucket
    makes no row for each of its pairs. Two near texts that share no band are missed; the recall at one and two edits in
    100 characters is tested.
    """
    made = stage(band_cells(docs, bands, distance), "bands")
    classes = (
        made.where("doc_id is not null").groupBy("t1", "t2")
        .agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("rows"), F.max("n_chars").alias("n_chars"), F.first("cells").alias("cells"), F.first("sketch").alias("sketch"))
        .withColumn("rep", F.monotonically_increasing_id())
    )
    classes = stage(classes, "classes")
    total = classes.count()
    cells = classes.select("rep", F.explode("cells").alias("cell"))
    low = cells.groupBy("cell").agg(F.min("rep").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    cells = stage(hot_join(cells, low, ["cell"], "n", total * bands * 4), "cells")
    near = classes.join(cells.select("rep").distinct(), "rep", "left_semi").select("rep", "t1", "t2")
    body = F.coalesce("text", F.lit(""))
    texts = docs.select(body.alias("text"), F.xxhash64(body).alias("t1"), F.xxhash64(F.lit(1), body).alias("t2")).join(near, ["t1", "t2"])
    texts = stage(texts.groupBy("rep").agg(F.first("text").alias("text")), "texts")

    star = cells.where("a <> rep").select("a", F.col("rep").alias("b")).distinct()
    links = verified(texts, allowed(star, classes, distance), distance)
    found = stage(components(links), "comp")

    marked = cells.drop("a", "n").join(found, F.col("rep") == F.col("id"), "left").select("cell", "rep", F.coalesce("component", "rep").alias("comp"))
    mixed = marked.groupBy("cell").agg(F.count(F.lit(1)).alias("k"), F.min("comp").alias("_low"), F.max("comp").alias("_high")).where("_low <> _high").drop("_low", "_high")
    # Only members of open buckets carry their sketches.
    parted = stage(hot_join(marked, mixed, ["cell"], "k", total * bands * 4).join(classes.select("rep", "n_chars", "sketch"), "rep"), "marked")
    more = verified(texts, open_pairs(parted, distance), distance)
    final = stage(components(more, known=found), "comp")

    named = classes.select("rep", "t1", "t2", "rows", "low").join(final.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    lows = named.groupBy("component").agg(F.min("low").alias("_low"), F.count(F.lit(1)).alias("k"))
    named = stage(hot_join(named, lows, ["component"], "k", total).select("t1", "t2", "rows", F.col("_low").alias("component")), "named")
    for table in (classes, cells, texts, links, found, parted, more, final):
        unstage(table)
    numbered = made.where("doc_id is not null").select("doc_id", "t1", "t2")
    out = hot_join(numbered, named, ["t1", "t2"], "rows", made.count()).select("doc_id", "component")
    return out.unionByName(made.where("doc_id is null").select("doc_id", F.col("doc_id").alias("component")))
