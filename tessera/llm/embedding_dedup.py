"""Near copies among embeddings: randomised-rotation binary codes decide which pairs are computed exactly.

A vector is scaled to length 1, padded to a power of two and turned by random orthogonal maps (three rounds of random
signs and a Hadamard transform; several maps until there are `POOL` coordinates). Its code holds the signs. With x the
sign vector of the first map scaled to length 1 and f = <x, turned vector> kept beside it as correction factor,
<x, turned query> / f is an unbiased estimate of the cosine, off by more than EPSILON * sqrt((1 - f*f) / (P - 1)) / f with
a chance below 1e-4 (and never by more than sqrt(1 - f*f) / f). The query is rounded to 4 bits a coordinate, kept as bit
planes, so the estimate is a few bit counts; its rounding widens the bound. Before that, the signs of all maps bound the
angle: at the threshold more than `most_apart` of them differ with a chance below 1e-6. A pair that either bound puts
below the threshold is dropped, any other is computed again in double precision, and only that decides.

Which pairs are estimated: vectors of one label fall into cells by bands of code bits. A label of up to `bucket` vectors is
one cell; for n vectors a band has log2(n / bucket) bits, and there are so many bands that a pair at the threshold misses
all with a chance of `miss` at most. A cell of more than `BLOCK` vectors is cut into blocks, and every two blocks
meet in a task; a task hands on counts and a spanning forest of its links, never pairs. The first pass over the
cells reads codes alone; the vectors themselves are sent only where an estimate left a pair open. A pair is looked at in
the first band that both share.

Defined results: equal vectors of a label are one class with as many members; vectors that are null, empty, zero or
hold null or non-finite components, and rows without label or vec_id, link with nothing; vectors of different lengths are not
compared; rows that repeat a vec_id are vectors of their own; an empty table gives an empty result; other columns are
not returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, hot_join, prepare, stage, tidy, unstage

#: Bits from which bands are drawn, at least; width of the confidence bounds; bit planes of a query.
POOL, EPSILON, PLANES = 256, 4.0, 4
#: Vectors of one side of a block pair; rows of cells that one task call gets on average.
BLOCK, DEAL = 2048, 20_000
CELL = ["label", "dim", "band", "key"]


def padded(dim: int) -> int:
    return max(64, 1 << (dim - 1).bit_length())


@cache
def sign_rounds(size: int, turn: int) -> np.ndarray:
    return np.random.default_rng([size, turn]).integers(0, 2, (3, size)) * 2.0 - 1.0


def hadamard(rows: np.ndarray) -> np.ndarray:
    """Orthonormal Walsh-Hadamard transform of each row; the length is a power of two."""
    n, size, step = *rows.shape, 1
    while step < size:
        pairs = rows.reshape(n, size // (2 * step), 2, step)
        rows = np.concatenate([pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]], axis=2).reshape(n, size)
        step *= 2
    return rows / math.sqrt(size)


def turned(unit: np.ndarray, turn: int) -> np.ndarray:
    """Padded unit vectors under the random orthogonal map number `turn`."""
    for signs in sign_rounds(unit.shape[1], turn):
        unit = hadamard(unit * signs)
    return unit


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as 64-bit words."""
    wide = np.zeros((len(bits), -(-bits.shape[1] // 64) * 64), np.uint8)
    wide[:, : bits.shape[1]] = bits
    return np.packbits(wide, axis=1, bitorder="little").view("<u8")


def turns(dim: int) -> int:
    return -(-POOL // padded(dim))


def encode(vectors: np.ndarray) -> dict[str, np.ndarray]:
    """Codes of rows of finite, non-zero vectors: pool (sign bits of all maps), code, planes, f, low, step."""
    # Scaled by the largest component first, so that squares neither vanish nor overflow.
    unit = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    size = padded(vectors.shape[1])
    unit = np.pad(unit, ((0, 0), (0, size - vectors.shape[1])))
    first = turned(unit, 0)
    signs = [first >= 0] + [turned(unit, t) >= 0 for t in range(1, turns(vectors.shape[1]))]
    low, high = first.min(axis=1), first.max(axis=1)
    step = np.maximum((high - low) / (2**PLANES - 1), 1e-12)
    levels = np.clip(np.rint((first - low[:, None]) / step[:, None]), 0, 2**PLANES - 1).astype(np.uint8)
    planes = np.stack([packed(levels >> j & 1) for j in range(PLANES)], axis=1)
    return {
        "pool": packed(np.concatenate(signs, axis=1)), "code": packed(signs[0]), "planes": planes,
        "f": np.abs(first).sum(axis=1) / math.sqrt(size), "low": low, "step": step,
    }


def upper_bounds(x: dict[str, np.ndarray], q: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, size: int) -> np.ndarray:
    """Upper confidence bounds of the cosines of the coded vectors x[i] with the queries q[j]."""
    shared = np.zeros(len(i))
    for k in range(PLANES):
        for w in range(x["code"].shape[1]):
            shared += np.bitwise_count(x["code"][i, w] & q["planes"][j, k, w]) * float(1 << k)
    ones = np.bitwise_count(x["code"]).sum(axis=1, dtype=np.float64)
    levels = sum((1 << k) * np.bitwise_count(q["planes"][:, k]).sum(axis=1, dtype=np.float64) for k in range(PLANES))
    total = size * q["low"] + q["step"] * levels
    inner = 2 * (q["low"][j] * ones[i] + q["step"][j] * shared) - total[j]
    f = x["f"][i]
    spread = np.sqrt(np.maximum(0, 1 - f * f)) * min(1.0, EPSILON / math.sqrt(size - 1))
    rounding = q["step"][j] * min(EPSILON / math.sqrt(12), math.sqrt(size) / 2)
    return (inner / math.sqrt(size) + spread + rounding) / f


def most_apart(bits: int, threshold: float) -> float:
    """How many of `bits` signs may differ at the threshold: the mean and five deviations."""
    share = math.acos(threshold) / math.pi
    return bits * share + 5 * math.sqrt(bits * share * (1 - share))


def bands(n: int, threshold: float, bucket: int, miss: float) -> tuple[int, int]:
    """Bits of a band and number of bands for a label of n vectors."""
    bits = min(60, max(0, math.ceil(math.log2(n / bucket))))
    if not bits:
        return 0, 1
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    # Bands share bits of the pool, which makes a miss likelier than for independent ones: half as many again.
    return bits, math.ceil(1.5 * math.log(miss) / math.log1p(-agree))


@cache
def band_places(pool: int, band: int) -> np.ndarray:
    """Places of a band's bits in the pool; a narrower band takes the first ones."""
    return np.random.default_rng([pool, 7, band]).permutation(pool)[:60]


def pool_bits(dim: int) -> int:
    return padded(dim) * turns(dim)


def band_keys(pool: np.ndarray, dim: int, bits: int, count: int) -> np.ndarray:
    """Keys (rows, bands) of the packed sign bits."""
    single = np.unpackbits(pool.view(np.uint8), axis=1, bitorder="little").astype(np.int64)
    weights = 1 << np.arange(bits, dtype=np.int64)
    return np.stack([single[:, band_places(pool_bits(dim), b)[:bits]] @ weights for b in range(count)], axis=1)


@cache
def band_mask(dim: int, bits: int, band: int) -> np.ndarray:
    mask = np.zeros((1, pool_bits(dim)), np.uint8)
    mask[0, band_places(pool_bits(dim), band)[:bits]] = 1
    return packed(mask)


def apart_before(a: np.ndarray, b: np.ndarray, dim: int, bits: int, band: int) -> np.ndarray:
    """Which rows of a and b (packed signs) agree in none of the bands before `band`."""
    left = np.arange(len(a))
    for earlier in range(band):
        if not len(left):
            break
        left = left[((a[left] ^ b[left]) & band_mask(dim, bits, earlier)).any(axis=1)]
    return left


CODES = T.StructType(
    [T.StructField("cls", T.LongType()), T.StructField("dim", T.IntegerType())]
    + [T.StructField(n, T.BinaryType()) for n in ("pool", "code", "planes", "vector")]
    + [T.StructField(n, T.DoubleType()) for n in ("f", "low", "step")]
    + [T.StructField("keys", T.ArrayType(T.LongType()))]
)


def coded(classes: DataFrame, threshold: float, bucket: int, miss: float) -> DataFrame:
    """CODES of classes (cls, vector array, of: vectors of its label); vectors without a direction give no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, sizes, names = batch.column(1), batch.column(2).to_numpy(), batch.column(0).to_numpy()
            lengths = lists.value_lengths().to_numpy()
            flat = lists.flatten()
            whole = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # null components become NaN
            ends = np.cumsum(lengths)
            for dim, n in sorted({(int(d), int(n)) for d, n in zip(lengths, sizes, strict=True) if d}):
                rows = np.flatnonzero((lengths == dim) & (sizes == n))
                vectors = whole[(ends[rows] - dim)[:, None] + np.arange(dim)]
                with np.errstate(invalid="ignore"):
                    fine = np.isfinite(vectors).all(axis=1) & (np.abs(vectors).max(axis=1) > 0)
                rows, vectors = rows[fine], vectors[fine]
                if not len(rows):
                    continue
                c = encode(vectors)
                bits, count = bands(n, threshold, bucket, miss)
                keys = band_keys(c["pool"], dim, bits, count)
                blobs = {k: pa.array([r.tobytes() for r in v], pa.binary()) for k, v in (("pool", c["pool"]), ("code", c["code"]), ("planes", c["planes"]), ("vector", vectors))}
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[rows], pa.int64()), pa.array(np.full(len(rows), dim), pa.int32()), *blobs.values()]
                    + [pa.array(c[k], pa.float64()) for k in ("f", "low", "step")] + [pa.array(list(keys), pa.list_(pa.int64()))],
                    names=CODES.names,
                )

    return classes.select("cls", "vector", "of").mapInArrow(tidy(run), CODES)


def arrays(rows: pd.DataFrame) -> dict[str, np.ndarray]:
    """The codes of a block as arrays."""
    words = lambda name: np.frombuffer(b"".join(rows[name]), "<u8").reshape(len(rows), -1)
    out = {"pool": words("pool"), "code": words("code"), "planes": words("planes")}
    out["planes"] = out["planes"].reshape(len(rows), PLANES, -1)
    return out | {n: rows[n].to_numpy() for n in ("f", "low", "step", "cls")}


def open_pairs(
    one: dict[str, np.ndarray], two: dict[str, np.ndarray] | None, dim: int, threshold: float, band: int = 0, bits: int = 0
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places (in one, in two; without two, in one twice) that share no earlier band and that no bound rules out,
    tile by tile."""
    other, size = one if two is None else two, padded(dim)
    words = one["pool"].shape[1]
    most = most_apart(64 * words, threshold)
    for top in range(0, len(one["f"]), 512):
        pool = one["pool"][top : top + 512]
        apart = np.zeros((len(pool), len(other["f"])), np.uint16)
        for w in range(words):
            apart += np.bitwise_count(pool[:, w, None] ^ other["pool"][None, :, w])
        near = apart <= most
        if two is None:
            near &= np.arange(len(other["f"])) > np.arange(top, top + len(pool))[:, None]
        i, j = np.nonzero(near)
        i += top
        for at in range(0, len(i), 1 << 16):
            u, v = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            if band:
                mine = apart_before(one["pool"][u], other["pool"][v], dim, bits, band)
                u, v = u[mine], v[mine]
            fine = upper_bounds(one, other, u, v, size) >= threshold
            yield u[fine], v[fine]


def exact_links(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs reach the threshold by cosine in double precision."""
    out = np.zeros(len(i), bool)
    for at in range(0, len(i), 8192):
        u, v = a[i[at : at + 8192]], b[j[at : at + 8192]]
        u, v = (x / np.abs(x).max(axis=1, keepdims=True) for x in (u, v))
        dot, uu, vv = (np.einsum("ij,ij->i", x, y) for x, y in ((u, v), (u, u), (v, v)))
        out[at : at + 8192] = dot / np.sqrt(uu * vv) >= threshold
    return out


def dealt(rows: DataFrame, total: int) -> DataFrame:
    """Rows with `deal`, a number that many cells share: one call of a task function gets some DEAL rows."""
    return rows.withColumn("deal", F.pmod(F.xxhash64(*CELL, "bi", "bj"), F.lit(max(1, total // DEAL))))


def sides(cell: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame | None]:
    """The two blocks of a block pair; one block that meets itself has no second."""
    bi, bj = cell["bi"].iat[0], cell["bj"].iat[0]
    return cell[cell["part"] == bi], None if bi == bj else cell[cell["part"] == bj]


def cells_of(rows: pd.DataFrame, threshold: float, bucket: int, miss: float) -> Iterator[tuple]:
    """(left rows, right rows, left codes, right codes, open pairs) of each block pair; a block that meets itself has no
    right side."""
    for _, cell in rows.groupby([*CELL, "bi", "bj"], sort=False):
        left, right = sides(cell)
        if right is not None and not (len(left) and len(right)):
            continue
        one, two = arrays(left), None if right is None else arrays(right)
        dim, band = int(cell["dim"].iat[0]), int(cell["band"].iat[0])
        yield left, right, one, two, open_pairs(one, two, dim, threshold, band, bands(int(cell["of"].iat[0]), threshold, bucket, miss)[0])


def estimate_cells(threshold: float, bucket: int, miss: float):
    """Task function: of the rows of some cells those that are in an open pair."""
    names = [*CELL, "bi", "bj", "part", "cls"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kept = []
        for left, right, _, _, pairs in cells_of(pdf, threshold, bucket, miss):
            i_open, j_open = np.zeros(len(left), bool), np.zeros(len(left if right is None else right), bool)
            for i, j in pairs:
                i_open[i], j_open[j] = True, True
            kept += [left[i_open | j_open]] if right is None else [left[i_open], right[j_open]]
        return pd.concat(kept)[names] if kept else pdf[names].iloc[:0]

    return run


LINKS = T.StructType([T.StructField(n, T.LongType()) for n in ("cls", "n", "other")])


def roots(size: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest place that each of `size` places reaches by the links (i, j)."""
    found = np.arange(size)
    while True:
        low = np.minimum(found[i], found[j])
        new = found.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == found).all():
            return found
        found = new


def link_cells(threshold: float, bucket: int, miss: float):
    """Task function: (cls, n, other) of each member with links in some cells: vectors linked, and one class of its tree."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for left, right, one, two, pairs in cells_of(pdf, threshold, bucket, miss):
            both = left if right is None else pd.concat([left, right])
            vectors = np.frombuffer(b"".join(both["vector"]), np.float64).reshape(len(both), -1)
            weights, names = both["members"].to_numpy(), both["cls"].to_numpy()
            shift = 0 if right is None else len(left)
            ends = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
            for i, j in pairs:
                j = j + shift
                good = exact_links(vectors, vectors, i, j, threshold)
                ends.append((i[good], j[good]))
            i, j = (np.concatenate(x) for x in zip(*ends, strict=True))
            n = np.bincount(i, weights[j], len(both)) + np.bincount(j, weights[i], len(both))
            held = np.flatnonzero(n)
            if len(held):
                out.append(pd.DataFrame({"cls": names[held], "n": n[held].astype(np.int64), "other": names[roots(len(both), i, j)[held]]}))
        return pd.concat(out) if out else pd.DataFrame({c: np.zeros(0, np.int64) for c in LINKS.names})

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.93, bucket: int = 1024, miss: float = 1e-4) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of rows (vec_id, embedding, label): links to vectors of equal label with a
    cosine of threshold or more."""
    spark = vectors.sparkSession
    prepare(spark)
    rows = vectors.select("vec_id", "embedding", "label", F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2"))
    able = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.coalesce(F.size("embedding"), F.lit(0)) > 0)
    name = ["label", "h1", "h2"]
    # An id made while the table is written is unique whatever tasks are run again.
    classes = rows.where(able).groupBy(*name).agg(F.count(F.lit(1)).alias("members"), F.min("vec_id").alias("least"), F.first("embedding").alias("vector"))
    classes = stage(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    n_classes = classes.count()
    of = classes.groupBy("label").agg(F.count(F.lit(1)).alias("of"))
    sized = hot_join(classes.select("label", "cls", "members", "vector"), of, ["label"], "of", n_classes)
    codes = stage(coded(sized, threshold, bucket, miss), "codes")

    # Cells with their number of classes; those of one class hold no pair.
    about = stage(sized.select("cls", "label", "members", "of"), "about")
    coded_rows = codes.drop("keys", "vector").join(about, "cls")
    cells = codes.select("cls", "dim", F.posexplode("keys").alias("band", "key")).join(about.select("cls", "label"), "cls")
    cells = stage(cells, "cells")
    n_cells = cells.count()
    held = cells.groupBy(*CELL).agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    parted = hot_join(cells, held, CELL, "k", n_cells).withColumn("parts", F.ceil(F.col("k") / BLOCK).cast("int"))
    parted = parted.withColumn("part", F.pmod(F.xxhash64("cls", "band"), "parts").cast("int"))
    # Every block meets every block of its cell, itself included.
    met = parted.select(*CELL, "part", "cls", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("_with"))
    met = met.select(*CELL, F.least("part", "_with").alias("bi"), F.greatest("part", "_with").alias("bj"), "part", "cls")
    opened = dealt(met.join(coded_rows.drop("dim", "label"), "cls"), n_cells)
    kinds = {f.name: f for f in met.schema}
    open_schema = T.StructType([kinds[c] for c in [*CELL, "bi", "bj", "part", "cls"]])
    survivors = stage(opened.groupBy("deal").applyInPandas(estimate_cells(threshold, bucket, miss), open_schema), "survivors")

    whole = codes.drop("keys", "dim").join(about.drop("label"), "cls")
    checked = dealt(survivors.join(whole, "cls"), survivors.count())
    links = stage(checked.groupBy("deal").applyInPandas(link_cells(threshold, bucket, miss), LINKS), "links")
    counted = links.groupBy("cls").agg(F.sum("n").alias("n"))
    found = components(links.select(F.col("cls").alias("a"), F.col("other").alias("b")))
    named = classes.join(codes.select("cls", F.lit(True).alias("coded")), "cls", "left").join(counted, "cls", "left").join(found, F.col("cls") == F.col("id"), "left")
    named = named.select(*name, "least", "members", "coded", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("component", "cls").alias("component"))
    named = stage(named, "named")
    first = named.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("k"))
    placed = stage(hot_join(named, first, ["component"], "k", n_classes).drop("k", "least", "component"), "placed")

    total = rows.count()
    linked = hot_join(rows.where(able).select("vec_id", *name), placed, name, "members", total)
    alone = F.col("coded").isNull()
    linked = linked.select(
        "vec_id",
        F.when(alone, F.lit(0).cast("long")).otherwise(F.col("n") + F.col("members") - 1).alias("n_links"),
        F.when(alone, F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
    rest = rows.where(~F.coalesce(able, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    for table in (codes, about, cells, survivors, links, named):
        unstage(table)
    return linked.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
