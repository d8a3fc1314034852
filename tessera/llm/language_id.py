"""Language identification by string kernels.

A text is the set of its character n-grams (lengths 1 to 3, lower case), hashed to a fixed number of bits: the
blended-spectrum presence kernel counts common n-grams and is normalised by the set sizes. A text of more than `WINDOW`
characters is the mean of the vectors of its windows, since the bits of a very long text would nearly all be set; all of
it is read. Landmarks of each language give a Nystroem map of the kernel, a one-versus-rest ridge regression is fitted
on it in closed form, and texts are scored batch by batch as matrix products.

Bounds: every language of the training rows is learned, from at most `per_lang` texts (one row of a doc_id: the least
text) and from fewer where languages are so many that they would make over `most_rows`. The `landmarks` columns are
shared: landmarks // languages of each language, or one of each of so many languages that a hash chooses. Texts stay in
the tasks, which add up the normal equations; the driver gets a vector of 2^BITS numbers for each landmark, landmarks + 1
sums for each language, and a matrix of (landmarks + 1)^2 for each task. Defined results: a null text or one
without a letter is `und` with score 0; without training rows every text is `und`; rows that repeat a doc_id are scored
one by one; ties go to the first language by name; operator columns replace input columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, prepare, stage, tidy, unstage, without
from .sampling import bounded_sample, fold, sampled_rows

#: Hashed n-gram space, texts of one matrix product, and characters of a window.
BITS, BATCH, WINDOW = 15, 64, 1 << 14


def presence(text: str, row: np.ndarray) -> None:
    """Set row at the hashed n-grams of a lower-case text."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    shift = np.uint32(32 - BITS)
    for n in (1, 2, 3):
        if len(code) < n:
            break
        h = code[: len(code) - n + 1] * np.uint32(0x9E3779B1)
        for k in range(1, n):
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77) + code[k : len(code) - n + 1 + k] * np.uint32(0xC2B2AE3D)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0x27D4EB2F + 2 * n)
        row[h >> shift] = 1


def windows(text: str) -> list[str]:
    """The text in lower case, cut so that no n-gram is lost."""
    low = text.lower()
    return [low[a : a + WINDOW + 2] for a in range(0, max(1, len(low) - 2), WINDOW)]


def blocks(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text of each row, its part of the text, normalised presence rows) in blocks of at most BATCH rows.

    Texts without a letter have no row. The rows of a block are valid until the next one.
    """
    rows = np.zeros((BATCH, 1 << BITS), np.float32)
    held: list[tuple[int, float]] = []

    def block() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        part = rows[: len(held)]
        part /= np.sqrt(np.maximum(part.sum(axis=1, keepdims=True, dtype=np.float64), 1)).astype(np.float32)
        return np.array([h[0] for h in held]), np.array([h[1] for h in held]), part

    for i, text in enumerate(texts):
        if not text or not any(map(str.isalpha, text)):
            continue
        parts = windows(text)
        for part in parts:
            presence(part, rows[len(held)])
            held.append((i, 1 / len(parts)))
            if len(held) == BATCH:
                yield block()
                rows[:] = 0
                held.clear()
    if held:
        yield block()


def vectors(texts: list[str | None]) -> np.ndarray:
    """The kernel's vector of each text."""
    out = np.zeros((len(texts), 1 << BITS), np.float32)
    for at, share, rows in blocks(texts):
        for i, s, row in zip(at, share, rows):
            out[i] += np.float32(s) * row
    return out


def kernel(texts: list[str | None], landmarks: np.ndarray) -> np.ndarray:
    """Kernel of each text with each landmark (a column)."""
    out = np.zeros((len(texts), landmarks.shape[1]))
    for at, share, rows in blocks(texts):
        np.add.at(out, at, share[:, None] * (rows @ landmarks))
    return out


def ridge(gram: np.ndarray, sums: dict[str, tuple[int, np.ndarray]], land: np.ndarray, penalty: float = 1e-3) -> dict:
    """The model from the landmarks' vectors (columns) and the sums of the training rows' kernel values with them, a one
    appended: of each language (rows, sum of values), and `gram`, the sum of outer products over rows, each divided by
    the rows of its language. Languages weigh alike."""
    names = sorted(sums)
    value, vector = np.linalg.eigh((land.T @ land).astype(np.float64))
    inverse_root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-6))) @ vector.T
    size = land.shape[1] + 1
    base = np.eye(size)
    base[:-1, :-1] = inverse_root
    total = sum(n for n, _ in sums.values())
    means = np.array([s / n for n, s in (sums[x] for x in names)]) @ base
    left = base.T @ gram @ base * (total / len(names)) + penalty * total * np.eye(size)
    # Targets are 1 for a row's own language and -1 for the others.
    right = (2 * means - means.sum(axis=0)).T * (total / len(names))
    w = np.linalg.solve(left, right)
    return {"names": names, "land": land, "map": inverse_root @ w[:-1], "bias": w[-1]}


def normal_sums(rows: DataFrame) -> tuple[np.ndarray | None, dict[str, tuple[int, np.ndarray]]]:
    """(gram, sums) of `ridge` from rows (lang, k). Tasks add up whole languages; a row for each language and one matrix
    for each task reach the driver."""
    parts = max(1, min(64, rows.count() // 5_000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            values = batch.column(1).values.to_numpy().reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 0))
            for lang, row in zip(batch.column(0).to_pylist(), values, strict=True):
                held.setdefault(lang, []).append(row)
        if not held:
            return
        names, counts, sums, gram = [], [], [], 0
        for lang in sorted(held):
            k = np.stack(sorted(held[lang], key=lambda r: r.tobytes()))
            k = np.concatenate([k, np.ones((len(k), 1))], axis=1)
            gram = gram + k.T @ k / len(k)
            names.append(lang), counts.append(len(k)), sums.append(k.sum(axis=0))
        names.append(None), counts.append(0), sums.append(np.asarray(gram).ravel())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64()), pa.array(sums, pa.list_(pa.float64()))], names=["lang", "n", "s"])

    found = rows.select("lang", "k").repartition(parts, "lang").mapInArrow(tidy(run), "lang string, n long, s array<double>").collect()
    grams = [np.array(r.s) for r in found if r.lang is None]
    if not grams:
        return None, {}
    size = int(round(len(grams[0]) ** 0.5))
    return sum(grams).reshape(size, size), {r.lang: (r.n, np.array(r.s)) for r in found if r.lang is not None}


def with_kernel(spark: SparkSession, rows: DataFrame, land: np.ndarray) -> DataFrame:
    """rows with k, their kernel values with the landmarks."""
    shared = spark.sparkContext.broadcast(land)  # 2^BITS numbers a landmark

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        return {"k": pa.array(list(kernel(batch.column(batch.schema.get_field_index("text")).to_pylist(), shared.value)), pa.list_(pa.float64()))}

    return arrow_map(rows, run, T.StructType([T.StructField("k", T.ArrayType(T.DoubleType()))]), keep=[c for c in rows.columns if c != "text"])


def fit(docs: DataFrame, per_lang: int = 500, landmarks: int = 96, parts: int = 3, held: int = 1, most_rows: int = 200_000) -> dict | None:
    """Learn from at most per_lang texts of each language outside the held-out fold, and from fewer of each (one at least)
    where so many languages would make more than most_rows. Languages share `landmarks` columns, however many there are:
    where there are more languages than columns, a hash of the name chooses those that give one."""
    spark = docs.sparkSession
    use = docs.select("doc_id", "lang").where(F.col("lang").isNotNull() & (fold("doc_id", parts) != held))
    quota = max(1, min(per_lang, most_rows // max(1, use.select("lang").distinct().count())))
    sample = bounded_sample(use, "doc_id", "lang", quota)
    if not sample:
        return None
    rows = sampled_rows(docs.where(F.col("text").rlike(r"\p{L}")), sample).withColumnRenamed("_stratum", "lang")
    rows = stage(rows, "language-rows")

    def vector(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        return {"v": pa.array([v.tobytes() for v in vectors(batch.column(1).to_pylist())], pa.binary())}

    langs = max(1, len({lang for _, lang in sample}))
    # The landmarks of a language are the first of its texts, in the order of the sample.
    order = {key: i for i, (key, _) in reversed(list(enumerate(sample)))}
    by: dict = {}
    for r in sorted(rows.select("doc_id", "lang").collect(), key=lambda r: order[r[0]]):
        by.setdefault(r[1], []).append(r[0])
    giving = sorted(by) if len(by) <= landmarks else sorted(by, key=lambda n: (xxhash.xxh3_64_intdigest(n), n))[:landmarks]
    marks = [x for n in giving for x in by[n][: max(1, landmarks // langs)]]
    if not marks:
        return None
    chosen = rows.where(F.col("doc_id").isin(marks)).select("doc_id", "text")
    found = arrow_map(chosen, vector, T.StructType([T.StructField("v", T.BinaryType())]), keep=["doc_id"]).collect()
    land = np.stack([np.frombuffer(r[1], np.float32) for r in sorted(found)]).T.copy()
    land /= np.maximum(np.sqrt((land * land).sum(axis=0)), 1e-9)
    seen = stage(with_kernel(spark, rows.select("lang", "text"), land).where(F.exists("k", lambda x: x != 0)), "language-kernel")
    gram, sums = normal_sums(seen)
    unstage(rows), unstage(seen)
    return ridge(gram, sums, land) if sums else None


def predict(docs: DataFrame, model: dict | None) -> DataFrame:
    """docs with lang_pred and score."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        m = shared.value
        texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
        names, scores = ["und"] * len(texts), np.zeros(len(texts))
        # Few rows at a time where there are many languages.
        step = max(1, 4_000_000 // len(m["names"])) if m else 1
        for first in range(0, len(texts) if m else 0, step):
            margin = kernel(texts[first : first + step], m["land"]) @ m["map"] + m["bias"]
            p = np.exp(4 * (margin - margin.max(axis=1, keepdims=True)))
            p /= p.sum(axis=1, keepdims=True)
            for r, text in enumerate(texts[first : first + step]):
                if text and any(map(str.isalpha, text)):
                    best = int(p[r].argmax())
                    names[first + r], scores[first + r] = m["names"][best], p[r, best]
        return {"lang_pred": pa.array(names, pa.string()), "score": pa.array(scores)}

    outputs = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return arrow_map(docs, run, outputs, keep=without(docs, ["lang_pred", "score"]))


def identify(docs: DataFrame, per_lang: int = 500, landmarks: int = 96) -> DataFrame:
    """docs with held_out, lang_pred and score."""
    prepare(docs.sparkSession)
    out = predict(docs.select(*without(docs, ["held_out"])), fit(docs, per_lang, landmarks))
    return out.withColumn("held_out", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)))
