"""Line dedup over levelled sorted runs of line hashes.

A key index is a log-structured store: each batch of documents becomes one sorted run of (key, documents,
owner); once a level holds `fanout` runs they are merged into one run of the next level. A new batch
merge-anti-joins the runs to learn which of its keys are new, and then adds its own run. Batches come in
descending doc_id, so the batch in which a key is new holds the key's largest doc_id: its owner.

Defined results: a null or empty text is one empty line; a null doc_id is smaller than any other; rows that
repeat a doc_id are separate holders of their lines, and the owner rule spares each of them; keys shorter than
`min_chars` code points never count; operator columns replace input columns of the same name; an empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_flat, arrow_map, hot_join, prepare, same, stage, text_bytes, unstage, without

KEY = ["h1", "h2"]


def line_keys(text: bytes, min_chars: int) -> list[bytes | None]:
    """The 128-bit key hash of each line, None for a line whose key is too short."""
    out: list[bytes | None] = []
    for line in text.split(b"\n"):
        key = line.strip().lower()
        if len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars):
            out.append(xxhash.xxh3_128_digest(key))
        else:
            out.append(None)
    return out


def document_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, doc_id): one row for each document and distinct line key."""

    def keys(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        ids, found, rows = batch.column(0), [], []
        for i, text in enumerate(text_bytes(batch.column(1))):
            own = set(line_keys(text, min_chars))
            own.discard(None)
            found.extend(own)
            rows.extend([i] * len(own))
        pair = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
        return {"h1": pa.array(pair[:, 0]), "h2": pa.array(pair[:, 1]), "doc_id": ids.take(pa.array(rows, pa.int64()))}

    outputs = T.StructType([T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), docs.schema["doc_id"]])
    return arrow_flat(docs.select("doc_id", "text"), keys, outputs)


class LineRuns:
    """Levelled sorted runs of (h1, h2, n_docs, owner), kept as staged tables."""

    def __init__(self, spark: SparkSession, fanout: int = 4):
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[DataFrame]] = []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def fresh(self, keys: DataFrame) -> DataFrame:
        """Rows of keys that no run holds."""
        for run in self.runs():
            keys = keys.join(run.select(*KEY), KEY, "left_anti")
        return keys

    def add(self, batch: DataFrame) -> None:
        """Add a batch (h1, h2, doc_id) as one sorted run; owner is set only where the key is new."""
        own = batch.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("top"))
        if self.runs():
            new = self.fresh(own.select(*KEY)).withColumn("new", F.lit(True))
            own = own.join(new, KEY, "left")
        else:
            own = own.withColumn("new", F.lit(True))
        run = own.select(*KEY, "n_docs", F.when(F.col("new"), F.col("top")).alias("owner"))
        self._put(0, stage(run.sortWithinPartitions(*KEY), "run"))

    def _put(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self._put(level + 1, stage(merge_runs(old).sortWithinPartitions(*KEY), "run"))
            for table in old:
                unstage(table)

    def index(self) -> DataFrame:
        """All runs merged: (h1, h2, n_docs, owner)."""
        return merge_runs(self.runs())


def merge_runs(runs: list[DataFrame]) -> DataFrame:
    merged = runs[0]
    for run in runs[1:]:
        merged = merged.unionByName(run)
    if len(runs) == 1:
        return merged
    return merged.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("owner").alias("owner"))


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4, fanout: int = 3) -> DataFrame:
    """docs with the repeated lines gone from text, and n_lines, n_dropped.

    A key of at least min_chars code points held by at least min_docs documents keeps its lines only in the
    largest doc_id that holds it.
    """
    spark = docs.sparkSession
    prepare(spark)
    cuts = docs.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    number = F.lit(0)
    for cut in cuts:
        number = number + F.when(F.col("doc_id") < F.lit(int(cut)), 1).when(F.col("doc_id").isNull(), 1).otherwise(0)
    lines = stage(document_keys(docs, min_chars).withColumn("batch", number), "lines", ["batch"])
    store = LineRuns(spark, fanout)
    for k in range(len(cuts) + 1):
        store.add(lines.where(F.col("batch") == k).drop("batch"))
    repeated = stage(store.index().where(F.col("n_docs") >= min_docs).select(*KEY, "n_docs", "owner"), "repeated")
    for run in store.runs():
        unstage(run)
    gone = (
        hot_join(lines.select(*KEY, "doc_id"), repeated, KEY, "n_docs", lines.count())
        .where(~same(F.col("doc_id"), F.col("owner")))
        .groupBy("doc_id")
        .agg(F.collect_set(F.struct(*KEY)).alias("gone"))
        .select(F.col("doc_id").alias("_gone_id"), F.col("gone.h1").alias("_gone1"), F.col("gone.h2").alias("_gone2"))
    )
    made = ["text", "n_lines", "n_dropped"]
    carried = without(docs, [*made, "_gone_id", "_gone1", "_gone2"])
    joined = docs.select(*carried, "text").join(gone, same(F.col("doc_id"), F.col("_gone_id")), "left")

    def cut_lines(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        names = batch.schema
        first = batch.column(names.get_field_index("_gone1")).to_pylist()
        second = batch.column(names.get_field_index("_gone2")).to_pylist()
        texts, n_lines, n_dropped = [], [], []
        source = batch.column(names.get_field_index("text"))
        for text, one, two in zip(text_bytes(source), first, second):
            if not one:
                texts.append(text)
                n_lines.append(text.count(b"\n") + 1)
                n_dropped.append(0)
                continue
            drop = {d.tobytes() for d in np.array([one, two], np.int64).T}
            parts = text.split(b"\n")
            kept = [p for p, key in zip(parts, line_keys(text, min_chars)) if key not in drop]
            texts.append(b"\n".join(kept))
            n_lines.append(len(parts))
            n_dropped.append(len(parts) - len(kept))
        return {"text": pa.array(texts, pa.binary()).cast(pa.string()), "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64())}

    outputs = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    return arrow_map(joined, cut_lines, outputs, keep=carried)
