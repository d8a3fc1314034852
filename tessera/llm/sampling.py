"""Bounded, repeatable training samples and the fold rule of the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(column: str, parts: int) -> Column:
    """crc32 of the id written as text, modulo parts (null ids: null)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts


def bounded_sample(rows: DataFrame, key: str, stratum: str, per_stratum: int, seed: int = 17) -> list[tuple]:
    """(key, stratum) of at most per_stratum keys of every stratum, on the driver; a key counts once in a stratum.

    Keys are taken in the order of a hash, so the sample depends on the ids alone. A first count turns the bound into a
    hash threshold for each stratum, with so much room that none comes out empty, and only rows under it travel.
    """
    rows = rows.where(F.col(key).isNotNull() & F.col(stratum).isNotNull()).select(key, stratum).distinct()
    counts = rows.groupBy(stratum).count().select(stratum, F.least(F.lit(1.0), max(1.3 * per_stratum, per_stratum + 20.0) / F.col("count")).alias("_most"))
    place = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 30)) / float(1 << 30)
    found = rows.withColumn("_place", place).join(counts, stratum).where("_place < _most").select(key, stratum, "_place").collect()
    by: dict = {}
    for row in sorted(found, key=lambda r: (r[2], r[0])):
        by.setdefault(row[1], []).append((row[0], row[1]))
    return [x for name in sorted(by, key=str) for x in by[name][:per_stratum]]


def sampled_rows(docs: DataFrame, sample: list[tuple], key: str = "doc_id") -> DataFrame:
    """(key, _stratum, text) of the sampled ids, one row an id: that of the least text. The id list is bounded, so it
    is broadcast."""
    field = docs.schema[key].dataType.simpleString()
    stratum = "bigint" if isinstance(sample[0][1], int) else "string"
    first = {x[0]: x for x in reversed(sample)}  # an id of several strata counts in its first one
    ids = docs.sparkSession.createDataFrame(list(first.values()), f"`{key}` {field}, _stratum {stratum}")
    got = docs.select(key, "text").join(F.broadcast(ids), key)
    return got.groupBy(key, "_stratum").agg(F.min("text").alias("text"))
