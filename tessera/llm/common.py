"""What the corpus operators share: staging, Arrow text mapping, batch limits, components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import ship_package
from tessera.staging import stage, unstage

#: Rows and characters that one call of a text function gets at most (a single longer text stands alone).
CHUNK_ROWS, CHUNK_CHARS = 2000, 1_000_000


#: Allocator settings of the workers: free memory goes back to the system, so idle workers stay small.
WORKER_ENV = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_TRIM_THRESHOLD_": "1000000", "MALLOC_MMAP_THRESHOLD_": "4000000", "MALLOC_ARENA_MAX": "2"}


def prepare(spark: SparkSession) -> None:
    """Make workers able to import this package and keep their Arrow batches small."""
    ship_package(spark)
    for name, value in WORKER_ENV.items():
        spark.sparkContext.environment.setdefault(name, value)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def free_shuffles(spark: SparkSession) -> None:
    """Ask the driver to drop shuffle files of data frames that are no longer referenced."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Tables that a worker keeps from task to task, by name. A task that asks for another one drops these first.
_KEPT: dict[str, Any] = {}


def free_worker() -> None:
    """Drop what this worker keeps and give free memory back to the system."""
    _KEPT.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def drop_kept() -> None:
    """Free the worker if it keeps anything."""
    if _KEPT:
        free_worker()


def kept(name: str, make: Callable[[], Any]) -> Any:
    """What `make` gives, kept in this worker while its tasks ask for the same name."""
    if name not in _KEPT:
        free_worker()
        _KEPT[name] = make()
    return _KEPT[name]


def tidy(task: Callable[[Iterator], Iterator], keeps: bool = False) -> Callable[[Iterator], Iterator]:
    """The task, freeing the worker's memory when it ends, and first of all what earlier tasks kept there unless it
    keeps tables itself."""

    def run(batches: Iterator) -> Iterator:
        if not keeps:
            drop_kept()
        try:
            yield from task(batches)
        finally:
            if not keeps:
                free_worker()

    return run


def slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """The batch cut so that each piece has few rows and few bytes of text."""
    column = batch.column(batch.schema.get_field_index(text))
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and (held + size > CHUNK_CHARS or i - start >= CHUNK_ROWS):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if len(sizes) > start:
        yield batch.slice(start)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text, null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def arrow_map(
    df: DataFrame,
    function: Callable[[pa.RecordBatch], dict[str, pa.Array] | None],
    outputs: T.StructType,
    keep: Iterable[str] = (),
    text: str = "text",
    keeps: bool = False,
) -> DataFrame:
    """df with the columns `keep` passed through untouched and those of `function` added, row by row."""
    keep = list(keep)
    names = [f.name for f in outputs]
    schema = T.StructType([df.schema[c] for c in keep] + list(outputs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text):
                made = function(batch)
                arrays = [batch.column(batch.schema.get_field_index(c)) for c in keep]
                yield pa.RecordBatch.from_arrays(arrays + [made[n] for n in names], names=keep + names)

    return df.mapInArrow(tidy(run, keeps), schema)


def arrow_flat(
    df: DataFrame,
    function: Callable[[pa.RecordBatch], dict[str, pa.Array]],
    outputs: T.StructType,
    text: str = "text",
    keeps: bool = False,
) -> DataFrame:
    """Rows made freely from each slice of df."""
    names = [f.name for f in outputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text):
                made = function(batch)
                yield pa.RecordBatch.from_arrays([made[n] for n in names], names=names)

    return df.mapInArrow(tidy(run, keeps), outputs)


def without(df: DataFrame, names: Iterable[str]) -> list[str]:
    """Columns of df that an operator carries along: all but those it makes itself."""
    made = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in made]


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


#: A key with over one HEAVY-th of all rows is joined by broadcast; at most HEAVY keys can have so many.
HEAVY = 1000


def hot_join(rows: DataFrame, small: DataFrame, keys: list[str], count: str, total: int, parts: int | None = None) -> DataFrame:
    """rows joined (inner) with `small`, which has one row a key and the key's number of rows in `count`.

    total bounds the sum of the counts, so at most HEAVY keys hold more than a HEAVY-th of it each. These are
    broadcast, and their rows are joined where they lie; all others are dealt by key. Both sides are read more than
    once, so what is dear to compute should be staged. With `parts` the light rows are dealt to so many partitions.
    """
    heavy = small.where(F.col(count) > total // HEAVY)
    lightly = small.where(F.col(count) <= total // HEAVY)
    hot = rows.join(F.broadcast(heavy), keys)
    rest = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti")
    rest = (rest.repartition(parts, *keys) if parts else rest).join(lightly, keys)
    return rest.unionByName(hot)


def components(edges: DataFrame, max_rounds: int = 60, known: DataFrame | None = None) -> DataFrame:
    """(id, component) for every id in edges (a, b) and in known: component is the smallest id reachable.

    Alternating large-star and small-star steps, each a pre-aggregated minimum and one join in which the hubs are
    broadcast (`hot_join`). Every step is dealt by node to partitions of some 100,000 pairs and staged; the loop ends when
    a round changes nothing, by a count and two 64-bit sums over the pairs. The number of rounds grows with the logarithm
    of the longest chain. `known` (id, component) holds the components of edges found before.
    """

    def settled(rows: DataFrame, parts: int) -> DataFrame:
        return stage(rows.where("u <> v").repartition(parts, "u").distinct(), "cc")

    def signature(rows: DataFrame) -> tuple:
        return tuple(rows.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64(F.lit(1), "v", "u"))).first())

    first = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    if known is not None:
        first = first.union(known.where("id <> component").select(F.col("id").alias("u"), F.col("component").alias("v")))
    pairs = stage(first.distinct(), "cc")
    before = signature(pairs)
    for _ in range(max_rounds):
        size = before[0]
        if not size:
            break
        parts = min(20_000, 1 + size // 100_000)
        # Large star: neighbours above u point at u's smallest neighbour or u itself.
        above = pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))
        both = pairs.select("u", "v").union(above).repartition(parts, "u")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = settled(hot_join(above, low, ["u"], "n", 2 * size, parts).select(F.col("v").alias("u"), F.col("m").alias("v")), parts)
        # Small star: u and its smaller neighbours point at the smallest of them. Each pair gave the large star one row at
        # most, so `size` bounds them.
        low = large.repartition(parts, "u").groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        near = hot_join(large, low, ["u"], "n", size, parts)
        new = settled(near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.select("u", F.col("m").alias("v"))), parts)
        after = signature(new)
        for table in (pairs, large):
            unstage(table)
        pairs, changed, before = new, after != before, after
        if not changed:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = pairs.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
