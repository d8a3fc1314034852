"""Running totals and row numbers that no single task has to compute for a whole key, or for a whole table.

A key of at most `most` rows is an ordinary window. Larger ones are cut by range into parts that are staged with their
number; a window runs inside each part, and the parts before it are summed up to one row for each key and part. Columns
_scan_… are its own, and no column of the rows or of the result may be called so.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.staging import stage

#: Rows of a key beyond which its scan is cut into parts.
MOST = 200_000


def _equal(a: str, b: str, names: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in names])


def parts_of(rows: DataFrame, by: Sequence[str], order: Sequence[str | Column], most: int) -> DataFrame:
    """rows, staged, with `_scan_part`: increasing along (by, order), some `most` rows each; equal rows share a part."""
    parts = max(1, -(-rows.count() // most))
    return stage(rows.repartitionByRange(parts, *by, *order).withColumn("_scan_part", F.spark_partition_id()), "parts")


def _carried(parted: DataFrame, by: Sequence[str], summed: Column, carry) -> DataFrame:
    """parted with `_scan_before`: what the earlier parts of the row's key come to. One row for each key and part is summed.

    Parts of a whole table (no key) are as many as tasks wrote them, so one task sums them.
    """
    tops = parted.groupBy(*by, "_scan_part").agg(summed.alias("_scan_sum"))
    earlier = Window.partitionBy(*by).orderBy("_scan_part").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.withColumn("_scan_before", carry(F.col("_scan_sum")).over(earlier)).drop("_scan_sum")
    own = [F.col(f"r.{c}") for c in parted.columns]
    return parted.alias("r").join(tops.alias("t"), _equal("r", "t", [*by, "_scan_part"])).select(*own, "t._scan_before")


def _split(rows: DataFrame, by: Sequence[str], most: int) -> tuple[DataFrame | None, DataFrame | None]:
    """(rows of keys with at most `most` rows, rows of larger keys); either may be None."""
    if not by:
        return None, rows
    large = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).drop("_n")
    if not large.limit(1).count():
        return rows, None
    large = stage(large, "large")
    return rows.alias("r").join(large.alias("t"), _equal("r", "t", by), "left_anti"), rows.alias("r").join(large.alias("t"), _equal("r", "t", by), "left_semi")


def running_total(rows: DataFrame, by: Sequence[str], order: Sequence[str | Column], value: Column, out: str, most: int = MOST) -> DataFrame:
    """rows with `out`: the sum of `value` over the rows of equal `by` up to the row's own. Rows that are equal in `order`
    are summed in any order, so the order should tell all rows apart."""
    rows = rows.withColumn("_scan_value", value)
    light, heavy = _split(rows, by, most)
    made = []
    if light is not None:
        over = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        made.append(light.withColumn(out, F.sum("_scan_value").over(over)).drop("_scan_value"))
    if heavy is not None:
        parted = _carried(parts_of(heavy, by, order, most), by, F.sum("_scan_value"), F.sum)
        over = Window.partitionBy(*by, "_scan_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        inside = F.sum("_scan_value").over(over)
        total = F.coalesce(F.col("_scan_before") + F.coalesce(inside, F.lit(0)), inside)
        made.append(parted.withColumn(out, total).drop("_scan_value", "_scan_part", "_scan_before"))
    return reduce(DataFrame.unionByName, made)


def numbered(rows: DataFrame, by: Sequence[str], order: Sequence[str | Column], out: str, most: int = MOST) -> DataFrame:
    """rows with `out`: 1, 2, 3 ... along `order` within equal `by`, as a long."""
    return running_total(rows, by, order, F.lit(1).cast("long"), out, most)


def filled_forward(rows: DataFrame, by: Sequence[str], order: Sequence[str | Column], value: Column, out: str, most: int = MOST, strictly: bool = False) -> DataFrame:
    """rows with `out`: the last non-null `value` at or before the row (strictly: before it) among equal `by`."""
    rows = rows.withColumn("_scan_value", value)
    light, heavy = _split(rows, by, most)
    last = -1 if strictly else 0
    made = []
    if light is not None:
        over = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, last)
        made.append(light.withColumn(out, F.last("_scan_value", ignorenulls=True).over(over)).drop("_scan_value"))
    if heavy is not None:
        parted = parts_of(heavy, by, order, most)
        # The last known value of a part, told by the place of its row in the part.
        over = Window.partitionBy(*by, "_scan_part").orderBy(*order)
        placed = parted.withColumn("_scan_place", F.row_number().over(over))
        parted = _carried(placed, by, F.max_by("_scan_value", F.when(F.col("_scan_value").isNotNull(), F.col("_scan_place"))), lambda c: F.last(c, ignorenulls=True))
        inside = F.last("_scan_value", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, last))
        made.append(parted.withColumn(out, F.coalesce(inside, F.col("_scan_before"))).drop("_scan_value", "_scan_part", "_scan_before", "_scan_place"))
    return reduce(DataFrame.unionByName, made)


def tasks_for(rows: DataFrame, most: int) -> int:
    """How many tasks get some `most` rows each, however large the table is. It counts the rows.

    A shuffle to at most spark.shuffle.sort.bypassMergeThreshold tasks streams its rows into a file for each; one to more tasks
    holds what a task reads in memory, gigabytes of narrow rows. So there are no more until each gets ten times `most` rows.
    """
    n, conf = rows.count(), rows.sparkSession.sparkContext.getConf()
    streamed = int(conf.get("spark.shuffle.sort.bypassMergeThreshold", "200"))
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-n // most), streamed), -(-n // (10 * most)))


def running_least(rows: DataFrame, by: Sequence[str], order: Sequence[str | Column], value: Column, out: str, most: int = MOST) -> DataFrame:
    """rows with `out`: the least non-null `value` over the rows of equal `by` up to the row's own. Rows that are equal in
    `order` come in any order. The rows are read more than once, so what is dear to compute should be staged."""
    tasks = tasks_for(rows, most)
    rows = rows.withColumn("_scan_value", value)
    light, heavy = _split(rows, by, most)
    made = []
    if light is not None:
        over = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        made.append(light.repartition(tasks, *by).withColumn(out, F.min("_scan_value").over(over)).drop("_scan_value"))
    if heavy is not None:
        parted = _carried(parts_of(heavy, by, order, most), by, F.min("_scan_value"), F.min)
        over = Window.partitionBy(*by, "_scan_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        least = F.array_min(F.array("_scan_before", F.min("_scan_value").over(over)))
        made.append(parted.withColumn(out, least).drop("_scan_value", "_scan_part", "_scan_before"))
    return reduce(DataFrame.unionByName, made)
