"""Ordered scans: fills, as-of matches, override chains, running budgets, segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.staging import stage

from . import scans

UP_TO = (Window.unboundedPreceding, 0)
BEFORE = (Window.unboundedPreceding, -1)


def forward_fill(rows: DataFrame, by: Sequence[str], order: Sequence[str], column: str, out: str) -> DataFrame:
    """The last non-null value at or before each row; a key that holds most rows is scanned in parts."""
    return scans.filled_forward(rows, by, order, F.col(column), out)


def last_before(rows: DataFrame, by: Sequence[str], order: Sequence[str], value: Column, out: str) -> DataFrame:
    """The last non-null value strictly before each row."""
    return scans.filled_forward(rows, by, order, value, out, strictly=True)


def next_boundary(rows: DataFrame, by: Sequence[str], order: Sequence[str], column: str, out: str, default) -> DataFrame:
    """The column's value at the next row, `default` at the last."""
    return rows.withColumn(out, F.lead(column, 1, default).over(Window.partitionBy(*by).orderBy(*order)))


def between_boundaries(rows: DataFrame, by: Sequence[str], order: Sequence[str], opens: Column, value: Column, out: str) -> DataFrame:
    """For each opening row the first value in the rows up to the next opening, else the last value before it.

    Openings are numbered and values carried by scans in parts; a segment's first value is an aggregate.
    """
    starts = F.coalesce(opens, F.lit(False))
    marked = rows.withColumns({"_opens": starts, "_own": value})
    marked = scans.running_total(marked, by, order, F.when(F.col("_opens"), 1).otherwise(0), "_segment")
    marked = scans.filled_forward(marked, by, order, F.col("_own"), "_earlier", strictly=True)
    first = marked.where(~F.col("_opens") & F.col("_own").isNotNull()).groupBy(*by, "_segment").agg(F.min_by("_own", F.struct(*order)).alias("_later"))
    own = [F.col(f"r.{c}") for c in rows.columns]
    same = F.col("r._segment") == F.col("t._segment")
    for c in by:
        same = same & F.col(f"r.{c}").eqNullSafe(F.col(f"t.{c}"))
    joined = marked.where("_opens").alias("r").join(first.alias("t"), same, "left")
    return joined.select(*own, F.coalesce("t._later", "r._earlier").alias(out))


def nth_occurrence(rows: DataFrame, name: str, order: Sequence[str], n: int) -> DataFrame:
    """The nth row of each name."""
    place = F.row_number().over(Window.partitionBy(name).orderBy(*order))
    return rows.withColumn("_n", place).where(F.col("_n") == n).drop("_n")


def write_effects(events: DataFrame, by: Sequence[str], order: Sequence[str], kind: str) -> DataFrame:
    """events (kind: write or read) with `effect`: produces, overrides, consumes or unresolved, and the earlier
    write's order value `previous`."""
    over = Window.partitionBy(*by).orderBy(*order).rowsBetween(*BEFORE)
    previous = F.last(F.when(F.col(kind) == "write", F.col(order[-1])), ignorenulls=True).over(over)
    out = events.withColumn("previous", previous)
    had = F.col("previous").isNotNull()
    effect = F.when(F.col(kind) == "write", F.when(had, "overrides").otherwise("produces")).otherwise(F.when(had, "consumes").otherwise("unresolved"))
    return out.withColumn("effect", effect)


def running_cut(rows: DataFrame, by: Sequence[str], order: Sequence[str], size: str, budget: int) -> DataFrame:
    """Rows of each group, or of the whole table, up to a running size budget."""
    return scans.running_total(rows, by, order, F.col(size), "running").where(F.col("running") <= budget)


def first_wins(rows: DataFrame, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key: the first in the given order."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("_n", place).where("_n = 1").drop("_n")


def shadowed(candidates: DataFrame, group: Sequence[str], order: Sequence[str], empty: Column) -> DataFrame:
    """candidates with `state`: selected (first non-empty of its group), shadowed or empty."""
    place = F.row_number().over(Window.partitionBy(*group, F.when(empty, 1).otherwise(0)).orderBy(*order))
    return candidates.withColumn("state", F.when(empty, "empty").when(place == 1, "selected").otherwise("shadowed"))


def dense_tokens(tokens: DataFrame, column: str, prefix: str, width: int = 6) -> DataFrame:
    """Distinct tokens with dense ids in token order.

    Tokens are numbered inside range partitions and moved by the counts of the partitions before, so no task sorts all.
    """
    spark = tokens.sparkSession
    parts = tokens.select(column).distinct().repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), column)
    parts = stage(parts.withColumn("_p", F.spark_partition_id()), "tokens")
    total, offsets = 0, [(-1, 0)]
    for p, n in sorted((r[0], r[1]) for r in parts.groupBy("_p").count().collect()):
        offsets.append((p, total))
        total += n
    first = spark.createDataFrame(offsets, "_p int, _o long")  # one row a partition
    place = F.row_number().over(Window.partitionBy("_p").orderBy(column)) + F.col("_o")
    return parts.join(F.broadcast(first), "_p").select(column, F.concat(F.lit(prefix), F.lpad(place.cast("string"), width, "0")).alias("token_id"))


def top_per_group(rows: DataFrame, by: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("_n", place).where(F.col("_n") <= n).drop("_n")


def strongest(rows: DataFrame, by: Sequence[str], strength: str, order: str, weak: int) -> DataFrame:
    """All equally strongest rows of a group, or just the first if even the strongest is weak."""
    best = rows.groupBy(*by).agg(F.max(strength).alias("_best"), F.min_by(order, F.struct(-F.col(strength), F.col(order))).alias("_first"))
    joined = rows.join(best, list(by)).where(F.col(strength) == F.col("_best"))
    return joined.where((F.col("_best") > weak) | (F.col(order) == F.col("_first"))).drop("_best", "_first")
