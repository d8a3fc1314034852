"""Evidence evaluation: freshness, latest per key, three-valued folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def freshness(age_seconds: Column, most: int) -> Column:
    """future, stale or fresh."""
    return F.when(age_seconds < 0, "future").when(age_seconds > most, "stale").otherwise("fresh")


def latest_per_key(rows: DataFrame, key: Sequence[str], time: str, ident: str, signature: Sequence[str]) -> DataFrame:
    """The newest row of each key; ties that disagree are inconsistent, otherwise the lowest id stands.

    The newest time is a pre-aggregated maximum joined back, so a hot key needs no window over all its rows.
    """
    unique = rows.dropDuplicates([ident])
    newest = unique.groupBy(*key).agg(F.max(time).alias("_newest"))
    ties = unique.join(newest, list(key)).where(F.col(time) == F.col("_newest"))
    signed = F.struct(*signature) if len(signature) > 1 else F.col(signature[0])
    same = ties.groupBy(*key).agg(
        F.min(ident).alias(ident),
        F.max(time).alias(time),
        # Null agrees with null only: distinct counts skip it, so it is counted on its own.
        (F.count_distinct(signed) + F.max(F.when(signed.isNull(), 1).otherwise(0))).alias("_signatures"),
    )
    return same.select(*key, ident, time, F.when(F.col("_signatures") > 1, "inconsistent").otherwise("ok").alias("state"))


def equality_check(expected: Column, got: Column) -> Column:
    """pass, fail, or unknown where nothing was observed."""
    return F.when(got.isNull(), "unknown").when(expected == got, "pass").otherwise("fail")


def fold(status: str, empty: str = "unknown") -> Column:
    """fail over unknown over pass; `empty` where there is no row."""
    rank = F.max(F.when(F.col(status) == "fail", 3).when(F.col(status) == "unknown", 2).when(F.col(status) == "pass", 1))
    return F.when(rank == 3, "fail").when(rank == 2, "unknown").when(rank == 1, "pass").otherwise(empty)


def severity_fold(column: str, order: Sequence[str], empty: str) -> Column:
    """The most severe value of a group; order lists values from most to least severe."""
    rank = F.lit(None).cast("int")
    for i, value in enumerate(order):
        rank = F.when(F.col(column) == value, len(order) - i).otherwise(rank)
    top = F.max(rank)
    out = F.lit(empty)
    for i, value in enumerate(order):
        out = F.when(top == len(order) - i, value).otherwise(out)
    return out


def required_observed(required: DataFrame, observed: DataFrame, on: Sequence[str], status: str) -> DataFrame:
    """required with the observed status, `not_run` where nothing was observed."""
    return required.join(observed, list(on), "left").withColumn(status, F.coalesce(status, F.lit("not_run")))


def status_merge(kinds: DataFrame, key: str, order: str, kind: str) -> DataFrame:
    """Successive change kinds (A, M, D) of one path merged: A then D vanishes, D then A is M, else the later.

    The list of one key is short by nature (its own changes), ordered before it is folded.
    """
    steps = F.transform(F.array_sort(F.collect_list(F.struct(order, kind))), lambda x: x[kind])

    def merge(old: Column, new: Column) -> Column:
        return (
            F.when(old == "", new)
            .when((old == "A") & (new == "D"), F.lit("-"))
            .when((old == "A") & (new == "M"), F.lit("A"))
            .when((old == "D") & (new == "A"), F.lit("M"))
            .when((old == "-") & (new == "D"), F.lit("-"))
            .otherwise(new)
        )

    return kinds.groupBy(key).agg(F.aggregate(steps, F.lit(""), merge).alias("merged")).where("merged <> '-'")


def attempt_numbers(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """rows with `number`: 1, 2, … per key in the given order."""
    return rows.withColumn("number", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def checked_sum(rows: DataFrame, by: Sequence[str], counter: str, most: int) -> DataFrame:
    """(by, total, overflow): sums of counters, and whether they exceed their bound (or a long)."""
    total = F.sum(F.col(counter).cast("decimal(38,0)"))
    return rows.groupBy(*by).agg(total.alias("_t")).select(*by, F.col("_t").try_cast("bigint").alias("total"), (F.col("_t") > most).alias("overflow"))
