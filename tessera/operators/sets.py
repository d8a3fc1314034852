"""Set comparison, consensus, medians and merged evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def membership_equal(left: DataFrame, right: DataFrame, key: str, member: str) -> DataFrame:
    """(key, equal): whether both sides hold the same members for each key, by one full outer join."""
    a = left.select(key, member).distinct().withColumn("_a", F.lit(True))
    b = right.select(key, member).distinct().withColumn("_b", F.lit(True))
    both = a.join(b, [key, member], "full_outer")
    return both.groupBy(key).agg(F.bool_and(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("equal"))


def union_distinct(parts: Sequence[DataFrame], key: str, order: Sequence[str]) -> DataFrame:
    """Concatenation in which the first part that holds a key wins."""
    whole = None
    for i, part in enumerate(parts):
        tagged = part.withColumn("_part", F.lit(i))
        whole = tagged if whole is None else whole.unionByName(tagged)
    best = whole.groupBy(key).agg(F.min(F.struct("_part", *order, *[c for c in whole.columns if c not in (key, "_part", *order)])).alias("b"))
    return best.select(key, "b.*").drop("_part").select(*parts[0].columns)


def fallback(primary: DataFrame, generic: DataFrame, key: Sequence[str]) -> DataFrame:
    """primary, and generic rows only for keys that primary does not cover."""
    return primary.unionByName(generic.join(primary.select(*key).distinct(), list(key), "left_anti"))


def required_change(before: DataFrame, after: DataFrame, key: str, member: str) -> DataFrame:
    """(key, member, change): members only one side requires."""
    gone = before.select(key, member).distinct().exceptAll(after.select(key, member).distinct()).withColumn("change", F.lit("removed"))
    new = after.select(key, member).distinct().exceptAll(before.select(key, member).distinct()).withColumn("change", F.lit("added"))
    return gone.unionByName(new)


def accepts(before: Column, after: Column) -> Column:
    """Whether every type that `before` lists is accepted by `after`; integer is a number."""
    return F.forall(before, lambda t: F.exists(after, lambda u: (t == u) | ((t == "integer") & (u == "number"))))


def median_floor(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """The element at position floor(n / 2) of each group's sorted values (not an average for even n).

    Positions come from counts of distinct values, so a hot group travels as one row per distinct value.
    """
    from pyspark.sql import Window

    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumns({"_upto": F.sum("_n").over(upto), "_all": F.sum("_n").over(Window.partitionBy(*by))})
    return ranked.where((F.col("_upto") > F.floor(F.col("_all") / 2)) & (F.col("_upto") - F.col("_n") <= F.floor(F.col("_all") / 2))).select(*by, F.col(value).alias("median"))


def consensus(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, choice, conflict): the value all rows agree on, or a conflict."""
    out = rows.groupBy(*by).agg(F.min(value).alias("_low"), F.count_distinct(value).alias("_n"))
    return out.select(*by, F.when(F.col("_n") == 1, F.col("_low")).alias("choice"), (F.col("_n") > 1).alias("conflict"))


def merged_evidence(rows: DataFrame, identity: Sequence[str], evidence: str, most: int = 32) -> DataFrame:
    """One row per identity with its distinct evidence, sorted and cut to `most` (the cut is the feature)."""
    return rows.groupBy(*identity).agg(F.slice(F.array_sort(F.collect_set(evidence)), 1, most).alias("evidence"), F.count_distinct(evidence).alias("n_evidence"))


def bound_change(before: DataFrame, after: DataFrame, key: Sequence[str], upper: Sequence[str]) -> DataFrame:
    """(key…, keyword, change) for bounds: tightened, loosened, or same; `upper` lists the keywords of maxima."""
    a = before.select(*key, "keyword", F.col("value").alias("_a"))
    b = after.select(*key, "keyword", F.col("value").alias("_b"))
    joined = a.join(b, [*key, "keyword"], "full_outer")
    up = F.col("keyword").isin(*upper)
    change = (
        F.when(F.col("_a").eqNullSafe(F.col("_b")), "same").when(F.col("_a").isNull(), "tightened").when(F.col("_b").isNull(), "loosened")
        .when(up == (F.col("_b") < F.col("_a")), "tightened").otherwise("loosened")
    )
    return joined.select(*key, "keyword", change.alias("change"))
