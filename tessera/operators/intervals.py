"""Containment and overlap of ranges: no join compares all with all, and no task many more pairs or rows than others."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.staging import stage

from . import scans


def cells(start: Column, end: Column, width: int) -> Column:
    """Numbers of the grid cells that a closed range touches."""
    return F.sequence(F.floor(start / width), F.floor(end / width))


#: Pairs of rows that one task compares at most, and rows of a range scan that one task sorts.
MOST_PAIRS, MOST_ROWS = 20_000_000, 500_000


def overlap_pairs(left: DataFrame, right: DataFrame, on: Sequence[str], width: int, most: int = MOST_PAIRS) -> DataFrame:
    """Pairs of rows (columns l_…, r_…) whose closed ranges [start, end] overlap within equal keys.

    Both sides are exploded into grid cells of `width`; a pair is kept only in the first cell that both touch. A cell in
    which over `most` pairs meet is dealt in pieces of its left rows, and cells are dealt to as many tasks as their pairs
    need, so no task compares many more than `most`.
    """
    a = left.select(*[F.col(c).alias(f"l_{c}") for c in left.columns]).withColumn("_cell", F.explode(cells(F.col("l_start"), F.col("l_end"), width)))
    b = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns]).withColumn("_cell", F.explode(cells(F.col("r_start"), F.col("r_end"), width)))
    keys = [f"_k{i}" for i in range(len(on))] + ["_cell"]
    a, b = (x.withColumns({f"_k{i}": F.col(f"{side}_{c}") for i, c in enumerate(on)}) for x, side in ((a, "l"), (b, "r")))
    sizes = a.groupBy(*keys).agg(F.count(F.lit(1)).alias("_l")).join(b.groupBy(*keys).agg(F.count(F.lit(1)).alias("_r")), keys)
    sizes = stage(sizes.select(*keys, F.ceil(F.col("_l") * F.col("_r") / most).cast("int").alias("_pieces"), (F.col("_l") * F.col("_r")).alias("_met")), "cells")
    met = sizes.agg(F.sum("_met")).first()[0] or 0
    tasks = int(min(20_000, max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * met // most)))
    cut = sizes.where("_pieces > 1").select(*keys, "_pieces")
    pieces = F.coalesce("_pieces", F.lit(1))
    a = a.join(cut, keys, "left").withColumn("_piece", F.pmod(F.xxhash64(*[f"l_{c}" for c in left.columns]), pieces).cast("int")).drop("_pieces")
    b = b.join(cut, keys, "left").withColumn("_piece", F.explode(F.sequence(F.lit(0), pieces - 1))).drop("_pieces")
    keys = [*keys, "_piece"]
    joined = a.repartition(tasks, *keys).join(b.repartition(tasks, *keys), keys)
    meets = (F.col("l_start") <= F.col("r_end")) & (F.col("r_start") <= F.col("l_end"))
    first = F.col("_cell") == F.floor(F.greatest("l_start", "r_start") / width)
    return joined.where(meets & first).drop(*keys)


def least_container(points: DataFrame, ranges: DataFrame, on: Sequence[str], ident: str, point: str, strict: bool) -> DataFrame:
    """(point, container) of the points (start, end) that some range contains: the id of the smallest one, ties by start,
    then id; strict: of those that are not the point's own range. Starts and ends are whole numbers.

    Starts are halved into blocks, level by level. A range that spans the middle of a block is filed under it; a point
    looks into the blocks in whose right half it starts, where every range filed starts before it. So only ends are left to
    be compared, and the least range among those that end late enough is a running minimum (`scans.running_least`): each
    row is filed some log2 of the width times, and no point meets range by range. Ranges of the point's own start stand apart.
    """
    known = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in (*on, "start", "end")])
    whole = ranges.where(known & (F.col("start") <= F.col("end"))).groupBy(*on, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).agg(F.min(ident).alias("id"))
    asked = points.where(known).select(*on, F.least("start", "end").cast("long").alias("start"), F.greatest("start", "end").cast("long").alias("end"), point)
    whole = stage(whole, "ranges")
    # Places count from the first start, before which nothing is contained, so wide numbers make no more levels than need be.
    low, high = whole.agg(F.coalesce(F.min("start"), F.lit(0)), F.coalesce(F.max("end"), F.lit(0))).first()
    asked = asked.where(F.col("start") >= low)
    place, levels = F.col("start") - low, F.sequence(F.lit(0), F.lit(max(1, (high - low).bit_length()) - 1))
    shifted = lambda by: F.call_function("shiftright", place, by)
    odd = lambda level: shifted(level) % 2 == 1
    middle = lambda level: F.call_function("shiftleft", shifted(level) + 1, level)
    spans = F.filter(levels, lambda v: ~odd(v) & (F.col("end") - low >= middle(v)))
    looks = F.filter(levels, odd)
    block = F.when(F.col("_level") < 0, place).otherwise(F.call_function("shiftright", place, F.col("_level") + 1))
    blank = lambda table, column: F.lit(None).cast(table.schema[column].dataType)
    filed = whole.select(*on, "start", "end", "id", blank(points, point).alias("_point"), F.lit(False).alias("_asks"), F.explode(F.concat(F.array(F.lit(-1)), spans)).alias("_level"))
    asking = asked.select(*on, "start", "end", blank(ranges, ident).alias("id"), F.col(point).alias("_point"), F.lit(True).alias("_asks"), F.explode(F.concat(F.array(F.lit(-1)), looks)).alias("_level"))
    # The ranges of one end come before the points of that end, but after them where a point's own range is among them.
    turn = F.col("_asks") != (F.lit(strict) & (F.col("_level") < 0))
    size = F.when(~F.col("_asks"), F.struct((F.col("end") - F.col("start")).alias("size"), "start", "id"))
    filed = stage(filed.unionByName(asking).select(*on, "_level", block.alias("_block"), (-F.col("end")).alias("_end"), turn.alias("_turn"), "_asks", "_point", size.alias("_range")), "filed")
    best = scans.running_least(filed, [*on, "_level", "_block"], ["_end", "_turn"], F.col("_range"), "_best", MOST_ROWS)
    best = best.where(F.col("_asks") & F.col("_best").isNotNull()).select("_point", "_best").repartition(scans.tasks_for(filed, MOST_ROWS), "_point")
    return best.groupBy(F.col("_point").alias(point)).agg(F.min("_best").alias("_best")).select(point, F.col("_best.id").alias("container"))


def smallest_container(points: DataFrame, ranges: DataFrame, on: Sequence[str], width: int, ident: str) -> DataFrame:
    """points (start, end) with `container`: the id of the smallest range that contains each (null: none).

    Ties go to the smaller start, then the smaller id. Blocks halve by themselves, so `width` no longer matters.
    """
    own = list(points.columns)
    # Ids made while the table is written tell equal points apart.
    points = stage(points.withColumn("_point", F.monotonically_increasing_id()), "points")
    best = least_container(points, ranges, on, ident, "_point", False)
    return points.join(best, "_point", "left").select(*own, "container")


def parents(symbols: DataFrame, on: Sequence[str], width: int, ident: str) -> DataFrame:
    """symbols with `parent`: the smallest other range that strictly contains each. `width` no longer matters."""
    best = least_container(symbols, symbols, on, ident, ident, True).withColumnRenamed("container", "parent")
    return symbols.join(best, ident, "left")


def rectangle_overlap(first: Sequence[Column], second: Sequence[Column], tolerance: float = 0.0) -> Column:
    """Whether two rectangles (x, y, width, height) overlap by more than the tolerance in both directions."""
    ax, ay, aw, ah = first
    bx, by, bw, bh = second
    wide = F.least(ax + aw, bx + bw) - F.greatest(ax, bx)
    high = F.least(ay + ah, by + bh) - F.greatest(ay, by)
    return (wide > tolerance) & (high > tolerance)


def clamp(start: Column, end: Column, last: Column) -> tuple[Column, Column, Column]:
    """A requested range cut to [1, last], and whether it was cut."""
    low, high = F.greatest(start, F.lit(1)), F.least(end, last)
    return low, high, (low != start) | (high != end)


def rebased(found: DataFrame, host: str) -> DataFrame:
    """found (offset, start, end, and the host text) with host_start, host_end and host_line: ranges of an embedded part
    that begins at `offset` of its host, in the host's offsets and lines."""
    start, end = F.col("offset") + F.col("start"), F.col("offset") + F.col("end")
    line = F.size(F.split(F.substring(F.col(host), F.lit(1), start), "\n", -1))
    return found.withColumns({"host_start": start, "host_end": end, "host_line": line})
