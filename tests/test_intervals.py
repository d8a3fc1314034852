"""Ranges against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import intervals, scans


@pytest.fixture(scope="module")
def ranges():
    rng = random.Random(5)
    made = [(rng.choice(["a", "b", "b"]), i, (low := rng.randrange(-40, 60)), low + rng.choice([0, 1, 3, 17, 70])) for i in range(240)]
    return [*made, (None, 240, 1, 5), ("a", 241, None, 5), ("c", 242, 4, 4)]


@pytest.fixture(scope="module")
def frame(spark, ranges):
    return spark.createDataFrame(ranges, "k string, id long, start int, end int").repartition(3)


def smallest(ranges, row, strict):
    k, _, a, b = row
    hold = [] if None in (k, a, b) else [r for r in ranges if r[0] == k and r[2] is not None and r[2] <= a and b <= r[3] and (not strict or r[3] - r[2] > b - a)]
    return min(((r[3] - r[2], r[2], r[1]) for r in hold), default=(None,) * 3)[2]


@pytest.mark.parametrize("most", [20, 500_000])
def test_smallest_containers_by_halved_blocks(ranges, frame, most, monkeypatch):
    monkeypatch.setattr(intervals, "MOST_ROWS", most)
    got = {r.id: r.parent for r in intervals.parents(frame, ["k"], 8, "id").collect()}
    assert got == {r[1]: smallest(ranges, r, True) for r in ranges}
    got = {r.id: r.container for r in intervals.smallest_container(frame, frame, ["k"], 8, "id").collect()}
    assert got == {r[1]: smallest(ranges, r, False) for r in ranges}


def test_containers_meet_no_pairs(spark):
    """Ranges that all hold one another: a row is filed a few times, not once for each other range."""
    rows = spark.range(3000).select(F.lit("k").alias("k"), "id", (-F.col("id")).alias("start"), F.col("id").alias("end"))
    seen = []
    scan = scans.running_least
    scans.running_least = lambda filed, *rest: seen.append(filed.count()) or scan(filed, *rest)
    try:
        got = {r.id: r.parent for r in intervals.parents(rows, ["k"], 8, "id").collect()}
    finally:
        scans.running_least = scan
    assert got == {i: i + 1 if i < 2999 else None for i in range(3000)}
    assert seen[0] < 3000 * 40


@pytest.mark.parametrize("most", [50, 20_000_000])
def test_overlaps_of_crowded_cells_are_dealt(ranges, frame, most):
    got = sorted((r.l_id, r.r_id) for r in intervals.overlap_pairs(frame, frame, ["k"], 16, most).collect())
    known = [r for r in ranges if None not in r]
    assert got == sorted((x[1], y[1]) for x in known for y in known if x[0] == y[0] and x[2] <= y[3] and y[2] <= x[3])
