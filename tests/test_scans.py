"""Scans in parts against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import scans


@pytest.fixture(scope="module")
def events():
    rng = random.Random(2)
    keys = ["hot"] * 300 + ["cold"] * 5 + ["one"] + [None] * 40
    rows = [(k, i, rng.choice([None, 1, 5, -2])) for i, k in enumerate(keys)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def frame(spark, events):
    return spark.createDataFrame(events, "key string, at long, value long").repartition(3)


@pytest.mark.parametrize("most", [7, 50, 100_000])
@pytest.mark.parametrize("by", [["key"], []])
def test_scans_do_not_depend_on_the_parts(events, frame, by, most):
    total, count, last = {}, {}, {}
    want = {}
    for key, at, value in sorted(events, key=lambda r: r[1]):
        k = key if by else 0
        before = last.get(k)
        count[k] = count.get(k, 0) + 1
        if value is not None:
            total[k], last[k] = total.get(k, 0) + value, value
        want[at] = (total.get(k), count[k], last.get(k), before)
    out = scans.running_total(frame, by, ["at"], F.col("value"), "total", most)
    out = scans.numbered(out, by, ["at"], "n", most)
    out = scans.filled_forward(out, by, ["at"], F.col("value"), "filled", most)
    out = scans.filled_forward(out, by, ["at"], F.col("value"), "earlier", most, strictly=True)
    assert {r.at: (r.total, r.n, r.filled, r.earlier) for r in out.collect()} == want
    assert not [c for c in out.columns if c.startswith("_")]


def test_descending_and_empty(frame):
    got = {r.at: r.n for r in scans.numbered(frame.where("key = 'hot'"), ["key"], [F.col("at").desc()], "n", 20).collect()}
    assert got == {at: 300 - at for at in range(300)}
    assert scans.running_total(frame.limit(0), [], ["at"], F.lit(1), "n", 5).collect() == []


def test_results_of_any_name_and_carried_columns(frame):
    carried = frame.withColumns({"_value": F.col("value"), "_place": F.lit(1), "_before": F.lit("b")})
    out = scans.running_total(carried, ["key"], ["at"], F.col("value"), "_part", 50)
    out = scans.filled_forward(out, ["key"], ["at"], F.col("_value"), "_sum", 50)
    assert set(out.columns) == {"key", "at", "value", "_value", "_place", "_before", "_part", "_sum"}
    plain = scans.running_total(frame, ["key"], ["at"], F.col("value"), "total").select("at", "total")
    assert {r.at: r._part for r in out.collect()} == {r.at: r.total for r in plain.collect()}


def test_tasks_stay_few_enough_to_stream(spark):
    """Over 200 tasks a shuffle holds in memory what a task reads, so there are more only where tasks would grow large."""
    assert [scans.tasks_for(spark.range(n), 2) for n in (2, 300, 1000, 4000, 4001, 10_000)] == [4, 150, 200, 200, 201, 500]
