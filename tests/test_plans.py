"""Registered queries without SQL against brute force on small tables of their own."""

from types import SimpleNamespace

import pytest

from tessera.plans import texts


@pytest.fixture(scope="module")
def orders_with_lines(spark):
    """Orders on both sides of key 3000, whose lines are added (A), deleted (R) or context (N)."""
    flags = {1: "AAR", 2: "NAAA", 2999: "ANA", 3000: "RRA", 3001: "AANA", 70_000: "AAAA", 5_000_000: "NRAAAA"}
    rows = [(key, i + 1, 770 + i, f) for key, own in flags.items() for i, f in enumerate(own)]
    table = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_returnflag string")
    return SimpleNamespace(spark=spark, lineitem=table), flags


def added(flags):
    """New line numbers of the added lines and their part keys."""
    new, out = 20, []
    for i, f in enumerate(flags):
        if f == "A":
            out.append((new, 770 + i))
        new += f != "R"
    return out


def test_changed_ranges_covers_all_orders(orders_with_lines):
    tables, flags = orders_with_lines
    want = set()
    for key, own in flags.items():
        lines = [n for n, _ in added(own)]
        starts = [n for n in lines if n - 1 not in lines]
        want |= {(key, n, next(m for m in lines if m >= n and m + 1 not in lines)) for n in starts}
    assert {(r.diff_id, r.start, r.end) for r in texts.changed_ranges(tables).collect()} == want


def test_patch_policy_covers_all_orders(orders_with_lines):
    tables, flags = orders_with_lines
    want = {(1, "protected-path", None, False)}
    for key, own in flags.items():
        lines = added(own)
        want |= {(key, "lucky", n, False) for n, part in lines if str(part).startswith("77")}
        want |= {(key, "many", n, key == 2) for n, part in lines if str(part).startswith("1")}
        if len(lines) > 3:
            want.add((key, "too-many-lines", None, False))
    assert {(r.diff_id, r.rule, r.line, r.excepted) for r in texts.patch_policy(tables).collect()} == want
