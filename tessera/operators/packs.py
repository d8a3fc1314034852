"""Greedy packing of items into a byte budget: data-dependent, so one program per pack."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "pack string, id bigint, place int, state string, reason string, used bigint"


def _covered(locators: list, held: dict) -> bool:
    """Whether every locator lies inside ranges already included of its path."""
    if not len(locators):
        return False
    for x in locators:
        if not any(a <= x["start"] and x["end"] <= b for a, b in held.get(x["path"], ())):
            return False
    return True


def pack_items(items: list[dict], budget: int) -> list[tuple]:
    """(id, place, state, reason, used) in pack order: mandatory first, priority down, id up."""
    out, seen, held, used = [], {}, {}, 0
    items = sorted(items, key=lambda x: (not x["mandatory"], -x["priority"], x["id"]))
    if sum(x["bytes"] for x in items if x["mandatory"]) > budget:
        return [(x["id"], i, "omitted", "mandatory-overflow", 0) for i, x in enumerate(items)]
    for i, x in enumerate(items):
        reason = None
        if x["sha256"] in seen:
            reason = "duplicate-artifact"
        elif _covered(x["locators"], held):
            reason = "duplicate-locator"
        elif used + x["bytes"] > budget:
            reason = "budget"
        if reason:
            out.append((x["id"], i, "omitted", reason, used))
            continue
        used += x["bytes"]
        seen[x["sha256"]] = x["id"]
        for r in x["locators"]:
            held.setdefault(r["path"], []).append((r["start"], r["end"]))
        out.append((x["id"], i, "included", None, used))
    return out


def greedy_pack(items: DataFrame, budget: int) -> DataFrame:
    """items (pack, id, mandatory, priority, sha256, bytes, locators) with their fate; a pack is one request's
    candidates and is bounded by the requester.

    Packs are dealt to tasks and read in order as a stream, one held at a time, so small packs cost no call each."""
    columns = ["pack", "id", "place", "state", "reason", "used"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack, held = None, []
        for batch in batches:
            made = []
            for item in batch.to_dict("records"):
                if held and item["pack"] != pack:
                    made.extend((pack, *r) for r in pack_items(held, budget))
                    held = []
                pack = item["pack"]
                held.append(item)
            yield pd.DataFrame(made, columns=columns)
        if held:
            yield pd.DataFrame([(pack, *r) for r in pack_items(held, budget)], columns=columns)

    return items.repartition("pack").sortWithinPartitions("pack").mapInPandas(run, SCHEMA)
