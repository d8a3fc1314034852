"""Graph queries over node and edge DataFrames: bounded traversal, closure, paths, adjacency, explanations.

Traversals are frontier loops: each level is one join of the frontier with the edges and one anti join against
what is already visited; levels beyond the second are staged, so lineage stays flat and a lost executor costs one level.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.staging import stage, unstage

FORWARD, BACKWARD, BOTH = "forward", "backward", "both"


def directed(edges: DataFrame, direction: str) -> DataFrame:
    """(here, there, id, type) in the direction of travel."""
    ahead = edges.select(F.col("src").alias("here"), F.col("dst").alias("there"), "id", "type")
    back = edges.select(F.col("dst").alias("here"), F.col("src").alias("there"), "id", "type")
    return {FORWARD: ahead, BACKWARD: back, BOTH: ahead.unionByName(back)}[direction]


def traverse(
    edges: DataFrame,
    seeds: DataFrame,
    direction: str = BACKWARD,
    depth: int | None = 2,
    types: Iterable[str] | None = None,
    max_rounds: int = 200,
) -> DataFrame:
    """Multi-seed breadth-first search: (seed, node, distance, path, relations, via).

    visited is kept per seed; an edge counts only where it first discovers a node for its seed. Of several
    discovering edges the one from the least (path so far, type, id) wins, so the result does not depend on
    order. depth None runs until no frontier is left. seeds has one column, node.
    """
    if types is not None:
        edges = edges.where(F.col("type").isin(*types))
    hops = directed(edges, direction)
    start = seeds.select(
        F.col("node").alias("seed"), "node", F.lit(0).alias("distance"), F.array("node").alias("path"),
        F.array().cast("array<string>").alias("relations"), F.lit(None).cast("string").alias("via"),
    ).distinct()
    # Two levels are one plan; deeper searches cut lineage at every level and stop at an empty one.
    lazy = depth is not None and depth <= 2
    frontier = start if lazy else stage(start, "frontier")
    levels = [frontier]
    visited = frontier.select("seed", "node")
    for level in range(1, (depth if depth is not None else max_rounds) + 1):
        found = frontier.join(hops, frontier["node"] == hops["here"]).where("here <> there").select(
            "seed", F.col("there").alias("node"), F.lit(level).alias("distance"),
            F.concat("path", F.array("there")).alias("path"), F.concat("relations", F.array("type")).alias("relations"), F.col("id").alias("via"),
        )
        fresh = found.join(visited, ["seed", "node"], "left_anti")
        best = fresh.groupBy("seed", "node").agg(F.min_by(F.struct("distance", "path", "relations", "via"), F.struct("path", "via")).alias("b"))
        new = best.select("seed", "node", "b.distance", "b.path", "b.relations", "b.via")
        new = new if lazy else stage(new, "frontier")
        if not lazy and not new.limit(1).count():
            unstage(new)
            break
        levels.append(new)
        visited = visited.union(new.select("seed", "node"))
        frontier = new
    else:
        if depth is None:
            raise RuntimeError("traversal did not end")
    out = levels[0]
    for part in levels[1:]:
        out = out.unionByName(part)
    return out


def depth_limited(edges: DataFrame, reached: DataFrame, direction: str, depth: int) -> DataFrame:
    """Seeds that have an undiscovered neighbour beyond the depth limit."""
    hops = directed(edges, direction)
    rim = reached.where(F.col("distance") == depth).join(hops, F.col("node") == F.col("here")).where("here <> there")
    beyond = rim.select("seed", F.col("there").alias("node")).join(reached.select("seed", "node"), ["seed", "node"], "left_anti")
    return beyond.select("seed").distinct()


def capped(reached: DataFrame, nodes: int) -> DataFrame:
    """The first `nodes` rows in the order (distance, seed, path), with `truncated` (one row is read ahead)."""
    order = ["distance", "seed", "path"]
    ahead = reached.orderBy(*order).limit(nodes + 1)
    place = Window.partitionBy().orderBy(*order)  # at most nodes + 1 rows
    numbered = ahead.withColumns({"_n": F.row_number().over(place), "_all": F.count(F.lit(1)).over(Window.partitionBy())})
    return numbered.where(F.col("_n") <= nodes).withColumn("truncated", F.col("_all") > nodes).drop("_n", "_all")


def closure(edges: DataFrame, seeds: DataFrame, direction: str = BACKWARD, types: Iterable[str] | None = None) -> DataFrame:
    """Everything reachable from the seeds together: (node, distance)."""
    if types is not None:
        edges = edges.where(F.col("type").isin(*types))
    hops = directed(edges, direction).select("here", "there").distinct()
    frontier = stage(seeds.select("node", F.lit(0).alias("distance")).distinct(), "closure")
    seen = frontier
    for level in range(1, 10_000):
        step = frontier.join(hops, frontier["node"] == hops["here"]).select(F.col("there").alias("node")).distinct()
        new = stage(step.join(seen.select("node"), "node", "left_anti").withColumn("distance", F.lit(level)), "closure")
        if not new.limit(1).count():
            return seen
        seen, frontier = seen.unionByName(new), new
    raise RuntimeError("closure did not end")


def related(edges: DataFrame, node: str, types: Iterable[str] | None = None) -> DataFrame:
    """One hop in either direction: (other, id, type, direction); a self-loop's direction is self."""
    if types is not None:
        edges = edges.where(F.col("type").isin(*types))
    out = edges.where(F.col("src") == node).select(F.col("dst").alias("other"), "id", "type", F.when(F.col("dst") == node, "self").otherwise("out").alias("direction"))
    into = edges.where((F.col("dst") == node) & (F.col("src") != node)).select(F.col("src").alias("other"), "id", "type", F.lit("in").alias("direction"))
    return out.unionByName(into)


def adjacency(edges: DataFrame, reverse: bool = True) -> DataFrame:
    """(node, neighbours): sorted distinct neighbour lists."""
    key, other = ("dst", "src") if reverse else ("src", "dst")
    return edges.groupBy(F.col(key).alias("node")).agg(F.array_sort(F.collect_set(other)).alias("neighbours"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, fan_in, fan_out) with partial aggregation, never a neighbour list."""
    ends = edges.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionAll(
        edges.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o"))
    )
    return ends.groupBy("node").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


def build_nodes(facts: DataFrame) -> DataFrame:
    """Nodes of facts (id, kind, name, evidence): one row per id, evidence merged and counted."""
    return facts.groupBy("id").agg(F.min("kind").alias("kind"), F.min("name").alias("name"), F.count_distinct("evidence").alias("n_evidence"))


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, end, node): edge endpoints that are no node."""
    ends = edges.select("id", F.explode(F.array(F.struct(F.lit("src").alias("end"), F.col("src").alias("node")), F.struct(F.lit("dst").alias("end"), F.col("dst").alias("node")))).alias("e"))
    return ends.select("id", "e.end", "e.node").join(nodes.select(F.col("id").alias("node")).distinct(), "node", "left_anti")


def explain(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, text): one sentence for each edge."""
    a = nodes.select(F.col("id").alias("src"), F.col("name").alias("_a"))
    b = nodes.select(F.col("id").alias("dst"), F.col("name").alias("_b"))
    joined = edges.join(a, "src", "left").join(b, "dst", "left")
    return joined.select("id", F.concat_ws(" ", F.coalesce("_a", "src"), F.lower("type"), F.coalesce("_b", "dst")).alias("text"))


def select_node(nodes: DataFrame, predicate: Column) -> DataFrame:
    """One row: how many nodes a selector found (missing / unique / ambiguous) and the node if unique."""
    hit = nodes.where(predicate).agg(F.count(F.lit(1)).alias("matches"), F.min("id").alias("_id"))
    state = F.when(F.col("matches") == 0, "missing").when(F.col("matches") == 1, "unique").otherwise("ambiguous")
    return hit.select("matches", state.alias("state"), F.when(F.col("matches") == 1, F.col("_id")).alias("node"))


def shortest_paths(edges: DataFrame, sources: DataFrame, targets: DataFrame, depth: int) -> DataFrame:
    """(seed, node, distance, path) of the shortest path from every source to every target within depth."""
    reached = traverse(edges, sources, FORWARD, depth)
    return reached.join(targets.select("node").distinct(), "node", "left_semi").select("seed", "node", "distance", "path")


def include_order(includes: DataFrame, root: str, max_depth: int = 12) -> DataFrame:
    """Ordered include expansion from a root file: (file, order_key, path, state); state cycle marks a file that
    is already on its own path. includes has (file, pos, target). order_key sorts depth first."""
    level = stage(
        includes.sparkSession.createDataFrame([(root,)], "file string").select(
            "file", F.array().cast("array<int>").alias("order_key"), F.array("file").alias("path"), F.lit("open").alias("state")
        ),
        "include",
    )
    out = level
    child = includes.select(F.col("file").alias("_parent"), F.col("pos").cast("int").alias("_pos"), F.col("target"))
    for _ in range(max_depth):
        step = level.where("state = 'open'").join(child, F.col("file") == F.col("_parent")).select(
            F.col("target").alias("file"), F.concat("order_key", F.array("_pos")).alias("order_key"),
            F.concat("path", F.array("target")).alias("path"),
            F.when(F.array_contains("path", F.col("target")), "cycle").otherwise("open").alias("state"),
        )
        level = stage(step, "include")
        if not level.limit(1).count():
            break
        out = out.unionByName(level)
    return out
