"""Bounded queries over a graph of nodes (id, name, ...) and edges (id, type, src, dst, ...), by operation name.

Only `trace` and `impact-evidence` travel; every other operation looks at the edges of one node, or at all edges of its
types where it may go without a node. Answers are cut at budgets in a fixed order and say so.

A traversal visits nodes as a queue would: level by level, a node's neighbours in the order of their edges (src, type,
dst, id). The place of a node in that order is its parent's place, then its edge; a level is numbered by a scan in
parts (`scans.numbered`), so budgets cut at a definite node although each level is a join. Travel stops at the level in
which a budget is used up.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.staging import stage, unstage

from .scans import numbered

INCOMING, OUTGOING, BOTH = "incoming", "outgoing", "both"

#: The direction each operation takes unless told otherwise, and the edge types of those that have their own.
DIRECTIONS = {
    "related": BOTH, "callers": INCOMING, "callees": OUTGOING, "includes": OUTGOING, "included-by": INCOMING, "tables": BOTH,
    "routes": BOTH, "scope-flow": BOTH, "impact-evidence": INCOMING, "trace": OUTGOING,
}
EDGE_TYPES = {
    "includes": ("INCLUDES",),
    "included-by": ("INCLUDES",),
    "tables": ("QUERY_READS_TABLE",),
    "routes": ("FORM_SUBMITS_TO", "REDIRECTS_TO", "AJAX_CALLS", "FETCHES", "ROUTES_WHEN"),
    "scope-flow": ("SCOPE_PRODUCES", "SCOPE_CONSUMES", "SCOPE_OVERRIDES"),
}
#: Budgets where a request names none.
MAX_RESULTS, MAX_DEPTH, MAX_VISITED = 1_000, 12, 10_000
#: Operations that may be asked without a node, and those that travel.
FREE = ("tables", "routes", "scope-flow", "unresolved")
TRAVEL = ("trace", "impact-evidence")
SELECTORS = ("node_id", "path", "canonical_name", "name")


@dataclass(frozen=True)
class Answer:
    """Result rows in no order, their sort columns, and what cut or failed the query (empty: nothing)."""

    results: DataFrame
    order: tuple[str, ...]
    codes: tuple[str, ...] = ()
    graph_complete: bool = True

    @property
    def truncated(self) -> bool:
        return any(c in ("QUERY_RESULT_LIMIT", "QUERY_DEPTH_LIMIT", "QUERY_VISITED_NODE_LIMIT") for c in self.codes)

    @property
    def complete(self) -> bool:
        return self.graph_complete and not self.codes


def of_types(edges: DataFrame, types: Iterable[str] | None) -> DataFrame:
    return edges if types is None else edges.where(F.col("type").isin(*types))


def wanted_types(operation: str, edge_types: Iterable[str] | None, relation_type: str | None) -> list[str] | None:
    """The request's edge types or else the operation's, narrowed to one relation type; None: all."""
    types = list(edge_types) if edge_types is not None else list(EDGE_TYPES[operation]) if operation in EDGE_TYPES else None
    if relation_type is None:
        return types
    return [relation_type] if types is None else [t for t in types if t == relation_type]


def adjacent(edges: DataFrame, node: str, direction: str) -> DataFrame:
    """(edge, type, src, dst, node, direction): edges of one node, with the node at their other end."""
    ends = {OUTGOING: F.col("src") == node, INCOMING: F.col("dst") == node}
    hit = edges.where(ends[OUTGOING] | ends[INCOMING] if direction == BOTH else ends[direction])
    way = F.when(ends[OUTGOING] & ends[INCOMING], "self").when(ends[OUTGOING], OUTGOING).otherwise(INCOMING)
    return hit.select(F.col("id").alias("edge"), "type", "src", "dst", F.when(ends[OUTGOING], F.col("dst")).otherwise(F.col("src")).alias("node"), way.alias("direction"))


def first_rows(rows: DataFrame, order: tuple[str, ...], most: int) -> tuple[DataFrame, bool]:
    """(the first `most` rows, whether there are more)."""
    ahead = stage(rows.orderBy(*order).limit(most + 1), "ahead")
    if ahead.count() <= most:
        return ahead, False
    return ahead.orderBy(*order).limit(most), True


def _level(frontier: DataFrame, hops: DataFrame, visited: DataFrame, depth: int, offset: int) -> DataFrame:
    """The nodes first reached from the frontier, with their rank in order of discovery."""
    key = F.struct(F.col("rank").alias("parent"), "src", "type", "dst", F.col("id").alias("edge"))
    met = frontier.select("rank", F.col("node").alias("here")).join(hops, "here").where("here <> there")
    fresh = met.withColumnRenamed("there", "node").join(visited, "node", "left_anti")
    first = fresh.groupBy("node").agg(F.min(key).alias("e")).select("node", "e.*")
    ranked = numbered(first, [], ["parent", "src", "type", "dst", "edge"], "_n")
    above = frontier.select(F.col("rank").alias("parent"), F.col("node_ids").alias("_nodes"), F.col("edge_ids").alias("_edges"))
    return ranked.join(above, "parent").select(
        "node", (F.col("_n") + offset).alias("rank"), "parent", "edge", F.concat("_nodes", F.array("node")).alias("node_ids"),
        F.concat("_edges", F.array("edge")).alias("edge_ids"), F.lit(depth).alias("depth"),
    )


def _result_cut(level: DataFrame, max_results: int) -> int | None:
    """The first rank from max_results on at which something is left to visit: in the queue, or beside the node."""
    last = level.groupBy("parent").agg(F.max("rank").alias("_last"))
    more = (F.col("rank") - 1 > F.col("parent")) | (F.col("_last") > F.col("rank"))
    return level.where(F.col("rank") >= max_results).join(last, "parent").where(more).agg(F.min("rank")).first()[0]


def bounded_search(
    edges: DataFrame, start: str, direction: str, max_results: int = MAX_RESULTS, max_depth: int = MAX_DEPTH, max_visited: int = MAX_VISITED
) -> tuple[DataFrame, tuple[str, ...]]:
    """((rank, node, parent, edge, node_ids, edge_ids, depth) in order of discovery, the budgets used up).

    rank 0 is the start, which is no result but counts as visited. max_results stops the search only where something is
    left in the queue or at the node at hand, so a lone chain is followed to its end.
    """
    ahead = edges.select(F.col("src").alias("here"), F.col("dst").alias("there"), "id", "type", "src", "dst")
    back = edges.select(F.col("dst").alias("here"), F.col("src").alias("there"), "id", "type", "src", "dst")
    hops = {OUTGOING: ahead, INCOMING: back, BOTH: ahead.unionByName(back)}[direction]
    spark = edges.sparkSession
    text = lambda: F.array().cast("array<string>")
    none = F.lit(None)
    frontier = spark.range(1).select(
        F.lit(start).alias("node"), F.lit(0).cast("long").alias("rank"), none.cast("long").alias("parent"), none.cast("string").alias("edge"),
        F.array(F.lit(start)).alias("node_ids"), text().alias("edge_ids"), F.lit(0).alias("depth"),
    )
    levels, visited, kept = [frontier], frontier.select("node"), 0
    codes: list[str] = []
    last = None
    for depth in range(1, max_depth + 1):
        made = _level(frontier, hops, visited, depth, kept)
        # One node beyond the budget shows that it is used up.
        level = stage(made.where(F.col("rank") <= max_visited), "level")
        size = level.count()
        if not size:
            unstage(level)
            frontier = level.limit(0)
            break
        cut = _result_cut(level, max_results)
        levels.append(level)
        if kept + size >= max_visited and (cut is None or cut >= max_visited):
            codes, last = ["QUERY_VISITED_NODE_LIMIT"], max_visited - 1
            break
        if cut is not None:
            codes, last = ["QUERY_RESULT_LIMIT"], cut
            break
        frontier, visited, kept = level, visited.unionByName(level.select("node")), kept + size
    else:
        rim = frontier.select(F.col("node").alias("here")).join(hops, "here").select(F.col("there").alias("node"))
        if rim.join(visited, "node", "left_anti").limit(1).count():
            codes = ["QUERY_DEPTH_LIMIT"]
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    out = out.where(F.col("rank") > 0)
    return (out if last is None else out.where(F.col("rank") <= last)), tuple(codes)


def target(nodes: DataFrame, selector: str, value: str, kind: str | None = None) -> tuple[str | None, str | None]:
    """(id, None) of the one node that the selector names, or (None, code)."""
    hit = nodes.where(F.col("id" if selector == "node_id" else selector) == value)
    if kind is not None:
        hit = hit.where(F.col("kind") == kind)
    ids = [r.id for r in hit.select("id").limit(2).collect()]
    if len(ids) == 1:
        return ids[0], None
    return None, "QUERY_TARGET_AMBIGUOUS" if ids else "QUERY_TARGET_NOT_FOUND"


def explanations(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges with `explanation`, one sentence each; confidence and reason are columns of edges where known."""
    a = nodes.select(F.col("id").alias("src"), F.col("name").alias("_a"))
    b = nodes.select(F.col("id").alias("dst"), F.col("name").alias("_b"))
    have = lambda c, other: F.coalesce(F.col(c), F.lit(other)) if c in edges.columns else F.lit(other)
    head = F.format_string('The graph records %s from "%s" to "%s" with %s confidence. %s', "type", "_a", "_b", have("confidence", "unresolved"), have("reason", "No confidence rationale was recorded."))
    note = F.when(F.col("dynamic"), " This relationship is dynamic and is not authoritative runtime proof.").otherwise("") if "dynamic" in edges.columns else F.lit("")
    return edges.join(a, "src").join(b, "dst").withColumn("explanation", F.substring(F.concat(head, note), 1, 2048)).drop("_a", "_b")


def graph_query(
    operation: str, nodes: DataFrame, edges: DataFrame, unresolved: DataFrame | None = None, *, kind: str | None = None, edge_id: str | None = None,
    relation_type: str | None = None, reason_code: str | None = None, edge_types: Iterable[str] | None = None, direction: str | None = None,
    max_results: int | None = MAX_RESULTS, max_depth: int = MAX_DEPTH, max_visited: int = MAX_VISITED, graph_complete: bool = True, **selector: str,
) -> Answer:
    """One of the thirteen operations. `selector` names the node by node_id, path, canonical_name or name (with `kind`).

    Operations that do not travel take no max_results (None) for all rows.
    """
    unknown = set(selector) - set(SELECTORS)
    if unknown or len(selector) > 1:
        raise TypeError(f"one node selector of {SELECTORS}, not {sorted(selector)}")
    if operation not in (*DIRECTIONS, "unresolved", "explain-edge", "stats"):
        raise ValueError(f"unknown operation {operation}")
    if operation in ("stats", "explain-edge") and selector:
        raise TypeError(f"{operation} takes no node")
    if direction not in (None, INCOMING, OUTGOING, BOTH):
        raise ValueError(f"unknown direction {direction}")
    if max_results is None and operation in TRAVEL:
        raise ValueError(f"{operation} needs max_results")

    def answer(rows: DataFrame, order: tuple[str, ...]) -> Answer:
        if max_results is None:
            return Answer(rows, order, (), graph_complete)
        rows, more = first_rows(rows, order, max_results)
        return Answer(rows, order, ("QUERY_RESULT_LIMIT",) if more else (), graph_complete)

    if operation == "stats":
        return Answer(edges.groupBy("type").agg(F.count(F.lit(1)).alias("n")), ("type",), (), graph_complete)
    if operation == "explain-edge":
        hit = edges if edge_id is None else edges.where(F.col("id") == edge_id)
        missing = "QUERY_EDGE_REQUIRED" if edge_id is None else "QUERY_EDGE_NOT_FOUND" if not hit.limit(1).count() else None
        return Answer(explanations(hit.limit(0) if missing else hit, nodes), ("id",), (missing,) if missing else (), graph_complete)

    node, failed = None, None
    if selector:
        node, failed = target(nodes, *next(iter(selector.items())), kind)
    elif operation not in FREE:
        failed = "QUERY_TARGET_REQUIRED"
    types = wanted_types(operation, edge_types, relation_type)
    way = direction or DIRECTIONS.get(operation, BOTH)
    if operation == "unresolved":
        if unresolved is None:
            raise ValueError("unresolved rows are needed")
        rows = unresolved if node is None else unresolved.where(F.col("source_node") == node)
        for column, value in (("relation_type", relation_type), ("reason_code", reason_code)):
            rows = rows if value is None else rows.where(F.col(column) == value)
        order = ("source_node", "relation_type", "id")
        return Answer(rows.limit(0), order, (failed,), graph_complete) if failed else answer(rows, order)
    order = ("edge", "direction", "node")
    if failed:
        return Answer(adjacent(edges, "", way).limit(0), order, (failed,), graph_complete)
    chosen = of_types(edges, types)
    if operation in TRAVEL:
        found, codes = bounded_search(chosen, node, way, max_results, max_depth, max_visited)
        return Answer(found, ("rank",), codes, graph_complete)
    if node is None:
        every = chosen.select(F.col("id").alias("edge"), "type", "src", "dst", F.col("dst").alias("node"), F.lit(OUTGOING).alias("direction"))
        return answer(every, ("src", "type", "dst", "edge"))
    return answer(adjacent(chosen, node, way), order)
