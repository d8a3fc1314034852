"""The bounded graph operations, over a graph made of the key columns of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph_query import Answer, graph_query

from .graphs import link, name, place_nodes
from .registry import Tables, query

#: The same edges in SQL. Customers, nations and regions include the next one up, and each region the next region, so
#: includes form chains that end in a cycle; nations and suppliers refer to each other; nations read their region.
GRAPH = """WITH RECURSIVE e0 AS (
  SELECT 'c:' || c_custkey AS src, 'n:' || c_nationkey AS dst, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'FORM_SUBMITS_TO' ELSE 'CALLS_METHOD' END AS type FROM customer
  UNION ALL SELECT 'c:' || c_custkey, 'n:' || c_nationkey, 'INCLUDES' FROM customer
  UNION ALL SELECT 'c:' || c_custkey, 'n:' || c_nationkey, 'SCOPE_PRODUCES' FROM customer
  UNION ALL SELECT 'n:' || n_nationkey, 'r:' || n_regionkey, 'INCLUDES' FROM nation
  UNION ALL SELECT 'n:' || n_nationkey, 'r:' || n_regionkey, 'SCOPE_CONSUMES' FROM nation
  UNION ALL SELECT 'n:' || n_nationkey, 'r:' || n_regionkey, 'QUERY_READS_TABLE' FROM nation
  UNION ALL SELECT 'r:' || r_regionkey, 'r:' || (r_regionkey + 1) % 5, 'INCLUDES' FROM region
  UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey, 'QUERY_READS_TABLE' FROM supplier
  UNION ALL SELECT 'n:' || s_nationkey, 's:' || s_suppkey, 'ROUTES_WHEN' FROM supplier),
e AS (SELECT *, src || '>' || dst || '>' || type AS id FROM e0)"""


def call_edges(t: Tables) -> DataFrame:
    c, n, r, s = name("c", "c_custkey"), name("n", "n_nationkey"), name("r", "n_regionkey"), name("s", "s_suppkey")
    kind = F.when(F.col("c_mktsegment") == "MACHINERY", "FORM_SUBMITS_TO").otherwise("CALLS_METHOD")
    calls = t.customer.select(c.alias("src"), name("n", "c_nationkey").alias("dst"), kind.alias("type"))
    out = calls.withColumn("id", F.concat_ws(">", "src", "dst", "type"))
    following = F.concat(F.lit("r:"), ((F.col("r_regionkey") + 1) % 5).cast("string"))
    for rows, a, b, kind in (
        (t.customer, c, name("n", "c_nationkey"), "INCLUDES"), (t.customer, c, name("n", "c_nationkey"), "SCOPE_PRODUCES"),
        (t.nation, n, r, "INCLUDES"), (t.nation, n, r, "SCOPE_CONSUMES"), (t.nation, n, r, "QUERY_READS_TABLE"),
        (t.region, name("r", "r_regionkey"), following, "INCLUDES"),
        (t.supplier, s, name("n", "s_nationkey"), "QUERY_READS_TABLE"), (t.supplier, name("n", "s_nationkey"), s, "ROUTES_WHEN"),
    ):
        out = out.unionByName(link(rows, a, b, kind))
    return out


def asked(t: Tables, operation: str, **options) -> Answer:
    return graph_query(operation, place_nodes(t), call_edges(t), **options)


def flagged(answer: Answer) -> DataFrame:
    """The result rows with what became of the query."""
    return answer.results.withColumn("truncated", F.lit(answer.truncated)).withColumn("codes", F.lit(",".join(answer.codes)))


def beside(node: str, where: str, most: int | None = 1000) -> str:
    """SQL of the edges of a node, or of all edges, with the first `most` by edge kept (None: all)."""
    ends = f"src = '{node}' OR dst = '{node}'"
    hit = GRAPH + f""", hit AS (
  SELECT id AS edge, type, CASE WHEN src = '{node}' THEN dst ELSE src END AS node, CASE WHEN src = '{node}' THEN 'outgoing' ELSE 'incoming' END AS direction
  FROM e WHERE ({ends}) AND {where})"""
    if most is None:
        return hit + " SELECT *, false AS truncated, '' AS codes FROM hit"
    return hit + f"""
SELECT *, (SELECT count(*) > {most} FROM hit) AS truncated, CASE WHEN (SELECT count(*) FROM hit) > {most} THEN 'QUERY_RESULT_LIMIT' ELSE '' END AS codes
FROM hit ORDER BY edge, direction, node LIMIT {most}"""


def rows_beside(answer: Answer) -> DataFrame:
    return flagged(answer).select("edge", "type", "node", "direction", "truncated", "codes")


@query("G4 J38", beside("n:3", "true", 40))
def graph_related(t: Tables) -> DataFrame:
    """All edges of a node in either direction, cut at forty."""
    return rows_beside(asked(t, "related", node_id="n:3", max_results=40))


@query("G4", beside("n:3", "dst = 'n:3'", 100_000))
def graph_callers(t: Tables) -> DataFrame:
    """Who refers to a node, over edges of any type."""
    return rows_beside(asked(t, "callers", node_id="n:3", max_results=100_000))


@query("G4", beside("n:3", "src = 'n:3'", 100_000))
def graph_callees(t: Tables) -> DataFrame:
    """What a node refers to; the node is picked by name and kind."""
    return rows_beside(asked(t, "callees", name="NATION_3", kind="nation", max_results=100_000))


@query("G4", beside("c:1", "src = 'c:1' AND type = 'INCLUDES'"))
def graph_includes(t: Tables) -> DataFrame:
    """One hop, although what is included includes more."""
    return rows_beside(asked(t, "includes", node_id="c:1"))


@query("G4", beside("r:1", "dst = 'r:1' AND type = 'INCLUDES'", None))
def graph_included_by(t: Tables) -> DataFrame:
    """All that include a node, without a budget."""
    return rows_beside(asked(t, "included-by", node_id="r:1", max_results=None))


@query("G4", beside("n:3", "type = 'QUERY_READS_TABLE'", 100_000))
def graph_tables(t: Tables) -> DataFrame:
    """What a node reads and what reads it."""
    return rows_beside(asked(t, "tables", node_id="n:3", max_results=100_000))


@query("G4", GRAPH + """, hit AS (SELECT id AS edge, type, src, dst FROM e WHERE type IN ('ROUTES_WHEN', 'FORM_SUBMITS_TO'))
SELECT edge, type, dst AS node, 'outgoing' AS direction, (SELECT count(*) > 30 FROM hit) AS truncated, CASE WHEN (SELECT count(*) FROM hit) > 30 THEN 'QUERY_RESULT_LIMIT' ELSE '' END AS codes
FROM hit ORDER BY src, type, dst LIMIT 30""")
def graph_routes(t: Tables) -> DataFrame:
    """Without a node: the first thirty routes of the whole graph."""
    return rows_beside(asked(t, "routes", max_results=30))


@query("G4", beside("n:3", "type IN ('SCOPE_PRODUCES', 'SCOPE_CONSUMES')", 100_000))
def graph_scope_flow(t: Tables) -> DataFrame:
    """Who sets values that a node gets, and who uses those it hands on."""
    return rows_beside(asked(t, "scope-flow", node_id="n:3", max_results=100_000))


@query("G4 R28", GRAPH + """, one AS (
  SELECT src AS node, min({'s': src, 't': type, 'd': dst, 'i': id}) AS k FROM e WHERE dst = 'r:1' AND src <> 'r:1' GROUP BY src
), r1 AS (SELECT node, row_number() OVER (ORDER BY k) AS rank, k.i AS edge FROM one),
two AS (
  SELECT e.src AS node, min({'p': r1.rank, 's': src, 't': type, 'd': dst, 'i': id}) AS k FROM r1 JOIN e ON e.dst = r1.node
  WHERE e.src <> 'r:1' AND e.src NOT IN (SELECT node FROM r1) GROUP BY e.src
), r2 AS (SELECT node, (SELECT count(*) FROM r1) + row_number() OVER (ORDER BY k) AS rank, k.i AS edge FROM two)
SELECT rank, node, edge, 1 AS depth, true AS truncated, 'QUERY_VISITED_NODE_LIMIT' AS codes FROM r1
UNION ALL SELECT rank, node, edge, 2, true, 'QUERY_VISITED_NODE_LIMIT' FROM r2 WHERE rank < 25""")
def graph_impact_evidence(t: Tables) -> DataFrame:
    """What is behind a region, as far as twenty-five visited nodes go: the order of discovery decides who is among them."""
    answer = asked(t, "impact-evidence", node_id="r:1", max_visited=25)
    return flagged(answer).select("rank", "node", "edge", "depth", "truncated", "codes")


@query("G4 R28", GRAPH + """, walk(node, depth) AS (
  SELECT 'c:1', 0 UNION SELECT e.dst, depth + 1 FROM walk JOIN e ON e.src = walk.node WHERE depth < 5)
SELECT node, min(depth) AS depth, true AS truncated, 'QUERY_DEPTH_LIMIT' AS codes FROM walk WHERE node <> 'c:1' GROUP BY node""")
def graph_trace(t: Tables) -> DataFrame:
    """Everything ahead of a customer within five hops: its nation, suppliers, and four of the five regions in a ring."""
    answer = asked(t, "trace", node_id="c:1", max_depth=5, max_results=100_000)
    return flagged(answer).select("node", "depth", "truncated", "codes")


@query("G4 F13", """SELECT 'c:' || o_custkey AS source_node, 'ORDERS' AS relation_type, 'NO_CREDIT' AS reason_code, 'o:' || o_orderkey AS id FROM orders
JOIN customer ON c_custkey = o_custkey WHERE c_acctbal <= 0 ORDER BY source_node, relation_type, id LIMIT 500""")
def graph_unresolved(t: Tables) -> DataFrame:
    """Orders of customers without credit, as unresolved references with their reason; the first five hundred."""
    poor = t.customer.where("c_acctbal <= 0").select(F.col("c_custkey").alias("o_custkey"))
    rows = t.orders.join(poor, "o_custkey", "left_semi").select(
        name("c", "o_custkey").alias("source_node"), F.lit("ORDERS").alias("relation_type"), F.lit("NO_CREDIT").alias("reason_code"), name("o", "o_orderkey").alias("id")
    )
    return asked(t, "unresolved", unresolved=rows, reason_code="NO_CREDIT", max_results=500).results
