"""Bounded graph queries against a queue walked by hand."""

import random
from types import SimpleNamespace

import duckdb
import pytest

from tessera.operators.graph_query import BOTH, INCOMING, OUTGOING, bounded_search, graph_query
from tessera.plans import ORACLE, operations


def by_queue(edges, start, direction, max_results, max_depth, max_visited):
    """(nodes in order of discovery with their depth, codes)."""
    key = lambda e: (e[2], e[1], e[3], e[0])
    visited, queue, found, codes = {start}, [(start, 0)], [], []

    def around(node):
        out = [(e, e[3]) for e in edges if e[2] == node and direction != INCOMING] + [(e, e[2]) for e in edges if e[3] == node and direction != OUTGOING]
        return sorted(out, key=lambda x: key(x[0]))

    while queue:
        node, depth = queue.pop(0)
        left = [n for _, n in around(node)]
        if depth >= max_depth:
            if any(n not in visited for n in left):
                codes = ["QUERY_DEPTH_LIMIT"]
            continue
        for n in left:
            if n in visited:
                continue
            if len(visited) >= max_visited:
                return found, ["QUERY_VISITED_NODE_LIMIT"]
            visited.add(n)
            found.append((n, depth + 1))
            if len(found) >= max_results and (queue or any(x not in visited for x in left)):
                return found, ["QUERY_RESULT_LIMIT"]
            queue.append((n, depth + 1))
    return found, codes


def table(spark, edges):
    return spark.createDataFrame(edges, "id string, type string, src string, dst string")


@pytest.mark.parametrize("seed", range(6))
def test_search_stops_where_a_queue_does(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(rng.choice([8, 25]))]
    edges = [(f"e{i}", rng.choice("AB"), rng.choice(names), rng.choice(names)) for i in range(rng.choice([12, 40]))]
    frame = table(spark, edges).cache()
    for direction, results, depth, visited in [(OUTGOING, 1000, 12, 10_000), (BOTH, rng.randint(1, 6), 12, 10_000), (INCOMING, 1000, rng.randint(0, 2), 10_000), (BOTH, rng.randint(1, 20), rng.randint(1, 4), rng.randint(1, 12))]:
        want, codes = by_queue(edges, "n0", direction, results, depth, visited)
        out, got_codes = bounded_search(frame, "n0", direction, results, depth, visited)
        got = sorted((r["rank"], r.node, r.depth) for r in out.collect())
        assert (got, list(got_codes)) == ([(i + 1, n, d) for i, (n, d) in enumerate(want)], codes), (direction, results, depth, visited)


CHAIN = [("1", "INCLUDES", "a", "b"), ("2", "INCLUDES", "b", "c"), ("3", "QUERY_READS_TABLE", "a", "b"), ("4", "QUERY_READS_TABLE", "c", "a"), ("5", "INCLUDES", "c", "c"), ("6", "SCOPE_PRODUCES", "b", "a")]


@pytest.fixture(scope="module")
def chain(spark):
    nodes = spark.createDataFrame([("a", "A", "page"), ("b", "B", "page"), ("c", "B", "table")], "id string, name string, kind string")
    return nodes, table(spark, CHAIN)


def answered(answer, *columns):
    return sorted(tuple(r) for r in answer.results.select(*columns).collect())


def test_only_two_operations_travel(chain):
    assert answered(graph_query("includes", *chain, node_id="a"), "edge", "node", "direction") == [("1", "b", "outgoing")]
    assert answered(graph_query("included-by", *chain, node_id="c"), "edge", "node", "direction") == [("2", "b", "incoming"), ("5", "c", "self")]
    assert answered(graph_query("tables", *chain, node_id="a"), "edge", "node", "direction") == [("3", "b", "outgoing"), ("4", "c", "incoming")]
    assert answered(graph_query("tables", *chain, node_id="a", direction=OUTGOING), "node") == [("b",)]
    assert answered(graph_query("tables", *chain), "edge", "node") == [("3", "b"), ("4", "a")]
    assert answered(graph_query("routes", *chain), "edge") == [] and graph_query("routes", *chain).complete
    assert answered(graph_query("callers", *chain, node_id="a"), "edge") == [("4",), ("6",)]
    assert answered(graph_query("callees", *chain, name="B", kind="page"), "edge") == [("2",), ("6",)]
    assert answered(graph_query("related", *chain, node_id="c"), "edge", "direction") == [("2", "incoming"), ("4", "outgoing"), ("5", "self")]
    trace = graph_query("trace", *chain, node_id="a", relation_type="INCLUDES")
    assert [(r.node, r.node_ids, r.edge_ids) for r in trace.results.orderBy("rank").collect()] == [("b", ["a", "b"], ["1"]), ("c", ["a", "b", "c"], ["1", "2"])]
    assert answered(graph_query("impact-evidence", *chain, node_id="c"), "node", "depth") == [("a", 2), ("b", 1)]
    assert graph_query("stats", *chain).results.where("type = 'INCLUDES'").first().n == 3


def test_limits_and_failures_are_told(chain):
    cut = graph_query("related", *chain, node_id="a", max_results=2)
    assert answered(cut, "edge") == [("1",), ("3",)] and cut.codes == ("QUERY_RESULT_LIMIT",) and cut.truncated and not cut.complete
    assert graph_query("trace", *chain, node_id="a", max_depth=0).codes == ("QUERY_DEPTH_LIMIT",)
    assert graph_query("trace", *chain, node_id="a", max_visited=1).codes == ("QUERY_VISITED_NODE_LIMIT",)
    assert graph_query("callers", *chain).codes == ("QUERY_TARGET_REQUIRED",)
    assert graph_query("tables", *chain, node_id="z").codes == ("QUERY_TARGET_NOT_FOUND",)
    ambiguous = graph_query("callers", *chain, name="B")
    assert ambiguous.codes == ("QUERY_TARGET_AMBIGUOUS",) and ambiguous.results.count() == 0 and not ambiguous.complete
    assert not graph_query("stats", *chain, graph_complete=False).complete


def test_edges_are_explained(chain):
    nodes, edges = chain
    told = graph_query("explain-edge", nodes, edges, edge_id="2").results.collect()
    assert [r.explanation for r in told] == ['The graph records INCLUDES from "B" to "B" with unresolved confidence. No confidence rationale was recorded.']
    assert graph_query("explain-edge", nodes, edges).codes == ("QUERY_EDGE_REQUIRED",)
    assert graph_query("explain-edge", nodes, edges, edge_id="9").codes == ("QUERY_EDGE_NOT_FOUND",)


def test_unresolved_filters(spark, chain):
    rows = spark.createDataFrame([("u1", "a", "CALLS", "DYNAMIC"), ("u2", "a", "READS", "MISSING"), ("u3", "b", "CALLS", "DYNAMIC")], "id string, source_node string, relation_type string, reason_code string")
    assert answered(graph_query("unresolved", *chain, rows, reason_code="DYNAMIC"), "id") == [("u1",), ("u3",)]
    assert answered(graph_query("unresolved", *chain, rows, node_id="a", relation_type="READS"), "id") == [("u2",)]
    with pytest.raises(ValueError):
        graph_query("nope", *chain)
    with pytest.raises(TypeError):
        graph_query("callers", *chain, node_id="a", name="A")


def test_all_rows_without_a_budget(spark):
    edges = table(spark, [(f"e{i:05d}", "INCLUDES", f"n{i}", "top") for i in range(1100)])
    nodes = spark.createDataFrame([("top", "top", "file")], "id string, name string, kind string")
    whole = graph_query("included-by", nodes, edges, node_id="top", max_results=None)
    assert (whole.results.count(), whole.truncated, whole.codes) == (1100, False, ())
    assert graph_query("included-by", nodes, edges, node_id="top").results.count() == 1000
    with pytest.raises(ValueError):
        graph_query("trace", nodes, edges, node_id="top", max_results=None)


def test_included_by_is_whole_in_query_and_sql(spark):
    """The registered query and its SQL on a region of 1,100 nations."""
    con = duckdb.connect()
    con.sql("CREATE TABLE region AS SELECT i AS r_regionkey, 'REGION_' || i AS r_name FROM range(5) t(i)")
    con.sql("CREATE TABLE nation AS SELECT i AS n_nationkey, 'NATION_' || i AS n_name, CASE WHEN i < 1100 THEN 1 ELSE 2 END AS n_regionkey FROM range(1110) t(i)")
    con.sql("CREATE TABLE customer AS SELECT i AS c_custkey, 'C' || i AS c_name, i AS c_nationkey, 'MACHINERY' AS c_mktsegment FROM range(20) t(i)")
    con.sql("CREATE TABLE supplier AS SELECT i AS s_suppkey, 'S' || i AS s_name, i AS s_nationkey FROM range(20) t(i)")
    read = {n: con.sql(f"SELECT * FROM {n}") for n in ("region", "nation", "customer", "supplier")}
    found = operations.graph_included_by(SimpleNamespace(**{n: spark.createDataFrame(r.fetchall(), r.columns) for n, r in read.items()}))
    want = {(f"{a}>r:1>INCLUDES", "INCLUDES", a, "incoming", False, "") for a in ["r:0", *(f"n:{i}" for i in range(1100))]}
    for rows in (found.collect(), con.sql(ORACLE["graph_included_by"]).fetchall()):
        assert len(rows) == len(want) and {tuple(r) for r in rows} == want
