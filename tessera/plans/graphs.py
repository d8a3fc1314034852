"""Graph queries over nodes and edges made of the key columns of the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import graph, graph_query, project, relational

from .registry import Tables, query

EDGES = """WITH e AS (
  SELECT 'n:' || n_nationkey AS src, 'r:' || n_regionkey AS dst, 'IN_REGION' AS type FROM nation
  UNION ALL SELECT 'c:' || c_custkey, 'n:' || c_nationkey, 'LIVES_IN' FROM customer
  UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey, 'BASED_IN' FROM supplier) """


def name(prefix: str, column: str) -> Column:
    return F.concat(F.lit(prefix + ":"), F.col(column).cast("string"))


def link(rows: DataFrame, a: Column, b: Column, kind: str) -> DataFrame:
    out = rows.select(a.alias("src"), b.alias("dst"), F.lit(kind).alias("type"))
    return out.withColumn("id", F.concat_ws(">", "src", "dst", "type"))


def place_edges(t: Tables) -> DataFrame:
    parts = link(t.nation, name("n", "n_nationkey"), name("r", "n_regionkey"), "IN_REGION")
    parts = parts.unionByName(link(t.customer, name("c", "c_custkey"), name("n", "c_nationkey"), "LIVES_IN"))
    return parts.unionByName(link(t.supplier, name("s", "s_suppkey"), name("n", "s_nationkey"), "BASED_IN"))


def place_nodes(t: Tables) -> DataFrame:
    rows = [(t.region, "r", "r_regionkey", "r_name", "region"), (t.nation, "n", "n_nationkey", "n_name", "nation"), (t.customer, "c", "c_custkey", "c_name", "customer"), (t.supplier, "s", "s_suppkey", "s_name", "supplier")]
    out = None
    for df, prefix, key, label, kind in rows:
        part = df.select(name(prefix, key).alias("id"), F.col(label).alias("name"), F.lit(kind).alias("kind"))
        out = part if out is None else out.unionByName(part)
    return out


@query("G2 G1 F11", EDGES + """, l1 AS (SELECT dst AS seed, src AS node, 1 AS distance, dst || '>' || src AS path FROM e WHERE dst LIKE 'r:%'),
l2 AS (SELECT l1.seed, e.src AS node, 2 AS distance, l1.path || '>' || e.src AS path FROM l1 JOIN e ON e.dst = l1.node)
SELECT 'r:' || r_regionkey AS seed, 'r:' || r_regionkey AS node, 0 AS distance, 'r:' || r_regionkey AS path FROM region UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2""")
def reverse_impact_depth2(t: Tables) -> DataFrame:
    """Everything at most two hops behind each region, per region."""
    seeds = t.region.select(name("r", "r_regionkey").alias("node"))
    out = graph.traverse(place_edges(t), seeds, graph.BACKWARD, 2)
    return out.select("seed", "node", "distance", F.array_join("path", ">").alias("path"))


def use_edges(t: Tables) -> DataFrame:
    placed = link(t.orders, name("c", "o_custkey"), name("o", "o_orderkey"), "PLACES")
    return placed.unionByName(link(t.lineitem.select("l_orderkey", "l_partkey").distinct(), name("o", "l_orderkey"), name("p", "l_partkey"), "USES"))


@query("G2 A26", """
WITH p AS (SELECT DISTINCT 'p:' || l_partkey AS part, 'o:' || l_orderkey AS ord, l_orderkey FROM lineitem WHERE l_partkey % 50 = 0),
l2 AS (SELECT part, 'c:' || o_custkey AS node, min([part, ord, 'c:' || o_custkey]) AS path FROM p JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2)
SELECT part AS seed, part AS node, 0 AS distance, part AS path FROM (SELECT DISTINCT part FROM p UNION SELECT 'p:' || p_partkey FROM part WHERE p_partkey % 50 = 0)
UNION ALL SELECT part, ord, 1, part || '>' || ord FROM p UNION ALL SELECT part, node, 2, array_to_string(path, '>') FROM l2""")
def impact_paths(t: Tables) -> DataFrame:
    """Orders and customers behind every fiftieth part (the seeds) with the least shortest path."""
    seeds = t.part.where("p_partkey % 50 = 0").select(name("p", "p_partkey").alias("node"))
    out = graph.traverse(use_edges(t), seeds, graph.BACKWARD, 2)
    return out.select("seed", "node", "distance", F.array_join("path", ">").alias("path"))


@query("G6 R28", EDGES + """SELECT 'r:0' AS node, 0 AS distance UNION ALL SELECT src, 1 FROM e WHERE dst = 'r:0' UNION ALL SELECT e.src, 2 FROM e JOIN e f ON e.dst = f.src WHERE f.dst = 'r:0'""")
def closure(t: Tables) -> DataFrame:
    seeds = t.region.where("r_regionkey = 0").select(name("r", "r_regionkey").alias("node"))
    return graph.closure(place_edges(t), seeds)


@query("J38 G3", EDGES + """SELECT dst AS other, type, 'out' AS direction FROM e WHERE src = 'n:3' UNION ALL SELECT src, type, 'in' FROM e WHERE dst = 'n:3'""")
def one_hop_related(t: Tables) -> DataFrame:
    return graph.related(place_edges(t), "n:3").select("other", "type", "direction")


@query("G4 A15", EDGES + "SELECT type, count(*) AS n FROM e GROUP BY type")
def graph_stats(t: Tables) -> DataFrame:
    return graph_query.graph_query("stats", place_nodes(t), place_edges(t)).results


@query("G9 A16", EDGES + "SELECT dst AS node, string_agg(src, ',' ORDER BY src) AS neighbours FROM e GROUP BY dst")
def adjacency_lists(t: Tables) -> DataFrame:
    return graph.adjacency(place_edges(t)).select("node", F.array_join("neighbours", ",").alias("neighbours"))


@query("G9", EDGES + ", d AS (SELECT src AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) SELECT node, cast(sum(i) AS BIGINT) AS fan_in, cast(sum(o) AS BIGINT) AS fan_out FROM d GROUP BY node")
def degrees(t: Tables) -> DataFrame:
    return graph.degrees(place_edges(t))


@query("G5", """
SELECT 'o:' || o_orderkey AS seed, 'r:' || n_regionkey AS node, 3 AS distance, 'o:' || o_orderkey || '>c:' || o_custkey || '>n:' || c_nationkey || '>r:' || n_regionkey AS path
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderkey % 50 = 0""")
def shortest_path_per_pair(t: Tables) -> DataFrame:
    edges = place_edges(t).unionByName(link(t.orders, name("o", "o_orderkey"), name("c", "o_custkey"), "PLACED_BY"))
    sources = t.orders.where("o_orderkey % 50 = 0").select(name("o", "o_orderkey").alias("node"))
    targets = t.region.select(name("r", "r_regionkey").alias("node"))
    return graph.shortest_paths(edges, sources, targets, 3).select("seed", "node", "distance", F.array_join("path", ">").alias("path"))


@query("G2", EDGES + "SELECT DISTINCT 'r:' || n_regionkey AS seed FROM nation WHERE EXISTS (SELECT 1 FROM e WHERE e.dst = 'n:' || n_nationkey)")
def depth_limit_reached(t: Tables) -> DataFrame:
    """Regions whose impact goes on beyond depth 1."""
    seeds = t.region.select(name("r", "r_regionkey").alias("node"))
    reached = graph.traverse(place_edges(t), seeds, graph.BACKWARD, 1)
    return graph.depth_limited(place_edges(t), reached, graph.BACKWARD, 1)


@query("L5 G3", EDGES + """, l AS (SELECT dst AS node, 0 AS distance, [dst] AS path FROM e WHERE dst = 'r:1' GROUP BY dst UNION ALL SELECT src, 1, [dst, src] FROM e WHERE dst = 'r:1' UNION ALL SELECT e.src, 2, [f.dst, f.src, e.src] FROM e JOIN e f ON e.dst = f.src WHERE f.dst = 'r:1')
SELECT node, distance, (SELECT count(*) FROM l) > 40 AS truncated FROM l ORDER BY distance, path LIMIT 40""")
def capped_traversal(t: Tables) -> DataFrame:
    seeds = t.region.where("r_regionkey = 1").select(name("r", "r_regionkey").alias("node"))
    return graph.capped(graph.traverse(place_edges(t), seeds, graph.BACKWARD, 2), 40).select("node", "distance", "truncated")


@query("G12", """
SELECT 'n:' || n_nationkey || '>r:' || n_regionkey || '>IN_REGION' AS id, n_name || ' in_region ' || r_name AS text FROM nation JOIN region ON n_regionkey = r_regionkey""")
def explain_edges(t: Tables) -> DataFrame:
    edges = link(t.nation, name("n", "n_nationkey"), name("r", "n_regionkey"), "IN_REGION")
    return graph.explain(edges, place_nodes(t))


@query("G10 R51 A14", "SELECT 'p:' || l_partkey AS id, count(DISTINCT l_suppkey) AS n_evidence FROM lineitem GROUP BY 1")
def nodes_with_evidence(t: Tables) -> DataFrame:
    facts = t.lineitem.select(name("p", "l_partkey").alias("id"), F.lit("part").alias("kind"), name("p", "l_partkey").alias("name"), F.col("l_suppkey").alias("evidence"))
    return graph.build_nodes(facts).select("id", "n_evidence")


@query("J39 R50 F13", """
SELECT 'o:' || o_orderkey AS id, 'c:' || o_custkey AS node, 'dst' AS "end" FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def dangling_edges(t: Tables) -> DataFrame:
    """Order edges to customers that are no node once those without credit are left out."""
    edges = t.orders.select(name("o", "o_orderkey").alias("id"), name("o", "o_orderkey").alias("src"), name("c", "o_custkey").alias("dst"), F.lit("PLACED_BY").alias("type"))
    nodes = t.orders.select(name("o", "o_orderkey").alias("id")).unionByName(t.customer.where("c_acctbal > 0").select(name("c", "c_custkey").alias("id")))
    return graph.dangling(edges, nodes).select("id", "node", "end")


@query("F12", "SELECT count(*) AS matches, CASE count(*) WHEN 0 THEN 'missing' WHEN 1 THEN 'unique' ELSE 'ambiguous' END AS state, CASE WHEN count(*) = 1 THEN min('n:' || n_nationkey) END AS node FROM nation")
def ambiguous_selector(t: Tables) -> DataFrame:
    return graph.select_node(place_nodes(t), F.col("kind") == "nation")


@query("G7", """
WITH RECURSIVE inc AS (SELECT p_partkey AS f, 0 AS pos, (p_partkey * 2) % 33 AS target FROM part UNION ALL SELECT p_partkey, 1, (p_partkey * 3 + 1) % 33 FROM part),
x AS (SELECT 1::BIGINT AS f, [1::BIGINT] AS path, '' AS k, false AS cyc, 0 AS d UNION ALL
  SELECT inc.target, list_append(x.path, inc.target), x.k || inc.pos, list_contains(x.path, inc.target), d + 1 FROM x JOIN inc ON inc.f = x.f WHERE NOT x.cyc AND x.d < 6)
SELECT cast(f AS VARCHAR) AS file, k AS order_key, CASE WHEN cyc THEN 'cycle' ELSE 'open' END AS state FROM x""")
def include_expansion(t: Tables) -> DataFrame:
    """Ordered include expansion with cycles, six levels deep."""
    k = F.col("p_partkey")
    base = t.part
    inc = base.select(k.cast("string").alias("file"), F.lit(0).alias("pos"), ((k * 2) % 33).cast("string").alias("target"))
    inc = inc.unionAll(base.select(k.cast("string").alias("file"), F.lit(1).alias("pos"), ((k * 3 + 1) % 33).cast("string").alias("target")))
    return graph.include_order(inc, "1", 6).select("file", F.array_join(F.transform("order_key", lambda x: x.cast("string")), "").alias("order_key"), "state")


PATHS = r"""WITH u AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS path FROM pages) """


def url_paths(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "").alias("path"))


@query("J30 R16 R26", PATHS + r"""
SELECT page_id, path, CASE WHEN regexp_matches(path, '^[^/]+/[^/]+/') THEN regexp_extract(path, '^([^/]+/[^/]+)/', 1) ELSE regexp_extract(path, '^([^/]+)/', 1) END AS owner FROM u""")
def nearest_ancestor(t: Tables) -> DataFrame:
    """The deepest owning directory (host or host/language) above each page."""
    paths = url_paths(t)
    dirs = paths.select(F.explode(F.array(F.regexp_extract("path", "^([^/]+)/", 1), F.regexp_extract("path", "^([^/]+/[^/]+)/", 1))).alias("dir")).where("dir <> ''").distinct()
    return relational.nearest_ancestor(paths, "path", dirs.withColumn("owner", F.col("dir")), "dir", "owner").select("page_id", "path", "owner")


@query("J34 J29", """

WITH q AS (SELECT DISTINCT p_name AS name FROM part) SELECT p_partkey, coalesce(a.name, b.name) AS hit FROM part LEFT JOIN q a ON a.name = p_name || '.js' LEFT JOIN q b ON b.name = replace(p_name, 'small', 'red')""")
def first_candidate_lookup(t: Tables) -> DataFrame:
    """Local lookups with fallbacks: the first candidate that exists."""
    tries = F.array(F.concat("p_name", F.lit(".js")), F.regexp_replace("p_name", "small", "red"))
    rows = t.part.select("p_partkey", "p_name")
    return relational.first_candidate(rows, tries, t.part, "p_name").select("p_partkey", "hit")


@query("J33", "SELECT p.p_partkey, b.b AS prefix FROM part p JOIN (SELECT DISTINCT p_brand AS b FROM part WHERE p_brand IN ('Brand#1', 'Brand#2')) b ON p.p_brand = b.b OR starts_with(p.p_brand, b.b || '0')")
def prefix_alias(t: Tables) -> DataFrame:
    """Alias prefixes matched exactly or before a separator (here 0)."""
    alias = t.part.where("p_brand in ('Brand#1', 'Brand#2')").select(F.col("p_brand").alias("prefix"))
    return relational.prefix_alias(t.part.select("p_partkey", "p_brand"), "p_brand", alias, "prefix", "0").select("p_partkey", "prefix")


@query("J22 J35 G13 A18 A19 F5 G11", """
WITH p AS (SELECT p_partkey AS k, replace(p_name, ' ', '_') AS slug, replace(p_brand, '#', '_') AS s FROM part),
t AS (SELECT *, 'packages/' || slug || '/test/' || s || '/part_' || k || '.test.js' AS test FROM p WHERE k % 3 = 0), c AS (SELECT *, 'packages/' || slug || '/src/' || s || '/part_' || k || '.js' AS change FROM p WHERE k % 97 = 0),
x AS (SELECT test, change, CASE WHEN t.k = c.k THEN 5 WHEN t.k - c.k IN (1, 2) THEN 4 WHEN t.slug = c.slug AND t.s = c.s THEN 2 ELSE 1 END AS r FROM t JOIN c ON t.slug = c.slug UNION ALL SELECT test, change, CASE WHEN t.k = c.k THEN 5 ELSE 4 END FROM t JOIN c ON t.k - c.k = 0 OR t.k - c.k = 1 OR t.k - c.k = 2)
SELECT test, CASE WHEN max(r) >= 4 THEN 'high' ELSE 'low' END AS confidence, ['repository', 'package', 'directory', 'name', 'import', 'direct-import'][max(r) + 1] AS evidence, cast(count(DISTINCT change) AS INTEGER) AS n_changes, string_agg(DISTINCT change, ',' ORDER BY change) AS changes FROM x GROUP BY test""")
def plan_tests(t: Tables) -> DataFrame:
    """Tests for changed sources by import path, name, directory and package, ranked; each name is a package."""
    slug, k = F.regexp_replace("p_name", " ", "_"), F.col("p_partkey")
    root, brand = F.concat(F.lit("packages/"), slug), F.regexp_replace("p_brand", "#", "_")
    place = lambda side, end: F.concat("root", F.lit(f"/{side}/"), "s", F.lit("/part_"), k.cast("string"), F.lit(end))
    parts = t.part.select("p_partkey", brand.alias("s"), root.alias("root"))
    sources = parts.select("p_partkey", place("src", ".js").alias("path"), "s", "root")
    # Each source imports that of the part before, each test its own source.
    up = F.lit("../../../../")
    before = sources.select((k + 1).alias("p_partkey"), F.concat(up, F.regexp_replace("path", r"\.js$", "")).alias("asked"))
    source_files = sources.join(before, "p_partkey", "left").select("path", F.coalesce(F.concat(F.lit("import x from '"), "asked", F.lit("';\n")), F.lit("")).alias("body"))
    test_files = parts.where("p_partkey % 3 = 0").select(place("test", ".test.js").alias("path"), F.concat(F.lit("const x = require('"), up, place("src", ".js"), F.lit("');\n")).alias("body"))
    imports = project.import_graph(source_files.unionByName(test_files))
    tests, packages = test_files.select("path"), parts.select("root").distinct()
    changes = sources.where("p_partkey % 97 = 0").select("path")
    out = project.map_tests(changes, tests, imports, depth=3, packages=packages)
    return out.select("test", "confidence", "evidence", "n_changes", F.array_join("changes", ",").alias("changes"))


@query("R1 R2 R4 R6", """
WITH s AS (SELECT l_partkey AS symbol, l_orderkey AS rec, l_linenumber AS line, l_returnflag AS kind FROM lineitem), q AS (SELECT DISTINCT symbol FROM s JOIN part ON p_partkey = symbol WHERE p_name = 'red widget')
SELECT s.symbol, s.rec, s.line, s.kind FROM s JOIN q ON s.symbol = q.symbol WHERE s.kind <> 'N'""")
def symbol_records(t: Tables) -> DataFrame:
    """Name to symbols to all records that share the symbol, aliases (kind N) excluded."""
    named = t.part.where("p_name = 'red widget'").select(F.col("p_partkey").alias("symbol"))
    rows = t.lineitem.where("l_returnflag <> 'N'").select(F.col("l_partkey").alias("symbol"), F.col("l_orderkey").alias("rec"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("kind"))
    return rows.join(named, "symbol", "left_semi")


@query("R5 R48", EDGES + "SELECT f.src AS implementation, e.dst AS base FROM e JOIN e f ON f.dst = e.src WHERE e.type = 'IN_REGION' AND f.type = 'BASED_IN'")
def implementations(t: Tables) -> DataFrame:
    """Two heritage edges in a row."""
    e = place_edges(t)
    up = e.where("type = 'IN_REGION'").select(F.col("src").alias("mid"), F.col("dst").alias("base"))
    return e.where("type = 'BASED_IN'").select(F.col("src").alias("implementation"), F.col("dst").alias("mid")).join(up, "mid").select("implementation", "base")
