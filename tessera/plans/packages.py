"""Queries over package manifests, snapshots and records made of the tables."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import intervals, project, relational
from tessera.sources import files
from tessera.staging import shared_dir

from .registry import Tables, query


@query("J15", "SELECT l_orderkey, l_linenumber, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey")
def lookup_join(t: Tables) -> DataFrame:
    """Id lookup; the planner broadcasts the part side only while its measured size is small."""
    return t.lineitem.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey").select("l_orderkey", "l_linenumber", "p_brand")


def _manifests(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    dev = F.when(k % 3 == 0, '{"vitest":"1.0.0"}').when(k % 3 == 1, '{"jest":"29.0.0","eslint":"9.0.0"}').otherwise("{}")
    body = F.concat(F.lit('{"scripts":{"test":"'), F.when(k % 2 == 0, "vitest run").otherwise("node --test"), F.lit('"},"devDependencies":'), dev, F.lit(',"exports":{".":{"import":"./dist/i'), (k % 4).cast("string"), F.lit('.mjs"},"./x":"./src/*.js"}}'))
    return t.supplier.select(F.concat(F.lit("packages/p"), k.cast("string")).alias("path"), body.alias("body"), k.alias("k"))


@query("R12 R13", """
WITH s AS (SELECT 'packages/p' || s_suppkey AS path, s_suppkey AS k FROM supplier), f AS (
  SELECT path, 'vitest' AS framework, 'dependency' AS signal FROM s WHERE k % 3 = 0 UNION ALL SELECT path, 'jest', 'dependency' FROM s WHERE k % 3 = 1
  UNION ALL SELECT path, 'vitest', 'script' FROM s WHERE k % 2 = 0 UNION ALL SELECT path, 'jest', 'config' FROM s WHERE k % 5 = 0)
SELECT path, framework, string_agg(DISTINCT signal, ',' ORDER BY signal) AS signals FROM f GROUP BY 1, 2""")
def framework_signals(t: Tables) -> DataFrame:
    """Frameworks by dependency, script and config file, with the signals that speak for each."""
    m = _manifests(t)
    configs = m.where("k % 5 = 0").select("path", F.lit("jest.config.js").alias("file"))
    none = m.where("k < 0").select("path", F.lit("x").alias("specifier"))
    known = t.spark.createDataFrame([("vitest", "vitest"), ("jest", "jest")], "package string, framework string")
    return project.frameworks(m, configs, none, known).select("path", "framework", F.array_join("signals", ",").alias("signals"))


@query("R15", "SELECT 'packages/p' || s_suppkey AS path, 'test' AS script FROM supplier WHERE s_nationkey = 7")
def changed_package_commands(t: Tables) -> DataFrame:
    """Commands of packages that own a changed path."""
    changed = t.supplier.where("s_nationkey = 7").select(F.concat(F.lit("packages/p"), F.col("s_suppkey").cast("string")).alias("path"))
    commands = project.commands(_manifests(t), t.spark.createDataFrame([], "path string, manager string"))
    return relational.supported(commands, changed, ["path"]).select("path", "script")


@query("R19", """
SELECT event_id, CASE WHEN event_type NOT IN ('view', 'click') THEN 'unknown_format' WHEN event_id % 17 = 0 THEN 'bad_version' WHEN event_type = 'view' THEN 'accepted'
  WHEN m < 5 OR m = 5 AND event_id % 3 = 0 THEN 'too_old' WHEN m < 10 OR m = 10 AND event_id % 3 = 0 THEN 'deprecated' WHEN m < 12 OR m = 12 AND event_id % 3 = 0 THEN 'accepted' ELSE 'too_new' END AS gate
FROM (SELECT *, event_id % 20 AS m FROM events)""")
def evidence_gates(t: Tables) -> DataFrame:
    """Outside evidence (events by type and a version made of the id) against a table of version gates; every third version
    is a prerelease, which comes before its release."""
    minor = (F.col("event_id") % 20).cast("string")
    version = F.when(F.col("event_id") % 17 == 0, "latest").otherwise(F.concat(F.lit("1."), minor, F.when(F.col("event_id") % 3 == 0, ".0-rc.1").otherwise(".0")))
    gates = [("view", "0.1.0", None, "accepted"), ("click", "1.5.0", "1.10.0", "deprecated"), ("click", "1.10.0", "1.12.0", "accepted")]
    table = t.spark.createDataFrame(gates, "format string, lowest string, below string, state string")
    return relational.gated(t.events.select("event_id", F.col("event_type").alias("format"), version.alias("version")), table).select("event_id", "gate")


#: Parts are files in directories of their brand; each imports the part before, in chains of ten; every third has a test.
PROJECT = """WITH RECURSIVE n AS (
  SELECT 'part:' || p_partkey AS id, 'src/' || replace(p_brand, '#', '_') || '/part_' || p_partkey || '.js' AS path, 'source' AS kind, 'code' AS plane FROM part
  UNION ALL SELECT 'test:' || p_partkey, 'test/part_' || p_partkey || '.test.js', 'test', 'evidence' FROM part WHERE p_partkey % 3 = 0
  UNION ALL SELECT 'goal:' || p_brand, 'src/' || replace(p_brand, '#', '_') || '/GOAL.md', 'doc', 'intent' FROM (SELECT DISTINCT p_brand FROM part)
  UNION ALL SELECT 'progress:' || p_brand, 'src/' || replace(p_brand, '#', '_') || '/PROGRESS.md', 'doc', 'intent' FROM (SELECT DISTINCT p_brand FROM part)
), e AS (
  SELECT 'part:' || p_partkey AS src, 'part:' || (p_partkey - 1) AS dst, 'imports' AS type FROM part WHERE p_partkey % 10 <> 1
  UNION ALL SELECT 'test:' || p_partkey, 'part:' || p_partkey, 'tests' FROM part WHERE p_partkey % 3 = 0
), hit(id) AS (SELECT id FROM n WHERE path = 'src/Brand_1' OR starts_with(path, 'src/Brand_1/') UNION SELECT e.src FROM hit JOIN e ON e.dst = hit.id) """


def project_tables(t: Tables) -> tuple[DataFrame, DataFrame]:
    k, folder = F.col("p_partkey").cast("string"), F.concat(F.lit("src/"), F.regexp_replace("p_brand", "#", "_"))
    node = lambda rows, id_, path, kind, plane: rows.select(id_.alias("id"), path.alias("path"), F.lit(kind).alias("kind"), F.lit(plane).alias("plane"))
    tested, brands = t.part.where("p_partkey % 3 = 0"), t.part.select("p_brand").distinct()
    part, test = F.concat(F.lit("part:"), k), F.concat(F.lit("test:"), k)
    nodes = node(t.part, part, F.concat(folder, F.lit("/part_"), k, F.lit(".js")), "source", "code")
    nodes = nodes.unionByName(node(tested, test, F.concat(F.lit("test/part_"), k, F.lit(".test.js")), "test", "evidence"))
    for name in ("goal", "progress"):
        nodes = nodes.unionByName(node(brands, F.concat(F.lit(name + ":"), "p_brand"), F.concat(folder, F.lit(f"/{name.upper()}.md")), "doc", "intent"))
    before = F.concat(F.lit("part:"), (F.col("p_partkey") - 1).cast("string"))
    edges = t.part.where("p_partkey % 10 <> 1").select(part.alias("src"), before.alias("dst"), F.lit("imports").alias("type"))
    return nodes, edges.unionByName(tested.select(test.alias("src"), part.alias("dst"), F.lit("tests").alias("type")))


def asked_of_project(t: Tables, command: str) -> DataFrame:
    return project.project_query(*project_tables(t), command, "src/Brand_1").select("id", "path")


@query("R28 F14", PROJECT + "SELECT id, path FROM n JOIN hit USING (id)")
def project_impact(t: Tables) -> DataFrame:
    """All files that import or test a directory's, however indirectly, and the directory itself."""
    return asked_of_project(t, "impact")


@query("R28", PROJECT + "SELECT id, path FROM n JOIN hit USING (id) WHERE kind = 'test'")
def project_tests_for(t: Tables) -> DataFrame:
    return asked_of_project(t, "tests-for")


@query("R28", PROJECT + "SELECT id, path FROM n WHERE kind = 'test'")
def project_path_to_done(t: Tables) -> DataFrame:
    return asked_of_project(t, "path-to-done")


@query("R28", PROJECT + "SELECT id, path FROM n WHERE id LIKE 'goal:%' OR id LIKE 'progress:%'")
def project_goals(t: Tables) -> DataFrame:
    return asked_of_project(t, "goals")


@query("R28", PROJECT + "SELECT id, path FROM n WHERE id LIKE 'progress:%'")
def project_progress(t: Tables) -> DataFrame:
    return asked_of_project(t, "progress")


@query("R47", """
SELECT o_custkey, bool_or(o_orderpriority LIKE '1-%') AS configuration, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS symbols FROM orders GROUP BY 1""")
def change_seeds(t: Tables) -> DataFrame:
    """Seeds of a change: a configuration override and the sorted symbols touched."""
    return t.orders.groupBy("o_custkey").agg(F.bool_or(F.col("o_orderpriority").rlike("^1-")).alias("configuration"), F.array_join(F.array_sort(F.collect_set("o_orderstatus")), ",").alias("symbols"))


@query("R54 R55", """
SELECT 'packages/p' || s_suppkey AS path, './dist/i' || (s_suppkey % 4) || '.mjs' AS target, CASE WHEN s_suppkey % 4 < 2 THEN 'present' ELSE 'missing' END AS state FROM supplier
UNION ALL SELECT 'packages/p' || s_suppkey, './src/*.js', 'not_checked' FROM supplier""")
def entrypoint_states(t: Tables) -> DataFrame:
    """Nested exports flattened to targets, and whether the files are there."""

    def flat(batches):
        for pdf in batches:
            rows = [(p, pointer, target) for p, body in zip(pdf["path"], pdf["body"]) for pointer, target in project.flatten_exports(body)]
            yield pd.DataFrame(rows, columns=["path", "pointer", "target"])

    exports = _manifests(t).select("path", "body").mapInPandas(flat, "path string, pointer string, target string")
    here = t.spark.createDataFrame([("./dist/i0.mjs",), ("./dist/i1.mjs",)], "path string")
    return project.entrypoints(exports, here)


@query("R59 R9", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(100 + l_linenumber AS INTEGER) AS start, cast(least(100 + l_linenumber + 5, 106) AS INTEGER) AS stop FROM lineitem")
def rebased_ranges(t: Tables) -> DataFrame:
    """Embedded ranges moved to their host's offsets and cut at its end."""
    start = (F.col("l_linenumber") + 100).cast("int")
    first, last, _ = intervals.clamp(start, start + 5, F.lit(106))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", first.alias("start"), last.alias("stop"))


@query("S5 S6 S18", """
WITH h AS (SELECT source AS path, string_agg(sha256(text), '' ORDER BY doc_id) AS d FROM documents WHERE doc_id % 2 = 0 GROUP BY 1), w AS (SELECT source AS path, string_agg(sha256(text), '' ORDER BY doc_id) AS d FROM documents WHERE doc_id % 2 = 0 OR source = 'src3' GROUP BY 1)
SELECT coalesce(h.path, w.path) AS path, CASE WHEN h.path IS NULL THEN 'added' WHEN w.path IS NULL THEN 'removed' WHEN h.d = w.d THEN 'same' ELSE 'changed' END AS change FROM h FULL JOIN w ON h.path = w.path""")
def revision_compare(t: Tables) -> DataFrame:
    """Two revisions given as (path, digest) tables."""

    def revision(cond: str) -> DataFrame:
        rows = t.documents.where(cond).select(F.col("source").alias("path"), "doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("d"))
        listed = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "d"))), lambda x: x["d"])
        return rows.groupBy("path").agg(F.array_join(listed, "").alias("d"))

    return relational.full_compare(revision("doc_id % 2 = 0"), revision("doc_id % 2 = 0 or source = 'src3'"), "path", "d")


@query("S7 S16 S19", "SELECT r_regionkey AS k, r_name AS name FROM region UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 0")
def json_round_trip(t: Tables) -> DataFrame:
    """Records appended to a log in two batches, written as JSON lines, and read back with a strict schema."""
    base = f"{shared_dir(t.spark)}/tessera-json-{uuid.uuid4().hex}"
    files.append_events(t.region.select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name")), f"{base}/log")
    files.append_events(t.nation.where("n_regionkey = 0").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")), f"{base}/log")
    files.json_lines(t.spark.read.parquet(f"{base}/log"), f"{base}/lines")
    return files.strict_json(t.spark, f"{base}/lines", T.StructType([T.StructField("k", T.IntegerType()), T.StructField("name", T.StringType())]))
