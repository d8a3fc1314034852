"""Project facts: test planning, frameworks, manifests, package managers, risk, schemas as data."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import import_specifiers, normal_path, package_manager, path_risk, purpose, stem, strip_comments
from tessera.staging import stage

from . import graph, relational
from .verdicts import severity_fold

#: Evidence kinds of a test for a change, weakest first.
EVIDENCE = ["repository", "package", "directory", "name", "import", "direct-import"]
CONFIDENCE = "case evidence_rank when 5 then 'high' when 4 then 'high' when 3 then 'medium' when 2 then 'low' when 1 then 'low' else 'fallback' end"


#: Endings tried for a local import, as such and as index files.
EXTENSIONS = [".ts", ".tsx", ".js", ".jsx", ".mts", ".cts", ".mjs", ".cjs"]


def import_graph(files: DataFrame) -> DataFrame:
    """(src, dst): static imports of files (path, body) that start with a dot, each resolved to the first existing
    candidate: the path as written, then (with .js, .jsx, .mjs or .cjs first without the ending) the bare path, the
    path with each ending, and its index files. Other specifiers and unresolved ones make no edge."""
    asked = files.select(F.col("path").alias("src"), F.explode(import_specifiers(strip_comments(F.col("body")))).alias("specifier")).where(F.col("specifier").startswith("."))
    base = normal_path(F.concat_ws("/", F.regexp_extract("src", "^(.*)/[^/]*$", 1), "specifier"))
    asked = asked.select("src", base.alias("base")).where("base is not null").distinct()
    bare = F.regexp_replace("base", r"\.[^./]*$", "")
    first = F.when(F.col("base").rlike(r"(?i)\.(js|jsx|mjs|cjs)$"), F.array(bare, "base")).otherwise(F.array("base", bare))
    ends = F.array(F.lit(""), *map(F.lit, EXTENSIONS), *(F.lit(f"/index{x}") for x in EXTENSIONS))
    tries = F.array_distinct(F.concat(F.array("base"), F.flatten(F.transform(first, lambda b: F.transform(ends, lambda e: F.concat(b, e))))))
    # A candidate is one of two names with an ending: files meet them under the names that they have without theirs, so that
    # two rows of an import travel instead of one for each candidate.
    ending = "(?:" + "|".join(x.replace(".", r"\.") for x in EXTENSIONS) + ")$"
    names = F.array_distinct(F.array("path", F.regexp_replace("path", ending, ""), F.regexp_replace("path", "/index" + ending, "")))
    known = files.select("path", F.explode(names).alias("_name"))
    met = asked.withColumn("_name", F.explode(F.array_distinct(F.array("base", bare)))).join(known, "_name")
    place = met.select("src", "base", F.array_position(tries, F.col("path")).alias("_place")).where("_place > 0")
    best = place.groupBy("src", "base").agg(F.min("_place").alias("_place"))
    return best.select("src", F.get(tries, F.col("_place").cast("int") - 1).alias("dst")).distinct()


def package_roots(paths: DataFrame, packages: DataFrame) -> DataFrame:
    """paths (path) with root: the deepest of packages (root) above each path, . where there is none."""
    roots = packages.select("root").where("root <> '.'").distinct()
    owned = relational.nearest_ancestor(paths.select("path").distinct(), "path", roots.withColumn("_own", F.col("root")).withColumnRenamed("root", "_dir"), "_dir", "_own")
    return owned.select("path", F.coalesce("owner", F.lit(".")).alias("root"))


def map_tests(changes: DataFrame, tests: DataFrame, imports: DataFrame, depth: int = 4, packages: DataFrame | None = None) -> DataFrame:
    """(test, confidence, evidence, evidence_rank, n_changes, changes): tests for changed paths.

    Imports come from a reverse traversal of the changes; name, directory and package matches are equi-joins with the
    gathered changes of each key, so changes and tests of one key never meet pair by pair; without any candidate all tests are returned as a fallback. packages (root)
    are the directories with a manifest, in which directories match too; without them no package is matched.
    """
    # Every level of the traversal reads the imports.
    imports = stage(imports.select("src", "dst"), "imports")
    edges = imports.select("src", "dst", F.concat_ws(">", "src", "dst").alias("id"), F.lit("IMPORTS").alias("type"))
    reached = graph.traverse(edges, changes.select(F.col("path").alias("node")), graph.BACKWARD, depth)
    by_import = reached.where("distance > 0").join(tests.select(F.col("path").alias("node")), "node", "left_semi").select(
        F.col("node").alias("test"), F.col("seed").alias("change"), F.when(F.col("distance") == 1, 5).otherwise(4).alias("rank")
    )
    folder = lambda c: F.regexp_replace(F.regexp_extract(c, "^(.*)/[^/]*$", 1), "^(src|lib|test|tests)/?", "")

    def tier(a: DataFrame, b: DataFrame, on: list[str], rank: int) -> DataFrame:
        """One row for each test: the changes of its key, gathered once a key."""
        gathered = a.groupBy(*on).agg(F.collect_set("path").alias("changes"))
        return b.join(gathered, on).select(F.col("path").alias("test"), "changes", F.lit(rank).alias("rank"))

    def keyed(rows: DataFrame, key: Column) -> DataFrame:
        return rows.select(key.alias("_k"), "path").where("_k <> ''")

    found = by_import.groupBy("test").agg(F.collect_set("change").alias("changes"), F.max("rank").alias("rank"))
    for key, rank in ((stem(F.col("path")), 3), (folder("path"), 2)):
        found = found.unionByName(tier(keyed(changes, key), keyed(tests, key), ["_k"], rank))
    if packages is not None:
        inner = F.when(F.col("root") == ".", F.col("path")).otherwise(F.expr("substring(path, length(root) + 2)"))
        own, other = (package_roots(x, packages).select("root", folder(inner).alias("_k"), "path") for x in (changes, tests))
        found = found.unionByName(tier(own, other, ["root"], 1)).unionByName(tier(own.where("_k <> ''"), other.where("_k <> ''"), ["root", "_k"], 2))
    # At most one row for each test and tier is left to be put together.
    out = found.groupBy("test").agg(F.max("rank").alias("evidence_rank"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("changes")))).alias("changes"))
    if not found.limit(1).count():
        out = tests.select(F.col("path").alias("test"), F.lit(0).alias("evidence_rank"), F.array().cast("array<string>").alias("changes"))
    label = F.get(F.array(*map(F.lit, EVIDENCE)), F.col("evidence_rank"))
    out = out.select("test", F.expr(CONFIDENCE).alias("confidence"), label.alias("evidence"), "evidence_rank", F.size("changes").alias("n_changes"), "changes")
    return out.orderBy(F.desc("evidence_rank"), "test")


#: Files that tell what is meant to be done, and how far it is.
GOALS = r"(?i)(^|/)(GOAL|ROADMAP|TASK|PROGRESS|EPIC)(\.md)?$"
PROGRESS = r"(?i)(^|/)(PROGRESS|TASK)(\.md)?$"


def project_query(nodes: DataFrame, edges: DataFrame, command: str, path: str | None = None, changed: DataFrame | None = None) -> DataFrame:
    """Nodes (id, path, kind, plane) that a project command asks for.

    evidence, tests-for, impact and context start from the nodes at or under `path` (all without one); impact and
    tests-for follow edges (src, dst, type) of types tests and imports backwards, as far as they go.
    """
    if path:
        under = path.rstrip("/") + "/"
        seeds = nodes.where((F.col("path") == path) | F.col("path").startswith(under))
    else:
        seeds = nodes
    if command == "context":
        return seeds
    if command == "evidence":
        return seeds.where("plane = 'evidence' or kind = 'test'")
    if command in ("impact", "tests-for"):
        edges = edges.select("src", "dst", "type", F.lit(None).cast("string").alias("id"))
        reached = graph.closure(edges, seeds.select(F.col("id").alias("node")), graph.BACKWARD, ["tests", "imports"])
        hit = nodes.join(reached.select(F.col("node").alias("id")), "id", "left_semi")
        return hit if command == "impact" else hit.where("kind = 'test'")
    if command == "changed":
        return nodes.limit(0) if changed is None else nodes.join(changed.select("path").distinct(), "path", "left_semi")
    if command in ("goals", "progress"):
        return nodes.where(F.col("path").rlike(GOALS if command == "goals" else PROGRESS))
    if command == "path-to-done":
        return nodes.where("kind = 'test'")
    raise ValueError(f"unknown command {command}")


def test_tiers(plan: DataFrame, weak: int = 2) -> dict[str, DataFrame]:
    """minimum: all equally strongest tests (one where they are weak); recommended: medium and up; release: all."""
    best = plan.agg(F.max("evidence_rank")).first()[0]
    top = plan.where(F.col("evidence_rank") == best) if best is not None else plan
    minimum = top if best is None or best > weak else top.orderBy("test").limit(1)
    return {"minimum": minimum, "recommended": plan.where(F.col("evidence_rank") >= 3), "release": plan}


def frameworks(manifests: DataFrame, configs: DataFrame, imports: DataFrame, known: DataFrame) -> DataFrame:
    """(path, framework, signals): frameworks by dependency, script command, config file and import."""
    deps = manifests.select("path", F.explode(F.from_json("body", "devDependencies map<string,string>")["devDependencies"]).alias("name", "version"))
    by_dep = deps.join(known, F.col("name") == F.col("package")).select("path", "framework", F.lit("dependency").alias("signal"))
    scripts = manifests.select("path", F.explode(F.from_json("body", "scripts map<string,string>")["scripts"]).alias("script", "command"))
    by_script = scripts.join(known, F.expr("command rlike concat('\\\\b', package, '\\\\b')")).select("path", "framework", F.lit("script").alias("signal"))
    by_config = configs.join(known, F.expr("file rlike concat('^', package, '\\\\.config\\\\.')")).select("path", "framework", F.lit("config").alias("signal"))
    by_import = imports.join(known, F.col("specifier") == F.col("package")).select("path", "framework", F.lit("import").alias("signal"))
    found = by_dep.unionByName(by_script).unionByName(by_config).unionByName(by_import)
    return found.groupBy("path", "framework").agg(F.array_sort(F.collect_set("signal")).alias("signals"))


def commands(manifests: DataFrame, managers: DataFrame) -> DataFrame:
    """(path, script, purpose, invocation): package scripts by purpose; invocation needs a known manager."""
    scripts = manifests.select("path", F.explode(F.from_json("body", "scripts map<string,string>")["scripts"]).alias("script", "command"))
    run = F.when(F.col("manager") == "npm", F.concat(F.lit("npm run "), F.col("script"))).when(F.col("manager").isNotNull(), F.concat_ws(" ", "manager", F.lit("run"), "script"))
    return scripts.join(managers, "path", "left").select("path", "script", purpose(F.col("script"), F.col("command")).alias("purpose"), run.alias("invocation"))


def missing_purposes(commands_: DataFrame, packages: DataFrame) -> DataFrame:
    """(path, purpose): packages without a build, test or lint script."""
    need = packages.select("path", F.explode(F.array(F.lit("build"), F.lit("test"), F.lit("lint"))).alias("purpose"))
    return need.join(commands_.select("path", "purpose"), ["path", "purpose"], "left_anti")


def managers(manifests: DataFrame, lockfiles: DataFrame) -> DataFrame:
    """(path, manager, confidence): a declaration against the families of lockfiles found beside it."""
    declared = manifests.select("path", package_manager(F.get_json_object("body", "$.packageManager"))["name"].alias("_d")).withColumn("_d", F.nullif("_d", F.lit("")))
    locks = lockfiles.groupBy("path").agg(F.array_sort(F.collect_set("family")).alias("_l"))
    joined = declared.join(locks, "path", "left").withColumn("_l", F.coalesce("_l", F.array().cast("array<string>")))
    one = F.size("_l") == 1
    manager = F.when(F.col("_d").isNotNull(), F.col("_d")).when(one, F.get("_l", F.lit(0)))
    confidence = (
        F.when(F.col("_d").isNotNull() & (F.size("_l") > 0) & ~F.array_contains("_l", F.col("_d")), "conflict").when(F.col("_d").isNotNull() & one, "high")
        .when(F.col("_d").isNotNull(), "medium").when(one, "medium").when(F.size("_l") > 1, "conflict").otherwise("unknown")
    )
    return joined.select("path", manager.alias("manager"), confidence.alias("confidence"))


def workspace_members(dirs: DataFrame, includes: list[str], excludes: list[str]) -> DataFrame:
    """Directories that a workspace pattern includes and none excludes."""
    hit = lambda patterns: F.lit(False) if not patterns else F.col("dir").rlike("|".join(relational.glob_to_regex(p) for p in patterns))
    return dirs.where(hit(includes) & ~hit(excludes))


def change_risk(changes: DataFrame, imports: DataFrame) -> DataFrame:
    """changes (path and more) with consumers and risk: by path, raised to high where many modules depend on it."""
    consumers = imports.groupBy(F.col("dst").alias("path")).agg(F.count_distinct("src").alias("_n"))
    joined = changes.join(consumers, "path", "left").withColumn("consumers", F.coalesce("_n", F.lit(0).cast("bigint")))
    own = path_risk(F.col("path"))
    risk = F.when(own.isin("critical", "high"), own).when(F.col("consumers") >= 10, "high").otherwise(own)
    return joined.select(*changes.columns, "consumers", risk.alias("risk"))


def entrypoints(exports: DataFrame, files: DataFrame) -> DataFrame:
    """(path, target, state): declared targets that exist, are missing, or are patterns and not checked."""
    known = files.select(F.col("path").alias("_file")).distinct().withColumn("_yes", F.lit(True))
    joined = exports.join(known, F.col("target") == F.col("_file"), "left")
    state = F.when(F.col("target").contains("*"), "not_checked").when(F.col("_yes"), "present").otherwise("missing")
    return joined.select("path", "target", state.alias("state"))


def flatten_exports(body: str) -> list[tuple[str, str]]:
    """(pointer, target) of a nested exports document, depth first."""
    out: list[tuple[str, str]] = []

    def walk(value, pointer: str) -> None:
        if isinstance(value, str):
            out.append((pointer, value))
        elif isinstance(value, dict):
            for k, v in value.items():
                walk(v, pointer + "/" + k.replace("~", "~0").replace("/", "~1"))
        elif isinstance(value, list):
            for i, v in enumerate(value):
                walk(v, f"{pointer}/{i}")

    walk(json.loads(body).get("exports"), "")
    return out


def schema_findings(before: DataFrame, after: DataFrame) -> DataFrame:
    """(pointer, keyword, finding) of two schemas flattened to (pointer, keyword, value JSON).

    type: narrowing is breaking, widening compatible, integer is a number; required: a new name is breaking;
    enum: a lost value is breaking; bounds: tightening is breaking; an unknown keyword that changed is unknown.
    """
    a = before.select("pointer", "keyword", F.col("value").alias("_a"))
    b = after.select("pointer", "keyword", F.col("value").alias("_b"))
    both = a.join(b, ["pointer", "keyword"], "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b")))
    many = lambda c: F.when(F.col(c).startswith("["), F.from_json(c, "array<string>")).when(F.col(c).isNotNull(), F.array(F.regexp_replace(c, '^"|"$', "")))
    number = lambda c: F.col(c).try_cast("double")
    accepted = F.forall(many("_a"), lambda x: F.exists(many("_b"), lambda y: (x == y) | ((x == "integer") & (y == "number"))))
    fewer = F.size(F.array_except(many("_a"), many("_b"))) > 0
    upper = F.col("keyword").isin("maximum", "exclusiveMaximum", "maxLength", "maxItems", "maxProperties")
    lower = F.col("keyword").isin("minimum", "exclusiveMinimum", "minLength", "minItems", "minProperties")
    bound = F.when(F.col("_b").isNull(), "compatible").when(F.col("_a").isNull(), "breaking").when(upper == (number("_b") < number("_a")), "breaking").otherwise("compatible")
    finding = (
        F.when(F.col("keyword").isin("title", "description", "examples", "default"), "compatible")
        .when(F.col("keyword").isin("type", "enum"), F.when(F.col("_b").isNull(), "compatible").when(F.col("_a").isNull(), "breaking").when(F.when(F.col("keyword") == "type", accepted).otherwise(~fewer), "compatible").otherwise("breaking"))
        .when(F.col("keyword") == "required", F.when(F.size(F.array_except(F.coalesce(many("_b"), F.array().cast("array<string>")), F.coalesce(many("_a"), F.array().cast("array<string>")))) > 0, "breaking").otherwise("compatible"))
        .when(upper | lower, bound)
        .when(F.col("keyword") == "additionalProperties", F.when(F.col("_b") == "false", "breaking").otherwise("compatible"))
        .when(F.col("keyword") == "property", F.when(F.col("_a").isNull(), "compatible").otherwise("breaking"))
        .otherwise("unknown")
    )
    return both.select("pointer", "keyword", finding.alias("finding"))


def contract_verdict(findings: DataFrame) -> DataFrame:
    """One row: breaking over unknown over compatible."""
    return findings.agg(severity_fold("finding", ["breaking", "unknown", "compatible"], "compatible").alias("verdict"))
