"""Operators on hand-computed fixtures: cycles, ties, ambiguity, caps, permutations, empty input."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import structured, text
from tessera.operators import graph, intervals, ordered, packs, project, relational, sets, verdicts
from tessera.sources import diffs, files, logs, markup, sqltext
from tessera.streaming import Cursor, page


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns or df.columns).collect()), key=str)


@pytest.fixture(scope="module")
def edges(spark):
    """a>b>c>d, a diamond a>x>c, a cycle d>a, a self-loop b>b and parallel edges a>b of two types."""
    data = [("1", "a", "b", "CALLS"), ("2", "b", "c", "CALLS"), ("3", "c", "d", "CALLS"), ("4", "a", "x", "CALLS"), ("5", "x", "c", "CALLS"), ("6", "d", "a", "CALLS"), ("7", "b", "b", "CALLS"), ("8", "a", "b", "INCLUDES")]
    return spark.createDataFrame(data, "id string, src string, dst string, type string")


def seeds(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def test_traverse_diamond_cycle_and_self_loop(spark, edges):
    for frame in (edges, edges.repartition(5).orderBy(F.desc("id"))):
        out = graph.traverse(frame, seeds(spark, "a"), graph.FORWARD, None)
        got = {r.node: (r.distance, r.path, r.via) for r in out.collect()}
        assert got["c"] == (2, ["a", "b", "c"], "2") and got["d"][0] == 3 and set(got) == {"a", "b", "c", "d", "x"}
        assert got["b"][2] == "1"


def test_traverse_depth_is_per_seed(spark, edges):
    out = graph.traverse(edges, seeds(spark, "c", "d"), graph.BACKWARD, 1)
    assert rows(out, "seed", "node", "distance") == [("c", "b", 1), ("c", "c", 0), ("c", "x", 1), ("d", "c", 1), ("d", "d", 0)]
    assert rows(graph.depth_limited(edges, out, graph.BACKWARD, 1)) == [("c",), ("d",)]
    assert rows(graph.traverse(edges, seeds(spark, "a"), graph.FORWARD, 3, ["INCLUDES"]), "node") == [("a",), ("b",)]


def test_caps_flag_truncation(spark, edges):
    out = graph.traverse(edges, seeds(spark, "a"), graph.FORWARD, None)
    assert rows(graph.capped(out, 5), "truncated") == [(False,)] * 5
    assert rows(graph.capped(out, 4), "truncated") == [(True,)] * 4


def test_related_self_loop_and_closure(spark, edges):
    got = rows(graph.related(edges, "b"), "other", "id", "direction")
    assert got == [("a", "1", "in"), ("a", "8", "in"), ("b", "7", "self"), ("c", "2", "out")]
    assert rows(graph.closure(edges, seeds(spark, "c")), "node") == [("a",), ("b",), ("c",), ("d",), ("x",)]
    assert graph.closure(edges, seeds(spark, "c").where("node = 'no'")).count() == 0


def test_node_selection_and_dangling(spark, edges):
    nodes = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "B")], "id string, name string")
    assert rows(graph.select_node(nodes, F.col("name") == "A")) == [(1, "unique", "a")]
    assert rows(graph.select_node(nodes, F.col("name") == "B"))[0][1] == "ambiguous"
    assert rows(graph.select_node(nodes, F.col("name") == "Z")) == [(0, "missing", None)]
    assert {r[1] for r in rows(graph.dangling(edges, nodes), "id", "node")} == {"d", "x"}


def test_include_cycle(spark):
    inc = spark.createDataFrame([("m", 0, "n"), ("m", 1, "o"), ("n", 0, "m")], "file string, pos int, target string")
    got = rows(graph.include_order(inc, "m").orderBy("order_key"), "file", "order_key", "state")
    assert got == sorted([("m", [], "open"), ("n", [0], "open"), ("m", [0, 0], "cycle"), ("o", [1], "open")], key=str)


def test_latest_per_key_ties(spark):
    data = [("k", 1, 10, "x"), ("k", 2, 10, "y"), ("m", 3, 10, "x"), ("m", 4, 10, "x"), ("m", 5, 9, "z"), ("n", 6, 1, None), ("n", 7, 1, "x")]
    frame = spark.createDataFrame(data, "key string, id int, at int, sig string")
    got = rows(verdicts.latest_per_key(frame, ["key"], "at", "id", ["sig"]), "key", "id", "state")
    assert got == [("k", 1, "inconsistent"), ("m", 3, "ok"), ("n", 6, "inconsistent")]


def test_folds_on_empty_input(spark):
    frame = spark.createDataFrame([("a", "pass"), ("a", "unknown"), ("b", "fail"), ("b", "unknown"), ("c", "pass")], "k string, s string")
    assert rows(frame.groupBy("k").agg(verdicts.fold("s"))) == [("a", "unknown"), ("b", "fail"), ("c", "pass")]
    none = frame.where("k = 'z'")
    assert none.agg(verdicts.fold("s")).first()[0] == "unknown" and none.agg(verdicts.fold("s", "pass")).first()[0] == "pass"


def test_status_merge(spark):
    data = [("p", 1, "A"), ("p", 2, "M"), ("q", 1, "A"), ("q", 2, "D"), ("r", 1, "D"), ("r", 2, "A"), ("s", 1, "M"), ("s", 2, "D")]
    frame = spark.createDataFrame(data, "path string, n int, kind string").repartition(3)
    assert rows(verdicts.status_merge(frame, "path", "n", "kind")) == [("p", "A"), ("r", "M"), ("s", "D")]


def test_division_and_membership(spark):
    pairs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "a"), (3, "b"), (3, "c")], "k int, m string")
    assert rows(relational.division(pairs, "k", "m", spark.createDataFrame([("a",), ("b",)], "m string"))) == [(1,), (3,)]
    other = spark.createDataFrame([(1, "b"), (1, "a"), (2, "z")], "k int, m string")
    assert rows(sets.membership_equal(pairs, other, "k", "m")) == [(1, True), (2, False), (3, False)]


def test_nearest_ancestor_ambiguity(spark):
    paths = spark.createDataFrame([("a/b/c.x",), ("a/z.x",), ("q/r.x",), ("d/e/f.x",)], "path string")
    owners = spark.createDataFrame([("a", "A"), ("a/b", "B"), ("d/e", "D1"), ("d/e", "D2"), ("d", "D0")], "dir string, owner string")
    got = rows(relational.nearest_ancestor(paths, "path", owners, "dir", "owner"))
    assert got == [("a/b/c.x", "B"), ("a/z.x", "A"), ("d/e/f.x", None), ("q/r.x", None)]


def test_pages_at_their_limits(spark):
    frame = spark.range(1, 6).toDF("k")
    assert [r.more for r in relational.keyset_page(frame, "k", 2, 3).collect()] == [False] * 3
    assert [r.more for r in relational.keyset_page(frame, "k", 2, 2).collect()] == [True] * 2
    log = spark.range(1, 11).selectExpr("id as event_id", "id % 2 as odd")
    got, cursor = page(log, Cursor("p", "h", 0, 10), 4, F.col("odd") == 0)
    assert [r.event_id for r in got.collect()] == [2, 4] and cursor.after == 4
    got, cursor = page(log, Cursor("p", "h", 8, 10), 4)
    assert [r.event_id for r in got.collect()] == [9, 10] and cursor.after == 10
    with pytest.raises(ValueError):
        cursor.check("p", "other")


def test_globs():
    import re

    rules = {"src/*.js": ("src/a.js", "src/b/a.js"), "**/x/?.ts": ("a/b/x/q.ts", "a/x/qq.ts"), "a/**": ("a/b/c", "b/a"), "a.b": ("a.b", "axb")}
    for pattern, (yes, no) in rules.items():
        assert re.match(relational.glob_to_regex(pattern), yes) and not re.match(relational.glob_to_regex(pattern), no)


def test_layered_rules_last_match_wins(spark):
    paths = spark.createDataFrame([("a/b",), ("a/keep",), ("c",)], "path string")
    rules = spark.createDataFrame([("^a/", True, 1), ("keep$", False, 2)], "pattern string, ignored boolean, rule_order int")
    assert rows(relational.layered_rules(paths, rules)) == [("a/b", True), ("a/keep", False), ("c", False)]


def test_intervals(spark):
    s = spark.createDataFrame([(1, "f", 1, 100), (2, "f", 10, 50), (3, "f", 20, 30), (4, "f", 20, 30), (5, "g", 1, 5)], "id int, path string, start int, end int")
    assert rows(intervals.parents(s, ["path"], 16, "id"), "id", "parent") == [(1, None), (2, 1), (3, 2), (4, 2), (5, None)]
    points = spark.createDataFrame([("f", 25, 25), ("f", 60, 70), ("f", 101, 101)], "path string, start int, end int")
    assert rows(intervals.smallest_container(points, s, ["path"], 16, "id"), "start", "container") == [(101, None), (25, 3), (60, 1)]
    got = intervals.overlap_pairs(s, s, ["path"], 7).where("l_id < r_id")
    assert rows(got, "l_id", "r_id") == [(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4)]


def test_rectangles_touching_do_not_overlap(spark):
    box = lambda *v: [F.lit(float(x)) for x in v]
    one = spark.range(1)
    check = lambda a, b, tol=0.0: one.select(intervals.rectangle_overlap(box(*a), box(*b), tol)).first()[0]
    assert not check((0, 0, 10, 10), (10, 0, 5, 5)) and check((0, 0, 10, 10), (9, 9, 5, 5)) and not check((0, 0, 10, 10), (9, 9, 5, 5), 1.0)


def test_median_takes_the_upper_middle(spark):
    frame = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("a", 4), ("b", 5), ("b", 5), ("b", 9)], "k string, v int")
    assert rows(sets.median_floor(frame, ["k"], "v")) == [("a", 3), ("b", 5)]


def test_greedy_pack_cases():
    item = lambda i, b, p=0, m=False, d=None, loc=(): {"id": i, "bytes": b, "priority": p, "mandatory": m, "sha256": d or str(i), "locators": list(loc)}
    out = {r[0]: r[2:4] for r in packs.pack_items([item(1, 60, m=True), item(2, 40, 5), item(3, 1, 4), item(4, 9, 9, d="1")], 100)}
    assert out == {1: ("included", None), 2: ("included", None), 3: ("omitted", "budget"), 4: ("omitted", "duplicate-artifact")}
    inside = [item(1, 5, 2, loc=[{"path": "f", "start": 1, "end": 9}]), item(2, 5, 1, loc=[{"path": "f", "start": 2, "end": 3}])]
    assert packs.pack_items(inside[::-1], 100) == packs.pack_items(inside, 100)
    assert packs.pack_items(inside, 100)[1][3] == "duplicate-locator"
    assert {r[3] for r in packs.pack_items([item(1, 200, m=True)], 100)} == {"mandatory-overflow"}


def test_log_diagnostics(spark):
    lines = ["src/a.ts(3,7): error TS1005: ';' expected.", "src/b.ts", "  4:2  warning  Unused  no-unused", " FAIL test/x.test.ts", "  ● first case", "    at run (test/x.test.ts:12:5)", "  ● second case"]
    frame = spark.createDataFrame([("log", i, x) for i, x in enumerate(lines)] + [("other", 0, "lib/q.c:9:1: error: bad")], "artifact string, seq int, line string")
    got = rows(logs.diagnostics(frame), "producer", "file", "line", "col")
    assert got == sorted([("compiler", "src/a.ts", 3, 7), ("lint", "src/b.ts", 4, 2), ("test", "test/x.test.ts", 12, 5), ("test", "test/x.test.ts", None, None), ("generic", "lib/q.c", 9, 1)], key=str)
    twice = logs.merged(logs.diagnostics(frame).unionByName(logs.diagnostics(frame)))
    assert twice.count() == 5


def test_structured_reports_reject_rows(spark):
    body = '[{"severity":"error","message":"m","line":1},{"severity":"odd","message":"n"},{"severity":"info"}]'
    ok, bad = logs.structured_rows(spark.createDataFrame([("a", body), ("b", "not json")], "artifact string, body string"))
    assert ok.count() == 1 and rows(bad) == [("a", 1, "INVALID_ROW"), ("a", 2, "INVALID_ROW"), ("b", -1, "INVALID_JSON")]


DIFF = """diff --git a/src/a.js b/src/a.js
--- a/src/a.js
+++ b/src/a.js
@@ -1,3 +1,4 @@
 one
+two secret
+three
-gone
 four
@@ -10 +11,2 @@
+ten
 eleven
diff --git a/old.md b/new.md
similarity index 90%
rename from old.md
rename to new.md
diff --git a/bin.dat b/bin.dat
Binary files a/bin.dat and b/bin.dat differ"""


def test_diffs(spark):
    lines = diffs.diff_lines(spark.createDataFrame([("d", DIFF)], "diff_id string, text string"))
    assert rows(lines.where("kind = 'add'"), "new_line", "text") == [(11, "ten"), (2, "two secret"), (3, "three")]
    assert rows(lines.where("kind = 'del'"), "old_line", "text") == [(2, "gone")]
    assert rows(diffs.file_summary(lines), "file", "change", "added", "deleted") == [("bin.dat", "binary", 0, 0), ("new.md", "renamed", 0, 0), ("src/a.js", "modified", 3, 1)]
    assert rows(diffs.changed_ranges(lines), "start", "end") == [(11, 11), (2, 3)]
    table = lambda data, ddl: spark.createDataFrame(data, ddl)
    got = diffs.policy_findings(lines, table([("old.md",)], "selector string"), table([("s", "secret", "error")], "rule string, needle string, severity string"), table([("s", "src/")], "rule string, selector string"), 2)
    assert rows(got, "rule", "file", "excepted") == [("protected-path", "new.md", False), ("s", "src/a.js", True), ("too-many-lines", "src/a.js", False)]


def test_markup(spark):
    html = "<table><tr><td>x</table><ul></ul><ul><li>a<li>b</ul><div><li>c</div><table><colgroup><col></colgroup></table>"
    nodes = markup.elements(spark.createDataFrame([(1, html), (2, None)], "i long, h string"), "i", "h")
    assert markup.missing_children(nodes, "table", "colgroup").count() == 1
    assert markup.missing_children(nodes, "ul", "li").count() == 1
    assert markup.misplaced_children(nodes, "li", ["ul", "ol"]).count() == 1
    assert markup.unbalanced("a(b]c") == [("(", 1), ("]", 3)] and markup.unbalanced("'('") == []
    assert markup.unclosed_tags("<a><b></a><br>") == ["b"] and markup.unclosed_tags("</i>x") == ["/i"]


def test_sql_text():
    names = sqltext.table_names("WITH a AS (SELECT * FROM x.y) SELECT * FROM a, b c JOIN \"d\" ON 1=1 WHERE z IN (SELECT q FROM e) -- FROM no")
    assert names == ["x.y", "b", "d", "e"]
    assert sqltext.table_names("DELETE FROM t1") == ["t1"] and sqltext.table_names("INSERT INTO t2 (a) VALUES (1)") == ["t2"] and sqltext.table_names("UPDATE [t 3] SET a = 1") == ["t 3"]
    assert sqltext.statements("select 1; select ';'\nGO\nselect 2") == ["select 1", "select ';'", "select 2"]


def test_versions():
    yes = [("1.2.3", "^1.2.0"), ("0.2.5", "^0.2.1"), ("18.0.0", ">=18 <23"), ("v20.1.0", "18.x || >=20"), ("3.1.4", "*"), ("1.5.0", "1.2.0 - 1.6.0"), ("1.0.0-beta.2", ">=1.0.0-beta.1")]
    no = [("2.0.0", "^1.2.0"), ("0.3.0", "^0.2.1"), ("1.0.0-beta", ">=1.0.0"), ("1.3.0", "~1.2.3")]
    assert all(structured.satisfies(v, r) for v, r in yes) and not any(structured.satisfies(v, r) for v, r in no)
    assert structured.satisfies("junk", "*") is None and structured.satisfies("1.0.0", None) is None


def test_pointers_and_json(spark):
    doc = '{"a/b":{"~":[1,{"c":null}]},"z":1}'
    assert structured.pointer(doc, "/a~1b/~0/0") == "1" and structured.pointer(doc, "/a~1b/~0/1/c") == "null" and structured.pointer(doc, "/q") is None
    frame = spark.createDataFrame([('{"b":1, "a":2}',), ('{"a":1,"a":2}',), ("x",), (None,)], "j string")
    assert [r[0] for r in frame.select(structured.canonical_json("j")).collect()] == ['{"a":2,"b":1}', None, None, None]


def test_evidence_arrays_hold_ids(spark):
    doc = '{"a":[{"evidence":["t:z","t:a","t:z",3]},{"b":{"evidence":["t:m"]}}],"evidence":"kept","c":{"evidence":[]}}'
    want = '{"a":[{"evidence":["ev-000001","ev-000003"]},{"b":{"evidence":["ev-000002"]}}],"evidence":"kept","c":{"evidence":[]}}'
    frame = spark.createDataFrame([(doc,), ("x",), (None,)], "j string")
    assert [r[0] for r in frame.select(structured.evidence_rewritten("j")).collect()] == [want, None, None]


def test_text_functions(spark):
    frame = spark.createDataFrame([("token=abc123 x", "a/./b//../c", "../up", "src/user.test.ts", "\x1b[31mred\x1b[0m\r\nend")], "t string, p string, u string, f string, a string")
    got = frame.select(text.redact(F.col("t")), text.normal_path(F.col("p")), text.normal_path(F.col("u")), text.stem(F.col("f")), text.strip_ansi(F.col("a")), text.file_kind(F.col("f"))).first()
    assert tuple(got) == ("token=[REDACTED] x", "a/c", None, "user", "red\nend", "test")


def test_project_plans(spark):
    table = lambda data, ddl: spark.createDataFrame(data, ddl)
    changes, tests = table([("src/a.js",), ("src/util/b.js",)], "path string"), table([("test/a.test.js",), ("test/util/z.test.js",), ("test/q.test.js",)], "path string")
    imports = table([("test/q.test.js", "src/m.js"), ("src/m.js", "src/a.js")], "src string, dst string")
    got = rows(project.map_tests(changes, tests, imports), "test", "evidence")
    assert got == [("test/a.test.js", "name"), ("test/q.test.js", "import"), ("test/util/z.test.js", "directory")]
    none = project.map_tests(table([("other/zzz.py",)], "path string"), tests, imports.where("src = 'no'"))
    assert {r.confidence for r in none.collect()} == {"fallback"} and none.count() == 3
    plan = project.test_tiers(project.map_tests(changes, tests, imports))
    assert rows(plan["minimum"], "test") == [("test/q.test.js",)] and plan["release"].count() == 3


def test_tests_of_the_same_package(spark):
    table = lambda data, ddl: spark.createDataFrame(data, ddl)
    changes = table([("packages/a/src/x.js",), ("packages/c/src/u/y.js",), ("tool.js",)], "path string")
    tests = table([(p,) for p in ("packages/a/spec/other.test.js", "packages/a/b/spec/deep.test.js", "packages/c/test/u/z.test.js", "packages/d/spec/no.test.js", "spec/top.test.js")], "path string")
    packages, none = table([("packages/a",), ("packages/a/b",), ("packages/c",), ("packages/d",)], "root string"), table([], "src string, dst string")
    got = rows(project.map_tests(changes, tests, none, packages=packages), "test", "evidence", "confidence")
    assert got == [("packages/a/spec/other.test.js", "package", "low"), ("packages/c/test/u/z.test.js", "directory", "low"), ("spec/top.test.js", "package", "low")]


def test_import_graph_resolves_specifiers(spark):
    files = {
        "a/x.js": "import y from './y';\nimport z from '../z.js';\nconst l = require('lib');\n// import n from './n'\n",
        "a/y/index.ts": "export * from '../x.js'", "z.ts": "const a = require('./a/x');\nimport q from './missing'", "z.js": "", "a/n.js": "import u from '../../up'",
    }
    got = rows(project.import_graph(spark.createDataFrame(list(files.items()), "path string, body string")), "src", "dst")
    assert got == [("a/x.js", "a/y/index.ts"), ("a/x.js", "z.js"), ("a/y/index.ts", "a/x.js"), ("z.ts", "a/x.js")]


def test_manifests(spark):
    table = lambda data, ddl: spark.createDataFrame(data, ddl)
    m = table([("p", '{"packageManager":"pnpm@8.0.0","scripts":{"build":"tsc","t":"vitest"},"devDependencies":{"vitest":"1"}}'), ("q", "{}")], "path string, body string")
    locks = table([("p", "yarn"), ("q", "npm")], "path string, family string")
    assert rows(project.managers(m, locks)) == [("p", "pnpm", "conflict"), ("q", "npm", "medium")]
    commands = project.commands(m, table([("p", "pnpm")], "path string, manager string"))
    assert rows(commands, "script", "purpose", "invocation") == [("build", "build", "pnpm run build"), ("t", "test", "pnpm run t")]
    assert rows(project.missing_purposes(commands, m.select("path"))) == [("p", "lint"), ("q", "build"), ("q", "lint"), ("q", "test")]
    known = table([("vitest", "vitest")], "package string, framework string")
    found = project.frameworks(m, table([("p", "vitest.config.ts")], "path string, file string"), table([("p", "vitest")], "path string, specifier string"), known)
    assert rows(found) == [("p", "vitest", ["config", "dependency", "import", "script"])]
    assert project.flatten_exports('{"exports":{".":{"import":"./a.mjs","x/y":["./b.js"]}}}') == [("/./import", "./a.mjs"), ("/./x~1y/0", "./b.js")]


@pytest.mark.parametrize(
    "keyword,before,after,want",
    [
        ("type", '"string"', '"string"', None), ("type", '["string","null"]', '"string"', "breaking"), ("type", '"integer"', '"number"', "compatible"), ("type", '"number"', '"integer"', "breaking"),
        ("required", '["a"]', '["a","b"]', "breaking"), ("required", '["a","b"]', '["a"]', "compatible"), ("enum", '["a","b"]', '["a"]', "breaking"), ("enum", '["a"]', '["a","b"]', "compatible"),
        ("maximum", "5", "4", "breaking"), ("maximum", "5", "6", "compatible"), ("minLength", "1", "2", "breaking"), ("minLength", "1", None, "compatible"), ("minimum", None, "1", "breaking"),
        ("additionalProperties", "true", "false", "breaking"), ("property", None, "true", "compatible"), ("weird", "1", "2", "unknown"), ("title", '"a"', '"b"', "compatible"),
    ],
)
def test_schema_findings(spark, keyword, before, after, want):
    side = lambda v: spark.createDataFrame([("/p", keyword, v)] if v is not None else [], "pointer string, keyword string, value string")
    got = [r.finding for r in project.schema_findings(side(before), side(after)).collect()]
    assert got == ([want] if want else [])


def test_file_snapshot(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.js").write_text("one\ntwo\n")
    (tmp_path / "key.pem").write_text("x")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "b.js").write_text("y")
    found = files.discover(spark, str(tmp_path))
    assert rows(found, "path", "skipped") == [("key.pem", "secret"), ("node_modules/b.js", "ignored"), ("src/a.js", None)]
    assert rows(files.file_nodes(found, str(tmp_path)), "path", "lines", "kind") == [("src/a.js", 3, "source")]
    one = files.fingerprint(files.file_nodes(found, str(tmp_path))).first()[0]
    (tmp_path / "src" / "a.js").write_text("changed")
    spark.catalog.clearCache()
    assert files.fingerprint(files.file_nodes(files.discover(spark, str(tmp_path)), str(tmp_path))).first()[0] != one


def test_event_ids_are_gapless(spark):
    log = spark.createDataFrame([(7,)], "event_id long")
    new = spark.range(100).selectExpr("id * 3 as at")
    got = files.next_event_ids(log, new, "at").orderBy("at").collect()
    assert [r.event_id for r in got] == list(range(8, 108))
    assert rows(files.envelope(log, 5))[0][0] == "withheld" and rows(files.envelope(log, 50))[0][0] == "ok"


def test_write_effects_and_shadowing(spark):
    ev = spark.createDataFrame([("v", 1, "read"), ("v", 2, "write"), ("v", 3, "write"), ("v", 10, "read")], "name string, at int, kind string")
    got = rows(ordered.write_effects(ev, ["name"], ["at"], "kind"), "at", "effect", "previous")
    assert got == [(1, "unresolved", None), (10, "consumes", 3), (2, "produces", None), (3, "overrides", 2)]
    c = spark.createDataFrame([("d", 1, ""), ("d", 2, "x"), ("d", 3, "y")], "dir string, n int, body string")
    assert rows(ordered.shadowed(c, ["dir"], ["n"], F.col("body") == ""), "n", "state") == [(1, "empty"), (2, "selected"), (3, "shadowed")]


def test_stream_reads_a_table_of_many_parts(spark, tmp_path):
    from tessera.plans import QUERIES

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    want = events.where("event_type in ('error', 'signup')").count()
    assert QUERIES["follow_events"](spark, str(tmp_path)).count() == want == QUERIES["follow_events"](spark, "/root/testdata/sf0.001").count()


def test_redaction_cases():
    import re

    from tessera.functions.text import SECRETS

    def redact(line):
        for pattern, replacement in SECRETS:
            line = re.sub(pattern, re.sub(r"\$(\d)", r"\\\1", replacement), line)
        return line

    assert redact("PASSWORD = 'a b\nc' x") == "PASSWORD = [REDACTED] x"
    assert redact('{"api_key": "abc def"}') == '{"api_key": [REDACTED]}'
    assert redact("https://h/x?sig=ab12&x=1") == "https://h/x?sig=[REDACTED]&x=1"
    assert redact("xoxb-123456789012-abc and github_pat_" + "a1" * 15) == "[REDACTED] and [REDACTED]"
    assert redact("secret: one, two") == "secret: [REDACTED], two"
    assert redact("a skiing tokenizer: fine") == "a skiing tokenizer: fine"


def test_cfml_scan_knows_comments_strings_and_blocks():
    from tessera.sources.cfml import scan

    source = """<!--- <cfset a = b()> --->
<cfif isDefined('x(') and y()>don't call(1) #a.b#</cfif>
<cfscript>/* f( */ if (g("h(")) { function k() {} }
</cfscript>m()"""
    assert scan(source) == [
        ("tag", "cfif", 2), ("call", "isDefined", 2), ("call", "y", 2), ("variable", "a.b", 2), ("call", "g", 3), ("function", "k", 3),
    ]
    assert scan("") == [] and scan("<cfoutput>#x#") == [("tag", "cfoutput", 1), ("variable", "x", 1)]


def test_import_tokens_are_no_strings():
    from tessera.functions.text import imported

    assert imported("import a from 'b'; import 'c'; export { d } from \"e\"; const f = require('g'); h.require('i'); 'from' + 'j'; import(`k`); import(`${l}`)") == ["b", "c", "e", "g", "k"]
    assert imported(None) == [] and imported("// import 'x'\n/* from 'y' */ const s = \"import z from 'w'\"") == []


def test_updates_leases_and_fences(spark):
    from tessera.operators import relational

    state = spark.createDataFrame([(1, "a", 3), (2, "b", 1)], "k long, v string, version int")
    updates = spark.createDataFrame([(1, 3, "x"), (1, 3, "y"), (2, 5, "z"), (9, 1, "q")], "k long, expected int, new string")
    after, refused = relational.optimistic_update(state, updates, "k", "v")
    assert {tuple(r) for r in after.select("k", "v", "version").collect()} == {(1, "x", 4), (2, "b", 1)}
    assert {(r.k, r.new, r.reason) for r in refused.collect()} == {(1, "y", "lost"), (2, "z", "stale"), (9, "q", "unknown")}
    grants = spark.createDataFrame([(1, 1, "a", 10), (1, 2, "b", 20), (2, 1, "c", 5)], "k long, token long, holder string, at long")
    beats = spark.createDataFrame([(1, 1, 99), (1, 2, 40), (2, 1, 6)], "k long, token long, at long")
    assert {tuple(r) for r in relational.lease_states(grants, beats, "k", F.lit(50), 15).collect()} == {(1, 2, "b", "held"), (2, 1, "c", "expired")}
    writes = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "k long, token long")
    assert {tuple(r) for r in relational.fenced(writes, grants, "k").collect()} == {(1, 1)}


def test_version_keys_sort_like_versions(spark):
    from tessera.functions.text import version_key

    ordered = ["0.9", "1.0.0-1", "1.0.0-2", "1.0.0-11", "1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-alphabet", "1.0.0-beta-2", "1.0.0", "1.0.1-rc.1+b", "1.0.1", "1.2", "1.10.0", "v2"]
    got = spark.createDataFrame([(v,) for v in ordered], "v string").select("v", version_key(F.col("v")).alias("k")).collect()
    assert [r.v for r in sorted(got, key=lambda r: r.k)] == ordered
    assert spark.createDataFrame([("x",), ("1.2.3.4",), ("",), (None,)], "v string").where(version_key(F.col("v")).isNotNull()).count() == 0


def test_single_action_needs_all_queries_in_its_file(spark):
    from tessera.operators import relational

    facts = [("m1", "METHOD", "a"), ("m2", "METHOD", "a"), ("m3", "METHOD", "a"), ("m4", "METHOD", "b"), ("m5", "METHOD", "b"), ("m6", "METHOD", "b"), ("f", "FIELD", "a"), ("q1", "QUERY", "a"), ("q2", "QUERY", "b"), ("q3", "TABLE", "b")]
    actions = [("x1", "m1", "a", ["q1", "q1"]), ("x2", "m2", "a", ["q1", "q2"]), ("x3", "m3", "b", ["q1"]), ("x4", "m4", "b", ["q2"]), ("x5", "m4", "b", ["q2"]), ("x6", "m5", "b", []), ("x7", "m6", "b", ["q2", "q3", "q9"]), ("x8", "f", "a", ["q1"])]
    calls = spark.createDataFrame([(i, m) for i, m in enumerate(["m1", "m1", "m2", "m3", "m4", "m5", "m6", "f", "m9", None])], "i int, method string")
    out = relational.single_action(calls, spark.createDataFrame(facts, "id string, kind string, file string"), spark.createDataFrame(actions, "action string, method string, file string, query_ids array<string>"))
    want = [("resolved", "x1"), ("resolved", "x1"), ("foreign-query", None), ("other-file", None), ("ambiguous-action", None), ("no-query", None), ("foreign-query", None), ("unknown-method", None), ("unknown-method", None), ("unknown-method", None)]
    assert [(r.state, r.action) for r in out.orderBy("i").collect()] == want


def test_tests_and_changes_of_one_package_do_not_meet_in_pairs(spark):
    from tessera.operators import project

    n = 3000
    changes = spark.range(n).select(F.concat(F.lit("pkg/src/c"), F.col("id").cast("string"), F.lit(".js")).alias("path"))
    tests = spark.range(n).select(F.concat(F.lit("pkg/spec/t"), F.col("id").cast("string"), F.lit(".test.js")).alias("path"))
    none = spark.createDataFrame([], "src string, dst string")
    out = project.map_tests(changes, tests, none, packages=spark.createDataFrame([("pkg",)], "root string"))
    assert out.select("n_changes", "evidence").distinct().collect() == [(n, "package")] and out.count() == n


def test_project_commands(spark):
    from tessera.operators import project

    nodes = spark.createDataFrame([("a", "src/a.js", "source", "code"), ("b", "src/b.js", "source", "code"), ("x", "srcs/x.js", "source", "code"), ("t", "t/b.test.js", "test", "evidence"), ("g", "docs/TASK", "doc", "intent"), ("n", None, "note", "evidence")], "id string, path string, kind string, plane string")
    edges = spark.createDataFrame([("b", "a", "imports"), ("t", "b", "tests"), ("a", "t", "imports"), ("x", "b", "mentions")], "src string, dst string, type string")
    ids = lambda *a, **k: sorted(r.id for r in project.project_query(nodes, edges, *a, **k).collect())
    assert ids("impact", "src/a.js") == ["a", "b", "t"] and ids("tests-for", "src/") == ["t"] and ids("context", "src") == ["a", "b"]
    assert ids("evidence") == ["n", "t"] and ids("evidence", "src") == [] and ids("goals") == ["g"] == ids("progress") and ids("path-to-done") == ["t"]
    assert ids("changed") == [] and ids("changed", changed=nodes.where("id = 'x'").select("path")) == ["x"]
    with pytest.raises(ValueError):
        ids("nope")


def test_imports_resolve_to_the_first_candidate_and_are_read_once(spark, monkeypatch):
    """Against a list of candidates tried one by one; a traversal of several levels does not resolve them again."""
    names = ["a/x.ts", "a/x.js", "a/x", "a/y/index.tsx", "a/y.mjs", "a/z/index.js", "a/z.js/index.ts", "a/w.js.ts", "a/v.JS", "a/u.css", "a/index.ts", "a/u.css.cjs", "a/t.ts/index.ts"]
    asked = ["./x", "./x.js", "./x.ts", "./y", "./y.mjs", "./z", "./z.js", "./w.js", "./v.JS", "./v", "./u.css", "./u", ".", "./t", "./t.ts", "./none", "pkg", "../../up"]
    body = "".join(f"import q from '{x}';\n" for x in asked)
    files = spark.createDataFrame([(n, "") for n in names] + [("a/main.ts", body)], "path string, body string")
    want, have = set(), {*names, "a/main.ts"}
    for x in asked:
        base = {".": "a"}.get(x, "a/" + x[2:]) if x.startswith(".") and not x.startswith("..") else None
        if base is None:
            continue
        cut = base.rsplit("/", 1)
        bare = "/".join([*cut[:-1], cut[-1].rsplit(".", 1)[0]]) if "." in cut[-1] else base
        pair = [bare, base] if base.lower().rsplit(".", 1)[-1] in ("js", "jsx", "mjs", "cjs") and bare != base else [base, bare]
        tries = [base] + [b + e for b in pair for e in ["", *project.EXTENSIONS, *(f"/index{e}" for e in project.EXTENSIONS)]]
        want |= {("a/main.ts", t) for t in tries if t in have and t == next(c for c in tries if c in have)}
    imports = project.import_graph(files)
    assert {tuple(r) for r in imports.collect()} == want and len(want) >= 8
    staged, put = [], project.stage
    monkeypatch.setattr(project, "stage", lambda df, label: staged.append(label) or put(df, label))
    tests = spark.createDataFrame([("a/main.ts",)], "path string")
    changes = spark.createDataFrame([("a/u.css",)], "path string")
    got = project.map_tests(changes, tests, imports, depth=3).collect()
    assert [(r.test, r.evidence) for r in got] == [("a/main.ts", "direct-import")] and staged == ["imports"]
