"""Text extraction queries: lines, paths, links, markup, SQL, logs, diffs, JSON, versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import structured, text
from tessera.operators import project, relational, scans
from tessera.sources import diffs, logs, markup, sqltext

from .graphs import PATHS, url_paths
from .registry import Tables, query


@query("S10 X16 J13 W9", r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)
SELECT doc_id, cast(i + 1 AS INTEGER) AS line_no, regexp_extract(line, '^(\S+)', 1) AS head, length(line) AS n FROM l WHERE regexp_matches(line, '^\S+ \S+ \S+ \S+')""")
def regex_extract_rows(t: Tables) -> DataFrame:
    """Lines of at least four words with their number, first word and length."""
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    return lines.where(F.col("line").rlike(r"^\S+ \S+ \S+ \S+")).select("doc_id", (F.col("i") + 1).alias("line_no"), F.regexp_extract("line", r"^(\S+)", 1).alias("head"), F.length("line").cast("bigint").alias("n"))


@query("X14", "SELECT page_id, 'GET ' || url || '?access_token=[REDACTED]&sig=[REDACTED] \"refresh-token\": [REDACTED], ok' AS safe FROM pages")
def redact_urls(t: Tables) -> DataFrame:
    """Log lines of requests for the pages, without the credentials in them."""
    k = F.col("page_id").cast("string")
    line = F.concat(F.lit("GET "), "url", F.lit("?access_token="), k, F.lit("&sig=a"), k, F.lit(' "refresh-token": "t '), k, F.lit('", ok'))
    return t.pages.select("page_id", text.redact(line).alias("safe"))


@query("X14 X13")
def redact_documents(t: Tables) -> DataFrame:
    """Documents in which a credential pattern was found, with terminal codes and secrets taken out."""
    safe = text.redact(text.strip_ansi(F.col("text")))
    return t.documents.select("doc_id", "text", safe.alias("safe")).where("text <> safe").select("doc_id", F.sha2(F.col("safe").cast("binary"), 256).alias("safe_sha256"))


@query("S20", r"""
WITH u AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)\b(?:href|src|action)\s*=\s*["'']([^"'']*)["'']', 1)) AS target FROM pages) SELECT page_id, target, count(*) AS n FROM u GROUP BY 1, 2""")
def page_links(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.explode(markup.references(F.col("html"))).alias("target")).groupBy("page_id", "target").agg(F.count(F.lit(1)).alias("n"))


@query("S13", r"""
WITH s AS (SELECT page_id, regexp_extract_all(html, '\btrack\(([0-9]+)\)', 1) AS calls, regexp_extract_all(html, '([a-z]+)\{margin', 1) AS rules FROM pages)
SELECT page_id, array_to_string(calls, ',') AS calls, array_to_string(rules, ',') AS rules FROM s""")
def script_and_style_facts(t: Tables) -> DataFrame:
    get = lambda p: F.array_join(F.regexp_extract_all("html", F.lit(p), F.lit(1)), ",")
    return t.pages.select("page_id", get(r"\btrack\(([0-9]+)\)").alias("calls"), get(r"([a-z]+)\{margin").alias("rules"))


@query("S13 X33", r"""
SELECT page_id AS doc_id, 'paragraph-without-bold' AS rule, len(regexp_extract_all(html, '<p>')) - len(regexp_extract_all(html, '<p><b>')) AS n FROM pages WHERE len(regexp_extract_all(html, '<p>')) > len(regexp_extract_all(html, '<p><b>'))
UNION ALL SELECT page_id, 'item-outside-list', 0 FROM pages WHERE html NOT LIKE '%<ul>%' AND html LIKE '%<li>%'
UNION ALL SELECT page_id, 'list-without-item', 1 FROM pages WHERE html LIKE '%<ul></ul>%'""")
def markup_policy(t: Tables) -> DataFrame:
    """Lists without a direct item, items outside a list and plain paragraphs, counted by a tree of each page."""
    nodes = markup.elements(t.pages, "page_id", "html")
    found = markup.missing_children(nodes, "ul", "li").select("doc_id", F.lit("list-without-item").alias("rule"))
    found = found.unionByName(markup.misplaced_children(nodes, "li", ["ul", "ol", "menu"]).select("doc_id", F.lit("item-outside-list").alias("rule")))
    found = found.unionByName(markup.missing_children(nodes, "p", "b").select("doc_id", F.lit("paragraph-without-bold").alias("rule")))
    return found.groupBy("doc_id", "rule").agg(F.count(F.lit(1)).alias("n"))


@query("S13", r"""
WITH e AS (SELECT unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)[ >/]', 1)) AS tag FROM pages) SELECT tag, count(*) AS n, count(*) FILTER (tag <> 'html') AS n_nested FROM e GROUP BY tag""")
def element_counts(t: Tables) -> DataFrame:
    """Elements per tag, and how many lie inside another."""
    nodes = markup.elements(t.pages, "page_id", "html")
    return nodes.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.count("parent").alias("n_nested"))


@query("X18 S23", """
SELECT 'orders_' || o_orderstatus AS table_name, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT 'customer_' || (o_custkey % 10), count(*) FROM orders GROUP BY 1 UNION ALL SELECT 'audit', count(*) FROM orders""")
def sql_table_refs(t: Tables) -> DataFrame:
    """Tables named in SQL scripts made of the orders: statements are split, parsed and counted."""
    script = F.concat(F.lit("WITH x AS (SELECT * FROM orders_"), F.col("o_orderstatus"), F.lit(") SELECT * FROM x JOIN customer_"), (F.col("o_custkey") % 10).cast("string"), F.lit(" c ON 1=1; DELETE FROM audit -- FROM nothing\n;"))
    statements = t.orders.select("o_orderkey", F.explode(sqltext.sql_statements(script)).alias("s"))
    return statements.select(F.explode(sqltext.sql_tables("s")).alias("table_name")).groupBy("table_name").agg(F.count(F.lit(1)).alias("n"))


@query("S11 U8 W2 W3 L11", """
WITH l AS (SELECT cast(user_id % 20 AS VARCHAR) AS artifact, cast(event_id AS INTEGER) AS seq, event_type AS k, 'src/f' || (event_id % 7) || '.ts' AS f, event_id AS n FROM events),
m AS (SELECT *, last_value(CASE WHEN k = 'signup' THEN f END IGNORE NULLS) OVER w AS lint, last_value(CASE WHEN k = 'purchase' THEN f END IGNORE NULLS) OVER w AS fail FROM l WINDOW w AS (PARTITION BY artifact ORDER BY seq ROWS UNBOUNDED PRECEDING))
SELECT artifact, seq, 'compiler' AS producer, 'error' AS severity, 'compile' AS phase, 'TS2304' AS code, f AS file, cast(n AS INTEGER) AS line, 3 AS col, 'Cannot find name.' AS message FROM m WHERE k = 'error'
UNION ALL SELECT artifact, seq, 'lint', 'warning', 'lint', 'no-unused', lint, cast(n AS INTEGER), 5, 'Unused value' FROM m WHERE k = 'click' AND lint IS NOT NULL
UNION ALL SELECT artifact, seq, 'test', 'error', 'test', NULL, fail, NULL, NULL, 'case ' || n FROM m WHERE k = 'view'""")
def log_diagnostics(t: Tables) -> DataFrame:
    """Compiler, lint and test lines made of the events, read back as diagnostics."""
    f = F.concat(F.lit("src/f"), (F.col("event_id") % 7).cast("string"), F.lit(".ts"))
    n = F.col("event_id").cast("string")
    line = (
        F.when(F.col("event_type") == "error", F.concat(f, F.lit("("), n, F.lit(",3): error TS2304: Cannot find name.")))
        .when(F.col("event_type") == "signup", f).when(F.col("event_type") == "click", F.concat(F.lit("  "), n, F.lit(":5  warning  Unused value  no-unused")))
        .when(F.col("event_type") == "purchase", F.concat(F.lit(" FAIL "), f)).otherwise(F.concat(F.lit("  ● case "), n))
    )
    lines = t.events.select((F.col("user_id") % 20).cast("string").alias("artifact"), F.col("event_id").cast("int").alias("seq"), line.alias("line"))
    return logs.diagnostics(lines)


@query("S8 A8", """
WITH u AS (SELECT user_id, count(*) FILTER (value <= 50) AS p, count(*) FILTER (value > 50) AS f FROM events GROUP BY 1)
SELECT cast(user_id AS VARCHAR) AS artifact, CASE WHEN user_id % 5 = 0 THEN 'broken_frame' WHEN user_id % 3 = 0 THEN 'count_mismatch' ELSE 'complete' END AS state, p AS passed, CASE WHEN user_id % 3 = 0 THEN f - 1 ELSE f END AS failed FROM u""")
def capture_verdicts(t: Tables) -> DataFrame:
    """Framed JSONL captures, one per user: header, cases, summary, end."""
    case = F.concat(F.lit('{"type":"case","status":"'), F.when(F.col("value") > 50, "fail").otherwise("pass"), F.lit('"}'))
    body = t.events.select(F.col("user_id").cast("string").alias("artifact"), F.col("event_id").alias("seq"), case.alias("line"))
    users = t.events.groupBy("user_id").agg(F.count_if(F.col("value") <= 50).alias("p"), F.count_if(F.col("value") > 50).alias("f")).withColumn("f", F.when(F.col("user_id") % 3 == 0, F.col("f") - 1).otherwise(F.col("f")))
    own = F.col("user_id").cast("string").alias("artifact")
    big = F.lit(2**60)
    head = users.select(own, F.lit(-1).cast("bigint").alias("seq"), F.lit('{"type":"header"}').alias("line"))
    summary = users.select(own, big.alias("seq"), F.concat(F.lit('{"type":"summary","passed":'), F.col("p").cast("string"), F.lit(',"failed":'), F.col("f").cast("string"), F.lit("}")).alias("line"))
    end = users.where("user_id % 5 <> 0").select(own, (big + 1).alias("seq"), F.lit('{"type":"end"}').alias("line"))
    return logs.capture_verdicts(body.unionByName(head).unionByName(summary).unionByName(end))


def _patches(t: Tables) -> DataFrame:
    """One unified diff per order: a hunk whose lines are its lineitems."""
    mark = F.when(F.col("l_returnflag") == "A", "+").when(F.col("l_returnflag") == "R", "-").otherwise(" ")
    lines = t.lineitem.repartition(scans.tasks_for(t.lineitem, 500_000), "l_orderkey")
    rows = lines.select("l_orderkey", "l_linenumber", F.concat(mark, F.lit("part "), F.col("l_partkey").cast("string")).alias("x"))
    body = rows.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "x"))), lambda r: r["x"]), "\n").alias("b"))
    k = F.col("l_orderkey").cast("string")
    head = F.concat(F.lit("diff --git a/src/o"), k, F.lit(".txt b/src/o"), k, F.lit(".txt\n--- a/x\n+++ b/x\n@@ -10,0 +20,0 @@\n"))
    return body.select(F.col("l_orderkey").alias("diff_id"), F.concat(head, "b").alias("text"))


@query("S10 W9 R44 F7", """
WITH r AS (SELECT l_orderkey AS diff_id, l_returnflag AS f, 'part ' || l_partkey AS text, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CASE l_returnflag WHEN 'A' THEN '+' WHEN 'R' THEN '-' ELSE ' ' END || 'part ' || l_partkey) AS n FROM lineitem)
SELECT diff_id, cast(n + 3 AS INTEGER) AS diff_line, text, coalesce(CASE WHEN f <> 'R' THEN cast(20 + coalesce(sum(CASE WHEN f <> 'R' THEN 1 ELSE 0 END) OVER (PARTITION BY diff_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) END, -1) AS new_line,
  coalesce(CASE WHEN f <> 'A' THEN cast(10 + coalesce(sum(CASE WHEN f <> 'A' THEN 1 ELSE 0 END) OVER (PARTITION BY diff_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) END, -1) AS old_line FROM r""")
def line_numbering(t: Tables) -> DataFrame:
    lines = diffs.diff_lines(_patches(t))
    return lines.where(F.col("kind").isin("add", "del", "context")).select("diff_id", "diff_line", "text", *[F.coalesce(c, F.lit(-1)).cast("bigint").alias(c) for c in ("new_line", "old_line")])


@query("J23 F3 F7 R49 A25", """
WITH l AS (SELECT l_orderkey AS diff_id, 'src/o' || l_orderkey || '.txt' AS file, l_returnflag AS f, 'part ' || l_partkey AS text, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CASE l_returnflag WHEN 'A' THEN '+' WHEN 'R' THEN '-' ELSE ' ' END || 'part ' || l_partkey) AS n FROM lineitem),
m AS (SELECT *, 20 + count(*) FILTER (f <> 'R') OVER (PARTITION BY diff_id ORDER BY n ROWS UNBOUNDED PRECEDING) - 1 AS line FROM l),
x AS (SELECT DISTINCT diff_id, file, 'lucky' AS rule, 'error' AS severity, line FROM m WHERE f = 'A' AND contains(text, 'part 77') UNION ALL SELECT DISTINCT diff_id, file, 'many', 'warning', line FROM m WHERE f = 'A' AND contains(text, 'part 1')
  UNION ALL SELECT diff_id, file, 'too-many-lines', 'warning', NULL FROM m WHERE f = 'A' GROUP BY diff_id, file HAVING count(*) > 3 UNION ALL SELECT DISTINCT diff_id, file, 'protected-path', 'error', NULL FROM m WHERE file = 'src/o1.txt')
SELECT diff_id, file, rule, severity, line, rule = 'many' AND file = 'src/o2.txt' AS excepted FROM x""")
def patch_policy(t: Tables) -> DataFrame:
    """Protected paths, content needles and size limits over the diffs, exceptions applied."""
    spark = t.spark
    lines = diffs.diff_lines(_patches(t))
    protected = spark.createDataFrame([("src/o1.txt",), ("lib/",)], "selector string")
    needles = spark.createDataFrame([("lucky", "part 77", "error"), ("many", "part 1", "warning")], "rule string, needle string, severity string")
    exceptions = spark.createDataFrame([("many", "src/o2.txt"), ("lucky", "lib/")], "rule string, selector string")
    return diffs.policy_findings(lines, protected, needles, exceptions, 3)


@query("R44 J37", """
WITH l AS (SELECT l_orderkey AS diff_id, 'src/o' || l_orderkey || '.txt' AS file, l_returnflag AS f, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CASE l_returnflag WHEN 'A' THEN '+' WHEN 'R' THEN '-' ELSE ' ' END || 'part ' || l_partkey) AS n FROM lineitem),
m AS (SELECT diff_id, file, f, 20 + count(*) FILTER (f <> 'R') OVER (PARTITION BY diff_id ORDER BY n ROWS UNBOUNDED PRECEDING) - 1 AS line FROM l),
g AS (SELECT *, line - row_number() OVER (PARTITION BY diff_id, file ORDER BY line) AS run FROM m WHERE f = 'A') SELECT diff_id, file, min(line) AS "start", max(line) AS "end" FROM g GROUP BY diff_id, file, run""")
def changed_ranges(t: Tables) -> DataFrame:
    return diffs.changed_ranges(diffs.diff_lines(_patches(t)))


@query("X10", "SELECT doc_id, len(string_split(text[1:200], chr(10))) AS line, CASE WHEN strpos(reverse(text[1:200]), chr(10)) = 0 THEN length(text[1:200]) + 1 ELSE strpos(reverse(text[1:200]), chr(10)) END AS col FROM documents")
def offset_to_position(t: Tables) -> DataFrame:
    at = F.lit(200)
    return t.documents.select("doc_id", text.line_of(F.col("text"), at).cast("bigint").alias("line"), text.column_of(F.col("text"), at).cast("bigint").alias("col"))


@query("X28 F16", "SELECT doc_id, strlen(text) AS bytes, substr(text, 1, 40) AS head FROM documents")
def bounded_projection(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.octet_length("text").cast("bigint").alias("bytes"), F.substring("text", 1, 40).alias("head"))


@query("X26", "SELECT a.item_id, string_split(a.text, ' ')[1:3] = string_split(b.text, ' ')[1:3] AS same_head FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1")
def sequence_equality(t: Tables) -> DataFrame:
    rows = t.benchmark.select("item_id", F.slice(F.split("text", " "), 1, 3).alias("h"))
    return rows.alias("a").join(rows.withColumn("item_id", F.col("item_id") - 1).alias("b"), "item_id").select("item_id", (F.col("a.h") == F.col("b.h")).alias("same_head"))


@query("F1", "SELECT p_partkey, CASE WHEN p_name = 'red widget' THEN 'exact' WHEN starts_with(p_name, 'red') THEN 'prefix' ELSE 'substring' END AS mode FROM part WHERE contains(p_name, 'red')")
def name_search(t: Tables) -> DataFrame:
    mode = F.when(F.col("p_name") == "red widget", "exact").when(F.col("p_name").startswith("red"), "prefix").otherwise("substring")
    return t.part.where(F.col("p_name").contains("red")).select("p_partkey", mode.alias("mode"))


@query("F2 F17", "SELECT p_partkey, p_name FROM part WHERE p_type IN ('SMALL', 'ECONOMY') AND p_size < 10 AND NOT contains(p_name, 'bolt')")
def kind_filter(t: Tables) -> DataFrame:
    return t.part.where(F.col("p_type").isin("SMALL", "ECONOMY")).where("p_size < 10").where(~F.col("p_name").contains("bolt")).select("p_partkey", "p_name")


@query("F3 F14 J23", PATHS + "SELECT page_id FROM u WHERE starts_with(path, split_part((SELECT min(path) FROM u), '/', 1) || '/') OR path = (SELECT max(path) FROM u)")
def path_selectors(t: Tables) -> DataFrame:
    """Selectors: a directory and an exact path, held as a two-row rule table."""
    paths = url_paths(t)
    rules = paths.agg(F.concat(F.regexp_extract(F.min("path"), "^([^/]+)", 1), F.lit("/")).alias("a"), F.max("path").alias("b")).select(F.explode(F.array("a", "b")).alias("selector"))
    return paths.join(F.broadcast(rules), relational.selector_match(F.col("path"), F.col("selector")), "left_semi").select("page_id")


@query("F4 F5 R22 S1", PATHS + r"SELECT page_id FROM u WHERE regexp_full_match(path, '(?:.*/)?(?:fr|de)/[^/]*') AND NOT regexp_full_match(path, '.*/[0-9][^/]')")
def glob_filter(t: Tables) -> DataFrame:
    paths = url_paths(t)
    hits = project.workspace_members(paths.withColumnRenamed("path", "dir"), ["**/fr/*", "**/de/*"], [])
    return hits.where(~F.col("dir").rlike(r"^.*/[0-9][^/]$")).select("page_id")


@query("F6", PATHS + "SELECT path, CASE WHEN contains(path, '/en/') THEN false WHEN contains(path, 'example.com') THEN true ELSE false END AS ignored FROM u GROUP BY path")
def ignore_layers(t: Tables) -> DataFrame:
    rules = t.spark.createDataFrame([(".*example\\.com.*", True, 1), (".*/en/.*", False, 2)], "pattern string, ignored boolean, rule_order int")
    return relational.layered_rules(url_paths(t).select("path").distinct(), rules)


@query("F20", PATHS + r"""
SELECT page_id, ['test', 'doc', 'manifest', 'source', 'asset'][page_id % 5 + 1] AS kind FROM u""")
def file_classes(t: Tables) -> DataFrame:
    """Files below the pages' paths by what their names tell."""
    ends = F.array(*map(F.lit, [".spec.ts", "/readme.md", "/package.json", ".py", ".png"]))
    return url_paths(t).select("page_id", text.file_kind(F.concat("path", F.element_at(ends, (F.col("page_id") % 5 + 1).cast("int")))).alias("kind"))


@query("X24 X22 X23", """
SELECT p_partkey, 'part_' || p_partkey AS stem, CASE p_partkey % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'lint' WHEN 2 THEN 'build' WHEN 3 THEN 'test' ELSE 'other' END AS purpose, CASE WHEN p_size % 2 = 0 THEN 'pnpm' ELSE '' END AS manager, CASE WHEN p_size % 2 = 0 THEN '8.' || p_size || '.0' ELSE '' END AS version FROM part""")
def path_functions(t: Tables) -> DataFrame:
    """Stems of test paths, purposes of scripts and manager declarations made of the parts."""
    k = F.col("p_partkey")
    pick = lambda *values: F.element_at(F.array(*map(F.lit, values)), (k % 5 + 1).cast("int"))
    path = F.concat(F.lit("a/b/part_"), k.cast("string"), pick(".test.js", "_test.py", "-spec.ts", ".js", ".spec.tsx"))
    manager = text.package_manager(F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("pnpm@8."), F.col("p_size").cast("string"), F.lit(".0+sha"))).otherwise("none"))
    rows = t.part.select("p_partkey", text.stem(path).alias("stem"), text.purpose(pick("test:unit", "format", "bundle", "x", "y"), pick("", "", "", "npx vitest run", "node y.js")).alias("purpose"), manager.alias("m"))
    return rows.select("p_partkey", "stem", "purpose", F.col("m.name").alias("manager"), F.col("m.version").alias("version"))


@query("X11", "SELECT page_id, list_reduce(list_prepend('', list_filter(string_split(regexp_replace(url, '^https?:', ''), '/'), lambda x: x <> '' AND x <> '.')), lambda a, b: CASE WHEN a = '' THEN b ELSE a || '/' || b END) AS path FROM pages")
def normal_paths(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.normal_path(F.regexp_replace("url", "^https?:", "")).alias("path"))


@query("X15 X16", """
SELECT specifier, count(*) AS n FROM (SELECT './' || replace(p_name, ' ', '-') AS specifier FROM part UNION ALL SELECT 'lib/' || replace(p_name, ' ', '-') FROM part) GROUP BY 1""")
def import_facts(t: Tables) -> DataFrame:
    """Import specifiers of scripts made of the parts, comments left out."""
    n = F.regexp_replace("p_name", " ", "-")
    code = F.concat(F.lit("import x from './"), n, F.lit("';\n// import y from 'no'\nconst z = require(\"lib/"), n, F.lit("\"); /* from 'never' */"))
    rows = t.part.select("p_partkey", F.explode(text.import_specifiers(text.strip_comments(code))).alias("specifier"))
    return rows.groupBy("specifier").agg(F.count(F.lit(1)).alias("n"))


@query("X20", """
WITH v AS (SELECT p_partkey, p_size % 4 AS a, p_partkey % 7 AS b, p_partkey % 3 AS c FROM part)
SELECT p_partkey, a || '.' || b || '.' || c AS version, CASE p_partkey % 5 WHEN 0 THEN '^1.2.0' WHEN 1 THEN '~2.1' WHEN 2 THEN '>=1 <3' WHEN 3 THEN '0.x || 3.0.0' ELSE 'bad range here!' END AS wanted,
  CASE p_partkey % 5 WHEN 0 THEN a = 1 AND b >= 2 WHEN 1 THEN a = 2 AND b = 1 WHEN 2 THEN a IN (1, 2) WHEN 3 THEN a = 0 OR (a = 3 AND b = 0 AND c = 0) END AS ok FROM v""")
def semver_ranges(t: Tables) -> DataFrame:
    """Versions made of the line numbers against ranges."""
    v = F.concat_ws(".", (F.col("p_size") % 4).cast("string"), (F.col("p_partkey") % 7).cast("string"), (F.col("p_partkey") % 3).cast("string"))
    wanted = F.element_at(F.array(*map(F.lit, ["^1.2.0", "~2.1", ">=1 <3", "0.x || 3.0.0", "bad range here!"])), (F.col("p_partkey") % 5 + 1).cast("int"))
    return t.part.select("p_partkey", v.alias("version"), wanted.alias("wanted")).withColumn("ok", structured.semver_satisfies("version", "wanted"))


@query("X7 X9 X12 X31", """
SELECT event_id, '{"a":[1,2],"b":' || replace(props, ' ', '') || '}' AS canonical, json_extract_string(props, '$.k') AS k, 'a/' || event_id AS rel, 'a|''b,c''|f(d,e)' AS parts FROM events""")
def structured_scalars(t: Tables) -> DataFrame:
    """Canonical JSON, pointers, relative paths and quoted lists over the event payloads."""
    rows = t.events.select("event_id", F.concat(F.lit('{"b":'), "props", F.lit(',"a":[1,2]}')).alias("doc"))
    return rows.select(
        "event_id", structured.canonical_json("doc").alias("canonical"), structured.json_pointer("doc", F.lit("/b/k")).alias("k"),
        structured.relative_path(F.concat(F.lit("C:\\repo\\a\\"), F.col("event_id").cast("string")), F.lit("c:\\repo")).alias("rel"),
        F.array_join(structured.split_quoted_list(F.lit("a, 'b,c', f(d,e)")), "|").alias("parts"),
    )


@query("X8", "SELECT event_id, sha256('[\"' || event_type || '\",' || user_id || ']') AS ident FROM events")
def content_ids(t: Tables) -> DataFrame:
    body = F.concat(F.lit('["'), "event_type", F.lit('",'), F.col("user_id").cast("string"), F.lit("]"))
    return t.events.select("event_id", F.sha2(body, 256).alias("ident"))


@query("S25 R14 R56", """
SELECT 'packages/p' || s_suppkey AS path, x.script, x.purpose, CASE WHEN s_suppkey % 2 = 0 THEN 'pnpm run ' ELSE 'npm run ' END || x.script AS invocation FROM supplier, LATERAL (
  SELECT 'test:unit' AS script, 'test' AS purpose UNION ALL SELECT 'build', 'build' UNION ALL SELECT 'x', 'lint') x""")
def manifest_commands(t: Tables) -> DataFrame:
    """Scripts of package manifests made of the suppliers, with purpose and invocation."""
    k = F.col("s_suppkey")
    body = F.concat(F.lit('{"name":"p'), k.cast("string"), F.lit('","packageManager":"'), F.when(k % 2 == 0, "pnpm@8.1.0").otherwise("npm@10.0.0"), F.lit('","scripts":{"test:unit":"vitest run","build":"tsc -p .","x":"eslint ."}}'))
    manifests = t.supplier.select(F.concat(F.lit("packages/p"), k.cast("string")).alias("path"), body.alias("body"))
    managers = project.managers(manifests, t.spark.createDataFrame([("packages/p2", "pnpm"), ("packages/p3", "yarn")], "path string, family string"))
    return project.commands(manifests, managers.select("path", "manager"))


@query("J21 U5 U6 R41 R42 R43 A13", """
WITH a AS (SELECT p_brand, max(p_size) AS mx, min(p_size) AS mn, list_sort(list(DISTINCT p_type)) AS e FROM part WHERE p_partkey % 2 = 0 GROUP BY 1),
b AS (SELECT p_brand, max(p_size) AS mx, min(p_size) AS mn, list_sort(list(DISTINCT p_type)) AS e FROM part WHERE p_partkey % 2 = 1 GROUP BY 1),
f AS (SELECT coalesce(a.p_brand, b.p_brand) AS pointer, a.e AS ae, b.e AS be, a.mx AS amx, b.mx AS bmx, a.mn AS amn, b.mn AS bmn FROM a FULL JOIN b ON a.p_brand = b.p_brand)
SELECT pointer, 'enum' AS keyword, CASE WHEN be IS NULL THEN 'compatible' WHEN ae IS NULL THEN 'breaking' WHEN len(list_filter(ae, lambda x: NOT list_contains(be, x))) > 0 THEN 'breaking' ELSE 'compatible' END AS finding FROM f WHERE ae IS DISTINCT FROM be
UNION ALL SELECT pointer, 'maximum', CASE WHEN bmx IS NULL THEN 'compatible' WHEN amx IS NULL OR bmx < amx THEN 'breaking' ELSE 'compatible' END FROM f WHERE amx IS DISTINCT FROM bmx
UNION ALL SELECT pointer, 'minimum', CASE WHEN bmn IS NULL THEN 'compatible' WHEN amn IS NULL OR bmn > amn THEN 'breaking' ELSE 'compatible' END FROM f WHERE amn IS DISTINCT FROM bmn""")
def schema_compare(t: Tables) -> DataFrame:
    """Two flattened schemas per brand (types and size bounds of even and odd parts) compared."""
    def side(cond: str) -> DataFrame:
        own = t.part.where(cond).groupBy("p_brand").agg(F.to_json(F.array_sort(F.collect_set("p_type"))).alias("enum"), F.max("p_size").cast("string").alias("maximum"), F.min("p_size").cast("string").alias("minimum"))
        return own.unpivot(["p_brand"], ["enum", "maximum", "minimum"], "keyword", "value").withColumnRenamed("p_brand", "pointer")

    return project.schema_findings(side("p_partkey % 2 = 0"), side("p_partkey % 2 = 1"))
