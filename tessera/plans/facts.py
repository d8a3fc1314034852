"""Queries of facts: files, manifests, scripts, styles, reports, risk, test tiers, redaction, exact joins."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import intervals, ordered, packs, project, relational, sets, verdicts
from tessera.sources import cfml, files, logs, markup, sqltext
from tessera.staging import shared_dir

from .graphs import PATHS, url_paths
from .registry import Tables, query


def s(column: str) -> Column:
    return F.col(column).cast("string")


@query("S1 S4", """
SELECT 'nation=' || c_nationkey AS dir, 'doc' AS kind, count(*) + 1 AS lines, cast(sum(strlen(c_name) + 1) AS BIGINT) AS bytes, 64 AS digest_chars FROM customer GROUP BY c_nationkey""")
def walked_files(t: Tables) -> DataFrame:
    """Text files of the customers of each nation, walked back as file nodes with bytes, lines, digest and kind."""
    root = f"{shared_dir(t.spark)}/tessera-walk-{uuid.uuid4().hex}"
    rows = t.customer.select(F.col("c_nationkey").alias("nation"), F.col("c_name").alias("value")).repartition("nation")
    rows.write.partitionBy("nation").text(root)
    found = files.file_nodes(files.discover(t.spark, root, include=r"\.txt$"), root)
    return found.select(F.regexp_extract("path", "(nation=[0-9]+)/", 1).alias("dir"), "kind", F.col("lines").cast("bigint").alias("lines"), "bytes", F.length("digest").alias("digest_chars"))


@query("S12", """
SELECT 'u' || user_id AS artifact, event_type = 'error' AS kept, count(*) AS n FROM events GROUP BY 1, 2""")
def structured_reports(t: Tables) -> DataFrame:
    """JSON reports made of the events, one row a diagnostic: rows without a known severity are rejected with a reason."""
    item = F.to_json(F.struct(F.when(F.col("event_type") == "error", "error").otherwise("fatal").alias("severity"), F.lit("run").alias("phase"), F.concat(F.lit("event "), s("event_id")).alias("message")))
    reports = t.events.groupBy("user_id").agg(F.collect_list(item).alias("x")).select(F.concat(F.lit("u"), s("user_id")).alias("artifact"), F.concat(F.lit("["), F.array_join("x", ","), F.lit("]")).alias("body"))
    rows, rejected = logs.structured_rows(reports)
    both = rows.select("artifact", F.lit(True).alias("kept")).unionByName(rejected.select("artifact", F.lit(False).alias("kept")))
    return both.groupBy("artifact", "kept").agg(F.count(F.lit(1)).alias("n"))


@query("S21", """
SELECT p_partkey, 'img/' || p_size || '.png' AS target FROM part UNION ALL SELECT p_partkey, 'base' || (p_partkey % 3) || '.css' FROM part""")
def style_targets(t: Tables) -> DataFrame:
    """Targets of url() and @import in style sheets made of the parts."""
    css = F.concat(F.lit("@import \"base"), (F.col("p_partkey") % 3).cast("string"), F.lit(".css\"; a { background: url( 'img/"), s("p_size"), F.lit(".png' ) }"))
    return t.part.select("p_partkey", F.explode(markup.style_references(css)).alias("target"))


@query("S22", """
SELECT s_suppkey, '/api/' || s_nationkey AS target FROM supplier UNION ALL SELECT s_suppkey, '/ajax/' || s_suppkey FROM supplier UNION ALL SELECT s_suppkey, 'next.html' FROM supplier""")
def script_targets(t: Tables) -> DataFrame:
    """Targets of fetch, ajax and location assignments in scripts made of the suppliers."""
    script = F.concat(F.lit("fetch('/api/"), s("s_nationkey"), F.lit("'); $.ajax({ url: \"/ajax/"), s("s_suppkey"), F.lit("\" }); window.location.href = 'next.html';"))
    return t.supplier.select("s_suppkey", F.explode(markup.script_calls(script)).alias("target"))


FORM_HTML = ['<p>x<form id="f', '" action="/go/', '" method="POST"><input name="q"><select name="s"></form><a href="/a">l</a><script src="/s.js"></script><link rel="stylesheet" href="/c.css">']


@query("S20 S13", """
SELECT s_suppkey AS doc_id, x.kind, x.target, x.fields FROM supplier, LATERAL (
  SELECT 'form' AS kind, '/go/' || s_nationkey AS target, 'q,s' AS fields UNION ALL SELECT 'link', '/a', '' UNION ALL SELECT 'script', '/s.js', '' UNION ALL SELECT 'style', '/c.css', '') x""")
def page_parts(t: Tables) -> DataFrame:
    """Links, forms with their fields, scripts and style sheets as rows, from a tree of each page (with an open <p>)."""
    a, b, c = map(F.lit, FORM_HTML)
    pages = t.supplier.select("s_suppkey", F.concat(a, s("s_suppkey"), b, s("s_nationkey"), c).alias("html"))
    return markup.page_parts(markup.elements(pages, "s_suppkey", "html")).select("doc_id", "kind", "target", "fields")


@query("S13 X33 X32", """
SELECT s_suppkey AS doc_id, 'list-without-item' AS rule FROM supplier WHERE s_acctbal < 0 UNION ALL SELECT s_suppkey, 'item-outside-list' FROM supplier WHERE s_acctbal >= 0""")
def nesting_findings(t: Tables) -> DataFrame:
    """Nesting rules over markup made of the suppliers: those in debt have an empty list, the others a stray item."""
    html = F.when(F.col("s_acctbal") < 0, "<div><ul><p>none</p></ul></div>").otherwise("<ul><li>a<li>b</ul><div><li>c</li></div>")
    nodes = markup.elements(t.supplier.select("s_suppkey", html.alias("html")), "s_suppkey", "html")
    empty = markup.missing_children(nodes, "ul", "li").select("doc_id", F.lit("list-without-item").alias("rule"))
    return empty.unionByName(markup.misplaced_children(nodes, "li", ["ul", "ol", "menu"]).select("doc_id", F.lit("item-outside-list").alias("rule")))


@query("X32", """
SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '' WHEN p_size % 3 = 1 THEN 'b' ELSE '/i' END AS tags, CASE WHEN p_size % 2 = 0 THEN '' ELSE '(@3' END AS delimiters FROM part""")
def unclosed_pairs(t: Tables) -> DataFrame:
    """Tags and brackets that are opened and not closed, or closed and not opened, in text made of the parts."""
    html = F.element_at(F.array(*map(F.lit, ["<p><b>x</b></p>", "<p><b>x<br></p>", "<p>x</i></p>"])), (F.col("p_size") % 3 + 1).cast("int"))
    code = F.when(F.col("p_size") % 2 == 0, 'f(")", [1])').otherwise("[1](2, ')'")
    found = F.transform(markup.unbalanced_delimiters(code), lambda x: F.concat(x["delimiter"], F.lit("@"), x["offset"].cast("string")))
    return t.part.select("p_partkey", F.array_join(markup.unclosed_tag_names(html), ",").alias("tags"), F.array_join(found, ",").alias("delimiters"))


@query("S14 S24", """
SELECT p_partkey, x.kind, x.name, x.line FROM part, LATERAL (
  SELECT 'tag' AS kind, 'cfquery' AS name, 1 AS line UNION ALL SELECT 'variable', 'form.id', 2 UNION ALL SELECT 'tag', 'cfset', 4 UNION ALL SELECT 'call', 'getPart' || p_size, 4
  UNION ALL SELECT 'call', 'trim', 6 UNION ALL SELECT 'function', 'load' || p_size, 7) x""")
def cfml_facts(t: Tables) -> DataFrame:
    """Tags, output variables, calls and functions of CFML sources made of the parts; comments and strings are no code."""
    n = s("p_size")
    source = F.concat(
        F.lit('<cfquery name="q">\nSELECT #form.id#\n<!--- <cfabort> --->\n<cfset x = getPart'), n, F.lit("(\"<cfdump>\")>\n<cfscript>\ny = trim( 'no(1)' ); // call(2)\nfunction load"), n, F.lit("() { }\n</cfscript>"),
    )
    return t.part.select("p_partkey", F.explode(cfml.facts(source)).alias("f")).select("p_partkey", "f.kind", "f.name", "f.line")


@query("S14", """
WITH s AS (SELECT p_partkey, p_size % 5 AS k, strlen(p_name) AS n FROM part)
SELECT p_partkey, 'finding' AS kind, 'UNCLOSED_TAG' AS code, 'cfif' AS tag, n AS start, n + 8 AS stop, n AS open_start FROM s WHERE k = 1
UNION ALL SELECT p_partkey, 'finding', 'MISMATCHED_CLOSE', 'cfoutput', n + 8, n + 19, n FROM s WHERE k = 1
UNION ALL SELECT p_partkey, 'finding', 'UNBALANCED_DELIMITER', '(', n + 11, n + 12, NULL FROM s WHERE k = 2
UNION ALL SELECT p_partkey, 'incomplete', 'UNSUPPORTED_SYNTAX', 'cfnew', n, n + 7, NULL FROM s WHERE k = 3
UNION ALL SELECT p_partkey, 'finding', 'INVALID_BRANCH', 'cftry', n + 7, n + 15, n FROM s WHERE k = 4""")
def cfml_findings(t: Tables) -> DataFrame:
    """What a stack machine over the tags finds wrong in CFML sources made of the parts, with the places."""
    bodies = ["<cfif a><cfelse></cfif>don't", "<cfif a></cfoutput>", "<cfscript>f(</cfscript>", "<cfnew>", "<cftry></cftry>"]
    body = F.element_at(F.array(*map(F.lit, bodies)), (F.col("p_size") % 5 + 1).cast("int"))
    found = cfml.source_findings(t.part.select("p_partkey", F.concat("p_name", body).alias("source")), "p_partkey", "source")
    return found.withColumnRenamed("end", "stop")


@query("S24", """
SELECT s_suppkey, x.kind, x.name, x.block, x.value, x.start FROM (SELECT *, strlen(s_name) AS n, strlen(s_nationkey::VARCHAR) AS w FROM supplier), LATERAL (
  SELECT 'tag' AS kind, 'cfoutput' AS name, NULL AS block, NULL AS value, n AS start UNION ALL SELECT 'tag', 'cfmodule', 'cfoutput', 'm' || s_nationkey, n + 10
  UNION ALL SELECT 'call', 'trim', 'cfoutput', NULL, n + 36 + w UNION ALL SELECT 'region', 'cfoutput', NULL, NULL, n + 10) x""")
def cfml_attributes(t: Tables) -> DataFrame:
    """Tags with their attributes, nested blocks and spans of CFML sources made of the suppliers."""
    source = F.concat(F.lit("<cfoutput><cfmodule name='m"), s("s_nationkey"), F.lit("' size=\"#trim(a)#\"></cfoutput>"))
    facts = cfml.source_facts(t.supplier.select("s_suppkey", F.concat("s_name", source).alias("source")), "s_suppkey", "source")
    return facts.select("s_suppkey", "kind", "name", "block", F.col("attributes")["name"].alias("value"), "start")


@query("S20 S13", """
SELECT page_id, 'link' AS kind, target, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS target FROM pages) GROUP BY 1, 3""")
def page_tree_links(t: Tables) -> DataFrame:
    """Links, forms, scripts and style sheets of all pages, from a tree of each page."""
    parts = markup.page_parts(markup.elements(t.pages, "page_id", "html"))
    return parts.groupBy(F.col("doc_id").alias("page_id"), "kind", "target").agg(F.count(F.lit(1)).alias("n"))


@query("X32", "SELECT page_id, cast(len(regexp_extract_all(html, '<b>')) - len(regexp_extract_all(html, '</b>')) AS INTEGER) AS unclosed FROM pages")
def page_unclosed(t: Tables) -> DataFrame:
    """How many bold passages of each page are opened and not closed."""
    return t.pages.select("page_id", F.size(F.filter(markup.unclosed_tag_names(F.col("html")), lambda x: x == "b")).alias("unclosed"))


@query("X19 S23", """
SELECT o_orderkey, x.clause, x.start FROM orders, LATERAL (SELECT 'SELECT' AS clause, 0 AS start UNION ALL SELECT 'FROM', 9 UNION ALL SELECT 'WHERE', 19 + strlen(o_orderstatus)) x""")
def sql_clause_ranges(t: Tables) -> DataFrame:
    """Top-level clauses of statements made of the orders; the clauses of a subquery are not top-level."""
    sql = F.concat(F.lit("SELECT a FROM tab_"), F.col("o_orderstatus"), F.lit(" WHERE b IN (SELECT c FROM d)"))
    return t.orders.select("o_orderkey", F.explode(sqltext.sql_clauses(sql)).alias("x")).select("o_orderkey", "x.clause", "x.start")


@query("X13 X14", """
SELECT p_partkey, CASE p_size % 8 WHEN 0 THEN 'token=[REDACTED], ok' WHEN 1 THEN 'Authorization: Bearer [REDACTED]' WHEN 2 THEN 'use [REDACTED] now' WHEN 3 THEN 'https://u:[REDACTED]@h/p' WHEN 4 THEN 'GET /f?X-Amz-Signature=[REDACTED]&a=1'
  WHEN 5 THEN 'password: [REDACTED] end' WHEN 6 THEN 'key [REDACTED].' ELSE 'plain' || chr(10) || 'café ' || p_size END AS safe FROM part""")
def redacted_lines(t: Tables) -> DataFrame:
    """Credentials of eight kinds in lines made of the parts, with terminal codes and composed accents."""
    cases = [
        "\x1b[31mtoken=abc123def\x1b[0m, ok", "Authorization: Bearer eyJhbGciOi.x.y", "use sk-" + "a1B2" * 6 + " now", "https://u:p4ss@h/p",
        "GET /f?X-Amz-Signature=0123abcd&a=1", "password: \"two\nlines\" end", "key AIza" + "Sy0_-" * 7 + ".",
    ]
    line = F.element_at(F.array(*map(F.lit, cases)), (F.col("p_size") % 8 + 1).cast("int"))
    line = F.when(F.col("p_size") % 8 == 7, F.concat(F.lit("plain\r\ncafé "), s("p_size"))).otherwise(line)
    return t.part.select("p_partkey", text.redact(text.normal_form(text.strip_ansi(line))).alias("safe"))


@query("X4 X5", """
SELECT event_id, CASE event_type WHEN 'click' THEN 'object' WHEN 'error' THEN 'array' WHEN 'purchase' THEN 'text' WHEN 'signup' THEN 'integer' ELSE NULL END AS type, event_type IN ('click', 'error', 'purchase', 'signup') AS valid FROM events""")
def json_types(t: Tables) -> DataFrame:
    """json_type and json_valid of payloads made of the events."""
    k = F.col("event_type")
    body = F.when(k == "click", F.col("props")).when(k == "error", '[1, {"a": 2}]').when(k == "purchase", '"x"').when(k == "signup", s("event_id")).otherwise("{'open")
    return t.events.select("event_id", text.json_type(body).alias("type"), text.json_valid(body).alias("valid"))


@query("X15 X16 X17", """
SELECT p_partkey, x.specifier FROM part, LATERAL (SELECT './a' || p_size AS specifier UNION ALL SELECT 'lib/b' UNION ALL SELECT '../c' UNION ALL SELECT 'd') x""")
def import_tokens(t: Tables) -> DataFrame:
    """Imports of scripts made of the parts by a tokenizer: strings, templates and comments hide nothing and import nothing."""
    code = F.concat(
        F.lit("import x, { y } from './a"), s("p_size"), F.lit("';\nconst s = \"import z from 'no'\"; // import 'no'\nconst u = 'http://x'; const r = require(\"lib/b\");\n/* require('no') */ export * from `../c`;\nawait import('d'); const v = `require('no')`;"),
    )
    return t.part.select("p_partkey", F.explode(text.import_tokens(code)).alias("specifier"))


@query("F19 F20 X29 S2", """
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'source' WHEN 1 THEN 'doc' WHEN 2 THEN 'test' WHEN 3 THEN 'asset' ELSE 'manifest' END AS kind,
  CASE p_partkey % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' WHEN 3 THEN 'medium' ELSE 'high' END AS risk, p_partkey % 5 = 3 AS secret FROM part""")
def path_classes(t: Tables) -> DataFrame:
    """Kind, risk and secrecy of paths made of the parts, by the path functions."""
    slug = F.concat(F.regexp_replace("p_name", "[^a-z]+", "_"), F.lit("_"), s("p_partkey"))
    path = F.element_at(F.array(F.concat(F.lit("src/auth/"), slug, F.lit(".js")), F.concat(F.lit("docs/"), slug, F.lit(".md")), F.concat(F.lit("test/"), slug, F.lit(".test.js")), F.concat(slug, F.lit(".pem")), F.concat(F.lit("packages/"), slug, F.lit("/package.json"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return t.part.select("p_partkey", text.file_kind(path).alias("kind"), text.path_risk(path).alias("risk"), text.secret_like(path).alias("secret"))


@query("A21 X29", """
WITH c AS (SELECT l_partkey, count(DISTINCT l_orderkey) AS consumers FROM lineitem GROUP BY 1),
r AS (SELECT p_partkey, coalesce(consumers, 0) AS consumers, CASE WHEN p_partkey % 4 = 0 THEN 'critical' WHEN p_partkey % 4 = 1 THEN 'low' ELSE 'medium' END AS own, p_brand FROM part LEFT JOIN c ON l_partkey = p_partkey),
x AS (SELECT p_brand, CASE WHEN own = 'critical' THEN 'critical' WHEN consumers >= 10 THEN 'high' ELSE own END AS risk FROM r)
SELECT p_brand, CASE WHEN bool_or(risk = 'critical') THEN 'critical' WHEN bool_or(risk = 'high') THEN 'high' WHEN bool_or(risk = 'medium') THEN 'medium' ELSE 'low' END AS risk FROM x GROUP BY 1""")
def brand_risk(t: Tables) -> DataFrame:
    """The highest risk of each brand's changes: by path, raised where many orders depend on the file."""
    path = lambda k: F.concat(F.when(k % 4 == 0, "src/auth/p").when(k % 4 == 1, "p").otherwise("src/p"), k.cast("string"), F.when(k % 4 == 1, ".md").otherwise(".js"))
    changes = t.part.select(path(F.col("p_partkey")).alias("path"), "p_brand")
    imports = t.lineitem.select(s("l_orderkey").alias("src"), path(F.col("l_partkey")).alias("dst"))
    risks = project.change_risk(changes, imports)
    return risks.groupBy("p_brand").agg(verdicts.severity_fold("risk", ["critical", "high", "medium", "low"], "low").alias("risk"))


@query("R38", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'unknown' WHEN (CASE l_returnflag WHEN 'N' THEN 'O' ELSE 'F' END) = l_linestatus THEN 'pass' ELSE 'fail' END AS verdict FROM lineitem""")
def status_equality(t: Tables) -> DataFrame:
    """Expected against observed line status; what was not observed (returned lines) is unknown."""
    expected, got = F.when(F.col("l_returnflag") == "N", "O").otherwise("F"), F.when(F.col("l_returnflag") != "R", F.col("l_linestatus"))
    return t.lineitem.select("l_orderkey", "l_linenumber", verdicts.equality_check(expected, got).alias("verdict"))


@query("R9", """
WITH d AS (SELECT doc_id, doc_id % 7 - 2 AS a, doc_id % 11 + 3 AS b, len(string_split(coalesce(text, ''), chr(10))) AS last FROM documents)
SELECT doc_id, greatest(a, 1) AS low, least(b, last) AS high, greatest(a, 1) <> a OR least(b, last) <> b AS cut FROM d""")
def clamped_ranges(t: Tables) -> DataFrame:
    """Requested line ranges cut to the lines that a document has."""
    k = F.col("doc_id")
    last = F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("bigint")
    low, high, cut = intervals.clamp(k % 7 - 2, k % 11 + 3, last)
    return t.documents.select("doc_id", low.alias("low"), high.alias("high"), cut.alias("cut"))


@query("R59", """
SELECT s_suppkey, 11 + strlen('' || s_suppkey) AS host_start, 15 + strlen('' || s_suppkey) AS host_end, 2 AS host_line FROM supplier""")
def embedded_ranges(t: Tables) -> DataFrame:
    """Ranges found in an embedded part, moved to the offsets and lines of the document around it."""
    host = F.concat(F.lit("<a>"), s("s_suppkey"), F.lit("\n<b>sel ect</b>"))
    start = F.instr(host, "<b>") + 2
    found = t.supplier.select("s_suppkey", host.alias("host"), start.alias("offset"), F.lit(4).alias("start"), F.lit(8).alias("end"))
    return intervals.rebased(found, "host").select("s_suppkey", "host_start", "host_end", "host_line")


@query("W4", """
SELECT user_id, event_id, last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS failed FROM events""")
def last_failure_before(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "event_id", "event_type")
    return ordered.last_before(rows, ["user_id"], ["event_id"], F.when(F.col("event_type") == "error", F.col("event_id")), "failed").select("user_id", "event_id", "failed")


@query("W10", """
SELECT o_orderkey, (SELECT max(event_id) FROM events) + row_number() OVER (ORDER BY o_orderkey) AS event_id FROM orders""")
def appended_ids(t: Tables) -> DataFrame:
    """New rows numbered without gaps after the log's largest id."""
    return files.next_event_ids(t.events, t.orders.select("o_orderkey"), "o_orderkey").select("o_orderkey", "event_id")


@query("F14", PATHS + r"""
, r AS (SELECT min(regexp_extract(path, '^([^/]+/[^/]+)/', 1)) AS root FROM u) SELECT page_id FROM u, r WHERE path = root OR starts_with(path, root || '/')""")
def subtree_pages(t: Tables) -> DataFrame:
    """Pages below the first host and language."""
    paths = url_paths(t)
    root = paths.agg(F.min(F.regexp_extract("path", "^([^/]+/[^/]+)/", 1))).first()[0]
    return paths.where(relational.in_subtree(F.col("path"), root or "-")).select("page_id")


@query("S25 R57", """
SELECT 'p' || s_suppkey AS path, x.purpose FROM supplier, LATERAL (SELECT 'test' AS purpose, 0 AS n UNION ALL SELECT 'lint', 1) x WHERE n = 0 AND s_suppkey % 2 = 1 OR n = 1 AND s_suppkey % 3 > 0""")
def missing_scripts(t: Tables) -> DataFrame:
    """Packages without a build, test or lint script: odd ones have no test, those not divisible by 3 no lint."""
    k = F.col("s_suppkey")
    body = F.concat(F.lit('{"scripts":{"build":"tsc"'), F.when(k % 2 == 0, ',"unit":"jest"').otherwise(""), F.when(k % 3 == 0, ',"lint:all":"x"').otherwise(""), F.lit("}}"))
    manifests = t.supplier.select(F.concat(F.lit("p"), k.cast("string")).alias("path"), body.alias("body"))
    rows = files.manifest_rows(manifests).select("path", text.purpose(F.col("script"), F.col("command")).alias("purpose"))
    return project.missing_purposes(rows, manifests)


@query("U4", """
WITH a AS (SELECT DISTINCT p_brand, p_type FROM part WHERE p_size <= 25), b AS (SELECT DISTINCT p_brand, p_type FROM part WHERE p_size > 25)
SELECT p_brand, p_type, 'removed' AS change FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT p_brand, p_type, 'added' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def required_differences(t: Tables) -> DataFrame:
    """Types that only the small or only the large parts of a brand require."""
    return sets.required_change(t.part.where("p_size <= 25"), t.part.where("p_size > 25"), "p_brand", "p_type")


@query("U3", """
WITH x AS (SELECT c_nationkey AS id, 0 AS part, 'customer' AS source FROM customer WHERE c_acctbal < 0 UNION ALL SELECT s_nationkey, 1, 'supplier' FROM supplier UNION ALL SELECT n_nationkey, 2, 'nation' FROM nation)
SELECT id, arg_min(source, part) AS source FROM x GROUP BY id""")
def first_resolver(t: Tables) -> DataFrame:
    """The outputs of three resolvers merged: the first that knows an id wins."""
    part = lambda df, key, label: df.select(F.col(key).alias("id"), F.lit(label).alias("source"))
    return sets.union_distinct([part(t.customer.where("c_acctbal < 0"), "c_nationkey", "customer"), part(t.supplier, "s_nationkey", "supplier"), part(t.nation, "n_nationkey", "nation")], "id", ["source"])


@query("J31", """
WITH m AS (SELECT l_orderkey, l_partkey, count(*) AS n, min(l_linenumber) AS one FROM lineitem GROUP BY 1, 2)
SELECT o_orderkey, p.l_partkey, CASE WHEN n IS NULL THEN 'missing' WHEN n = 1 THEN 'unique' ELSE 'ambiguous' END AS state, CASE WHEN n = 1 THEN one END AS line
FROM (SELECT o_orderkey, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = 1 UNION ALL SELECT o_orderkey, -1 FROM orders) p LEFT JOIN m ON m.l_orderkey = o_orderkey AND m.l_partkey = p.l_partkey""")
def exactly_one(t: Tables) -> DataFrame:
    """A composite key (order, part) that must name exactly one line."""
    asked = t.orders.join(t.lineitem.where("l_linenumber = 1"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", "l_partkey")
    asked = asked.unionByName(t.orders.select("o_orderkey", F.lit(-1).cast("bigint").alias("l_partkey")))
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", F.col("l_linenumber").alias("line"))
    return relational.exactly_one(asked, lines, ["o_orderkey", "l_partkey"], "line")


@query("J32", """
WITH x AS (
  SELECT o_orderkey, c_custkey AS c, CASE WHEN o_orderkey % 7 = 0 OR c_custkey IS NULL OR c_acctbal < 0 THEN 'unknown-method' WHEN c_custkey % 3 = 2 THEN 'no-action' WHEN c_custkey % 3 = 0 THEN 'ambiguous-action'
    WHEN c_custkey % 5 = 0 THEN 'other-file' WHEN c_custkey % 11 = 0 THEN 'no-query' WHEN c_custkey % 2 = 1 THEN 'foreign-query' ELSE 'resolved' END AS state
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey)
SELECT o_orderkey, state, CASE WHEN state = 'resolved' THEN 'a' || c END AS action FROM x""")
def single_action(t: Tables) -> DataFrame:
    """Calls of customers as methods: each needs one action, in the method's file, whose queries all lie there (a nation is
    a file). Every seventh call names no method; customers in debt are no methods."""
    c, n = F.col("c_custkey"), F.col("c_nationkey")
    file = lambda x: F.concat(F.lit("f"), x.cast("string"))
    calls = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, "none").otherwise(F.concat(F.lit("m"), s("o_custkey"))).alias("method"))
    facts = t.customer.select(F.concat(F.lit("m"), s("c_custkey")).alias("id"), F.when(F.col("c_acctbal") < 0, "FIELD").otherwise("METHOD").alias("kind"), file(n).alias("file"))
    facts = facts.unionByName(t.part.select(F.concat(F.lit("q"), s("p_partkey")).alias("id"), F.lit("QUERY").alias("kind"), file(F.col("p_partkey") % 25).alias("file")))
    queries = F.transform(F.array(n + 25, n + 50 + c % 2, n + 25), lambda k: F.concat(F.lit("q"), k.cast("string")))
    action = t.customer.where("c_custkey % 3 <> 2").select(
        F.concat(F.lit("a"), s("c_custkey")).alias("action"), F.concat(F.lit("m"), s("c_custkey")).alias("method"),
        F.when(c % 5 == 0, "f99").otherwise(file(n)).alias("file"), F.when(c % 11 == 0, F.array().cast("array<string>")).otherwise(queries).alias("query_ids"),
    )
    second = action.where(F.expr("cast(substring(action, 2) as long) % 3 = 0")).withColumn("action", F.concat("action", F.lit("b")))
    return relational.single_action(calls, facts, action.unionByName(second)).select("o_orderkey", "state", "action")


@query("A32", """
SELECT o_custkey, count(*) AS attempts, count(*) >= 12 AS exhausted FROM orders GROUP BY 1""")
def attempts_against_bound(t: Tables) -> DataFrame:
    """Attempts of each task against the most that are allowed."""
    return relational.attempts_left(t.orders, "o_custkey", 12).select("o_custkey", "attempts", "exhausted")


@query("A7", """
SELECT l_returnflag, cast(sum(l_linenumber) AS BIGINT) AS total, sum(l_linenumber) > 100000 AS overflow FROM lineitem GROUP BY 1""")
def counter_sums(t: Tables) -> DataFrame:
    """Sums of counters with a check that they stay within their bound."""
    return verdicts.checked_sum(t.lineitem, ["l_returnflag"], "l_linenumber", 100_000).select("l_returnflag", "total", "overflow")


@query("K7", """
SELECT o_orderkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = 1 WHERE l_linestatus IS DISTINCT FROM o_orderstatus""")
def plan_source_mismatch(t: Tables) -> DataFrame:
    """Orders whose status is not that of the line they pin (their first)."""
    pinned = t.lineitem.where("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linestatus").alias("pinned"))
    return relational.pinned_mismatch(t.orders.select("o_orderkey", "o_orderstatus"), pinned, ["o_orderkey"], "o_orderstatus", "pinned").select("o_orderkey")


@query("J33", """
SELECT p_partkey, p_brand AS prefix, '' AS rest FROM part UNION ALL SELECT p_partkey, 'Brand', substr(p_brand, 7) FROM part""")
def alias_prefixes(t: Tables) -> DataFrame:
    """Aliases that are a path, or a prefix of it before a separator, with what is left of the path."""
    alias = t.part.select(F.col("p_brand").alias("prefix")).distinct().union(t.spark.createDataFrame([("Brand",), ("Bra",)], "prefix string"))
    return relational.prefix_alias(t.part.select("p_partkey", "p_brand"), "p_brand", alias, "prefix", "#").select("p_partkey", "prefix", "rest")


@query("R53", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'F' ELSE o_orderstatus END AS status, CASE WHEN o_orderstatus = 'O' THEN 2 ELSE 1 END AS version FROM orders""")
def optimistic_updates(t: Tables) -> DataFrame:
    """Orders closed by updates that expect version 1; those of finished orders expect version 0 and are refused."""
    state = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("status"), F.lit(1).alias("version"))
    updates = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "O", 1).otherwise(0).alias("expected"), F.lit("F").alias("new"))
    return relational.optimistic_update(state, updates, "o_orderkey", "status")[0].select("o_orderkey", "status", "version")


@query("R53", "SELECT o_orderkey, 'stale' AS reason FROM orders WHERE o_orderstatus <> 'O'")
def refused_updates(t: Tables) -> DataFrame:
    state = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("status"), F.lit(1).alias("version"))
    updates = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "O", 1).otherwise(0).alias("expected"), F.lit("F").alias("new"))
    return relational.optimistic_update(state, updates, "o_orderkey", "status")[1].select("o_orderkey", "reason")


@query("T8", """
WITH g AS (SELECT user_id, max(event_id) AS token FROM events WHERE event_type = 'signup' GROUP BY 1),
b AS (SELECT user_id, max(event_id) AS beat FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT g.user_id, g.token, CASE WHEN (SELECT max(event_id) FROM events) - greatest(g.token, CASE WHEN beat >= g.token THEN beat ELSE g.token END) > 500 THEN 'expired' ELSE 'held' END AS state FROM g LEFT JOIN b ON b.user_id = g.user_id""")
def lease_expiry(t: Tables) -> DataFrame:
    """Sign-ups as lease grants (the event id is token and time), views since as heartbeats."""
    grants = t.events.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("token"), F.lit("u").alias("holder"), F.col("event_id").alias("at"))
    newest = grants.groupBy("user_id").agg(F.max("token").alias("token"))
    beats = t.events.where("event_type = 'view'").select("user_id", F.col("event_id").alias("at")).join(newest, "user_id").where("at >= token").select("user_id", "token", "at")
    now = t.events.agg(F.max("event_id")).first()[0]
    return relational.lease_states(grants, beats, "user_id", F.lit(now), 500).select("user_id", "token", "state")


@query("T8", """
WITH g AS (SELECT user_id, max(event_id) AS token FROM events WHERE event_type = 'signup' GROUP BY 1)
SELECT e.event_id FROM events e JOIN g ON g.user_id = e.user_id WHERE e.event_type = 'purchase' AND e.event_id < g.token""")
def fenced_writes(t: Tables) -> DataFrame:
    """Purchases written with a token older than the user's newest grant."""
    grants = t.events.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("token"))
    writes = t.events.where("event_type = 'purchase'").select("user_id", "event_id", F.col("event_id").alias("token"))
    return relational.fenced(writes, grants, "user_id").select("event_id")


@query("S18", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1")
def cached_counts(t: Tables) -> DataFrame:
    """Rows written to a cache file that appears whole or not at all, and read back."""
    path = f"{shared_dir(t.spark)}/tessera-cache-{uuid.uuid4().hex}.json"
    rows = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    files.atomic_json(rows, path)
    return t.spark.read.schema(rows.schema).json(path)


@query("A13 R41 R42", """
WITH a AS (SELECT p_brand, max(p_size) AS mx, min(p_size) AS mn, list_sort(list(DISTINCT p_type)) AS e FROM part WHERE p_retailprice < 950 GROUP BY 1),
b AS (SELECT p_brand, max(p_size) AS mx, min(p_size) AS mn, list_sort(list(DISTINCT p_type)) AS e FROM part WHERE p_retailprice >= 950 GROUP BY 1),
f AS (SELECT a.e IS DISTINCT FROM b.e AND a.p_brand IS NULL OR a.mx IS DISTINCT FROM b.mx AND (a.mx IS NULL OR b.mx < a.mx) OR a.mn IS DISTINCT FROM b.mn AND (a.mn IS NULL OR b.mn > a.mn) OR len(list_filter(coalesce(a.e, []), lambda x: b.e IS NOT NULL AND NOT list_contains(b.e, x))) > 0 AS bad FROM a FULL JOIN b ON a.p_brand = b.p_brand)
SELECT CASE WHEN bool_or(bad) THEN 'breaking' ELSE 'compatible' END AS verdict FROM f""")
def contract_check(t: Tables) -> DataFrame:
    """One verdict over two schemas made of the cheap and the dear parts of each brand."""
    def side(cond: str) -> DataFrame:
        own = t.part.where(cond).groupBy("p_brand").agg(F.to_json(F.array_sort(F.collect_set("p_type"))).alias("enum"), F.max("p_size").cast("string").alias("maximum"), F.min("p_size").cast("string").alias("minimum"))
        return own.unpivot(["p_brand"], ["enum", "maximum", "minimum"], "keyword", "value").withColumnRenamed("p_brand", "pointer")

    return project.contract_verdict(project.schema_findings(side("p_retailprice < 950"), side("p_retailprice >= 950")))


@query("R17 L9", """
WITH r AS (SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 0 ELSE p_size % 6 END AS k FROM part), m AS (SELECT max(k) AS best FROM r)
SELECT 'release' AS tier, p_partkey AS test FROM r UNION ALL SELECT 'recommended', p_partkey FROM r WHERE k >= 3
UNION ALL SELECT 'minimum', p_partkey FROM r, m WHERE k = best AND (best > 2 OR p_partkey = (SELECT min(p_partkey) FROM r, m WHERE k = best))""")
def tiered_plan(t: Tables) -> DataFrame:
    """Minimum, recommended and release tiers of a test plan ranked by evidence."""
    plan = t.part.select(F.col("p_partkey").alias("test"), (F.col("p_size") % 6).alias("evidence_rank"))
    tiers = [rows.select(F.lit(tier).alias("tier"), "test") for tier, rows in project.test_tiers(plan).items()]
    return tiers[0].unionByName(tiers[1]).unionByName(tiers[2])


@query("L7 W11 R35", """
WITH i AS (SELECT o_custkey AS pack, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS place FROM orders)
SELECT pack, id, CASE WHEN place % 4 = 0 THEN 'included' ELSE 'omitted' END AS state, CASE place % 4 WHEN 1 THEN 'duplicate-locator' WHEN 2 THEN 'duplicate-artifact' WHEN 3 THEN 'budget' END AS reason FROM i""")
def packed_locators(t: Tables) -> DataFrame:
    """Orders of each customer packed: of four in a row the second lies inside the first, the third repeats its content,
    and the fourth is over the budget."""
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    rows = t.orders.select("o_custkey", "o_orderkey", place.alias("place"))
    k, part = F.floor(F.col("place") / 4).cast("int"), F.col("place") % 4
    locator = F.array(F.struct(F.concat(F.lit("f"), k.cast("string")).alias("path"), (part * 2).cast("int").alias("start"), (F.lit(10) - part).cast("int").alias("end")))
    own = F.concat_ws("-", s("o_custkey"), k.cast("string"), F.when(part == 2, 0).otherwise(part).cast("string"))
    items = rows.select(
        F.col("o_custkey").cast("string").alias("pack"), F.col("o_orderkey").alias("id"), F.lit(False).alias("mandatory"), F.lit(0).alias("priority"),
        F.sha2(own, 256).alias("sha256"), F.when(part == 3, 10**9).otherwise(1).cast("bigint").alias("bytes"), F.when(part == 1, locator).when(part == 0, locator).otherwise(F.array().cast("array<struct<path:string,start:int,end:int>>")).alias("locators"),
    )
    return packs.greedy_pack(items, 10**6).select(F.col("pack").cast("bigint").alias("pack"), "id", "state", "reason")


@query("L13 S19", """
SELECT p_brand AS scope, sum(strlen('{"p_partkey":' || p_partkey || ',"p_name":"' || p_name || '"}')) OVER (PARTITION BY p_brand) > 0 AS kept FROM (SELECT p_brand, min(p_partkey) AS p_partkey, min(p_name) AS p_name FROM part GROUP BY 1)
QUALIFY sum(strlen('{"p_partkey":' || p_partkey || ',"p_name":"' || p_name || '"}')) OVER (ORDER BY p_brand) <= 500""")
def scopes_that_fit(t: Tables) -> DataFrame:
    """Whole scopes dropped from the end until the output fits its byte bound."""
    rows = t.part.groupBy("p_brand").agg(F.min("p_partkey").alias("p_partkey"), F.min("p_name").alias("p_name"))
    return files.fitting_scopes(rows, "p_brand", ["p_partkey", "p_name"], 500).select("p_brand", F.lit(True).alias("kept")).withColumnRenamed("p_brand", "scope")


@query("X21", """
SELECT p_partkey, p_brand = 'Brand#1' AS whole, contains(p_brand, 'Brand#1') AS part, regexp_full_match(p_name, '[a-m]+ [a-z]+') AS name FROM part""")
def pattern_probes(t: Tables) -> DataFrame:
    """Samples against patterns, as a whole and in part."""
    whole, part = text.pattern_probe(F.col("p_brand"), "Brand#1")
    return t.part.select("p_partkey", whole.alias("whole"), part.alias("part"), text.pattern_probe(F.col("p_name"), "[a-m]+ [a-z]+")[0].alias("name"))


@query("R20", """
SELECT 'test/t' || s_suppkey || '.test.js' AS test, 'fallback' AS confidence, 'repository' AS evidence FROM supplier""")
def fallback_plan(t: Tables) -> DataFrame:
    """A change that no test is related to: every test of the repository is the plan."""
    tests = t.supplier.select(F.concat(F.lit("test/t"), s("s_suppkey"), F.lit(".test.js")).alias("path"))
    changes = t.region.select(F.concat(F.lit("lib/r"), s("r_regionkey"), F.lit(".js")).alias("path"))
    imports = t.spark.createDataFrame([], "src string, dst string")
    return project.map_tests(changes, tests, imports).select("test", "confidence", "evidence")
