"""Scanners of CFML, scripts, logs and credentials."""

import re
import time

import pytest

from tessera.functions.text import SECRETS, imported, redact
from tessera.sources import cfml, logs


def codes(source, **limits):
    return [(f.kind, f.code, f.tag, f.start, f.open_start) for f in cfml.check(source, **limits)]


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("<cfif a><cfelseif b><cfelse></cfif><cfset x='it''s > fine'>", []),
        ("<cfif></cfoutput>", [("finding", "UNCLOSED_TAG", "cfif", 0, 0), ("finding", "MISMATCHED_CLOSE", "cfoutput", 6, 0)]),
        ("</cfloop>", [("finding", "UNEXPECTED_CLOSE", "cfloop", 0, None)]),
        ("</cfscript>", [("finding", "UNEXPECTED_CLOSE", "cfscript", 0, None)]),
        ("<cfelse>", [("finding", "INVALID_BRANCH", "cfelse", 0, None)]),
        ("<cfif a><cfelse><cfelseif b><cfelse></cfif>", [("finding", "INVALID_BRANCH", "cfelseif", 16, 0), ("finding", "INVALID_BRANCH", "cfelse", 28, 0)]),
        ("<cftry><cfset a=1></cftry>", [("finding", "INVALID_BRANCH", "cftry", 18, 0)]),
        ("<cftry><cffinally></cffinally><cfcatch></cfcatch></cftry>", [("finding", "INVALID_BRANCH", "cfcatch", 30, 0)]),
        ("<cfcatch></cfcatch>", [("finding", "INVALID_BRANCH", "cfcatch", 0, None)]),
        ("<cfswitch><cfcase></cfcase><cfdefaultcase></cfdefaultcase><cfdefaultcase></cfdefaultcase></cfswitch>", [("finding", "INVALID_BRANCH", "cfdefaultcase", 58, 0)]),
        ("<cfloop/><cfnew></cfset>", [("incomplete", "UNSUPPORTED_SYNTAX", "cfloop", 0, None), ("incomplete", "UNSUPPORTED_SYNTAX", "cfnew", 9, None), ("incomplete", "UNSUPPORTED_SYNTAX", "cfset", 16, None)]),
        ("<cftransaction action='commit'><cftransaction></cftransaction><cftransaction action='#a#'>", [("incomplete", "UNSUPPORTED_SYNTAX", "cftransaction", 62, None)]),
        ("<cfscript>f(1; }</cfscript>", [("finding", "UNBALANCED_DELIMITER", "(", 11, None), ("finding", "UNBALANCED_DELIMITER", "}", 15, None)]),
        ("<cfscript>// ( \n/* [ */ x = '{'; <cfset y=1></cfscript>", [("incomplete", "UNSUPPORTED_SYNTAX", "cfset", 33, None)]),
        ("<cfscript>a", [("finding", "UNCLOSED_TAG", "cfscript", 0, 0), ("incomplete", "UNTERMINATED_TAG", "", 11, None)]),
        ("<cfscript>/* a", [("finding", "UNCLOSED_TAG", "cfscript", 0, 0), ("finding", "UNTERMINATED_COMMENT", "", 10, None), ("incomplete", "UNTERMINATED_COMMENT", "", 14, None)]),
        ("<cfset x='a''", [("incomplete", "UNTERMINATED_STRING", "", 13, None)]),
        ("<cfset x <!--- > --->", [("incomplete", "UNTERMINATED_TAG", "", 0, None)]),
        ("<!--- a <!--- b ---> <cfif>", [("incomplete", "UNTERMINATED_COMMENT", "", 0, None)]),
        ("<!--- <cfif> ---> 'don't' /* <b>", []),
    ],
)
def test_cfml_findings(source, want):
    assert codes(source) == want


def test_cfml_limits():
    assert codes("<cfif>" * 4, max_nesting=3) == [("incomplete", "LIMIT_EXCEEDED", "", 18, None)]
    assert codes("</cfif>" * 4, max_findings=2)[-1] == ("incomplete", "LIMIT_EXCEEDED", "", 14, None)


def test_cfml_facts_have_spans_blocks_and_attributes():
    source = "<cfoutput query='q'>\n<cfmodule name=\"a\"\"b\" size=3 value='#trim(form.x)#'>#y.z#\n<cfscript>z = \"#g(1)#\" + h();</cfscript></cfoutput>"
    found = cfml.facts_of(source)
    assert [(f.kind, f.name, f.line, f.block) for f in found] == [
        ("tag", "cfoutput", 1, None), ("tag", "cfmodule", 2, "cfoutput"), ("call", "trim", 2, "cfoutput"), ("variable", "y.z", 2, "cfoutput"),
        ("tag", "cfscript", 3, "cfoutput"), ("call", "g", 3, "cfscript"), ("call", "h", 3, "cfscript"), ("region", "cfscript", 3, "cfoutput"), ("region", "cfoutput", 1, None),
    ]
    assert found[1].attributes == {"name": 'a"b', "size": "3", "value": "#trim(form.x)#"} and found[0].attributes == {"query": "q"}
    by = {(f.kind, f.name): source[f.start : f.end] for f in found}
    assert by["region", "cfscript"] == 'z = "#g(1)#" + h();' and by["variable", "y.z"] == "y.z" and by["tag", "cfoutput"] == "<cfoutput query='q'>"
    # A tag in a string is no tag; an expression tag has no attributes.
    assert [(f.kind, f.name, f.attributes) for f in cfml.facts_of("<cfset a = f('<cfabort>')>")] == [("tag", "cfset", None), ("call", "f", None)]


@pytest.mark.parametrize("unit", ["/* ", "' ", "<!--- ", "# ", "<cfif ", "<cfscript>/*", "plain text of a page\n", '<cfset x = "a" & f(b)>\n'])
def test_cfml_scanners_are_linear(unit):
    text = unit * (1_000_000 // len(unit))
    start = time.time()
    cfml.facts_of(text), cfml.check(text)
    assert time.time() - start < 12


def test_cfml_as_rows(spark):
    frame = spark.createDataFrame([(1, "<cfif>"), (2, None), (3, "<cfset x=f(1)>"), (4, "")], "id long, body string")
    assert [tuple(r) for r in cfml.source_findings(frame, "id", "body").collect()] == [(1, "finding", "UNCLOSED_TAG", "cfif", 0, 6, 0)]
    got = sorted(tuple(r)[:4] for r in cfml.source_facts(frame, "id", "body").collect())
    assert got == [(1, "tag", "cfif", 1), (3, "call", "f", 1), (3, "tag", "cfset", 1)]


def test_imports_among_regular_expressions_and_templates():
    assert imported("""const r=/'/; import x from './a'; const t=/"/;""") == ["./a"]
    assert imported("const q = a / b; const s = 'x' / 2; import('./c')") == ["./c"]
    assert imported("if (x) /'/.test(y); const z = require('./d')") == ["./d"]
    assert imported("const t = `a ${ f(`b ${ require('./e') } c`, {k: `}`}) } require('./no')`; require('./f')") == ["./e", "./f"]
    assert imported("x = /[/'\"]/g; import a from './g'; y = 1 / 2 / 3; export * from './h'") == ["./g", "./h"]
    assert imported("const a = 'it\\'s'; import b from './i\\x41'; require('./j\\'k')") == ["./j'k"]
    assert imported("const s = 'open\nimport y from './l'") == ["./l"]
    assert imported("o.require('./m'); `require('./n')`; return /from '.o'/; ") == []
    start = time.time()
    imported("`${" * 100_000 + "a / b 'c' " * 50_000)
    assert time.time() - start < 8


def test_compiler_lines_without_a_place(spark):
    lines = ["src/a.ts(3,7): error TS2322: Type 'x'.", "error TS18003: No inputs were found.", "  warning TS6053: File 'b' not found.", "error: TS1 no", "x error TS1: no"]
    frame = spark.createDataFrame([("log", i, x) for i, x in enumerate(lines)], "artifact string, seq int, line string")
    got = [tuple(r) for r in logs.compiler_rows(frame).orderBy("seq").select("severity", "code", "file", "line", "col", "message").collect()]
    assert got == [
        ("error", "TS2322", "src/a.ts", 3, 7, "Type 'x'."), ("error", "TS18003", None, None, None, "No inputs were found."),
        ("warning", "TS6053", None, None, None, "File 'b' not found."),
    ]


REDACTED = {
    "refresh_token=abc&x": "refresh_token=[REDACTED]",
    "my client-secret: 'a\nb' rest": "my client-secret: [REDACTED] rest",
    '"private_key": "unended \\" value\nmore': '"private_key": [REDACTED]',
    "Authorization: Digest abc123, ok": "Authorization: Digest [REDACTED], ok",
    '"authorization": "Token abc def" end': '"authorization": "Token [REDACTED]" end',
    "session-token = x; id_token=y}": "session-token = [REDACTED]; id_token=[REDACTED]}",
    '{"the api key": 1, "stored password hint": "p q"}': '{"the api key": 1, "stored password hint": [REDACTED]}',
    "db_url=postgres://u:p@h/x": "db_url=[REDACTED]",
    "mongodb://u:pw@h": "mongodb://u:[REDACTED]@h",
    "ghp_abcdefgh12 AKIAABCDEFGH": "[REDACTED] [REDACTED]",
    "tokens: fine, secretary = fine": "tokens: fine, secretary = fine",
    "password: [REDACTED]": "password: [REDACTED]",
}


def test_redaction_of_names_schemes_and_open_quotes(spark):
    for text, want in REDACTED.items():
        line = text
        for pattern, replacement in SECRETS:
            line = re.sub(pattern, re.sub(r"\$(\d)", r"\\\1", replacement), line)
        assert line == want
    frame = spark.createDataFrame(list(REDACTED.items()), "text string, want string")
    assert [(r.got, r.want) for r in frame.select(redact(frame.text).alias("got"), "want").collect() if r.got != r.want] == []


def test_sources_of_one_partition_are_dealt_and_come_in_batches(spark):
    """One small file may hold many sources: several tasks read them, and hand out rows of many sources at a time."""
    rows = [(i, "<cfif a>" * (i % 4) + "<cfnew>") for i in range(3000)] + [(None, "<cfnew>"), (5000, None)]
    sources = spark.createDataFrame(rows, "k long, source string").coalesce(1)
    found = cfml.source_findings(sources, "k", "source")
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    want = sorted(((k, *r) for k, text in rows for r in cfml.check(text or "")), key=str)
    assert sorted((tuple(r) for r in found.collect()), key=str) == want
    facts = cfml.source_facts(sources.where("k < 50"), "k", "source").collect()
    assert sorted((r.k, r.kind, r.name, r.start) for r in facts) == sorted((k, f.kind, f.name, f.start) for k, text in rows[:50] for f in cfml.facts_of(text))
