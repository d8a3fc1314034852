"""Facts and findings out of CFML sources, by scanners whose time is linear in the text.

`facts_of` is one pass with a stack of modes: plain text, the inside of a tag (attributes, or an expression), expressions
between # signs, and script regions. Each mode has one pattern that finds its next token, so nothing outside a mode is
looked at twice; comments and strings are tokens of their own. Facts carry their span in characters, their line, the
block they lie in and, for tags, the literal attributes.

`check` is a stack machine over the tags: it pairs them, judges branches and handlers by the block that is directly open,
balances brackets inside scripts, and goes on after a fault. What cannot be read is a row `incomplete`, never an
exception: an unknown tag, a paired tag that closes itself, a string, comment or tag without an end, too deep nesting.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import scans

#: Tags with a body, tags that belong to a branch, and tags without a body.
PAIRED = frozenset(
    "cfif cfloop cfoutput cfquery cfsavecontent cfsilent cfcomponent cffunction cfscript cftry cfcatch cffinally cftransaction cfswitch cfcase cfdefaultcase".split()
)
BRANCH = frozenset("cfelseif cfelse".split())
BODYLESS = frozenset(
    "cfset cfreturn cfinclude cfargument cfqueryparam cfparam cfabort cfbreak cferror cfcookie cfheader cffile cfimage cflocation cfpdf cfdirectory cfexecute"
    " cfflush cfmodule cfzip cfsetting".split()
)
#: Tags whose inside is an expression, not attributes.
EXPRESSIONS = frozenset("cfset cfif cfelseif cfreturn".split())
#: Words before a bracket that are no calls.
KEYWORDS = frozenset("if else elseif for while switch case catch return function and or not in".split())

STRING = r'"(?:[^"]++|"")*+(?:"|\Z)|' + r"'(?:[^']++|'')*+(?:'|\Z)"
NOTE = r"//[^\r\n]*+|/\*(?s:.*?)(?:\*/|\Z)"
COMMENT_EDGE = re.compile(r"<!---|--->")
IN_TEXT = re.compile(r"(?P<comment><!---)|(?P<tag></?cf[\w:-]++)|\#(?P<inner>[^\#\r\n<>]*+)\#", re.I)
IN_TAG = re.compile(rf"(?P<comment><!---)|(?P<end>/?>)|(?P<attribute>[A-Za-z_][\w:.-]*+)\s*+=\s*+(?P<value>{STRING}|[^\s\"'=<>`]++)?|(?P<string>{STRING})|[\w.:-]++")
IN_EXPRESSION = re.compile(rf"(?P<comment><!---)|(?P<end>/?>)|(?P<string>{STRING})|\bfunction\s++(?P<function>[A-Za-z_]\w*+)\s*+\(|(?P<call>[A-Za-z_]\w*+)(?=\s*+\()|[\w.]++")
IN_SCRIPT = re.compile(rf"(?P<note>{NOTE})|(?P<string>{STRING})|(?P<close></cfscript\b[^>]*+>?)|\bfunction\s++(?P<function>[A-Za-z_]\w*+)\s*+\(|(?P<call>[A-Za-z_]\w*+)(?=\s*+\()|[\w.]++", re.I)
HASHED = re.compile(r"\#\#|\#(?P<inner>[^\#]*+)\#")
VARIABLE = re.compile(r"[A-Za-z_][\w.]*\Z")


class Fact(NamedTuple):
    kind: str
    name: str
    line: int
    start: int
    end: int
    block: str | None
    attributes: dict[str, str] | None


def comment_end(source: str, start: int) -> int | None:
    """Where the comment that opens at start ends; comments nest. None: nowhere."""
    depth = 0
    for m in COMMENT_EDGE.finditer(source, start):
        depth += 1 if m.group() == "<!---" else -1
        if not depth:
            return m.end()
    return None


def unquoted(value: str) -> str:
    if value[:1] in ("'", '"'):
        body = value[1:-1] if len(value) > 1 and value[-1] == value[0] else value[1:]
        return body.replace(value[0] * 2, value[0])
    return value


class _Facts:
    """The state of one pass."""

    def __init__(self, source: str) -> None:
        self.source, self.found, self.blocks = source, [], []
        self.lines = [m.end() for m in re.finditer("\n", source)]

    def add(self, kind: str, name: str, start: int, end: int, attributes: dict[str, str] | None = None) -> None:
        block = self.blocks[-1][0] if self.blocks else None
        self.found.append(Fact(kind, name, 1 + bisect_right(self.lines, start), start, end, block, attributes))

    def hashed(self, start: int, end: int) -> None:
        """Expressions between # signs of a string or text."""
        for m in HASHED.finditer(self.source, start, end):
            if m["inner"] is not None:
                self.inner(*m.span("inner"))

    def inner(self, start: int, end: int) -> None:
        if VARIABLE.match(self.source, start, end):
            self.add("variable", self.source[start:end], start, end)
            return
        for m in IN_EXPRESSION.finditer(self.source, start, end):
            if m["call"] and m["call"].lower() not in KEYWORDS:
                self.add("call", m["call"], *m.span("call"))

    def tag(self, start: int, at: int) -> int:
        """A tag whose name ends at `at`; returns where the tag ends."""
        closing = self.source[start + 1] == "/"
        name = self.source[start + 1 + closing : at].lower()
        place, attributes = len(self.found), {}
        pattern = IN_EXPRESSION if name in EXPRESSIONS else IN_TAG
        ended = False
        while not ended:
            m = pattern.search(self.source, at)
            if m is None:
                at = len(self.source)
                break
            kind, at = m.lastgroup, m.end()
            if kind == "comment":
                at = comment_end(self.source, m.start()) or len(self.source)
            elif kind == "end":
                ended = True
            elif kind == "string":
                self.hashed(*m.span())
            elif kind == "call" and m["call"].lower() not in KEYWORDS:
                self.add("call", m["call"], *m.span("call"))
            elif kind in ("attribute", "value"):
                attributes[m["attribute"].lower()] = unquoted(m["value"] or "")
                self.hashed(*m.span("value")) if m["value"] else None
        if not closing:
            block = self.blocks[-1][0] if self.blocks else None
            self.found.insert(place, Fact("tag", name, 1 + bisect_right(self.lines, start), start, at, block, None if name in EXPRESSIONS else attributes))
            if name in PAIRED and self.source[at - 2 : at] != "/>":
                self.blocks.append((name, at))
        elif any(b[0] == name for b in self.blocks):
            # Blocks left open inside are closed with theirs.
            while True:
                opened, inside = self.blocks.pop()
                if opened == name:
                    break
            self.add("region", name, inside, start)
        return at

    def script(self, at: int) -> int:
        """A script region from `at` on, up to its closing tag."""
        while True:
            m = IN_SCRIPT.search(self.source, at)
            if m is None:
                return len(self.source)
            kind, at = m.lastgroup, m.end()
            if kind == "close":
                return m.start()
            if kind == "string":
                self.hashed(*m.span())
            elif kind == "function":
                self.add("function", m["function"], *m.span("function"))
            elif kind == "call" and m["call"].lower() not in KEYWORDS:
                self.add("call", m["call"], *m.span("call"))

    def run(self) -> list[Fact]:
        at = 0
        while True:
            m = IN_TEXT.search(self.source, at)
            if m is None:
                return self.found
            at = m.end()
            if m["comment"]:
                at = comment_end(self.source, m.start()) or len(self.source)
            elif m["tag"]:
                at = self.tag(m.start(), at)
                if self.blocks and self.blocks[-1] == ("cfscript", at):
                    at = self.script(at)
            elif m["inner"]:
                self.inner(*m.span("inner"))


def facts_of(source: str) -> list[Fact]:
    """Facts of kinds tag, variable, call, function and region, in order; a region comes when it ends."""
    return _Facts(source).run()


def scan(source: str) -> list[tuple[str, str, int]]:
    """(kind, name, line) of the facts of a source, without script tags and regions. Calls count inside tags and scripts."""
    return [(f.kind, f.name, f.line) for f in facts_of(source) if f.kind != "region" and (f.kind, f.name) != ("tag", "cfscript")]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("name", T.StringType()), T.StructField("line", T.IntegerType())])))
def facts(source: pd.Series) -> pd.Series:
    return pd.Series([[{"kind": k, "name": n, "line": i} for k, n, i in scan(t or "")] for t in source], dtype=object)


class Finding(NamedTuple):
    kind: str
    code: str
    tag: str
    start: int
    end: int
    open_start: int | None


IN_CHECK = re.compile(r"(?P<comment><!---)|(?P<tag></?cf[\w:-]++)", re.I)
TO_END = re.compile(rf"(?P<comment><!---)|(?P<end>>)|(?P<string>{STRING})")
IN_REGION = re.compile(rf"(?P<line>//[^\r\n]*+)|(?P<note>/\*)|(?P<string>{STRING})|(?P<tag></?cf[\w:-]++)", re.I)
IN_BRACKETS = re.compile(rf"(?P<line>//[^\r\n]*+)|(?P<note>/\*)|(?P<string>{STRING})|(?P<open>[(\[{{])|(?P<close>[)\]}}])")
ATTRIBUTE = re.compile(rf"\s*+([A-Za-z_][\w:.-]*+)\s*+=\s*+({STRING}|[^\s\"'=<>`]++)\s*+")
PARTNER = {")": "(", "]": "[", "}": "{"}
#: Tags that must lie directly in another one.
PARENT = {"cfcatch": "cftry", "cffinally": "cftry", "cfcase": "cfswitch", "cfdefaultcase": "cfswitch"}


def unended(text: str, m: re.Match) -> bool:
    """Whether a string token runs to the end of the text without its closing quote."""
    value = m["string"]
    return len(value) < 2 or value[-1] != value[0] or (len(value) - len(value.rstrip(value[0])) - (value.strip(value[0]) == "")) % 2 == 0


def transaction_kind(attributes: str) -> str:
    """open, bodyless or unknown, by the literal action of a transaction tag."""
    at, action, size = 0, None, len(attributes.rstrip())
    while at < size:
        m = ATTRIBUTE.match(attributes, at)
        if m is None or m[1].lower() == "attributecollection" or (m[1].lower() == "action" and action is not None):
            return "unknown"
        if m[1].lower() == "action":
            action = unquoted(m[2]).lower()
        at = m.end()
    if action in (None, "begin"):
        return "open"
    return "bodyless" if action in ("commit", "rollback", "setsavepoint") else "unknown"


class _Stop(Exception):
    pass


class _Check:
    def __init__(self, source: str, max_nesting: int, max_findings: int) -> None:
        self.source, self.max_nesting, self.max_findings = source, max_nesting, max_findings
        self.rows: list[Finding] = []
        self.open: list[dict] = []
        self.counts = {"finding": 0, "incomplete": 0}

    def add(self, kind: str, code: str, tag: str, start: int, end: int, opened: dict | None = None) -> None:
        if self.counts[kind] >= self.max_findings:
            self.stop("LIMIT_EXCEEDED", start)
        self.counts[kind] += 1
        self.rows.append(Finding(kind, code, tag, start, end, opened and opened["start"]))

    def stop(self, code: str, at: int, end: int | None = None) -> None:
        """The source cannot be read on."""
        self.rows.append(Finding("incomplete", code, "", at, min(len(self.source), at + 1) if end is None else end, None))
        raise _Stop

    def tag_end(self, start: int, at: int) -> int:
        while True:
            m = TO_END.search(self.source, at)
            if m is None:
                self.stop("UNTERMINATED_TAG", start)
            at = m.end()
            if m.lastgroup == "end":
                return at
            if m.lastgroup == "comment":
                at = comment_end(self.source, m.start()) or self.stop("UNTERMINATED_COMMENT", m.start())
            elif at == len(self.source) and unended(self.source, m):
                self.stop("UNTERMINATED_STRING", at)

    def brackets(self, start: int, end: int) -> None:
        held: list[tuple[str, int]] = []
        at = start
        while m := IN_BRACKETS.search(self.source, at, end):
            at, kind = m.end(), m.lastgroup
            if kind == "note":
                at = self.source.find("*/", at, end) + 2
                if at == 1:
                    self.add("finding", "UNTERMINATED_COMMENT", "", m.start(), end)
                    break
            elif kind == "string":
                if at == end and unended(self.source, m):
                    self.add("finding", "UNTERMINATED_STRING", "", end, end)
                    break
            elif kind == "open":
                if len(held) >= self.max_nesting:
                    self.stop("LIMIT_EXCEEDED", m.start())
                held.append((m[0], m.start()))
            elif kind == "close":
                if held and held[-1][0] == PARTNER[m[0]]:
                    held.pop()
                else:
                    self.add("finding", "UNBALANCED_DELIMITER", m[0], m.start(), at)
        for sign, place in held:
            self.add("finding", "UNBALANCED_DELIMITER", sign, place, place + 1)

    def script(self, start: int) -> int:
        """A script region; returns where its closing tag begins. Other tags inside are told and passed over."""
        at, fault, islands = start, None, []
        while fault is None:
            m = IN_REGION.search(self.source, at)
            if m is None:
                fault, at = "UNTERMINATED_TAG", len(self.source)
                break
            at, kind = m.end(), m.lastgroup
            if kind == "note":
                at = self.source.find("*/", at) + 2
                if at == 1:
                    fault, at = "UNTERMINATED_COMMENT", len(self.source)
            elif kind == "string":
                if at == len(self.source) and unended(self.source, m):
                    fault = "UNTERMINATED_STRING"
            elif kind == "tag":
                if m[0].lower() == "</cfscript":
                    at = m.start()
                    break
                try:
                    end = self.tag_end(m.start(), at)
                except _Stop:
                    fault, at = self.rows.pop().code, m.start()
                    break
                islands.append((m[0].strip("</").lower(), m.start(), end))
                at = end
        self.brackets(start, at)
        for name, a, b in islands:
            self.add("incomplete", "UNSUPPORTED_SYNTAX", name, a, b)
        if fault:
            self.stop(fault, at)
        return at

    def branch(self, name: str, start: int, end: int) -> None:
        top = self.open[-1] if self.open else None
        if top is None or top["name"] != "cfif":
            self.add("finding", "INVALID_BRANCH", name, start, end)
            return
        if top["done"]:
            self.add("finding", "INVALID_BRANCH", name, start, end, top)
        top["done"] = top["done"] or name == "cfelse"

    def opened(self, name: str, start: int, end: int) -> None:
        if len(self.open) >= self.max_nesting:
            self.stop("LIMIT_EXCEEDED", start)
        top, parent = self.open[-1] if self.open else None, PARENT.get(name)
        if parent and (top is None or top["name"] != parent):
            self.add("finding", "INVALID_BRANCH", name, start, end)
        elif parent:
            last = name in ("cffinally", "cfdefaultcase")
            # Nothing may follow the last handler of a try; a switch has one default.
            if top["done"] and (last or parent == "cftry"):
                self.add("finding", "INVALID_BRANCH", name, start, end, top)
            top["handled"], top["done"] = True, top["done"] or last
        self.open.append({"name": name, "start": start, "end": end, "done": False, "handled": False})

    def closed(self, name: str, start: int, end: int) -> None:
        top = self.open[-1] if self.open else None
        if name in BODYLESS:
            self.add("incomplete", "UNSUPPORTED_SYNTAX", name, start, end)
        elif top is None or (name == "cfscript" and top["name"] != name):
            self.add("finding", "UNEXPECTED_CLOSE", name, start, end)
        elif top["name"] != name:
            self.add("finding", "MISMATCHED_CLOSE", name, start, end, top)
        else:
            if name == "cftry" and not top["handled"]:
                self.add("finding", "INVALID_BRANCH", name, start, end, top)
            self.open.pop()

    def tag(self, start: int, at: int) -> int:
        closing = self.source[start + 1] == "/"
        name = self.source[start + 1 + closing : at].lower()
        end = self.tag_end(start, at)
        inside = self.source[at : end - 1].rstrip()
        itself = inside.endswith("/")
        if closing:
            if name in PAIRED or name in BRANCH or name in BODYLESS:
                self.closed(name, start, end)
            else:
                self.add("incomplete", "UNSUPPORTED_SYNTAX", name, start, end)
            return end
        kind = "branch" if name in BRANCH else "bodyless" if name in BODYLESS else "open" if name in PAIRED else "unknown"
        if name == "cftransaction":
            kind = transaction_kind(inside[:-1] if itself else inside)
        if kind == "unknown" or (kind == "open" and itself):
            self.add("incomplete", "UNSUPPORTED_SYNTAX", name, start, end)
        elif kind == "branch":
            self.branch(name, start, end)
        elif kind == "open":
            self.opened(name, start, end)
            if name == "cfscript":
                return self.script(end)
        return end

    def run(self) -> list[Finding]:
        at = 0
        try:
            while m := IN_CHECK.search(self.source, at):
                at = m.end()
                if m["comment"]:
                    at = comment_end(self.source, m.start()) or self.stop("UNTERMINATED_COMMENT", m.start(), min(len(self.source), m.start() + 5))
                else:
                    at = self.tag(m.start(), at)
        except _Stop:
            pass
        if not any(r.code == "LIMIT_EXCEEDED" for r in self.rows):
            for tag in reversed(self.open):
                if self.counts["finding"] >= self.max_findings:
                    break
                self.add("finding", "UNCLOSED_TAG", tag["name"], tag["start"], tag["end"], tag)
        return sorted(self.rows, key=lambda r: (r.kind, r.start, r.code))


def check(source: str, max_nesting: int = 256, max_findings: int = 1000) -> list[Finding]:
    """Findings and incomplete parts of a source, each kind by place and code."""
    return _Check(source, max_nesting, max_findings).run()


FINDINGS = [T.StructField("kind", T.StringType()), T.StructField("code", T.StringType()), T.StructField("tag", T.StringType())] + [T.StructField(n, T.LongType()) for n in ("start", "end", "open_start")]
FACTS = [T.StructField("kind", T.StringType()), T.StructField("name", T.StringType())] + [T.StructField(n, T.LongType()) for n in ("line", "start", "end")] + [T.StructField("block", T.StringType()), T.StructField("attributes", T.MapType(T.StringType(), T.StringType()))]


#: Sources that one task reads on average at most, and rows from which on a worker hands them out.
SOURCES, ROWS = 50_000, 2_000


def _rows_of(sources: DataFrame, key: str, source: str, made: list[T.StructField], parse) -> DataFrame:
    """The rows that `parse` makes of each source, with its key. Sources are dealt by key, as a small file may hold many; some
    ROWS rows and those of one source are held at a time."""
    kinds = [pa.string() if isinstance(f.dataType, T.StringType) else pa.int64() if isinstance(f.dataType, T.LongType) else pa.map_(pa.string(), pa.string()) for f in made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, rows = [], []

            def table() -> pa.RecordBatch:
                keys = batch.column(0).take(pa.array(owners))
                values = [[list(v.items()) if isinstance(v, dict) else v for v in column] for column in zip(*rows, strict=True)]
                return pa.RecordBatch.from_arrays([keys] + [pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=[key] + [f.name for f in made])

            for i, text in enumerate(batch.column(1).to_pylist()):
                found = parse(text or "")
                owners += [i] * len(found)
                rows += found
                if len(rows) >= ROWS:
                    yield table()
                    owners, rows = [], []
            if rows:
                yield table()

    dealt = sources.select(key, source).repartition(scans.tasks_for(sources, SOURCES), key)
    return dealt.mapInArrow(run, T.StructType([sources.schema[key], *made]))


def source_facts(sources: DataFrame, key: str, source: str) -> DataFrame:
    """(key, kind, name, line, start, end, block, attributes) of every fact of every source."""
    return _rows_of(sources, key, source, FACTS, facts_of)


def source_findings(sources: DataFrame, key: str, source: str) -> DataFrame:
    """(key, kind, code, tag, start, end, open_start) of every finding and incomplete part of every source."""
    return _rows_of(sources, key, source, FINDINGS, check)
