"""Facts out of markup: links, nesting policies, unbalanced delimiters, style and script references."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose end tag may be left out, and the start tags that close them.
CLOSED_BY = {
    "li": {"li"}, "p": {"p", "div", "ul", "ol", "table", "h1", "h2", "h3", "section", "article", "nav"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"},
    "tr": {"tr", "tbody", "tfoot"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"},
}
#: Pages that a worker reads at a time, and rows of elements from which on it hands them out.
PAGES, ROWS = 200, 10_000
ELEMENTS = "doc_id bigint, node int, parent int, tag string, line int, attributes map<string,string>, form int"


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple] = []
        self.stack: list[tuple[int, str]] = []

    def handle_starttag(self, tag, attrs):
        if self.stack and tag in CLOSED_BY.get(self.stack[-1][1], ()):
            self.stack.pop()
        number = len(self.rows)
        form = next((n for n, t in reversed(self.stack) if t == "form"), None)
        self.rows.append((number, self.stack[-1][0] if self.stack else None, tag, self.getpos()[0], {k: v or "" for k, v in attrs}, form))
        if tag not in VOID:
            self.stack.append((number, tag))

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][1] == tag:
                del self.stack[i:]
                return


def elements(pages: DataFrame, ident: str, html: str) -> DataFrame:
    """Element rows (doc_id, node, parent, tag, line, attributes, form) of each document, by a stack machine; form is the
    innermost form around the element."""

    def table(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["doc_id", "node", "parent", "tag", "line", "attributes", "form"])
        out[["parent", "form"]] = out[["parent", "form"]].astype("Int32")
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch["i"], batch["h"]):
                tree = _Tree()
                tree.feed(text or "")
                tree.close()
                rows.extend((doc, *r) for r in tree.rows)
                if len(rows) >= ROWS:
                    yield table(rows)
                    rows = []
            yield table(rows)

    # A worker holds a few hundred pages at a time, whatever a task reads.
    pages.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(PAGES))
    return pages.select(F.col(ident).cast("bigint").alias("i"), F.col(html).alias("h")).mapInPandas(run, ELEMENTS)


def missing_children(nodes: DataFrame, parent: str, child: str) -> DataFrame:
    """Elements of tag `parent` without a direct child of tag `child`."""
    have = nodes.where(F.col("tag") == child).select("doc_id", F.col("parent").alias("node"))
    return nodes.where(F.col("tag") == parent).join(have, ["doc_id", "node"], "left_anti")


def misplaced_children(nodes: DataFrame, child: str, parents: list[str]) -> DataFrame:
    """Elements of tag `child` whose direct parent is none of `parents`."""
    own = nodes.select("doc_id", F.col("node").alias("parent"), F.col("tag").alias("_ptag"))
    joined = nodes.where(F.col("tag") == child).join(own, ["doc_id", "parent"], "left")
    return joined.where(~F.coalesce(F.col("_ptag").isin(*parents), F.lit(False))).drop("_ptag")


def references(html: Column) -> Column:
    """Values of href, src and action attributes, in order."""
    return F.regexp_extract_all(html, F.lit(r"""(?i)\b(?:href|src|action)\s*=\s*["']([^"']*)["']"""), F.lit(1))


def style_references(css: Column) -> Column:
    """Targets of url(…) and @import in style text."""
    urls = F.regexp_extract_all(css, F.lit(r"""(?i)url\(\s*["']?([^"')\s]+)["']?\s*\)"""), F.lit(1))
    imports = F.regexp_extract_all(css, F.lit(r"""(?i)@import\s+["']([^"']+)["']"""), F.lit(1))
    return F.array_distinct(F.concat(urls, imports))


def script_calls(script: Column) -> Column:
    """Targets of fetch, ajax url and location assignments in script text."""
    fetches = F.regexp_extract_all(script, F.lit(r"""\bfetch\(\s*["'`]([^"'`]+)["'`]"""), F.lit(1))
    ajax = F.regexp_extract_all(script, F.lit(r"""\burl\s*:\s*["']([^"']+)["']"""), F.lit(1))
    moves = F.regexp_extract_all(script, F.lit(r"""\blocation(?:\.href)?\s*=\s*["']([^"']+)["']"""), F.lit(1))
    return F.array_distinct(F.concat(fetches, ajax, moves))


def unbalanced(text: str) -> list[tuple[str, int]]:
    """(delimiter, offset) of brackets that do not match; quotes hide what they hold."""
    stack, bad, quote = [], [], ""
    pairs = {")": "(", "]": "[", "}": "{"}
    for i, c in enumerate(text or ""):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "([{":
            stack.append((c, i))
        elif c in pairs:
            if stack and stack[-1][0] == pairs[c]:
                stack.pop()
            else:
                bad.append((c, i))
    return sorted(bad + stack, key=lambda x: x[1])


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("delimiter", T.StringType()), T.StructField("offset", T.IntegerType())])))
def unbalanced_delimiters(text: pd.Series) -> pd.Series:
    return pd.Series([[{"delimiter": c, "offset": i} for c, i in unbalanced(t)] for t in text], dtype=object)


TAG = re.compile(r"<(/?)([A-Za-z][\w:-]*)([^<>]*?)(/?)>")


def unclosed_tags(text: str) -> list[str]:
    """Paired tags that are opened and not closed, or closed and not opened, in order of place."""
    stack, bad = [], []
    for m in TAG.finditer(text or ""):
        name = m[2].lower()
        if name in VOID or m[4]:
            continue
        if not m[1]:
            stack.append((m.start(), name))
        elif any(n == name for _, n in stack):
            while stack[-1][1] != name:
                bad.append(stack.pop())
            stack.pop()
        else:
            bad.append((m.start(), "/" + name))
    return [n for _, n in sorted(bad + stack)]


@F.pandas_udf(T.ArrayType(T.StringType()))
def unclosed_tag_names(html: pd.Series) -> pd.Series:
    return pd.Series([unclosed_tags(t) for t in html], dtype=object)


#: Where the target of each kind of page part stands.
PARTS = [("a", "link", "href"), ("script", "script", "src"), ("link", "style", "href"), ("img", "image", "src"), ("iframe", "frame", "src")]


def page_parts(nodes: DataFrame) -> DataFrame:
    """(doc_id, node, kind, target, fields, method) of links, scripts, style sheets, images, frames and forms.

    A form's fields are the names of the controls below it at any depth, in order; a control belongs to the innermost
    form around it. Elements without a target are left out, forms are not.
    """
    kind, target = F.lit(None).cast("string"), F.lit(None).cast("string")
    for tag, label, attribute in PARTS:
        hit = F.col("tag") == tag
        if tag == "link":
            hit = hit & F.lower(F.coalesce(F.col("attributes")["rel"], F.lit(""))).contains("stylesheet")
        kind, target = F.when(hit, label).otherwise(kind), F.when(hit, F.col("attributes")[attribute]).otherwise(target)
    plain = nodes.select("doc_id", "node", kind.alias("kind"), target.alias("target"), F.lit("").alias("fields"), F.lit(None).cast("string").alias("method")).where("kind is not null and target is not null")
    method = F.upper(F.coalesce(F.col("attributes")["method"], F.lit("GET")))
    forms = nodes.where("tag = 'form'").select("doc_id", "node", F.coalesce(F.col("attributes")["action"], F.lit("")).alias("target"), method.alias("method"))
    controls = nodes.where(F.col("tag").isin("input", "select", "textarea", "button") & F.col("attributes")["name"].isNotNull())
    own = controls.where("form is not null").groupBy("doc_id", F.col("form").alias("node")).agg(F.array_sort(F.collect_list(F.struct(F.col("node").alias("at"), F.col("attributes")["name"].alias("name")))).alias("c"))
    fields = F.coalesce(F.array_join(F.transform("c", lambda x: x["name"]), ","), F.lit(""))
    made = forms.join(own, ["doc_id", "node"], "left").select("doc_id", "node", F.lit("form").alias("kind"), "target", fields.alias("fields"), "method")
    return plain.unionByName(made)
