"""Text functions as column expressions."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names of credentials; a dash may also be an underscore or missing.
SECRET_NAMES = (
    "api-key apikey access-key access-token refresh-token client-secret private-key secret-access-key secret-key session-token id-token oauth-token"
    " token password passwd pwd secret database-url db-url signed-url"
).split()
_NAME = rf"(?<![A-Za-z0-9])(?:{'|'.join(n.replace('-', '[-_]?') for n in SECRET_NAMES)})(?![A-Za-z0-9])"
#: A quoted value goes on over lines and, without an end, to the end of the text; escapes do not end it.
_QUOTED = r"""(?:"(?:\\[\s\S]|[^"\\])*+(?:"|\\?\Z)|'(?:\\[\s\S]|[^'\\])*+(?:'|\\?\Z))"""
_UNHIDDEN = r"""(?!["']?\[REDACTED\])"""
#: Patterns of credentials in text, replaced in this order.
SECRETS = (
    (rf"""(?i)(?<![A-Za-z0-9])(["']?authorization(?![A-Za-z0-9])["']?\s*[:=]\s*(["'])[A-Za-z][A-Za-z0-9_-]*\s+)(?!\[REDACTED\])(?:\\[\s\S]|(?!\2)[^\\])*+(?:\2|\\?\Z)""", "$1[REDACTED]$2"),
    (r"""(?i)(?<![A-Za-z0-9])(["']?authorization(?![A-Za-z0-9])["']?\s*[:=]\s*[A-Za-z][A-Za-z0-9_-]*\s+)(?!\[REDACTED\])[^\s,;}\]"']+""", "$1[REDACTED]"),
    (r"(?i)([?&](?:x-amz-signature|x-amz-credential|x-goog-signature|signature|sig|access_token)=)[^\s&#\"']+", "$1[REDACTED]"),
    (rf"""(?i)((["'])[^'"\r\n]*?{_NAME}[^'"\r\n]*?\2\s*[:=]\s*){_UNHIDDEN}(?:{_QUOTED}|[^\s,;}}\]]+)""", "$1[REDACTED]"),
    (rf"""(?i)((["']?){_NAME}\2\s*[:=]\s*){_UNHIDDEN}(?:{_QUOTED}|[^\s,;}}\]]+)""", "$1[REDACTED]"),
    (r"\b(?:sk-[A-Za-z0-9_-]{16,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{8,}|github_pat_[A-Za-z0-9_]{8,})", "[REDACTED]"),
    (r"\bgh[pousr]_[A-Za-z0-9_-]{8,}\b", "[REDACTED]"),
    (r"\bAKIA[0-9A-Za-z_-]{8,}\b", "[REDACTED]"),
    (r"(?i)([a-z][a-z0-9+.-]*://[^\s:/@]+:)[^\s@/]+@", "$1[REDACTED]@"),
    (r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----", "[REDACTED]"),
)


def redact(text: Column) -> Column:
    for pattern, replacement in SECRETS:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def strip_ansi(text: Column) -> Column:
    """Without terminal colour and title sequences, line ends as \\n."""
    text = F.regexp_replace(text, r"\x1B\[[0-?]*[ -/]*[@-~]", "")
    text = F.regexp_replace(text, r"\x1B\][^\x07\x1B]*(?:\x07|\x1B\\)", "")
    return F.regexp_replace(text, r"\r\n?", "\n")


def strip_comments(text: Column) -> Column:
    """Without /* */ and // comments (strings are not recognised)."""
    return F.regexp_replace(F.regexp_replace(text, r"/\*[\s\S]*?\*/", " "), r"(^|[^:])//[^\n]*", "$1")


def import_specifiers(text: Column) -> Column:
    """Module names of static imports, re-exports and require calls."""
    names = F.regexp_extract_all(text, F.lit(r"""(?:\bfrom\s*|\bimport\s*\(?\s*|\brequire\s*\(\s*)["']([^"'\n]+)["']"""), F.lit(1))
    return F.array_distinct(names)


def line_of(text: Column, offset: Column) -> Column:
    """1-based line of a 0-based character offset."""
    return F.size(F.split(F.substring(text, F.lit(1), offset), "\n", -1))


def column_of(text: Column, offset: Column) -> Column:
    """1-based column of a 0-based character offset."""
    before = F.substring(text, F.lit(1), offset)
    at = F.instr(F.reverse(before), "\n")
    return F.when(at == 0, F.length(before) + 1).otherwise(at)


def normal_path(path: Column) -> Column:
    """Forward slashes, no empty and . parts; null for a path that leaves its root."""
    parts = F.filter(F.split(F.regexp_replace(path, r"\\", "/"), "/"), lambda p: (p != "") & (p != "."))

    def step(done: Column, part: Column) -> Column:
        up = part == ".."
        return F.when(done.isNull() | (up & (F.size(done) == 0)), F.lit(None)).when(up, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(part)))

    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def stem(path: Column) -> Column:
    """File name without directory, test marks and extension."""
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    return F.regexp_replace(F.regexp_replace(name, r"\.[^.]+$", ""), r"(?i)(?:[._-](?:test|tests|spec)|^test_|Test$)", "")


def purpose(script: Column, command: Column) -> Column:
    """What a package script is for, by its name first and its command next."""
    low, run = F.lower(script), F.lower(command)
    return (
        F.when(low.rlike(r"(^|[:_-])(test|spec|e2e)"), "test").when(low.rlike(r"lint|format"), "lint").when(low.rlike(r"type-?check|tsc"), "typecheck")
        .when(low.rlike(r"build|compile|bundle"), "build").when(low.rlike(r"^(start|dev|serve)"), "run")
        .when(run.rlike(r"\b(jest|vitest|mocha|pytest|ava)\b"), "test").when(run.rlike(r"\b(eslint|prettier|ruff)\b"), "lint").otherwise("other")
    )


def package_manager(declaration: Column) -> Column:
    """struct<name, version> of a name@version declaration."""
    return F.struct(F.regexp_extract(declaration, r"^([a-z]+)@", 1).alias("name"), F.regexp_extract(declaration, r"@([0-9][^+]*)", 1).alias("version"))


VERSION = r"^[vV=]?(\d{1,18})(?:\.(\d{1,18}))?(?:\.(\d{1,18}))?(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?$"


def version_key(version: Column) -> Column:
    """A text that sorts as versions do: numbers by value, a prerelease before its release, its numeric parts before
    names, and fewer parts first. Null for what is no version."""
    part = lambda i: F.lpad(F.coalesce(F.nullif(F.regexp_extract(version, VERSION, i), F.lit("")), F.lit("0")), 18, "0")
    pre = F.regexp_extract(version, VERSION, 4)
    named = F.array_join(F.transform(F.split(pre, r"\."), lambda x: F.when(x.rlike(r"^\d+$"), F.concat(F.lit("0"), F.lpad(x, 18, "0"))).otherwise(F.concat(F.lit("1"), x))), " ")
    return F.when(version.rlike(VERSION), F.concat_ws(".", part(1), part(2), part(3), F.when(pre == "", "~").otherwise(named)))


def file_kind(path: Column) -> Column:
    low = F.lower(path)
    return (
        F.when(low.rlike(r"(^|/)(test|tests|__tests__)/|\.(test|spec)\.[a-z]+$"), "test").when(low.rlike(r"\.(md|rst|txt)$|(^|/)docs/"), "doc")
        .when(low.rlike(r"(^|/)(package\.json|pom\.xml|pyproject\.toml|cargo\.toml|go\.mod)$"), "manifest")
        .when(low.rlike(r"\.(js|mjs|cjs|ts|tsx|jsx|py|java|go|rs|cfc|cfm|sql)$"), "source").otherwise("asset")
    )


def secret_like(path: Column) -> Column:
    return F.lower(path).rlike(r"(^|/)(\.env(\..*)?|id_[rd]sa|.*\.(pem|key|pfx|p12)|credentials(\.json)?|\.npmrc)$")


def path_risk(path: Column) -> Column:
    low = F.lower(path)
    return (
        F.when(low.rlike(r"(^|/)(auth|security|payment|migrations?)(/|\.)"), "critical").when(low.rlike(r"(^|/)(package\.json|.*lock.*|dockerfile|\.github/)"), "high")
        .when(low.rlike(r"\.(md|txt)$"), "low").otherwise("medium")
    )


@F.pandas_udf(T.StringType())
def normal_form(text: pd.Series) -> pd.Series:
    """Text with composed accents (NFC)."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def json_valid(text: Column) -> Column:
    """Whether a text is one JSON value; null where there is no text."""
    return F.when(text.isNotNull(), F.try_parse_json(text).isNotNull())


def json_type(text: Column) -> Column:
    """object, array, text, integer, real, true, false or null; no type for text that is not JSON."""
    value = F.try_parse_json(text)
    kind = F.lower(F.schema_of_variant(value))
    return (
        F.when(value.isNull(), F.lit(None)).when(kind.startswith("object"), "object").when(kind.startswith("array"), "array").when(kind == "string", "text")
        .when(kind == "boolean", F.trim(text)).when(kind.isin("bigint", "decimal(20,0)"), "integer").when(kind == "void", "null").otherwise("real")
    )


#: Tokens of a script as far as imports need them. A string keeps to its line; a regular expression is tried only where
#: a value may begin.
SCRIPT = re.compile(
    r"""(?P<skip>//[^\r\n]*+|/\*(?s:.*?)(?:\*/|\Z)|\s++)|(?P<string>"(?:[^"\\\r\n]++|\\(?s:.))*+(?:"|(?=[\r\n])|\Z)|'(?:[^'\\\r\n]++|\\(?s:.))*+(?:'|(?=[\r\n])|\Z))"""
    r"""|(?P<number>[0-9][\w.]*+)|(?P<name>[A-Za-z_$][\w$]*+)|(?P<sign>(?s:.))"""
)
REGEX = re.compile(r"/(?:[^/\\\[\r\n]++|\\.|\[(?:[^\]\\\r\n]++|\\.)*+\]?)*+/?[A-Za-z]*+")
TEMPLATE = re.compile(r"(?:[^`\\$]++|\\(?s:.)|\$(?!\{))*+(?P<stop>`|\$\{|\Z)")
#: Words after which a value begins, and words whose brackets hold a condition before a statement.
BEFORE_VALUE = frozenset("return throw case delete void typeof new yield await else do in of instanceof".split())
CONDITIONS = frozenset("if while for with switch catch".split())


def script_tokens(code: str) -> list[tuple[str, str]]:
    """(kind, value) of a script: name, sign, string (only literals without odd escapes), opaque for any other value.

    Braces inside a template's ${ } are counted on a stack, so templates nest; a slash begins a regular expression
    unless it follows a value.
    """
    out: list[tuple[str, str]] = []
    # Depth of braces in each open template; whether each open bracket holds a condition.
    templates: list[int] = []
    brackets: list[bool] = []
    at, value_next = 0, True

    def template(at: int) -> int:
        m = TEMPLATE.match(code, at)
        if m["stop"] == "${":
            templates.append(0)
            out.append(("opaque", ""))
        else:
            out.append(("string", code[at : m.start("stop")]) if code[at - 1] == "`" and "\\" not in m[0] else ("opaque", ""))
        return m.end()

    while at < len(code):
        m = SCRIPT.match(code, at)
        kind, text = m.lastgroup, m[0]
        if kind == "sign" and text == "`":
            at = template(m.end())
            value_next = bool(out and code[at - 2 : at] == "${")
            continue
        if kind == "sign" and text == "/" and value_next:
            at, value_next = REGEX.match(code, at).end(), False
            out.append(("opaque", ""))
            continue
        at = m.end()
        if kind == "skip":
            continue
        if kind == "string":
            body = text[1:-1]
            odd = len(text) < 2 or text[-1] != text[0] or re.search(r'''\\[^\\"'/]''', body)
            out.append(("opaque", "") if odd else ("string", re.sub(r"\\(.)", r"\1", body)))
            value_next = False
        elif kind == "number":
            out.append(("opaque", ""))
            value_next = False
        elif kind == "name":
            value_next = text in BEFORE_VALUE and out[-1:] != [("sign", ".")]
            out.append(("name", text))
        elif text == "}" and templates and not templates[-1]:
            templates.pop()
            at = template(at)
            value_next = code[at - 2 : at] == "${"
        else:
            if templates:
                templates[-1] += (text == "{") - (text == "}")
            after = False
            if text == "(":
                brackets.append(out[-1:] and out[-1][0] == "name" and out[-1][1] in CONDITIONS and out[-2:-1] != [("sign", ".")])
            elif text == ")":
                after = bool(brackets and brackets.pop())
            value_next = after or text not in (")", "]", "}", ".")
            out.append(("sign", text))
    return out


def imported(code: str | None) -> list[str]:
    """Specifiers of static and dynamic imports, re-exports and require calls in order, by tokens."""
    tokens = script_tokens(code or "")
    out: list[str] = []
    for i, (kind, value) in enumerate(tokens):
        if kind != "string":
            continue
        before = [t for _, t in tokens[max(0, i - 3) : i]]
        called = before[-1:] == ["("] and before[-2:-1] in (["require"], ["import"]) and before[-3:-2] != ["."]
        if (called or before[-1:] in (["from"], ["import"])) and value not in out:
            out.append(value)
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def import_tokens(code: pd.Series) -> pd.Series:
    return pd.Series([imported(t) for t in code], dtype=object)


def pattern_probe(sample: Column, pattern: str) -> tuple[Column, Column]:
    """Whether a pattern fits a sample as a whole, and whether it fits a part of it."""
    return sample.rlike(f"^(?:{pattern})$"), sample.rlike(pattern)
