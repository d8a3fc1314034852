"""SQL text: statements, referenced tables and clause ranges."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(r"--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|\[[^\]]*\]|`[^`]*`|[A-Za-z_@#$][\w@#$]*|\d[\w.]*|\s+|.", re.S)
_NAME = re.compile(r"[A-Za-z_][\w$]*$|\".*\"$|\[.*\]$|`.*`$", re.S)
#: Words after which a table name stands, and words that are never one.
_BEFORE = {"FROM", "JOIN", "UPDATE", "INTO", "TABLE", "USING"}
_NEVER = {"SELECT", "SET", "WHERE", "VALUES", "LATERAL", "UNNEST", "ONLY", "ON", "IF", "EXISTS", "NOT", "AS", "ORDER", "GROUP", "BY"}
CLAUSES = ("WITH", "SELECT", "FROM", "WHERE", "GROUP BY", "HAVING", "ORDER BY", "LIMIT", "UNION", "VALUES", "SET")


def tokens(text: str) -> list[tuple[str, int]]:
    """(token, offset) without white space and comments."""
    out = []
    for m in _TOKEN.finditer(text):
        t = m[0]
        if not t.isspace() and not t.startswith(("--", "/*")):
            out.append((t, m.start()))
    return out


def statements(text: str | None) -> list[str]:
    """Statements split at ; and GO lines, outside quotes and comments."""
    out, start = [], 0
    text = text or ""
    for t, at in tokens(text):
        alone = t.upper() == "GO" and text[text.rfind("\n", 0, at) + 1 : at].strip() == "" and re.match(r"\s*(\n|$)", text[at + 2 :])
        if t == ";" or alone:
            out.append(text[start:at].strip())
            start = at + len(t)
    out.append(text[start:].strip())
    return [s for s in out if s]


def table_names(text: str | None) -> list[str]:
    """Tables that a statement names, without its common table expressions; dynamic names are left out."""
    ts = [t for t, _ in tokens(text or "")]
    up = [t.upper() for t in ts]
    ctes = {ts[i].lower() for i in range(len(ts)) if _NAME.match(ts[i]) and i + 2 < len(ts) and up[i + 1] == "AS" and ts[i + 2] == "(" and i and (up[i - 1] in ("WITH", "RECURSIVE") or ts[i - 1] == ",")}
    found: list[str] = []

    def name_at(i: int) -> int:
        parts = []
        while i < len(ts) and _NAME.match(ts[i]) and up[i] not in _NEVER:
            parts.append(ts[i].strip('"[]`'))
            if i + 1 < len(ts) and ts[i + 1] == ".":
                i += 2
                continue
            i += 1
            break
        if parts and not (i < len(ts) and ts[i] == "(" and up[i - 1] not in ("INTO",) and not into):
            name = ".".join(parts)
            if name.lower() not in ctes and name not in found:
                found.append(name)
        return i

    i = 0
    while i < len(ts):
        if up[i] in _BEFORE and not (up[i] == "FROM" and i and up[i - 1] in ("DISTINCT",) and up[max(0, i - 2)] == "IS"):
            into = up[i] in ("INTO", "TABLE")
            clause = up[i]
            i = name_at(i + 1)
            # A FROM list goes on after commas, past an alias.
            while clause == "FROM" and i < len(ts):
                j = i
                if j < len(ts) and up[j] == "AS":
                    j += 1
                if j < len(ts) and _NAME.match(ts[j]) and up[j] not in _NEVER | _BEFORE | {"INNER", "LEFT", "RIGHT", "FULL", "CROSS", "NATURAL", "UNION", "LIMIT", "HAVING"}:
                    j += 1
                if j < len(ts) and ts[j] == ",":
                    i = name_at(j + 1)
                else:
                    break
        else:
            i += 1
    return found


def clause_ranges(text: str | None) -> list[tuple[str, int, int]]:
    """(clause, start, end) of top-level clauses."""
    ts, level, marks = tokens(text or ""), 0, []
    for i, (t, at) in enumerate(ts):
        level += (t == "(") - (t == ")")
        two = f"{t} {ts[i + 1][0]}".upper() if i + 1 < len(ts) else ""
        if level == 0 and (t.upper() in CLAUSES or two in CLAUSES):
            marks.append((two if two in CLAUSES else t.upper(), at))
    ends = [a for _, a in marks[1:]] + [len(text or "")]
    return [(n, a, b) for (n, a), b in zip(marks, ends)]


@F.pandas_udf(T.ArrayType(T.StringType()))
def sql_statements(text: pd.Series) -> pd.Series:
    return pd.Series([statements(t) for t in text], dtype=object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def sql_tables(text: pd.Series) -> pd.Series:
    return pd.Series([table_names(t) for t in text], dtype=object)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("clause", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))
def sql_clauses(text: pd.Series) -> pd.Series:
    return pd.Series([[{"clause": c, "start": a, "end": b} for c, a, b in clause_ranges(t)] for t in text], dtype=object)
