"""Diagnostics out of log lines, structured reports and test captures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.scans import filled_forward, running_total

#: The location before a compiler's message may be missing.
COMPILER = r"^(?:(.+?)\((\d+),(\d+)\):\s+|\s*)(error|warning)\s+(TS\d+):\s*(.+)$"
COLON = r"^(.+?):(\d+):(\d+)\s*[-:]?\s*(error|warning|info)\b:?\s*(.*)$"
FAIL = r"^\s*FAIL\s+(\S+)"
LOCATION = r"\(?([^\s()]+):(\d+):(\d+)\)?\s*$"
MESSAGE = r"^\s*(?:●|✕|×)\s+(.*)$"
#: The diagnostic columns shared by every producer.
COLUMNS = ["artifact", "seq", "producer", "severity", "phase", "code", "file", "line", "col", "message"]


def compiler_rows(lines: DataFrame) -> DataFrame:
    """Diagnostics of compiler lines file(line,col): severity CODE: message, or without a place: severity CODE: message."""
    g = lambda i: F.nullif(F.regexp_extract("line", COMPILER, i), F.lit(""))
    hit = lines.where(F.col("line").rlike(COMPILER))
    return hit.select("artifact", "seq", F.lit("compiler").alias("producer"), g(4).alias("severity"), F.lit("compile").alias("phase"), g(5).alias("code"), g(1).alias("file"), g(2).cast("int").alias("line_no"), g(3).cast("int").alias("col"), g(6).alias("message")).withColumnRenamed("line_no", "line")


def generic_rows(lines: DataFrame) -> DataFrame:
    """Diagnostics of file:line:col lines."""
    g = lambda i: F.regexp_extract("line", COLON, i)
    hit = lines.where(F.col("line").rlike(COLON))
    return hit.select("artifact", "seq", F.lit("generic").alias("producer"), g(4).alias("severity"), F.lit("unknown").alias("phase"), F.lit(None).cast("string").alias("code"), g(1).alias("file"), g(2).cast("int").alias("line_no"), g(3).cast("int").alias("col"), g(5).alias("message")).withColumnRenamed("line_no", "line")


def lint_rows(lines: DataFrame) -> DataFrame:
    """Lint blocks: a line that is a path, then indented line:col severity message rule lines."""
    path, item = r"^(\S+\.[A-Za-z]+)$", r"^\s+(\d+):(\d+)\s+(error|warning)\s+(.*?)\s{2,}(\S+)$"
    filled = filled_forward(lines, ["artifact"], ["seq"], F.when(F.col("line").rlike(path), F.regexp_extract("line", path, 1)), "file")
    g = lambda i: F.regexp_extract("line", item, i)
    hit = filled.where(F.col("line").rlike(item) & F.col("file").isNotNull())
    return hit.select("artifact", "seq", F.lit("lint").alias("producer"), g(3).alias("severity"), F.lit("lint").alias("phase"), g(5).alias("code"), "file", g(1).cast("int").alias("line_no"), g(2).cast("int").alias("col"), g(4).alias("message")).withColumnRenamed("line_no", "line")


def test_rows(lines: DataFrame) -> DataFrame:
    """Failed tests: each message takes the first location before the next message, else the last FAIL file."""
    marked = lines.withColumns(
        {
            "_m": F.when(F.col("line").rlike(MESSAGE), F.regexp_extract("line", MESSAGE, 1)),
            "_fail": F.when(F.col("line").rlike(FAIL), F.regexp_extract("line", FAIL, 1)),
            "_loc": F.when(F.col("line").rlike(LOCATION), F.struct(*[F.regexp_extract("line", LOCATION, i).alias(n) for i, n in ((1, "f"), (2, "l"), (3, "c"))])),
        }
    )
    marked = running_total(marked, ["artifact"], ["seq"], F.when(F.col("_m").isNotNull(), 1).otherwise(0), "_part")
    marked = filled_forward(marked, ["artifact"], ["seq"], F.col("_fail"), "_lastfail")
    first = marked.where(F.col("_loc").isNotNull()).groupBy("artifact", "_part").agg(F.min_by("_loc", "seq").alias("_next"))
    hit = marked.where(F.col("_m").isNotNull()).join(first, ["artifact", "_part"], "left")
    return hit.select("artifact", "seq", F.lit("test").alias("producer"), F.lit("error").alias("severity"), F.lit("test").alias("phase"), F.lit(None).cast("string").alias("code"), F.coalesce("_next.f", "_lastfail").alias("file"), F.expr("cast(_next.l as int)").alias("line"), F.expr("cast(_next.c as int)").alias("col"), F.col("_m").alias("message"))


def diagnostics(lines: DataFrame) -> DataFrame:
    """All producers; generic rows only for artifacts that no other producer recognised."""
    known = compiler_rows(lines).unionByName(lint_rows(lines)).unionByName(test_rows(lines))
    rest = generic_rows(lines).join(known.select("artifact").distinct(), "artifact", "left_anti")
    return known.unionByName(rest).select(*COLUMNS)


def merged(diagnostics_: DataFrame, most: int = 32) -> DataFrame:
    """One row per diagnostic identity with merged evidence, sorted, nulls last."""
    identity = ["producer", "severity", "phase", "code", "file", "line", "col", "message"]
    out = diagnostics_.groupBy(*identity).agg(F.slice(F.array_sort(F.collect_set(F.concat_ws(":", "artifact", "seq"))), 1, most).alias("evidence"))
    return out.orderBy(*[F.col(c).asc_nulls_last() for c in ("file", "line", "col", "severity", "code", "message", "producer")])


def structured_rows(reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(diagnostics, rejected) of JSON reports (artifact, body): an array of objects each."""
    schema = "array<struct<severity:string,phase:string,code:string,file:string,line:int,column:int,message:string>>"
    parsed = reports.withColumn("_d", F.from_json("body", schema))
    rows = parsed.select("artifact", F.posexplode("_d").alias("seq", "d")).select("artifact", "seq", F.lit("structured").alias("producer"), "d.severity", "d.phase", "d.code", "d.file", "d.line", F.col("d.column").alias("col"), "d.message")
    ok = F.col("message").isNotNull() & F.coalesce(F.col("severity").isin("error", "warning", "info"), F.lit(False))
    rejected = parsed.where(F.col("_d").isNull()).select("artifact", F.lit(-1).alias("seq"), F.lit("INVALID_JSON").alias("reason"))
    return rows.where(ok), rows.where(~ok).select("artifact", "seq", F.lit("INVALID_ROW").alias("reason")).unionByName(rejected)


def capture_verdicts(lines: DataFrame) -> DataFrame:
    """(artifact, state, passed, failed) of JSONL test captures framed by header, summary and end records.

    complete needs the header first, the end last, one summary, and no more cases of a status than it counts.
    """
    record = F.from_json("line", "type string, status string, passed bigint, failed bigint")
    rows = lines.withColumn("r", record).select("artifact", "seq", "r.*")
    n = lambda c: F.count_if(c)
    out = rows.groupBy("artifact").agg(
        F.min_by("type", "seq").alias("_first"), F.max_by("type", "seq").alias("_last"), n(F.col("type") == "summary").alias("_summaries"),
        n((F.col("type") == "case") & (F.col("status") == "pass")).alias("_p"), n((F.col("type") == "case") & (F.col("status") == "fail")).alias("_f"),
        F.max("passed").alias("passed"), F.max("failed").alias("failed"), n(F.col("type").isNull()).alias("_bad"),
    )
    framed = (F.col("_first") == "header") & (F.col("_last") == "end") & (F.col("_summaries") == 1) & (F.col("_bad") == 0)
    counted = (F.col("_p") <= F.col("passed")) & (F.col("_f") <= F.col("failed"))
    state = F.when(~F.coalesce(framed, F.lit(False)), "broken_frame").when(~F.coalesce(counted, F.lit(False)), "count_mismatch").otherwise("complete")
    return out.select("artifact", state.alias("state"), "passed", "failed")
