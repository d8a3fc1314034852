"""Unified diffs: files, hunks, numbered lines and policy findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.relational import selector_match
from tessera.staging import stage

HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
FILE = r"^diff --git a/(.+) b/(.+)$"


def diff_lines(diffs: DataFrame) -> DataFrame:
    """(diff_id, diff_line, file, old_file, kind, text, new_line, old_line) of every line of (diff_id, text).

    Files and hunks are what the last header before a line tells; inside a hunk the new line number is the hunk's start
    plus the context and added lines since its header. All of it comes from windows of one order, so lines are sorted once.
    """
    lines = diffs.select("diff_id", F.posexplode(F.split("text", "\n", -1)).alias("diff_line", "line"))
    ordered = Window.partitionBy("diff_id").orderBy("diff_line").rowsBetween(Window.unboundedPreceding, 0)
    is_file, is_hunk = F.col("line").rlike(FILE), F.col("line").rlike(HUNK)
    part = lambda pattern, i: F.regexp_extract("line", pattern, i)
    number = lambda cond, i: F.when(cond, part(HUNK, i)).cast("int")
    last = lambda c: F.last(c, ignorenulls=True).over(ordered)
    # A file's header ends the hunk before it, so it tells a hunk without numbers.
    lines = lines.withColumns(
        {
            "_file": last(F.when(is_file, F.struct(part(FILE, 2).alias("new"), part(FILE, 1).alias("old")))),
            "_hunk": last(F.when(is_file | is_hunk, F.struct(number(is_hunk, 3).alias("new"), number(is_hunk, 1).alias("old")))),
        }
    )
    head = F.substring("line", 1, 1)
    kind = F.when(is_file, "file").when(is_hunk, "hunk").when(F.col("_hunk.new").isNull(), "meta").when(head == "+", "add").when(head == "-", "del").when(head == " ", "context").otherwise("meta")
    lines = lines.withColumn("kind", kind)
    count = lambda *kinds: F.sum(F.when(F.col("kind").isin(*kinds), 1).otherwise(0)).over(ordered)
    lines = lines.withColumns({"_n": count("add", "context"), "_o": count("del", "context")})
    # What had been counted at the hunk's header.
    lines = lines.withColumn("_base", last(F.when(F.col("kind").isin("file", "hunk"), F.struct("_n", "_o"))))
    return lines.select(
        "diff_id", "diff_line", F.col("_file.new").alias("file"), F.col("_file.old").alias("old_file"), "kind",
        F.when(F.col("kind").isin("add", "del", "context"), F.expr("substring(line, 2)")).otherwise(F.col("line")).alias("text"),
        F.when(F.col("kind").isin("add", "context"), F.col("_hunk.new") + F.col("_n") - F.col("_base._n") - 1).alias("new_line"),
        F.when(F.col("kind").isin("del", "context"), F.col("_hunk.old") + F.col("_o") - F.col("_base._o") - 1).alias("old_line"),
    )


def file_summary(lines: DataFrame) -> DataFrame:
    """(diff_id, file, old_file, change, added, deleted) per file of diff_lines."""
    has = lambda p: F.bool_or((F.col("kind") == "meta") & F.col("text").rlike(p))
    n = lambda k: F.count_if(F.col("kind") == k)
    change = F.when(has("^new file mode"), "added").when(has("^deleted file mode"), "deleted").when(has("^rename from"), "renamed").when(has("^Binary files|^GIT binary"), "binary").otherwise("modified")
    return lines.where(F.col("file").isNotNull()).groupBy("diff_id", "file", "old_file").agg(change.alias("change"), n("add").alias("added"), n("del").alias("deleted"))


def changed_ranges(lines: DataFrame) -> DataFrame:
    """(diff_id, file, start, end) of consecutive added lines."""
    added = lines.where(F.col("kind") == "add")
    run = F.col("new_line") - F.row_number().over(Window.partitionBy("diff_id", "file").orderBy("new_line"))
    return added.withColumn("_run", run).groupBy("diff_id", "file", "_run").agg(F.min("new_line").alias("start"), F.max("new_line").alias("end")).drop("_run")


def policy_findings(lines: DataFrame, protected: DataFrame, needles: DataFrame, exceptions: DataFrame, most_added: int) -> DataFrame:
    """Findings of a patch policy with `excepted`: protected paths (selector), content needles (rule, needle,
    severity) on added lines, and files over a line limit; exceptions are (rule, selector). The planner
    decides from their sizes whether rule tables are broadcast. Lines are numbered once and staged, as the rules read
    them more than once."""
    lines = stage(lines.select("diff_id", "file", "old_file", "kind", "text", "new_line"), "lines")
    files = stage(file_summary(lines), "files")
    touched = files.select("diff_id", "file", F.explode(F.array_distinct(F.array("file", "old_file"))).alias("path"))
    guarded = touched.join(protected, selector_match(F.col("path"), F.col("selector"))).select("diff_id", "file", F.lit("protected-path").alias("rule"), F.lit("error").alias("severity"), F.lit(None).cast("int").alias("line")).distinct()
    content = lines.where(F.col("kind") == "add").join(needles, F.col("text").contains(F.col("needle"))).select("diff_id", "file", "rule", "severity", F.col("new_line").alias("line"))
    large = files.where(F.col("added") > most_added).select("diff_id", "file", F.lit("too-many-lines").alias("rule"), F.lit("warning").alias("severity"), F.lit(None).cast("int").alias("line"))
    found = guarded.unionByName(content).unionByName(large)
    waived = exceptions.select(F.col("rule").alias("_rule"), F.col("selector").alias("_sel"))
    joined = found.join(waived, (F.col("rule") == F.col("_rule")) & selector_match(F.col("file"), F.col("_sel")), "left")
    return joined.groupBy("diff_id", "file", "rule", "severity", "line").agg(F.bool_or(F.col("_rule").isNotNull()).alias("excepted"))
