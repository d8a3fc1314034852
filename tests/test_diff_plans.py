"""How often the lines of diffs are sorted and dealt."""

from tessera.sources import diffs


def test_lines_are_sorted_once(spark):
    rows = spark.createDataFrame([("d", "diff --git a/x b/y\n@@ -1 +5 @@\n+one\n two\ndiff --git a/z b/z\n+three")], "diff_id string, text string")
    lines = diffs.diff_lines(rows)
    assert [tuple(r)[2:] for r in lines.orderBy("diff_line").collect()] == [
        ("y", "x", "file", "diff --git a/x b/y", None, None), ("y", "x", "hunk", "@@ -1 +5 @@", None, None), ("y", "x", "add", "one", 5, None),
        ("y", "x", "context", "two", 6, 1), ("z", "z", "file", "diff --git a/z b/z", None, None), ("z", "z", "meta", "+three", None, None),
    ]
    plan = lines._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[-1]
    assert (plan.count("Sort ["), plan.count("Exchange hashpartitioning")) == (1, 1)


def test_policy_numbers_lines_once(spark):
    rows = spark.createDataFrame([("d", "@@ -1 +5 @@\n+secret one"), ("e", "diff --git a/x b/y\n@@ -1 +5 @@\n+secret")], "diff_id string, text string")
    none = spark.createDataFrame([], "rule string, selector string")
    needles = spark.createDataFrame([("leak", "secret", "error")], "rule string, needle string, severity string")
    found = diffs.policy_findings(diffs.diff_lines(rows), none.select("selector"), needles, none, 3)
    assert sorted(map(tuple, found.collect())) == [("d", None, "leak", "error", 5, False), ("e", "y", "leak", "error", 5, False)]
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
