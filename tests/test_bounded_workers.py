"""What Python workers hold at a time."""

from pyspark.sql import functions as F

from tessera.operators import packs
from tessera.sources import markup


def test_elements_leave_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(markup, "ROWS", 5)
    monkeypatch.setattr(markup, "PAGES", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    pages = spark.range(0, 10, 1, 1).select("id", F.lit("<ul><li>a<li>b</ul>").alias("html"))
    nodes = markup.elements(pages, "id", "html")
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "3"
    assert sorted((r.doc_id, r.node, r.parent) for r in nodes.collect()) == [(d, n, None if not n else 0) for d in range(10) for n in range(3)]


def test_packs_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    rows = [(p, i, False, 0, f"{p}{i}", 1, []) for p in ("a", "b", None, "c") for i in range(7)]
    items = spark.createDataFrame(rows, "pack string, id long, mandatory boolean, priority int, sha256 string, bytes long, locators array<struct<path:string,start:int,end:int>>")
    out = packs.greedy_pack(items, 5)
    assert sorted(((r.pack or "", r.id, r.state, r.used) for r in out.collect())) == [(p, i, "included" if i < 5 else "omitted", min(i + 1, 5)) for p in ("", "a", "b", "c") for i in range(7)]
    assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
