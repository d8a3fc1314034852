"""Interval, ranking, window and packing queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import structured
from tessera.operators import intervals, ordered, packs, scans
from tessera.sources.files import envelope

from .registry import Tables, query

@query("J24 R9 R10 F10", """
WITH s AS (SELECT l_partkey AS p, l_orderkey AS id, min(l_linenumber) AS a, max(l_linenumber) + 2 AS b FROM lineitem GROUP BY 1, 2), q AS (SELECT DISTINCT l_partkey AS p, l_linenumber AS a FROM lineitem)
SELECT p, a AS start, (SELECT id FROM s WHERE s.p = q.p AND s.a <= q.a AND q.a <= s.b ORDER BY s.b - s.a, s.a, s.id LIMIT 1) AS container FROM q""")
def smallest_container(t: Tables) -> DataFrame:
    """For a line number of a part the smallest order range that holds it."""
    lines = t.lineitem.select("l_partkey", "l_orderkey", "l_linenumber")
    lines = lines.repartition(scans.tasks_for(lines, 500_000), "l_partkey")
    ranges = lines.groupBy(F.col("l_partkey").alias("p"), F.col("l_orderkey").alias("id")).agg(F.min("l_linenumber").alias("start"), (F.max("l_linenumber") + 2).alias("end"))
    points = lines.select(F.col("l_partkey").alias("p"), F.col("l_linenumber").alias("start"), F.col("l_linenumber").alias("end")).distinct()
    return intervals.smallest_container(points, ranges, ["p"], 8, "id").select("p", "start", "container")


SPANS = """WITH s AS (SELECT c_nationkey AS k, c_custkey AS id, cast(c_custkey * 7 % 9973 AS INTEGER) AS a, cast(c_custkey * 7 % 9973 + c_custkey % 130 AS INTEGER) AS b FROM customer)"""


def _spans(t: Tables) -> DataFrame:
    c = F.col("c_custkey")
    return t.customer.select(F.col("c_nationkey").alias("k"), c.alias("id"), (c * 7 % 9973).cast("int").alias("start"), (c * 7 % 9973 + c % 130).cast("int").alias("end"))


@query("J26 J37", SPANS + " SELECT x.id AS l_id, y.id AS r_id FROM s x JOIN s y ON x.k = y.k AND x.id < y.id AND x.a <= y.b AND y.a <= x.b")
def overlap_pairs(t: Tables) -> DataFrame:
    s = _spans(t)
    return intervals.overlap_pairs(s, s, ["k"], 64).where("l_id < r_id").select("l_id", "r_id")


@query("J25 G8 R58", SPANS + " SELECT x.id, coalesce((SELECT y.id FROM s y WHERE y.k = x.k AND y.a <= x.a AND x.b <= y.b AND y.b - y.a > x.b - x.a ORDER BY y.b - y.a, y.a, y.id LIMIT 1), -1) AS parent FROM s x")
def interval_parents(t: Tables) -> DataFrame:
    return intervals.parents(_spans(t), ["k"], 64, "id").select("id", F.coalesce("parent", F.lit(-1).cast("bigint")).alias("parent"))


@query("J27 X25", """
WITH r AS (SELECT p_partkey AS id, cast(p_partkey % 40 AS DOUBLE) AS x, cast(p_partkey % 17 AS DOUBLE) AS y, cast(p_size AS DOUBLE) AS w, 5.0::DOUBLE AS h FROM part)
SELECT a.id, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x) > 1 AND least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y) > 1 AS overlaps FROM r a JOIN r b ON b.id = a.id + 1""")
def rect_overlap(t: Tables) -> DataFrame:
    """Declared pairs (a part and the next) of rectangles."""
    k = F.col("p_partkey")
    r = t.part.select(k.alias("id"), (k % 40).cast("double").alias("x"), (k % 17).cast("double").alias("y"), F.col("p_size").cast("double").alias("w"), F.lit(5.0).alias("h"))
    a, b = r.alias("a"), r.withColumn("id", F.col("id") - 1).alias("b")
    box = lambda n: [F.col(f"{n}.{c}") for c in "xywh"]
    return a.join(b, F.col("a.id") == F.col("b.id")).select("a.id", intervals.rectangle_overlap(box("a"), box("b"), 1.0).alias("overlaps"))


@query("L1 L8", """
SELECT p_partkey FROM part ORDER BY CASE p_type WHEN 'ECONOMY' THEN 0 WHEN 'SMALL' THEN 1 ELSE 2 END, CASE WHEN p_name = 'red widget' THEN 0 ELSE 1 END, CASE WHEN p_name LIKE 'red %' THEN 0 ELSE 1 END, p_brand, p_size, p_partkey LIMIT 100""")
def rank_keys(t: Tables) -> DataFrame:
    rank = F.when(F.col("p_type") == "ECONOMY", 0).when(F.col("p_type") == "SMALL", 1).otherwise(2)
    return t.part.orderBy(rank, F.when(F.col("p_name") == "red widget", 0).otherwise(1), F.when(F.col("p_name").startswith("red "), 0).otherwise(1), "p_brand", "p_size", "p_partkey").limit(100).select("p_partkey")


@query("L9 R17", """
WITH r AS (SELECT c_nationkey, c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 2 WHEN 'MACHINERY' THEN 1 ELSE 0 END AS s FROM customer), m AS (SELECT c_nationkey, max(s) AS s FROM r GROUP BY 1)
SELECT r.c_nationkey, r.c_custkey FROM r JOIN m ON r.c_nationkey = m.c_nationkey AND r.s = m.s WHERE m.s > 0 OR r.c_custkey = (SELECT min(c_custkey) FROM r q WHERE q.c_nationkey = r.c_nationkey AND q.s = m.s)""")
def minimum_set(t: Tables) -> DataFrame:
    """All equally strongest rows, or one where the strongest is weak."""
    s = F.when(F.col("c_mktsegment") == "BUILDING", 2).when(F.col("c_mktsegment") == "MACHINERY", 1).otherwise(0)
    rows = t.customer.select("c_nationkey", "c_custkey", s.alias("s"))
    return ordered.strongest(rows, ["c_nationkey"], "s", "c_custkey", 0).select("c_nationkey", "c_custkey")


@query("L11", "SELECT doc_id, quality FROM (SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) ORDER BY quality ASC NULLS LAST, doc_id LIMIT 60")
def nulls_last_order(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left").orderBy(F.asc_nulls_last("quality"), "doc_id").limit(60)


@query("L6", "(SELECT cast(p_partkey AS VARCHAR) AS item FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 9) UNION ALL SELECT '…truncated'")
def cap_with_marker(t: Tables) -> DataFrame:
    top = t.part.orderBy(F.desc("p_retailprice"), "p_partkey").limit(9).select(F.col("p_partkey").cast("string").alias("item"))
    return top.unionAll(t.spark.createDataFrame([("…truncated",)], "item string"))


@query("W2", """
SELECT event_id, coalesce(last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) AS current_file FROM events""")
def forward_fill(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "user_id", F.when(F.col("event_type") == "signup", F.col("event_id")).alias("mark"))
    return ordered.forward_fill(rows, ["user_id"], ["event_id"], "mark", "current_file").select("event_id", F.coalesce("current_file", F.lit(-1).cast("bigint")).alias("current_file"))


@query("W3", "SELECT event_id, lead(event_id, 1, 9223372036854775807) OVER (PARTITION BY user_id ORDER BY event_id) AS boundary FROM events WHERE event_type = 'error'")
def next_boundary(t: Tables) -> DataFrame:
    rows = t.events.where("event_type = 'error'").select("event_id", "user_id")
    return ordered.next_boundary(rows, ["user_id"], ["event_id"], "event_id", "boundary", 2**63 - 1).select("event_id", "boundary")


@query("J28 W4", """
WITH m AS (SELECT event_id, user_id, lead(event_id, 1, 9223372036854775807) OVER (PARTITION BY user_id ORDER BY event_id) AS nxt FROM events WHERE event_type = 'error')
SELECT event_id, coalesce((SELECT min(l.event_id) FROM events l WHERE l.user_id = m.user_id AND l.event_type = 'click' AND l.event_id > m.event_id AND l.event_id < m.nxt),
  (SELECT max(f.event_id) FROM events f WHERE f.user_id = m.user_id AND f.event_type = 'click' AND f.event_id < m.event_id), -1) AS location FROM m""")
def asof_next_before(t: Tables) -> DataFrame:
    """Each error takes the first click before the user's next error, else the last click before it."""
    rows = t.events.select("event_id", "user_id", "event_type")
    value = F.when(F.col("event_type") == "click", F.col("event_id"))
    return ordered.between_boundaries(rows, ["user_id"], ["event_id"], F.col("event_type") == "error", value, "location").select("event_id", F.coalesce("location", F.lit(-1).cast("bigint")).alias("location"))


@query("W5 R8", "WITH n AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) SELECT o_custkey, o_orderkey FROM n WHERE k = 2")
def nth_occurrence(t: Tables) -> DataFrame:
    return ordered.nth_occurrence(t.orders, "o_custkey", ["o_orderdate", "o_orderkey"], 2).select("o_custkey", "o_orderkey")


@query("W6", """
WITH c AS (SELECT s_nationkey, s_suppkey, s_acctbal < 0 AS e FROM supplier), n AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey, e ORDER BY s_suppkey) AS k FROM c)
SELECT s_suppkey, CASE WHEN e THEN 'empty' WHEN k = 1 THEN 'selected' ELSE 'shadowed' END AS state FROM n""")
def shadowed_rules(t: Tables) -> DataFrame:
    return ordered.shadowed(t.supplier, ["s_nationkey"], ["s_suppkey"], F.col("s_acctbal") < 0).select("s_suppkey", "state")


@query("W7", """
WITH e AS (SELECT event_id, user_id, CASE WHEN event_type IN ('view', 'click') THEN 'read' ELSE 'write' END AS kind FROM events), p AS (
  SELECT *, max(CASE WHEN kind = 'write' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM e)
SELECT event_id, coalesce(previous, -1) AS previous, CASE WHEN kind = 'write' THEN CASE WHEN previous IS NULL THEN 'produces' ELSE 'overrides' END ELSE CASE WHEN previous IS NULL THEN 'unresolved' ELSE 'consumes' END END AS effect FROM p""")
def override_chain(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "user_id", F.when(F.col("event_type").isin("view", "click"), "read").otherwise("write").alias("kind"))
    return ordered.write_effects(rows, ["user_id"], ["event_id"], "kind").select("event_id", F.coalesce("previous", F.lit(-1).cast("bigint")).alias("previous"), "effect")


@query("W8", """
WITH r AS (SELECT source, doc_id, cast(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM documents) SELECT * FROM r WHERE running <= 20000""")
def running_budget(t: Tables) -> DataFrame:
    return ordered.running_cut(t.documents.select("source", "doc_id", "n_chars"), ["source"], ["doc_id"], "n_chars", 20000).select("source", "doc_id", "running")


@query("L7")
def greedy_pack(t: Tables) -> DataFrame:
    """Documents of each source, a thousand ids a request, packed into a byte budget: mandatory first, then by priority, duplicates out."""
    rows = t.documents.select(
        F.concat_ws("/", "source", F.floor(F.col("doc_id") / 1000).cast("string")).alias("pack"), F.col("doc_id").alias("id"), (F.col("doc_id") % 50 == 0).alias("mandatory"), (F.col("doc_id") % 7).cast("int").alias("priority"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("bytes"), F.array().cast("array<struct<path:string,start:int,end:int>>").alias("locators"),
    )
    return packs.greedy_pack(rows, 60000)


@query("A20 A18", "SELECT l_partkey, count(DISTINCT l_suppkey) AS consumers FROM lineitem GROUP BY 1")
def distinct_consumers(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_partkey").agg(F.count_distinct("l_suppkey").alias("consumers"))


@query("R24 R25", "SELECT t AS token, 'ev-' || lpad(cast(row_number() OVER (ORDER BY t) AS VARCHAR), 6, '0') AS token_id FROM (SELECT DISTINCT unnest(string_split(lower(text), ' ')) AS t FROM benchmark)")
def evidence_interning(t: Tables) -> DataFrame:
    words = t.benchmark.select(F.explode(F.split(F.lower("text"), " ")).alias("token"))
    return ordered.dense_tokens(words, "token", "ev-")


@query("R25")
def evidence_rewrite(t: Tables) -> DataFrame:
    """A nested document per benchmark item, whose words are evidence tokens, with ids in their place."""
    words = F.split(F.lower("text"), " ")
    claim = F.struct(F.col("item_id").alias("claim"), words.alias("evidence"))
    nested = F.struct(F.slice(words, 1, 3).alias("evidence"), F.array(claim).alias("claims"))
    return t.benchmark.select("item_id", structured.evidence_rewritten(F.to_json(nested)).alias("doc"))


@query("S19 A14 L13 R11", "SELECT 'ok' AS status, true AS complete, count(*) AS n, cast(sum(strlen('{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}')) AS BIGINT) AS bytes FROM region")
def result_envelope(t: Tables) -> DataFrame:
    return envelope(t.region, 10_000)


@query("R18", "SELECT c_nationkey, c_custkey FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer) WHERE n <= 3")
def top_alternatives(t: Tables) -> DataFrame:
    return ordered.top_per_group(t.customer, ["c_nationkey"], [F.desc("c_acctbal"), "c_custkey"], 3).select("c_nationkey", "c_custkey")
