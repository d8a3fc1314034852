"""Evidence queries: latest per key, freshness, required against observed, verdict folds, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import ordered, relational, sets, verdicts

from .registry import Tables, query

DAY = "date_format(ts, 'yyyy-MM-dd')"


@query("W1 R38", """
WITH e AS (SELECT event_id, user_id, event_type, strftime(ts, '%Y-%m-%d') AS day, value > 50 AS sig FROM events),
n AS (SELECT user_id, event_type, max(day) AS day FROM e GROUP BY 1, 2)
SELECT e.user_id, e.event_type, min(e.event_id) AS event_id, max(e.day) AS day, CASE WHEN count(DISTINCT e.sig) > 1 THEN 'inconsistent' ELSE 'ok' END AS state
FROM e JOIN n ON e.user_id = n.user_id AND e.event_type = n.event_type AND e.day = n.day GROUP BY 1, 2""")
def latest_per_key_with_conflict(t: Tables) -> DataFrame:
    """Newest day per user and type; rows of that day that disagree are inconsistent."""
    rows = t.events.select("event_id", "user_id", "event_type", F.expr(DAY).alias("day"), (F.col("value") > 50).alias("sig"))
    return verdicts.latest_per_key(rows, ["user_id", "event_type"], "day", "event_id", ["sig"])


@query("F15 X27", """
WITH a AS (SELECT event_id, date_diff('day', cast(ts AS DATE), DATE '2024-01-20') * 86400 AS age FROM events)
SELECT event_id, cast(age AS BIGINT) AS age, CASE WHEN age < 0 THEN 'future' WHEN age > 604800 THEN 'stale' ELSE 'fresh' END AS state FROM a""")
def freshness_state(t: Tables) -> DataFrame:
    age = (F.datediff(F.lit("2024-01-20").cast("date"), F.to_date("ts")) * 86400).cast("bigint")
    return t.events.select("event_id", age.alias("age")).withColumn("state", verdicts.freshness(F.col("age"), 604800))


@query("J16 R39 S9", """
SELECT d.doc_id, coalesce(CASE l.quality WHEN 1 THEN 'pass' WHEN 0 THEN 'fail' END, 'not_run') AS status FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def required_left_observed(t: Tables) -> DataFrame:
    seen = t.labels.select("doc_id", F.when(F.col("quality") == 1, "pass").when(F.col("quality") == 0, "fail").alias("status"))
    return verdicts.required_observed(t.documents.select("doc_id"), seen, ["doc_id"], "status")


@query("J17 R21", """
WITH r AS (SELECT r_regionkey, r_name, k FROM region, (SELECT unnest(['view','click','refund']) AS k)), o AS (SELECT user_id % 5 AS g, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT r_name, k AS kind, o.g IS NOT NULL AS available, coalesce(o.n, 0) AS n FROM r LEFT JOIN o ON o.g = r.r_regionkey AND o.event_type = r.k""")
def nested_requirements(t: Tables) -> DataFrame:
    """Regions, each with an array of required event kinds, against what was observed."""
    need = t.region.withColumn("kinds", F.array(F.lit("view"), F.lit("click"), F.lit("refund"))).select("r_regionkey", "r_name", F.explode("kinds").alias("kind"))
    got = t.events.groupBy((F.col("user_id") % 5).cast("int").alias("r_regionkey"), F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return need.join(got, ["r_regionkey", "kind"], "left").select("r_name", "kind", F.col("n").isNotNull().alias("available"), F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


STATUS = "case when value is null then 'unknown' when value > 90 then 'fail' when value > 60 then 'unknown' else 'pass' end"


@query("A9 A10 A11 A12 R7", """
WITH s AS (SELECT user_id, CASE WHEN value IS NULL THEN 'unknown' WHEN value > 90 THEN 'fail' WHEN value > 60 THEN 'unknown' ELSE 'pass' END AS st FROM events)
SELECT c_custkey AS user_id, CASE WHEN bool_or(st = 'fail') THEN 'fail' WHEN bool_or(st = 'unknown') THEN 'unknown' WHEN bool_or(st = 'pass') THEN 'pass' ELSE 'unknown' END AS verdict,
  coalesce(NOT bool_or(st = 'unknown'), false) AS complete FROM customer LEFT JOIN s ON s.user_id = c_custkey GROUP BY 1""")
def verdict_fold(t: Tables) -> DataFrame:
    """fail over unknown over pass per customer, unknown without evidence; completeness is a fold of its own."""
    rows = t.events.select("user_id", F.expr(STATUS).alias("st"))
    folded = rows.groupBy("user_id").agg(verdicts.fold("st").alias("_v"), (~F.bool_or(F.col("st") == "unknown")).alias("_c"))
    return t.customer.select(F.col("c_custkey").alias("user_id")).join(folded, "user_id", "left").select("user_id", F.coalesce("_v", F.lit("unknown")).alias("verdict"), F.coalesce("_c", F.lit(False)).alias("complete"))


@query("A6 A7 A8", """
SELECT event_type, count(*) FILTER (value > 90) AS errors, count(*) FILTER (value > 60 AND value <= 90) AS warnings, count(*) FILTER (value <= 60) AS infos FROM events GROUP BY 1""")
def counts_by_verdict(t: Tables) -> DataFrame:
    v = F.col("value")
    return t.events.groupBy("event_type").agg(F.count_if(v > 90).alias("errors"), F.count_if((v > 60) & (v <= 90)).alias("warnings"), F.count_if(v <= 60).alias("infos"))


@query("A13 A19 A21", """
SELECT o_custkey, CASE WHEN bool_or(o_orderpriority = '1-URGENT') THEN '1-URGENT' WHEN bool_or(o_orderpriority = '2-HIGH') THEN '2-HIGH' ELSE 'other' END AS worst FROM orders GROUP BY 1""")
def severity_fold(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(verdicts.severity_fold("o_orderpriority", ["1-URGENT", "2-HIGH"], "other").alias("worst"))


@query("J19 J20 R32 R46", """
WITH a AS (SELECT doc_id // 2 AS k, source AS v FROM documents WHERE doc_id % 2 = 0 AND doc_id % 7 <> 0), b AS (SELECT doc_id // 2 AS k, source AS v FROM documents WHERE doc_id % 2 = 1 AND doc_id % 5 <> 0)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN a.v IS NOT DISTINCT FROM b.v THEN 'same' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.k = b.k""")
def snapshot_diff(t: Tables) -> DataFrame:
    """Two snapshots made of even and odd documents, compared by half id."""
    k = F.expr("doc_id div 2").alias("k")
    a = t.documents.where("doc_id % 2 = 0 and doc_id % 7 <> 0").select(k, F.col("source").alias("v"))
    b = t.documents.where("doc_id % 2 = 1 and doc_id % 5 <> 0").select(k, F.col("source").alias("v"))
    return relational.full_compare(a, b, "k", "v")


@query("A29", """
WITH a AS (SELECT source || lang AS s, count(*) AS n FROM documents WHERE doc_id % 2 = 0 AND lang IS NOT NULL GROUP BY 1), b AS (SELECT source || lang AS s, count(*) AS n FROM documents WHERE doc_id % 2 = 1 AND lang IS NOT NULL GROUP BY 1)
SELECT coalesce(a.s, b.s) AS s, least(coalesce(a.n, 0), coalesce(b.n, 0)) AS existing, greatest(coalesce(b.n, 0) - coalesce(a.n, 0), 0) AS new, greatest(coalesce(a.n, 0) - coalesce(b.n, 0), 0) AS gone FROM a FULL JOIN b ON a.s = b.s""")
def baseline_multiset_compare(t: Tables) -> DataFrame:
    rows = t.documents.where("lang is not null").select("doc_id", F.concat("source", "lang").alias("s"))
    return relational.multiset_baseline(rows.where("doc_id % 2 = 0"), rows.where("doc_id % 2 = 1"), "s")


@query("J21 R42", """
WITH a AS (SELECT DISTINCT l_suppkey AS p, l_returnflag AS v FROM lineitem WHERE l_quantity > 49), b AS (SELECT DISTINCT l_suppkey AS p, l_returnflag AS v FROM lineitem WHERE l_quantity < 2)
SELECT coalesce(a.p, b.p) AS p, coalesce(a.v, b.v) AS v, CASE WHEN a.p IS NULL THEN 'added' WHEN b.p IS NULL THEN 'removed' ELSE 'kept' END AS change FROM a FULL JOIN b ON a.p = b.p AND a.v = b.v""")
def property_compare(t: Tables) -> DataFrame:
    side = lambda cond, flag: t.lineitem.where(cond).select(F.col("l_suppkey").alias("p"), F.col("l_returnflag").alias("v")).distinct().withColumn(flag, F.lit(True))
    both = side("l_quantity > 49", "_a").join(side("l_quantity < 2", "_b"), ["p", "v"], "full_outer")
    return both.select("p", "v", F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("kept").alias("change"))


@query("U5 U6", """
WITH a AS (SELECT p_brand, list(DISTINCT p_type ORDER BY p_type) AS ts FROM part WHERE p_size <= 25 GROUP BY 1), b AS (SELECT p_brand, list(DISTINCT p_type ORDER BY p_type) AS ts FROM part WHERE p_size > 40 GROUP BY 1)
SELECT a.p_brand, len(list_filter(a.ts, lambda x: NOT list_contains(b.ts, x))) = 0 AS compatible, array_to_string(list_filter(a.ts, lambda x: NOT list_contains(b.ts, x)), ',') AS lost FROM a JOIN b ON a.p_brand = b.p_brand""")
def enum_restriction(t: Tables) -> DataFrame:
    """Whether the later value set accepts every earlier value, and which were lost."""
    side = lambda cond, name: t.part.where(cond).groupBy("p_brand").agg(F.array_sort(F.collect_set("p_type")).alias(name))
    both = side("p_size <= 25", "a").join(side("p_size > 40", "b"), "p_brand")
    return both.select("p_brand", sets.accepts(F.col("a"), F.col("b")).alias("compatible"), F.array_join(F.array_sort(F.array_except("a", "b")), ",").alias("lost"))


@query("R41", """
WITH a AS (SELECT p_brand AS k, 'maximum' AS keyword, max(p_size) AS v FROM part WHERE p_partkey % 2 = 0 GROUP BY 1 UNION ALL SELECT p_brand, 'minimum', min(p_size) FROM part WHERE p_partkey % 2 = 0 GROUP BY 1),
b AS (SELECT p_brand AS k, 'maximum' AS keyword, max(p_size) AS v FROM part WHERE p_partkey % 2 = 1 GROUP BY 1 UNION ALL SELECT p_brand, 'minimum', min(p_size) FROM part WHERE p_partkey % 2 = 1 GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, coalesce(a.keyword, b.keyword) AS keyword, CASE WHEN a.v IS NOT DISTINCT FROM b.v THEN 'same' WHEN a.v IS NULL THEN 'tightened' WHEN b.v IS NULL THEN 'loosened'
  WHEN (coalesce(a.keyword, b.keyword) = 'maximum') = (b.v < a.v) THEN 'tightened' ELSE 'loosened' END AS change FROM a FULL JOIN b ON a.k = b.k AND a.keyword = b.keyword""")
def bounds_changed(t: Tables) -> DataFrame:
    def side(cond: str) -> DataFrame:
        own = t.part.where(cond).groupBy(F.col("p_brand").alias("k")).agg(F.max("p_size").alias("maximum"), F.min("p_size").alias("minimum"))
        return own.unpivot(["k"], ["maximum", "minimum"], "keyword", "value")

    return sets.bound_change(side("p_partkey % 2 = 0"), side("p_partkey % 2 = 1"), ["k"], ["maximum"])


@query("R43", "SELECT DISTINCT event_type FROM events WHERE event_type NOT IN ('view', 'click', 'purchase')")
def unsupported_keywords(t: Tables) -> DataFrame:
    known = t.spark.createDataFrame([("view",), ("click",), ("purchase",)], "event_type string")
    return t.events.select("event_type").distinct().join(F.broadcast(known), "event_type", "left_anti")


@query("A30", "WITH s AS (SELECT event_type, list(value ORDER BY value) AS v FROM events GROUP BY 1) SELECT event_type, v[len(v) // 2 + 1] AS median FROM s")
def median_floor(t: Tables) -> DataFrame:
    return sets.median_floor(t.events, ["event_type"], "value")


@query("A23 A24 R23", "SELECT p_brand, CASE WHEN count(DISTINCT p_type) = 1 THEN min(p_type) END AS choice, count(DISTINCT p_type) > 1 AS conflict FROM part GROUP BY 1")
def consensus(t: Tables) -> DataFrame:
    return sets.consensus(t.part, ["p_brand"], "p_type")


@query("A17", """
WITH d AS (SELECT event_type, user_id % 10 AS g, list(DISTINCT cast(user_id AS VARCHAR) ORDER BY cast(user_id AS VARCHAR)) AS e FROM events GROUP BY 1, 2)
SELECT event_type, g, array_to_string(e[1:32], ',') AS evidence, cast(len(e) AS BIGINT) AS n_evidence FROM d""")
def dedup_merge_evidence(t: Tables) -> DataFrame:
    rows = t.events.select("event_type", (F.col("user_id") % 10).alias("g"), F.col("user_id").cast("string").alias("e"))
    return sets.merged_evidence(rows, ["event_type", "g"], "e").select("event_type", "g", F.array_join("evidence", ",").alias("evidence"), "n_evidence")


@query("A27 S3", "SELECT source, sha256(string_agg(cast(doc_id AS VARCHAR) || ':' || sha256(text), chr(10) ORDER BY doc_id)) AS digest FROM documents GROUP BY source")
def snapshot_digest(t: Tables) -> DataFrame:
    """One digest per source over its sorted (id, text digest) list."""
    rows = t.documents.select("source", "doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("d"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "d"))), lambda x: F.concat(x["doc_id"].cast("string"), F.lit(":"), x["d"]))
    return rows.groupBy("source").agg(F.sha2(F.array_join(listed, "\n"), 256).alias("digest"))


@query("A31 R45", """
WITH k AS (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS f FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1, 2), p AS (
  SELECT l_orderkey, max(CASE WHEN l_linenumber = 1 THEN f END) AS a, max(CASE WHEN l_linenumber = 2 THEN f END) AS b FROM k GROUP BY 1)
SELECT l_orderkey, CASE WHEN a IS NULL THEN tb WHEN b IS NULL THEN ta WHEN ta = 'A' AND tb = 'M' THEN 'A' WHEN ta = 'D' AND tb = 'A' THEN 'M' ELSE tb END AS merged
FROM (SELECT *, CASE a WHEN 'A' THEN 'A' WHEN 'N' THEN 'M' ELSE 'D' END AS ta, CASE b WHEN 'A' THEN 'A' WHEN 'N' THEN 'M' ELSE 'D' END AS tb FROM p) WHERE NOT coalesce(a = 'A' AND b = 'R', false)""")
def change_status_merge(t: Tables) -> DataFrame:
    """Return flags read as added, modified, deleted; two successive changes of one order merged."""
    kind = F.when(F.col("f") == "A", "A").when(F.col("f") == "N", "M").otherwise("D")
    first = t.lineitem.where("l_linenumber <= 2").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("f"))
    return verdicts.status_merge(first.select("l_orderkey", "l_linenumber", kind.alias("kind")), "l_orderkey", "l_linenumber", "kind")


@query("R34 R33", """
SELECT user_id, count(DISTINCT event_type) = 1 AS agree, CASE WHEN count(*) < 3 THEN 'incomplete' WHEN bool_or(event_type = 'error') THEN 'unsupported' ELSE 'ok' END AS class FROM events GROUP BY 1""")
def agreement_guard(t: Tables) -> DataFrame:
    few = F.count(F.lit(1)) < 3
    kind = F.when(few, "incomplete").when(F.bool_or(F.col("event_type") == "error"), "unsupported").otherwise("ok")
    return t.events.groupBy("user_id").agg((F.count_distinct("event_type") == 1).alias("agree"), kind.alias("class"))


@query("R36 R37 R40", """
SELECT page_id, CASE WHEN url NOT LIKE 'https://%' THEN 'fail' ELSE 'pass' END AS scope, CASE WHEN html NOT LIKE '%<title>%' THEN 'unknown' WHEN html LIKE '%<title></title>%' THEN 'fail' ELSE 'pass' END AS title,
  CASE WHEN url NOT LIKE 'https://%' OR html LIKE '%<title></title>%' THEN 'fail' WHEN html NOT LIKE '%<title>%' THEN 'unknown' ELSE 'pass' END AS verdict FROM pages""")
def page_checks(t: Tables) -> DataFrame:
    """A stack of checks per page and their fold, without exploding rows."""
    scope = F.when(~F.col("url").startswith("https://"), "fail").otherwise("pass")
    title = F.when(~F.col("html").contains("<title>"), "unknown").when(F.col("html").contains("<title></title>"), "fail").otherwise("pass")
    checks = F.array("scope", "title")
    verdict = F.when(F.array_contains(checks, "fail"), "fail").when(F.array_contains(checks, "unknown"), "unknown").otherwise("pass")
    return t.pages.select("page_id", scope.alias("scope"), title.alias("title")).withColumn("verdict", verdict)


@query("R30", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'done-urgent' WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' THEN 'escalate' ELSE 'wait' END AS class FROM orders""")
def decision_table(t: Tables) -> DataFrame:
    """Classification by a rule table; of several matching rules the first counts."""
    rules = t.spark.createDataFrame([(1, "F", "1-URGENT", "done-urgent"), (2, "F", "2-HIGH", "done-urgent"), (3, "F", None, "done"), (4, "O", "1-URGENT", "escalate"), (5, None, None, "wait")], "n int, s string, p string, class string")
    match = (F.col("s").isNull() | (F.col("s") == F.col("o_orderstatus"))) & (F.col("p").isNull() | (F.col("p") == F.col("o_orderpriority")))
    return t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority").join(F.broadcast(rules), match).groupBy("o_orderkey").agg(F.min_by("class", "n").alias("class"))


@query("R29", "SELECT s_suppkey, array_to_string(list_filter([CASE WHEN s_acctbal < 0 THEN 'balance' END, CASE WHEN s_nationkey > 20 THEN 'nation' END, CASE WHEN s_name NOT LIKE 'Supplier%' THEN 'name' END], lambda x: x IS NOT NULL), ',') AS mismatches FROM supplier")
def identity_mismatches(t: Tables) -> DataFrame:
    flags = F.array(F.when(F.col("s_acctbal") < 0, "balance"), F.when(F.col("s_nationkey") > 20, "nation"), F.when(~F.col("s_name").startswith("Supplier"), "name"))
    return t.supplier.select("s_suppkey", F.array_join(F.array_compact(flags), ",").alias("mismatches"))


@query("R27", """
SELECT lang, count(*) AS n, CASE WHEN bool_or(l.doc_id IS NULL) THEN 'partial' ELSE 'complete' END AS coverage FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE lang IS NOT NULL GROUP BY lang""")
def coverage_status(t: Tables) -> DataFrame:
    seen = t.labels.select("doc_id", F.lit(True).alias("_l"))
    joined = t.documents.where("lang is not null").select("doc_id", "lang").join(seen, "doc_id", "left")
    return joined.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.when(F.bool_or(F.col("_l").isNull()), "partial").otherwise("complete").alias("coverage"))


@query("A25 L10", """
WITH s AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'A') AS added, count(*) FILTER (l_returnflag = 'R') AS deleted FROM lineitem GROUP BY 1)
SELECT * FROM s WHERE added + deleted > 7 ORDER BY l_orderkey""")
def threshold_findings(t: Tables) -> DataFrame:
    s = t.lineitem.groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "A").alias("added"), F.count_if(F.col("l_returnflag") == "R").alias("deleted"))
    return s.where("added + deleted > 7").orderBy("l_orderkey")


@query("U8 U1 U2 U3", """
WITH a AS (SELECT c_nationkey AS k, c_name AS name FROM customer), g AS (SELECT s_nationkey AS k, s_name AS name FROM supplier)
SELECT k, name FROM a UNION ALL SELECT k, name FROM g WHERE k NOT IN (SELECT k FROM a)""")
def union_with_fallback(t: Tables) -> DataFrame:
    a = t.customer.select(F.col("c_nationkey").alias("k"), F.col("c_name").alias("name"))
    return sets.fallback(a, t.supplier.select(F.col("s_nationkey").alias("k"), F.col("s_name").alias("name")), ["k"])


@query("U10 W12 R3", """
WITH u AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events) SELECT user_id, event_type, event_id FROM u WHERE n = 1""")
def first_wins(t: Tables) -> DataFrame:
    # First by input position is a minimum: it pre-aggregates, a window would not.
    return t.events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


@query("U7", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unlabelled(t: Tables) -> DataFrame:
    return relational.unsupported(t.documents.select("doc_id"), t.labels, ["doc_id"])


@query("U9", "SELECT DISTINCT page_id, unnest([url, regexp_replace(url, '[?#].*$', '')]) AS path FROM pages")
def old_and_new_path(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.explode(F.array_distinct(F.array("url", F.regexp_replace("url", "[?#].*$", "")))).alias("path"))
