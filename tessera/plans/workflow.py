"""Workflow queries: orders as tasks, lineitems as attempts, events as the log."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import relational, sets, verdicts
from tessera.streaming.follow import Cursor, page, replay_table, start
from tessera.streaming.follow import request_conflicts as repeated_requests
from tessera.streaming.stateful import leases, requests

from .registry import Tables, query

ZERO = "cast(0 as bigint)"


@query("J6 L2 A32 S15", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders o
WHERE o_orderstatus IN ('O', 'P')
  AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')
  AND NOT EXISTS (SELECT 1 FROM orders e WHERE e.o_custkey = o.o_custkey AND e.o_orderdate < o.o_orderdate AND e.o_orderstatus <> 'F')
ORDER BY o_orderpriority, o_orderdate, o_orderkey LIMIT 50""")
def ready_orders(t: Tables) -> DataFrame:
    """Open orders without a returned line and without an earlier unfinished order of the customer."""
    open_ = t.orders.where(F.col("o_orderstatus").isin("O", "P"))
    returned = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    # The earliest unfinished date per customer stands for all earlier ones.
    first = t.orders.where("o_orderstatus <> 'F'").groupBy("o_custkey").agg(F.min("o_orderdate").alias("_first"))
    free = open_.join(returned, "o_orderkey", "left_anti").join(first, "o_custkey").where("o_orderdate <= _first")
    return free.orderBy("o_orderpriority", "o_orderdate", "o_orderkey").limit(50).select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")


@query("J1 J2", "SELECT l.l_orderkey, l.l_linenumber, o.o_custkey FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey")
def inner_composite_join(t: Tables) -> DataFrame:
    lines = t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey")
    return lines.join(t.orders, "o_orderkey").select(F.col("o_orderkey").alias("l_orderkey"), "l_linenumber", "o_custkey")


@query("J3 J4", """
SELECT o.o_orderkey, count(l.l_orderkey) AS attempts, cast(coalesce(max(l.l_linenumber), 0) AS INTEGER) AS last_attempt
FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY o.o_orderkey""")
def left_join_attempts(t: Tables) -> DataFrame:
    # Attempts are summed before the join: one row per order travels.
    tried = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("attempts"), F.max("l_linenumber").alias("last_attempt"))
    return t.orders.select("o_orderkey").join(tried, "o_orderkey", "left").select("o_orderkey", F.coalesce("attempts", F.expr(ZERO)).alias("attempts"), F.coalesce("last_attempt", F.lit(0)).alias("last_attempt"))


@query("J5 X1 F18", """
SELECT DISTINCT e.user_id, cast(json_extract_string(e.props, '$.k') AS BIGINT) AS k, s.s_name
FROM events e JOIN supplier s ON s.s_suppkey = cast(json_extract_string(e.props, '$.k') AS BIGINT) WHERE e.event_type = 'error'""")
def json_key_join(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    rows = t.events.where("event_type = 'error'").select("user_id", k.alias("k"))
    return rows.join(t.supplier.select(F.col("s_suppkey").alias("k"), "s_name"), "k").select("user_id", "k", "s_name").distinct()


@query("J7 J8", """
SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_linestatus <> 'F')
  AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def semi_incomplete(t: Tables) -> DataFrame:
    open_lines = t.lineitem.where("l_linestatus <> 'F'").select(F.col("l_orderkey").alias("o_orderkey"))
    poor = t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return relational.supported(relational.supported(t.orders, open_lines, ["o_orderkey"]), poor, ["o_custkey"]).select("o_orderkey")


#: The order statuses a customer's next order may have, by the status before.
TRANSITIONS = [("F", "F"), ("F", "O"), ("O", "O"), ("O", "P"), ("P", "F")]


@query("J9 K4 K5 X30", """
WITH h AS (SELECT o_custkey, o_orderkey, o_orderstatus AS after, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders)
SELECT o_custkey, o_orderkey, before, after FROM h WHERE before IS NOT NULL
  AND (before, after) NOT IN (VALUES ('F','F'),('F','O'),('O','O'),('O','P'),('P','F'))""")
def illegal_transitions(t: Tables) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    steps = t.orders.select("o_custkey", "o_orderkey", F.lag("o_orderstatus").over(w).alias("before"), F.col("o_orderstatus").alias("after")).where("before is not null")
    legal = t.spark.createDataFrame(TRANSITIONS, "before string, after string")
    return steps.join(F.broadcast(legal), ["before", "after"], "left_anti").select("o_custkey", "o_orderkey", "before", "after")


@query("J10 K6 K14 K20", """
SELECT o_orderkey FROM orders o WHERE o_orderstatus = 'F' AND NOT EXISTS (
  SELECT 1 FROM lineitem l JOIN supplier s ON s.s_suppkey = l.l_suppkey JOIN nation n ON n.n_nationkey = s.s_nationkey
  WHERE l.l_orderkey = o.o_orderkey AND l.l_linestatus = 'F' AND n.n_regionkey IN (0, 1, 2)
    AND EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = l.l_partkey AND p.p_size > 10))""")
def completion_without_proof(t: Tables) -> DataFrame:
    """Finished orders that no finished line of a large part from three regions backs."""
    home = t.supplier.join(t.nation.where("n_regionkey in (0, 1, 2)"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"))
    large = t.part.where("p_size > 10").select(F.col("p_partkey").alias("l_partkey"))
    proof = t.lineitem.where("l_linestatus = 'F'").join(home, "l_suppkey", "left_semi").join(large, "l_partkey", "left_semi")
    return relational.unsupported(t.orders.where("o_orderstatus = 'F'"), proof.select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"]).select("o_orderkey")


@query("J11 K7", """
SELECT DISTINCT user_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT event_type FROM events) r
  WHERE NOT EXISTS (SELECT 1 FROM events p WHERE p.user_id = e.user_id AND p.event_type = r.event_type AND p.value > 5))""")
def division_all_types(t: Tables) -> DataFrame:
    """Users with an event over 5 of every type."""
    return relational.division(t.events.where("value > 5").select("user_id", "event_type"), "user_id", "event_type", t.events)


@query("K19", """
WITH req AS (SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem), held AS (
  SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus FROM lineitem WHERE l_quantity > 20)
SELECT l_suppkey FROM held GROUP BY l_suppkey HAVING count(*) = (SELECT count(*) FROM req)""")
def composite_division(t: Tables) -> DataFrame:
    pair = F.struct("l_returnflag", "l_linestatus").alias("member")
    return relational.division(t.lineitem.where("l_quantity > 20").select("l_suppkey", pair), "l_suppkey", "member", t.lineitem.select(pair))


@query("J12 U4", """
WITH a AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 2 = 0), b AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 2 = 1)
SELECT coalesce(a.user_id, b.user_id) AS user_id, bool_and(a.user_id IS NOT NULL AND b.user_id IS NOT NULL) AS equal
FROM a FULL JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type GROUP BY 1""")
def membership_equality(t: Tables) -> DataFrame:
    """Whether a user's even and odd events cover the same types."""
    return sets.membership_equal(t.events.where("event_id % 2 = 0"), t.events.where("event_id % 2 = 1"), "user_id", "event_type")


@query("J13 X2 X3", """
WITH w AS (SELECT item_id, string_split(text, ' ') AS ws FROM benchmark), u AS (SELECT item_id, unnest(ws) AS word FROM w)
SELECT item_id, count(*) AS n_words, count(DISTINCT word) AS n_distinct FROM u GROUP BY item_id""")
def lateral_unnest(t: Tables) -> DataFrame:
    words = t.benchmark.select("item_id", F.explode(F.split("text", " ")).alias("word"))
    return words.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_words"), F.count_distinct("word").alias("n_distinct"))


@query("J14 K16", """
SELECT r.r_name, count(*) AS n_lines FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey JOIN part p ON l.l_partkey = p.p_partkey WHERE p.p_size >= 25 GROUP BY r.r_name""")
def five_table_join(t: Tables) -> DataFrame:
    place = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("s_suppkey").alias("l_suppkey"), "r_name")
    size = t.part.where("p_size >= 25").select(F.col("p_partkey").alias("l_partkey"))
    return t.lineitem.select("l_suppkey", "l_partkey").join(size, "l_partkey").join(place, "l_suppkey").groupBy("r_name").agg(F.count(F.lit(1)).alias("n_lines"))


@query("A1", """
WITH d AS (SELECT p, s FROM (SELECT DISTINCT o_orderpriority AS p FROM orders), (SELECT unnest(['F','O','P','X']) AS s))
SELECT d.p AS priority, d.s AS status, count(o.o_orderkey) AS n FROM d LEFT JOIN orders o ON o.o_orderpriority = d.p AND o.o_orderstatus = d.s GROUP BY 1, 2""")
def status_counts_zero_filled(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))
    domain = rows.select("priority").distinct().select("priority", F.explode(F.array(*map(F.lit, "FOPX"))).alias("status"))
    return relational.zero_filled_counts(rows, domain, ["priority", "status"])


@query("A2 L14 W10", "SELECT coalesce(max(event_id), 0) AS watermark, coalesce((SELECT max(event_id) FROM events WHERE event_type = 'none'), 0) AS empty_watermark FROM events")
def high_watermark(t: Tables) -> DataFrame:
    none = F.when(F.col("event_type") == "none", F.col("event_id"))
    return t.events.agg(F.coalesce(F.max("event_id"), F.expr(ZERO)).alias("watermark"), F.coalesce(F.max(none), F.expr(ZERO)).alias("empty_watermark"))


@query("A3", "SELECT event_type, count(DISTINCT user_id) AS n_users FROM events GROUP BY event_type")
def distinct_members(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.count_distinct("user_id").alias("n_users"))


@query("A4 A22", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def dup_having(t: Tables) -> DataFrame:
    return relational.duplicates(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("A5", "SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1 HAVING count(*) > 1")
def one_open_violation(t: Tables) -> DataFrame:
    """Customers with more than one pending order."""
    return relational.duplicates(t.orders.where("o_orderstatus = 'P'"), ["o_custkey"])


@query("F8 F9", "SELECT o_orderkey, o_orderstatus FROM orders WHERE (NULL IS NULL OR o_orderpriority = NULL) AND o_orderstatus = 'P' AND (1 = 0 OR o_totalprice > 100000)")
def optional_filters(t: Tables) -> DataFrame:
    rows = relational.optional_filter(t.orders, o_orderpriority=None, o_orderstatus="P")
    include_small = False
    return (rows if include_small else rows.where("o_totalprice > 100000")).select("o_orderkey", "o_orderstatus")


@query("L3 L5", "WITH a AS (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 101) SELECT *, (SELECT count(*) FROM a) > 100 AS more FROM a ORDER BY o_orderkey LIMIT 100")
def keyset_page(t: Tables) -> DataFrame:
    return relational.keyset_page(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderkey", 1000, 100)


@query("L4", "SELECT c_custkey, (SELECT count(*) FROM customer) AS total, (SELECT count(*) FROM customer) > 60 AS has_more, CASE WHEN (SELECT count(*) FROM customer) > 60 THEN 60::BIGINT END AS next_offset FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 40")
def offset_page(t: Tables) -> DataFrame:
    return relational.offset_page(t.customer.select("c_custkey", "c_acctbal"), [F.desc("c_acctbal"), F.asc("c_custkey")], 40, 20).drop("c_acctbal")


@query("L12", "SELECT conv_id, turn, role FROM conversations ORDER BY turn DESC, conv_id DESC LIMIT 25")
def latest_messages(t: Tables) -> DataFrame:
    return t.conversations.orderBy(F.desc("turn"), F.desc("conv_id")).limit(25).select("conv_id", "turn", "role")


@query("K1 K2 X4 X5 X6", r"""
SELECT event_id, len(json_keys(props)) <> 1 OR json_extract_string(props, '$.k') IS NULL AS bad_shape, coalesce(NOT regexp_full_match(json_extract_string(props, '$.k'), '[0-9]{2}'), true) AS bad_value
FROM events WHERE len(json_keys(props)) <> 1 OR coalesce(NOT regexp_full_match(json_extract_string(props, '$.k'), '[0-9]{2}'), true)""")
def json_contract_violations(t: Tables) -> DataFrame:
    """Payloads with unlisted keys or a value outside its character class."""
    keys = F.json_object_keys("props")
    k = F.get_json_object("props", "$.k")
    shape = (F.size(F.array_except(keys, F.array(F.lit("k")))) > 0) | k.isNull()
    value = F.coalesce(~k.rlike("^[0-9]{2}$"), F.lit(True))
    return t.events.select("event_id", shape.alias("bad_shape"), value.alias("bad_value")).where("bad_shape or bad_value")


@query("K3 K9 K12 K15", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem l WHERE NOT EXISTS (
  SELECT 1 FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey WHERE o.o_orderkey = l.l_orderkey AND c.c_acctbal >= 0)""")
def authority_mismatch(t: Tables) -> DataFrame:
    """Large lines whose order has no customer in credit."""
    live = t.orders.join(t.customer.where("c_acctbal >= 0"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("l_orderkey"))
    rows = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    return relational.unsupported(rows, live, ["l_orderkey"])


@query("K8", "SELECT event_id FROM events WHERE cast(json_extract_string(props, '$.k') AS BIGINT) <> user_id % 100")
def column_json_mismatch(t: Tables) -> DataFrame:
    return t.events.where(F.get_json_object("props", "$.k").cast("bigint") != F.col("user_id") % 100).select("event_id")


@query("K10", """
SELECT event_id FROM events e WHERE event_type IN ('purchase', 'signup') AND NOT EXISTS (
  SELECT 1 FROM events p WHERE p.user_id = e.user_id AND p.event_id < e.event_id AND p.event_type = CASE e.event_type WHEN 'purchase' THEN 'click' ELSE 'view' END)""")
def terminal_without_proof(t: Tables) -> DataFrame:
    """Purchases without an earlier click, signups without an earlier view: the proof type depends on the kind."""
    firsts = t.events.where("event_type in ('click', 'view')").groupBy("user_id", F.col("event_type").alias("needs")).agg(F.min("event_id").alias("_first"))
    rows = t.events.where("event_type in ('purchase', 'signup')").withColumn("needs", F.when(F.col("event_type") == "purchase", "click").otherwise("view"))
    return rows.join(firsts, ["user_id", "needs"], "left").where("_first is null or _first >= event_id").select("event_id")


@query("K11 K21", """
SELECT a.event_id FROM events a JOIN events b ON b.event_id = a.event_id + 1
WHERE json_extract_string(a.props, '$.k') IS NOT DISTINCT FROM json_extract_string(b.props, '$.k') OR json_extract_string(a.props, '$.z') IS DISTINCT FROM json_extract_string(b.props, '$.z')""")
def null_safe_json_equality(t: Tables) -> DataFrame:
    a = t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.z").alias("z"))
    b = a.select((F.col("event_id") - 1).alias("event_id"), F.col("k").alias("k2"), F.col("z").alias("z2"))
    return a.join(b, "event_id").where(F.col("k").eqNullSafe(F.col("k2")) | ~F.col("z").eqNullSafe(F.col("z2"))).select("event_id")


@query("K13", """
SELECT o.o_orderkey FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE o.o_orderstatus = 'F'
GROUP BY o.o_orderkey HAVING NOT bool_and(l.l_quantity >= 5 AND l.l_linestatus = 'F')""")
def forall_lines(t: Tables) -> DataFrame:
    """Finished orders any of whose lines fails a field test."""
    bad = t.lineitem.where("not (l_quantity >= 5 and l_linestatus = 'F')").select(F.col("l_orderkey").alias("o_orderkey"))
    return relational.supported(t.orders.where("o_orderstatus = 'F'"), bad, ["o_orderkey"]).select("o_orderkey")


@query("K17 K23", "SELECT DISTINCT l.l_orderkey FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey WHERE l.l_shipdate < o.o_orderdate")
def shipped_before_ordered(t: Tables) -> DataFrame:
    lines = t.lineitem.groupBy("l_orderkey").agg(F.min("l_shipdate").alias("first"))
    return lines.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).where("first < o_orderdate").select("l_orderkey")


@query("K18", """
SELECT user_id FROM events GROUP BY user_id HAVING NOT (bool_or(event_type = 'view') AND bool_or(event_type = 'click') AND bool_or(event_type = 'error' AND value > 90) AND bool_or(event_type = 'purchase') AND bool_or(event_type = 'signup'))""")
def missing_categories(t: Tables) -> DataFrame:
    has = lambda c: F.bool_or(F.expr(c))
    needs = has("event_type = 'view'") & has("event_type = 'click'") & has("event_type = 'error' and value > 90") & has("event_type = 'purchase'") & has("event_type = 'signup'")
    return t.events.groupBy("user_id").agg(needs.alias("ok")).where("not ok").select("user_id")


@query("K22", """
SELECT o_orderkey FROM orders o WHERE o_orderstatus = 'F' AND NOT (EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'A')
  OR EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R' AND l.l_discount > 0.05))""")
def backed_by_either(t: Tables) -> DataFrame:
    first = t.lineitem.where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("o_orderkey"))
    again = t.lineitem.where("l_returnflag = 'R' and l_discount > 0.05").select(F.col("l_orderkey").alias("o_orderkey"))
    return relational.unsupported(t.orders.where("o_orderstatus = 'F'"), first.union(again), ["o_orderkey"]).select("o_orderkey")


@query("K24", """
WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), v AS (SELECT *, lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS b FROM d)
SELECT l_orderkey, l_linenumber FROM v WHERE b IS NOT NULL AND l_linenumber <> b + 1""")
def version_step_violation(t: Tables) -> DataFrame:
    steps = t.lineitem.select("l_orderkey", "l_linenumber").distinct()
    return relational.step_violations(steps, ["l_orderkey"], "l_linenumber", "l_linenumber")


@query("K25", """
WITH a AS (SELECT l_orderkey, min(l_returnflag) AS f, min(l_linestatus) AS s FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1),
     b AS (SELECT l_orderkey, min(l_returnflag) AS f, min(l_linestatus) AS s FROM lineitem WHERE l_linenumber > 3 GROUP BY 1)
SELECT a.l_orderkey, unnest(list_filter([CASE WHEN a.f IS DISTINCT FROM b.f THEN 'f' END, CASE WHEN a.s IS DISTINCT FROM b.s THEN 's' END], lambda x: x IS NOT NULL)) AS column_name FROM a JOIN b ON a.l_orderkey = b.l_orderkey""")
def immutable_changed(t: Tables) -> DataFrame:
    side = lambda cond: t.lineitem.where(cond).groupBy("l_orderkey").agg(F.min("l_returnflag").alias("f"), F.min("l_linestatus").alias("s"))
    return relational.changed_columns(side("l_linenumber <= 3"), side("l_linenumber > 3"), "l_orderkey", ["f", "s"])


@query("K26", """
SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)
UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice < 2000""")
def dangling_activation(t: Tables) -> DataFrame:
    without = relational.unsupported(t.customer, t.orders.select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"]).select("c_custkey")
    cheap = t.orders.where("o_orderstatus = 'P' and o_totalprice < 2000").select(F.col("o_custkey").alias("c_custkey"))
    return without.union(cheap).distinct()


@query("J39 R31", "SELECT 'lineitem' AS tab, count(*) AS n FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderstatus <> 'P') UNION ALL SELECT 'labels', count(*) FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id AND d.lang = 'en')")
def referential_integrity(t: Tables) -> DataFrame:
    """Dangling keys per table; the referenced side is filtered so that some dangle."""
    lines = relational.unsupported(t.lineitem, t.orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey")), ["l_orderkey"])
    labels = relational.unsupported(t.labels, t.documents.where("lang = 'en'").select("doc_id"), ["doc_id"])
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("tab"), "n")
    return n(lines, "lineitem").unionAll(n(labels, "labels"))


@query("W13", "SELECT o_orderkey, cast(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS number FROM orders")
def attempt_numbers(t: Tables) -> DataFrame:
    return verdicts.attempt_numbers(t.orders, "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_orderkey", "number")


@query("J18", "SELECT r_name, EXISTS (SELECT 1 FROM nation n WHERE n.n_regionkey = r.r_regionkey AND n.n_nationkey < 7) AS installed FROM region r")
def registry_installed(t: Tables) -> DataFrame:
    some = t.nation.where("n_nationkey < 7").select(F.col("n_regionkey").alias("r_regionkey")).distinct().withColumn("_yes", F.lit(True))
    return t.region.join(some, "r_regionkey", "left").select("r_name", F.col("_yes").isNotNull().alias("installed"))


@query("J36 F12", "SELECT l_partkey, count(DISTINCT l_suppkey) AS n, CASE count(DISTINCT l_suppkey) WHEN 1 THEN 'unique' ELSE 'ambiguous' END AS state FROM lineitem GROUP BY 1")
def ambiguity_states(t: Tables) -> DataFrame:
    rows = t.lineitem.groupBy("l_partkey").agg(F.count_distinct("l_suppkey").alias("n"))
    return rows.withColumn("state", relational.matched_state(F.col("n")))


@query("A28", "SELECT sum(n_chars)::BIGINT AS observed, greatest(0, 5000000 - sum(n_chars)::BIGINT) AS free FROM documents")
def storage_projection(t: Tables) -> DataFrame:
    used = F.coalesce(F.sum("n_chars"), F.expr(ZERO))
    return t.documents.agg(used.alias("observed"), F.greatest(F.expr(ZERO), F.lit(5000000).cast("bigint") - used).alias("free"))


@query("T5", "WITH r AS (SELECT DISTINCT user_id || '/' || event_type AS key, props AS digest FROM events) SELECT key, count(*) AS n FROM r GROUP BY key HAVING count(*) > 1")
def request_conflicts(t: Tables) -> DataFrame:
    rows = t.events.select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("key"), F.col("props").alias("digest"))
    return repeated_requests(rows, "key", "digest")


@query("T2 T3 T4", """
SELECT event_id, user_id, event_type FROM events WHERE event_id > 100 AND event_id <= 300 AND event_type = 'click'""")
def event_page(t: Tables) -> DataFrame:
    """A page of 200 ids after 100, filtered after the range is cut."""
    first = start(t.events, "p", "h", from_start=True)
    rows, _ = page(t.events, Cursor("p", "h", 100, first.watermark), 200, F.col("event_type") == "click")
    return rows.select("event_id", "user_id", "event_type")


@query("T1 T6 T7 S17", "SELECT event_id, user_id, event_type FROM events WHERE event_type IN ('error', 'signup')")
def follow_events(t: Tables) -> DataFrame:
    """The log as a file-source stream, run to its end."""
    schema = t.events.schema
    keep = lambda s: s.where(F.col("event_type").isin("error", "signup")).select("event_id", "user_id", "event_type")
    return replay_table(t.spark, f"{t.sf_dir}/events.parquet", schema, keep, "follow")


@query("T5 T7", """
SELECT user_id || '/' || event_type AS key, event_id AS request, CASE WHEN event_id = first(event_id) OVER w THEN 'accepted' WHEN props = first(props) OVER w THEN 'replay' ELSE 'conflict' END AS state, first(event_id) OVER w AS first
FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)""")
def request_states(t: Tables) -> DataFrame:
    """Each event as a request of its user and type: accepted, repeated or in conflict, by a stream that keeps the first."""
    key = F.concat_ws("/", F.col("user_id").cast("string"), "event_type")
    keyed = lambda s: s.select(key.alias("key"), F.col("event_id").alias("request"), F.col("props").alias("digest"), F.col("ts").alias("at"))
    return replay_table(t.spark, f"{t.sf_dir}/events.parquet", t.events.schema, lambda s: requests(keyed(s), "1 hour", timedelta(days=36500)), "requests")


@query("T1 T8", """
WITH r AS (SELECT user_id::VARCHAR AS key, event_id AS request, CASE WHEN event_type = 'signup' THEN 'grant' ELSE 'write' END AS kind, event_id * 7919 % 13 AS token, epoch_ms(ts) AS tm FROM events WHERE event_type IN ('signup', 'purchase')),
x AS (SELECT *, max(CASE WHEN kind = 'grant' THEN token END) OVER (PARTITION BY key ORDER BY tm, request ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM r),
y AS (SELECT *, kind = 'grant' AND (top IS NULL OR token >= top) AS good FROM x),
z AS (SELECT *, max(CASE WHEN good THEN tm END) OVER (PARTITION BY key ORDER BY tm, request) + 7200000 AS until FROM y),
done AS (SELECT key, max(CASE WHEN good THEN token END) AS token, max(CASE WHEN good THEN tm END) + 7200000 AS until FROM z GROUP BY key)
SELECT key, request, token, CASE WHEN token < top THEN 'fenced' WHEN kind = 'grant' THEN CASE WHEN token = top THEN 'held' ELSE 'granted' END WHEN top IS NULL OR token <> top THEN 'unknown' WHEN tm > until THEN 'late' ELSE 'held' END AS state FROM z
UNION ALL SELECT key, NULL, token, 'expired' FROM done WHERE until <= (SELECT max(tm) FROM r) - 3600000""")
def lease_stream(t: Tables) -> DataFrame:
    """Sign-ups as grants of two hours, purchases as writes, tokens from the event id: what a stream with timers tells."""
    kind = F.when(F.col("event_type") == "signup", "grant").otherwise("write")
    keyed = lambda s: s.where("event_type in ('signup', 'purchase')").select(
        F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("request"), kind.alias("kind"), (F.col("event_id") * 7919 % 13).alias("token"), F.col("ts").alias("at")
    )
    return replay_table(t.spark, f"{t.sf_dir}/events.parquet", t.events.schema, lambda s: leases(keyed(s), "1 hour", timedelta(hours=2)), "leases")


@query("R52", """
SELECT o_orderkey, NOT coalesce((SELECT bool_or(l_linestatus <> 'F') FROM lineitem l WHERE l.l_orderkey = o.o_orderkey), false) AS admitted FROM orders o WHERE o_orderstatus = 'O'""")
def task_admission(t: Tables) -> DataFrame:
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.bool_or(F.col("l_linestatus") != "F").alias("_blocked"))
    return t.orders.where("o_orderstatus = 'O'").join(lines, "o_orderkey", "left").select("o_orderkey", (~F.coalesce("_blocked", F.lit(False))).alias("admitted"))
