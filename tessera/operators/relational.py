"""Joins, constraint queries and counts of the workflow store, as reusable operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import version_key


def unsupported(rows: DataFrame, support: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows that no supporting row backs on the given columns (null-safe)."""
    other = support.select(*[F.col(c).alias(f"_s_{c}") for c in on]).distinct()
    condition = [rows[c].eqNullSafe(other[f"_s_{c}"]) for c in on]
    return rows.join(other, condition, "left_anti")


def supported(rows: DataFrame, support: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows that some supporting row backs."""
    return rows.join(support.select(*on).distinct(), list(on), "left_semi")


def division(pairs: DataFrame, key: str, member: str, required: DataFrame) -> DataFrame:
    """Keys that hold every required member (no counter-example exists).

    required is a one-column frame (member). Its distinct count is a single row, so the cross product with the
    grouped keys stays one row per key.
    """
    need = required.select(member).distinct()
    total = need.agg(F.count(F.lit(1)).alias("_need"))
    held = pairs.join(need, member, "left_semi").groupBy(key).agg(F.count_distinct(member).alias("_held"))
    return held.join(F.broadcast(total), F.col("_held") == F.col("_need")).select(key)


def zero_filled_counts(rows: DataFrame, domain: DataFrame, by: Sequence[str], name: str = "n") -> DataFrame:
    """Counts for every row of the domain, zero where no row falls."""
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias(name))
    return domain.join(counts, list(by), "left").withColumn(name, F.coalesce(name, F.lit(0).cast("bigint")))


def duplicates(rows: DataFrame, by: Sequence[str], name: str = "n") -> DataFrame:
    """Keys held by more than one row."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias(name)).where(F.col(name) > 1)


def keyset_page(rows: DataFrame, key: str, after, size: int) -> DataFrame:
    """Rows with key > after in key order, and `more`: whether another page follows (one row is read ahead)."""
    ahead = rows.where(F.col(key) > F.lit(after)).orderBy(key).limit(size + 1)
    place = Window.partitionBy().orderBy(key)  # at most size + 1 rows
    numbered = ahead.withColumns({"_n": F.row_number().over(place), "_all": F.count(F.lit(1)).over(Window.partitionBy())})
    return numbered.where(F.col("_n") <= size).withColumn("more", F.col("_all") > size).drop("_n", "_all")


def offset_page(rows: DataFrame, order: Sequence[Column], offset: int, size: int) -> DataFrame:
    """One page with the total, whether more follow, and the next offset (null at the end)."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    page = rows.orderBy(*order).offset(offset).limit(size)
    after = F.lit(offset + size).cast("bigint")
    return page.join(F.broadcast(total)).withColumns(
        {"has_more": F.col("total") > after, "next_offset": F.when(F.col("total") > after, after)}
    )


def optional_filter(rows: DataFrame, **wanted) -> DataFrame:
    """Equality filters that are left out where the value is None."""
    for column, value in wanted.items():
        if value is not None:
            rows = rows.where(F.col(column) == F.lit(value))
    return rows


def matched_state(candidates: Column) -> Column:
    """missing / unique / ambiguous for a number of candidates."""
    return F.when(candidates == 0, "missing").when(candidates == 1, "unique").otherwise("ambiguous")


def step_violations(versions: DataFrame, key: Sequence[str], order: str, version: str) -> DataFrame:
    """Rows whose version is not the one before plus one, in key order."""
    before = F.lag(version).over(Window.partitionBy(*key).orderBy(order))
    return versions.withColumn("_before", before).where(F.col("_before").isNotNull() & (F.col(version) != F.col("_before") + 1)).drop("_before")


def changed_columns(before: DataFrame, after: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, column): columns that differ between two snapshots of one row (null-safe)."""
    a, b = before.alias("a"), after.alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"))
    flags = F.array(*[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in columns])
    return joined.select(F.col(f"a.{key}").alias(key), F.explode(F.array_compact(flags)).alias("column_name"))


def full_compare(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change): added, removed, changed or same between two snapshots."""
    a = left.select(F.col(key).alias("_lk"), F.col(value).alias("_lv"))
    b = right.select(F.col(key).alias("_rk"), F.col(value).alias("_rv"))
    joined = a.join(b, F.col("_lk") == F.col("_rk"), "full_outer")
    change = (
        F.when(F.col("_lk").isNull(), "added").when(F.col("_rk").isNull(), "removed")
        .when(F.col("_lv").eqNullSafe(F.col("_rv")), "same").otherwise("changed")
    )
    return joined.select(F.coalesce("_lk", "_rk").alias(key), change.alias("change"))


def multiset_baseline(before: DataFrame, after: DataFrame, signature: str) -> DataFrame:
    """Per signature how many later rows existed before, are new, or went away."""
    a = before.groupBy(signature).agg(F.count(F.lit(1)).alias("_a"))
    b = after.groupBy(signature).agg(F.count(F.lit(1)).alias("_b"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint"))
    return a.join(b, signature, "full_outer").select(
        signature,
        F.least(n("_a"), n("_b")).alias("existing"),
        F.greatest(n("_b") - n("_a"), F.lit(0).cast("bigint")).alias("new"),
        F.greatest(n("_a") - n("_b"), F.lit(0).cast("bigint")).alias("gone"),
    )


def first_candidate(rows: DataFrame, candidates: Column, index: DataFrame, key: str) -> DataFrame:
    """rows with `hit`: the first of an ordered candidate list that the index holds (null: none)."""
    tried = rows.withColumn("_id", F.monotonically_increasing_id()).select("*", F.posexplode_outer(candidates).alias("_pos", "_try"))
    known = index.select(F.col(key).alias("_known")).distinct()
    joined = tried.join(known, F.col("_try") == F.col("_known"), "left")
    return joined.groupBy("_id", *rows.columns).agg(F.min_by("_known", F.when(F.col("_known").isNotNull(), F.col("_pos"))).alias("hit")).drop("_id")


def nearest_ancestor(paths: DataFrame, path: str, owners: DataFrame, owner_dir: str, owner: str) -> DataFrame:
    """paths with `owner`: that of the deepest directory above the path; null if that depth has two owners."""
    parts = F.split(F.col(path), "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("dir")))
    above = paths.select(path).distinct().select(path, F.inline(ancestors))
    own = owners.select(F.col(owner_dir).alias("dir"), F.col(owner).alias("_owner"))
    best = above.join(own, "dir").groupBy(path, "depth").agg(F.min("_owner").alias("_low"), F.count_distinct("_owner").alias("_n"))
    top = best.groupBy(path).agg(F.max(F.struct("depth", "_n", "_low")).alias("t")).select(path, F.when(F.col("t._n") == 1, F.col("t._low")).alias("owner"))
    return paths.join(top, path, "left")


def selector_match(path: Column, selector: Column) -> Column:
    """* selects all, a trailing slash selects a directory, anything else is an exact path."""
    return (selector == "*") | (F.endswith(selector, F.lit("/")) & F.startswith(path, selector)) | (path == selector)


def in_subtree(path: Column, root: str) -> Column:
    return (path == root) | path.startswith(root + "/")


def layered_rules(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """paths (path) with `ignored`: the verdict of the last matching rule (pattern, ignored, rule_order)."""
    matched = paths.join(rules, F.expr("path rlike pattern"), "left")
    return matched.groupBy("path").agg(F.coalesce(F.max_by("ignored", "rule_order"), F.lit(False)).alias("ignored"))


def glob_to_regex(pattern: str) -> str:
    """Anchored regular expression of a glob: ** crosses directories, * and ? do not."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = pattern[i]
            out += "[^/]*" if c == "*" else "[^/]" if c == "?" else "\\" + c if c in r"\.+^$()[]{}|" else c
            i += 1
    return f"^{out}$"


def exactly_one(asked: DataFrame, rows: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    """asked with state (missing, unique or ambiguous) and the value of the only row that a composite key names."""
    found = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"), F.min(value).alias("_one"))
    joined = asked.join(found, list(on), "left")
    state = F.when(F.col("_n").isNull(), "missing").when(F.col("_n") == 1, "unique").otherwise("ambiguous")
    return joined.select(*asked.columns, state.alias("state"), F.when(F.col("_n") == 1, F.col("_one")).alias(value))


def single_action(calls: DataFrame, facts: DataFrame, actions: DataFrame) -> DataFrame:
    """calls (method) with state and action: the method must be a METHOD among facts (id, kind, file) and have exactly one
    of actions (action, method, file, query_ids), in its own file, all of whose distinct ids are QUERY facts of that file.

    The universal check explodes the ids of single actions, joins them with the facts and compares two counts. No call is
    lost: the first condition that fails names its state.
    """
    methods = facts.where("kind = 'METHOD'").select(F.col("id").alias("method"), F.col("file").alias("_file"))
    own = actions.groupBy("method").agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct("action", "file", "query_ids")).alias("_a")).join(methods, "method")
    single = own.where("_n = 1").select("method", "_file", F.explode(F.array_distinct("_a.query_ids")).alias("id"))
    queries = facts.where("kind = 'QUERY'").select("id", F.col("file").alias("_at"))
    fits = F.count_if(F.coalesce(F.col("_at") == F.col("_file"), F.lit(False)))
    judged = single.join(queries, "id", "left").groupBy("method").agg(F.count(F.lit(1)).alias("_ids"), fits.alias("_fit"))
    known = methods.join(own.drop("_file"), "method", "left").join(judged, "method", "left")
    state = (
        F.when(F.col("_file").isNull(), "unknown-method").when(F.col("_n").isNull(), "no-action").when(F.col("_n") > 1, "ambiguous-action")
        .when(~F.col("_a.file").eqNullSafe(F.col("_file")), "other-file").when(F.col("_ids").isNull(), "no-query").when(F.col("_fit") < F.col("_ids"), "foreign-query").otherwise("resolved")
    )
    joined = calls.join(known, "method", "left").withColumn("state", state)
    return joined.select(*calls.columns, "state", F.when(F.col("state") == "resolved", F.col("_a.action")).alias("action"))


def gated(evidence: DataFrame, gates: DataFrame) -> DataFrame:
    """evidence (format, version) with gate: the state of the gate (format, lowest, below, state) whose versions, from
    lowest on and below the other end (null: open), hold the row's; too_old or too_new outside all of a format's gates.

    Versions are compared by a key that sorts as they do, so the gates are data: one join on format, then ranges.
    """
    key = lambda c: version_key(F.col(c))
    asked = evidence.withColumn("_key", key("version"))
    ends = gates.select(F.col("format").alias("_format"), key("lowest").alias("_low"), key("below").alias("_high"), F.col("state").alias("_state"))
    span = ends.groupBy("_format").agg(F.min("_low").alias("_least"), F.collect_list(F.struct("_low", "_high", "_state")).alias("_gates"))
    # A format has few gates; they travel as one row and are searched in place.
    first = F.filter("_gates", lambda g: (g["_low"].isNull() | (F.col("_key") >= g["_low"])) & (g["_high"].isNull() | (F.col("_key") < g["_high"])))
    joined = asked.join(span, F.col("format") == F.col("_format"), "left")
    gate = (
        F.when(F.col("_format").isNull(), "unknown_format").when(F.col("_key").isNull(), "bad_version")
        .otherwise(F.coalesce(F.get(F.transform(first, lambda g: g["_state"]), F.lit(0)), F.when(F.col("_key") < F.col("_least"), "too_old").otherwise("too_new")))
    )
    return joined.select(*evidence.columns, gate.alias("gate"))


def attempts_left(rows: DataFrame, key: str, most: int) -> DataFrame:
    """(key, attempts, exhausted): attempts of each task against the most that are allowed."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("attempts")).withColumn("exhausted", F.col("attempts") >= most)


def pinned_mismatch(plans: DataFrame, pinned: DataFrame, on: Sequence[str], source: str, pin: str) -> DataFrame:
    """Plans whose source is not the one pinned for them."""
    return plans.join(pinned, list(on)).where(~F.col(source).eqNullSafe(F.col(pin)))


def prefix_alias(rows: DataFrame, name: str, aliases: DataFrame, prefix: str, separator: str) -> DataFrame:
    """rows with each alias that equals the name or is followed in it by the separator, and the rest of the name.

    Every prefix that ends before a separator is a key of its own, so this is one equi-join.
    """
    parts = F.split(F.col(name), "\\Q" + separator + "\\E", -1)
    cut = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), separator).alias("k"), F.array_join(F.slice(parts, n + 1, F.size(parts)), separator).alias("rest")))
    keyed = rows.withColumn("_cut", F.explode(cut)).select(*rows.columns, F.col("_cut.k").alias(prefix), F.col("_cut.rest").alias("rest"))
    return keyed.join(aliases.select(prefix).distinct(), prefix)


def optimistic_update(state: DataFrame, updates: DataFrame, key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """(state after, refused): updates (key, expected, new) take effect where `expected` is the row's version.

    Of several updates of one version the least new value wins; the others are refused, as are those of unknown keys.
    """
    joined = updates.join(state.select(key, "version"), key, "left")
    fits = joined.where(F.col("expected") == F.col("version"))
    chosen = fits.groupBy(key).agg(F.min("new").alias("_new"))
    after = state.join(chosen, key, "left").withColumns({value: F.coalesce("_new", value), "version": F.col("version") + F.when(F.col("_new").isNotNull(), 1).otherwise(0)}).drop("_new")
    judged = joined.join(chosen, key, "left")
    reason = F.when(F.col("version").isNull(), "unknown").when(F.col("expected") != F.col("version"), "stale").when(F.col("new") != F.col("_new"), "lost")
    return after, judged.withColumn("reason", reason).where("reason is not null").select(key, "expected", "new", "reason")


def lease_states(grants: DataFrame, beats: DataFrame, key: str, now: Column, most: int) -> DataFrame:
    """(key, token, holder, state): the newest grant of each lease; expired if its last heartbeat (of that token) or the
    grant itself is more than `most` seconds before `now`."""
    newest = grants.groupBy(key).agg(F.max(F.struct("token", "holder", "at")).alias("g")).select(key, "g.*")
    last = beats.groupBy(key, "token").agg(F.max("at").alias("_beat"))
    joined = newest.join(last, [key, "token"], "left").withColumn("seen", F.greatest("at", "_beat"))
    return joined.select(key, "token", "holder", F.when(now - F.col("seen") > most, "expired").otherwise("held").alias("state"))


def fenced(writes: DataFrame, grants: DataFrame, key: str) -> DataFrame:
    """Writes whose fencing token is older than the newest granted: they must be refused."""
    top = grants.groupBy(key).agg(F.max("token").alias("_top"))
    return writes.join(top, key).where(F.col("token") < F.col("_top")).drop("_top")
