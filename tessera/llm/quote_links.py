"""Quotation linking of chat messages, in DataFrame expressions only.

A line's quote level is the number of > signs at its head (white space between them is allowed). Lines of one
level in a row, cut at blank lines, are a passage. Passages are normalised (lower case, runs of white space and
punctuation to one space) and hashed to 128 bits; a quoted passage is looked up among the unquoted passages and
lines of earlier messages of its conversation, first as a whole and line by line. The latest earlier message
that holds it is its original. A message replies to the original of most of its outermost quotes (ties: the
latest), or else to the message before it. Messages are ordered as a reply tree: a message that answers
something other than the message before it opens a branch, which is placed after the message it answers, before
what the answered branch goes on with; `reply_order` counts the messages of a conversation in that order, from 1,
and `branch_depth` tells how many branches a message lies in. `text` comes out without the quotes.

The order is the walk around the tree of branches. A branch is cut into segments behind the messages that others
answer; segments and branch ends form a linked list whose links follow from a segment and its neighbours alone, and
the list is ranked by pointer doubling, so a conversation of n messages takes n rows however deep its replies nest.

Looking backwards is a two-level as-of search: turns are cut into blocks, each block is scanned on its own, and
blocks hand on their largest turn; so a conversation, line or passage that holds most of the table is never in
one task.

Defined results: a null text is empty; a null role stays; rows without conv_id or turn form no links and have no
order; rows that repeat a (conv_id, turn) are all kept and share links; quotes found nowhere count
as unlinked; passages under `min_chars` normalised characters are not hashed; columns made here replace input
columns of the same name; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.scans import numbered, running_total

from .common import same, stage, unstage, without

HEAD = r"^[ \t]*((?:>[ \t]*)+)"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[\s\p{Punct}]+", " "))


def hashes(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def parsed_lines(text: Column) -> Column:
    """array<struct<level, body>> of a text's lines."""

    def one(line: Column) -> Column:
        head = F.regexp_extract(line, HEAD, 1)
        level = F.length(F.regexp_replace(head, "[^>]", ""))
        body = F.when(level > 0, F.regexp_replace(line, HEAD, "")).otherwise(line)
        return F.struct(level.alias("level"), body.alias("body"))

    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), one)


def run_starts(lines: Column) -> Column:
    """Places of the lines that begin a passage: runs of one level, cut at blank lines."""
    at = lambda i: F.get(lines, i)
    blank = lambda i: F.trim(at(i)["body"]) == ""
    return F.filter(
        F.sequence(F.lit(0), F.size(lines) - 1),
        lambda i: ~blank(i) & ((i == 0) | (at(i)["level"] != at(i - 1)["level"]) | F.coalesce(blank(i - 1), F.lit(True))),
    )


def passages(lines: str, starts: str) -> Column:
    """array<struct<level, body>> from columns of lines and run starts. The starts must be a column: written as an
    expression they would be found anew for each passage."""

    def run(start: Column, k: Column) -> Column:
        stop = F.coalesce(F.get(F.col(starts), k + 1), F.size(lines))
        level = F.get(F.col(lines), start)["level"]
        own = F.filter(F.slice(lines, start + 1, stop - start), lambda x: (x["level"] == level) & (F.trim(x["body"]) != ""))
        return F.struct(level.alias("level"), F.array_join(F.transform(own, lambda x: x["body"]), "\n").alias("body"))

    return F.transform(starts, run)


def latest_before(rows: DataFrame, keys: list[str], turn: str, known: Column, block: int) -> DataFrame:
    """rows with `found`: the largest turn below the row's own among rows of equal keys where `known` holds.

    Each block of turns is scanned by itself; the blocks before it are summed up by their largest known turn.
    """
    rows = rows.withColumns({"_block": F.floor(F.col(turn) / block), "_known": F.when(known, F.col(turn))})
    inside = Window.partitionBy(*keys, "_block").orderBy(turn).rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_near", F.max("_known").over(inside))
    tops = rows.groupBy(*keys, "_block").agg(F.max("_known").alias("_top"))
    across = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.withColumn("_far", F.max("_top").over(across)).drop("_top")
    mine = [F.col(f"r.{c}") for c in rows.columns]
    joined = rows.alias("r").join(tops.alias("t"), reduce(lambda a, b: a & b, [same(F.col(f"r.{k}"), F.col(f"t.{k}")) for k in [*keys, "_block"]]), "left")
    out = joined.select(*mine, "t._far")
    return out.withColumn("found", F.coalesce("_near", "_far")).drop("_block", "_known", "_near", "_far")


def quote_units(messages: DataFrame, min_chars: int) -> DataFrame:
    """(conv_id, turn, level, part, line, h1, h2): hashed passages (line -1) and their lines."""
    lined = messages.select("conv_id", "turn", parsed_lines(F.col("text")).alias("_lines")).withColumn("_starts", run_starts(F.col("_lines")))
    part = lined.select("conv_id", "turn", F.posexplode(passages("_lines", "_starts")).alias("part", "p"))
    lines = F.transform(F.split("p.body", "\n", -1), lambda x, i: F.struct(i.cast("int").alias("line"), x.alias("body")))
    units = F.concat(F.array(F.struct(F.lit(-1).alias("line"), F.col("p.body").alias("body"))), F.when(F.size(lines) > 1, lines).otherwise(F.array().cast("array<struct<line:int,body:string>>")))
    rows = part.select("conv_id", "turn", F.col("p.level").alias("level"), "part", F.explode(units).alias("u"))
    rows = rows.select("conv_id", "turn", "level", "part", F.col("u.line").alias("line"), normalised(F.col("u.body")).alias("body"))
    one, two = hashes(F.col("body"))
    return rows.where(F.length("body") >= min_chars).select("conv_id", "turn", "level", "part", "line", one.alias("h1"), two.alias("h2"))


def quote_links(messages: DataFrame, min_chars: int = 8, block: int = 1024) -> DataFrame:
    """(conv_id, turn, part, level, original_turn): every quoted passage and where it comes from (null: nowhere)."""
    units = quote_units(messages.where("conv_id is not null and turn is not null"), min_chars).distinct()
    # Only keys that some quote asks for need a search.
    asked = units.where("level > 0").select("conv_id", "h1", "h2").distinct()
    units = units.join(asked, ["conv_id", "h1", "h2"], "left_semi")
    found = latest_before(units, ["conv_id", "h1", "h2"], "turn", F.col("level") == 0, block)
    # A passage as a whole counts before its lines.
    best = F.max(F.when(F.col("line") == -1, F.col("found")))
    return (
        found.where("level > 0")
        .groupBy("conv_id", "turn", "part", "level")
        .agg(F.coalesce(best, F.max("found")).alias("original_turn"))
        .select("conv_id", "turn", "part", "level", "original_turn")
    )


#: The branch that a conversation begins with.
ROOT = -(1 << 63)


def ranked_list(elements: DataFrame, keys: list[str], weights: list[str], max_rounds: int = 64) -> DataFrame:
    """(conv_id, keys, weights): each weight summed from an element to the end of its list, by pointer doubling.

    elements has the key columns, next_<key> of the element that follows (null at the end), and the weights. Every element
    has at most one before it, in each round as at the start, so no join has a hot key.
    """
    following = [f"next_{k}" for k in keys]
    left = stage(elements, "list")
    for _ in range(max_rounds):
        if not left.where(F.col(following[0]).isNotNull()).limit(1).count():
            return left.select("conv_id", *keys, *weights)
        ahead = left.select("conv_id", *[F.col(k).alias(n) for k, n in zip(keys, following, strict=True)], *[F.col(n).alias(f"_{n}") for n in following], *[F.col(w).alias(f"_{w}") for w in weights])
        joined = left.join(ahead, ["conv_id", *following], "left")
        zero = F.lit(0).cast("long")
        new = joined.select("conv_id", *keys, *[F.col(f"_{n}").alias(n) for n in following], *[(F.col(w) + F.coalesce(f"_{w}", zero)).alias(w) for w in weights])
        new = stage(new, "list")
        unstage(left)
        left = new
    raise RuntimeError("a list is longer than 2^max_rounds")


def branch_order(chain: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_order, branch_depth) of messages (conv_id, turn, branch, answers).

    branch is the turn that opened the message's branch (ROOT for the first), answers the message that a message which
    opens a branch answers.
    """
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    own = ["conv_id", "branch"]
    starts = stage(chain.where("answers is not null").select("conv_id", "answers", F.col("turn").alias("child")), "starts")
    first_child = starts.groupBy("conv_id", F.col("answers").alias("turn")).agg(F.min("child").alias("child"))
    marked = chain.select("conv_id", "turn", "branch").join(first_child, ["conv_id", "turn"], "left")
    marked = numbered(marked, own, ["turn"], "num")
    met = F.when(F.col("child").isNotNull(), one).otherwise(zero)
    marked = running_total(marked, own, ["turn"], met, "_met").withColumn("segment", F.col("_met") - met).drop("_met")
    marked = stage(marked, "marked")
    held = marked.groupBy(*own, "segment").agg(F.count(F.lit(1)).alias("size"), F.min("num").alias("first"), F.max("child").alias("child"))
    held = stage(held, "segments")

    # After a segment comes the first branch that answers its last message, or the end of its own branch.
    root = F.lit(ROOT).cast("long")
    opening = (F.col("segment") == 0) & (F.col("branch") != root)
    segments = held.select(
        *own, "segment", F.coalesce("child", "branch").alias("next_branch"), F.when(F.col("child").isNotNull(), zero).otherwise(-one).alias("next_segment"),
        F.col("size").alias("after"), F.when(opening, one).otherwise(zero).alias("deeper"),
    )
    # After a branch's end comes the next branch that answers the same message, or what its parent goes on with, or the
    # parent's end.
    places = starts.join(marked.select("conv_id", F.col("turn").alias("answers"), F.col("branch").alias("above"), (F.col("segment") + 1).alias("beyond")), ["conv_id", "answers"])
    placed = stage(numbered(places, ["conv_id", "answers"], ["child"], "_n"), "places")
    sibling = placed.select("conv_id", "answers", (F.col("_n") - 1).alias("_n"), F.col("child").alias("sibling"))
    there = held.select("conv_id", F.col("branch").alias("above"), F.col("segment").alias("beyond"), F.lit(True).alias("goes_on"))
    ends = placed.join(sibling, ["conv_id", "answers", "_n"], "left").join(there, ["conv_id", "above", "beyond"], "left")
    ends = ends.select(
        "conv_id", F.col("child").alias("branch"), (-one).alias("segment"), F.coalesce("sibling", "above").alias("next_branch"),
        F.when(F.col("sibling").isNotNull(), zero).when(F.col("goes_on"), F.col("beyond")).otherwise(-one).alias("next_segment"), zero.alias("after"), (-one).alias("deeper"),
    )
    null = F.lit(None).cast("long")
    roots = chain.select("conv_id").distinct().select("conv_id", root.alias("branch"), (-one).alias("segment"), null.alias("next_branch"), null.alias("next_segment"), zero.alias("after"), zero.alias("deeper"))
    ranks = ranked_list(segments.unionByName(ends).unionByName(roots), ["branch", "segment"], ["after", "deeper"])

    # Sums to the end turn into counts from the start; depths over the whole list add up to nothing.
    whole = held.groupBy("conv_id").agg(F.sum("size").alias("_all"))
    at = held.join(ranks, [*own, "segment"]).join(whole, "conv_id")
    at = at.select(*own, "segment", (F.col("_all") - F.col("after") - F.col("first") + 1).alias("_before"), (F.when(opening, one).otherwise(zero) - F.col("deeper")).alias("branch_depth"))
    out = stage(marked.join(at, [*own, "segment"]).select("conv_id", "turn", (F.col("_before") + F.col("num")).alias("reply_order"), "branch_depth"), "ordered")
    for table in (starts, marked, held, placed):
        unstage(table)
    return out


def reply_order(messages: DataFrame, min_chars: int = 8, block: int = 1024) -> DataFrame:
    """messages with text free of quotes and n_quotes, n_linked, parent_turn, branch_depth, reply_order."""
    made = ["text", "n_quotes", "n_linked", "parent_turn", "branch_depth", "reply_order"]
    own_text = F.array_join(F.transform(F.filter("_lines", lambda x: x["level"] == 0), lambda x: x["body"]), "\n")
    quoted = F.size(F.filter("_starts", lambda i: F.get(F.col("_lines"), i)["level"] > 0)).cast("long")
    carried = without(messages, [*made, "_lines", "_starts", "_conv", "_turn"])

    links = stage(quote_links(messages, min_chars, block), "links")
    linked = links.where("original_turn is not null").groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n_linked"))
    outer = links.where("original_turn is not null and level = 1").groupBy("conv_id", "turn", "original_turn").agg(F.count(F.lit(1)).alias("n"))
    target = outer.groupBy("conv_id", "turn").agg(F.max(F.struct("n", "original_turn")).alias("top")).select("conv_id", "turn", F.col("top.original_turn").alias("answers"))

    turns = messages.where("conv_id is not null and turn is not null").select("conv_id", "turn").distinct()
    chain = latest_before(turns, ["conv_id"], "turn", F.lit(True), block).withColumnRenamed("found", "previous")
    chain = chain.join(target, ["conv_id", "turn"], "left").join(linked, ["conv_id", "turn"], "left")
    chain = chain.select(
        "conv_id", "turn", F.coalesce("n_linked", F.lit(0).cast("long")).alias("n_linked"), F.coalesce("answers", "previous").alias("parent_turn"),
        F.when(F.col("answers") != F.col("previous"), F.col("answers")).alias("answers"),
    )
    # The branch of a message: the latest branch start at or before its turn (0th branch: the conversation).
    opened = latest_before(chain, ["conv_id"], "turn", F.col("answers").isNotNull(), block)
    branch = F.when(F.col("answers").isNotNull(), F.col("turn")).otherwise(F.coalesce("found", F.lit(ROOT).cast("long")))
    opened = stage(opened.withColumn("branch", branch).drop("found"), "branches")

    # Conversations without a branch are in order as they are.
    forked = stage(opened.where("answers is not null").select("conv_id").distinct(), "forked")
    plain = numbered(opened.join(forked, "conv_id", "left_anti").select("conv_id", "turn"), ["conv_id"], ["turn"], "reply_order")
    order = plain.withColumn("branch_depth", F.lit(0).cast("long"))
    if forked.limit(1).count():
        order = order.unionByName(branch_order(opened.join(forked, "conv_id", "left_semi").select("conv_id", "turn", "branch", "answers")))
    placed = opened.join(order, ["conv_id", "turn"]).select(F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"), "n_linked", "parent_turn", "branch_depth", "reply_order")
    base = messages.select(*carried, parsed_lines(F.col("text")).alias("_lines")).withColumn("_starts", run_starts(F.col("_lines")))
    base = base.select(*carried, F.trim(own_text, F.lit("\n")).alias("text"), quoted.alias("n_quotes"))
    out = base.join(placed, (F.col("conv_id") == F.col("_conv")) & (F.col("turn") == F.col("_turn")), "left")
    zero = F.lit(0).cast("long")
    return out.select(*carried, "text", "n_quotes", F.coalesce("n_linked", zero).alias("n_linked"), "parent_turn", F.coalesce("branch_depth", zero).alias("branch_depth"), "reply_order")
