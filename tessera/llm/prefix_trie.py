"""Prefix tries of conversations: how much of their turns conversations share, node by node.

Conversations that are equal turn by turn are one class, named by their smallest conv_id. Classes are dealt by the
digest of their first turn; the trie of a first turn (several to a task) is built inside applyInPandas as dictionaries
that point from a node and a turn's digest to the child, and its totals are summed in an iterative postorder. A subtrie
of more than `limit` turns is not built in one task: its top node comes out of an aggregate, and its turns are dealt
again by the next turn, level by level, until every part fits. A part that holds a single class is a chain and needs
no trie: its nodes are its turns. So a conversation, or a group of copies, that holds most of the table is never in one
task. Totals of the parts are then summed up the levels. Turns are told apart by 128-bit digests of role and text.

Members whose conversation ends at a node are one class. The hash of their ids is taken over sorted pieces of some
`PIECE` bytes that range-sorted tasks have joined; only these pieces pass one after the other.

Defined results: a null role or text is empty; rows without conv_id belong to no conversation; turns are ordered by
(turn, role, text), null turns first, and repeated rows are turns of their own; conversations without turns are members of
the root alone; an empty table has no nodes; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.scans import numbered, running_total

from .common import hot_join, prepare, stage, tidy, unstage

#: Turns of the largest subtrie that one task builds, and that one call gets on average.
LIMIT = 20_000
#: Bytes of joined ids that one row hands to the hash.
PIECE = 1 << 16
#: Rebuilt conversations take fewer than HEADS turns of the first of every GROUP conversations.
HEADS, GROUP = 9, 5
LONG = T.LongType()


def turns_of(messages: DataFrame) -> DataFrame:
    """(conv, pos, t1, t2, bytes): numbered turns of every conversation, by digest of role and text."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = messages.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), "turn",
        F.xxhash64(role, text).alias("t1"), F.xxhash64(F.lit(1), text, role).alias("t2"), F.octet_length(text).cast("long").alias("bytes"),
    )
    return numbered(rows, ["conv"], [F.col("turn").asc_nulls_first(), "t1", "t2"], "pos").drop("turn")


def rebuilt(turns: DataFrame) -> DataFrame:
    """Turns of conversations that begin like the first of their group of five: conversation c takes the first
    crc32(c) % 9 turns of conversation c - c % 5 (as far as there are any), then its own after as many."""
    head = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(HEADS))
    convs = turns.select("conv").distinct().select("conv", (F.col("conv") - F.col("conv") % GROUP).alias("base"), head.alias("h"))
    first = turns.where(F.col("pos") < HEADS).select(F.col("conv").alias("base"), "pos", "t1", "t2", "bytes")
    taken = convs.join(first, "base").where("pos <= h").select("conv", "pos", "t1", "t2", "bytes")
    # How many turns a conversation really gets from its base.
    got = convs.join(first.groupBy("base").agg(F.count(F.lit(1)).alias("n")), "base", "left")
    got = got.select("conv", "h", F.least("h", F.coalesce("n", F.lit(0))).alias("got"))
    sizes = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("own"))
    got = stage(got.join(sizes, "conv"), "heads")
    total = turns.count()
    rest = hot_join(turns, got, ["conv"], "own", total).where("pos > h").select("conv", (F.col("got") + F.col("pos") - F.col("h")).alias("pos"), "t1", "t2", "bytes")
    return taken.unionByName(rest)


def sequence_classes(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """(conv, cls, len, weight) of every conversation, staged: cls is the smallest conv with the same turns."""
    keys = turns.groupBy("conv").agg(
        F.count(F.lit(1)).alias("len"), F.bit_xor(F.xxhash64("pos", "t1", "t2")).alias("k1"), F.bit_xor(F.xxhash64(F.lit(1), "pos", "t2", "t1")).alias("k2")
    )
    zero = F.lit(0).cast("long")
    keys = stage(convs.join(keys, "conv", "left").select("conv", *[F.coalesce(c, zero).alias(c) for c in ("len", "k1", "k2")]), "keys")
    name = ["len", "k1", "k2"]
    groups = keys.groupBy(*name).agg(F.min("conv").alias("cls"), F.count(F.lit(1)).alias("weight"))
    out = stage(hot_join(keys, groups, name, "weight", keys.count()).select("conv", "cls", "len", "weight"), "members")
    unstage(keys)
    return out


def joined_ids(members: DataFrame, piece: int = PIECE, share: int = 500_000) -> DataFrame:
    """(cls, ends_sha256): the hash of the sorted, comma-joined conv ids of each class. A task joins some `share` ids."""
    single = members.where("weight = 1").select("cls", F.sha2(F.col("cls").cast("string").cast("binary"), 256).alias("ends_sha256"))
    several = members.where("weight > 1").select("cls", "conv")
    n = several.count()
    if not n:
        return single

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size, name, first = 0, None, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([first], pa.int64()), pa.array([b",".join(held)], pa.binary())], names=["cls", "first", "piece"])
        for batch in batches:
            for cls, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and (cls != name or size >= piece):
                    yield row()
                    held, size = [], 0
                if not held:
                    name, first = cls, conv
                held.append(b"%d" % conv)
                size += len(held[-1]) + 1
        if held:
            yield row()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([state.hexdigest()], pa.string())], names=["cls", "ends_sha256"])
        for batch in batches:
            for cls, piece in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if cls != name:
                    if state is not None:
                        yield row()
                    name, state = cls, hashlib.sha256(piece)
                else:
                    state.update(b",")
                    state.update(piece)
        if state is not None:
            yield row()

    parts = 1 + n // share
    ordered = several.repartitionByRange(parts, "cls", "conv").sortWithinPartitions("cls", "conv")
    cut = ordered.mapInArrow(tidy(pieces), "cls long, first long, piece binary")
    lined = cut.repartition(parts, "cls").sortWithinPartitions("cls", "first")
    return single.unionByName(lined.mapInArrow(tidy(hashed), "cls long, ends_sha256 string"))


#: A node before its hash: `ends` is the class that ends there; p1, p2 name the part above (top nodes of parts only).
NODE = T.StructType([T.StructField(n, LONG) for n in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends", "p1", "p2")])


def build_tries(rows: pd.DataFrame) -> pd.DataFrame:
    """The nodes of the subtries in rows (c1, c2, p1, p2, up, cls, pos, t1, t2, bytes, len, weight)."""
    rows = rows.sort_values(["c1", "c2", "cls", "pos"], kind="stable")
    columns = [rows[c].tolist() for c in ("c1", "c2", "p1", "p2", "up", "cls", "pos", "t1", "t2", "bytes", "len", "weight")]
    pointers: dict[tuple, int] = {}
    parent, depth, lead, convs, text, ends, top = [], [], [], [], [], [], []
    path = at = None
    for c1, c2, p1, p2, up, cls, pos, t1, t2, size, length, weight in zip(*columns, strict=True):
        if (c1, c2, cls) != path:
            path, at = (c1, c2, cls), (c1, c2)
        node = pointers.get((at, t1, t2))
        if node is None:
            node = pointers[at, t1, t2] = len(parent)
            above = -1 if isinstance(at, tuple) else at
            parent.append(above), depth.append(pos), lead.append(cls), convs.append(0), text.append(size), ends.append(None)
            top.append((up, p1, p2) if above < 0 else None)
        lead[node] = min(lead[node], cls)
        convs[node] += weight
        if pos == length:
            ends[node] = cls
        at = node
    # Children come after their parents, so the reverse of that order is a postorder: totals are whole when handed up.
    n = len(parent)
    children, leaves, saved = [0] * n, [0] * n, [0] * n
    for node in range(n - 1, -1, -1):
        leaves[node] = leaves[node] or 1
        saved[node] += (convs[node] - 1) * text[node]
        if parent[node] >= 0:
            children[parent[node]] += 1
            leaves[parent[node]] += leaves[node]
            saved[parent[node]] += saved[node]
    above = [lead[p] if p >= 0 else top[i][0] for i, p in enumerate(parent)]
    p1, p2 = ([t and t[k] for t in top] for k in (1, 2))
    made = dict(zip(NODE.names, (lead, depth, above, convs, children, leaves, saved, ends, p1, p2), strict=True))
    return pd.DataFrame({k: pd.array(v, dtype="Int64") for k, v in made.items()})


def chains(rows: DataFrame, depth: int) -> DataFrame:
    """The nodes of parts of one class each."""
    shared = rows.where("weight > 1")
    alone = rows.where("weight = 1").withColumn("below", F.lit(0).cast("long"))
    below = running_total(shared, ["cls"], [F.col("pos").desc()], F.col("bytes"), "below")
    first = F.col("pos") == depth
    last = F.col("pos") == F.col("len")
    return alone.unionByName(below).select(
        F.col("cls").alias("conv_id"), F.col("pos").alias("depth"), F.when(first, F.col("up")).otherwise(F.col("cls")).alias("parent_conv_id"),
        F.col("weight").alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        ((F.col("weight") - 1) * F.col("below")).alias("saved_tokens"), F.when(last, F.col("cls")).alias("ends"),
        F.when(first, F.col("p1")).alias("p1"), F.when(first, F.col("p2")).alias("p2"),
    )


def trie_nodes(messages: DataFrame, rebuild: bool = False, limit: int = LIMIT, max_depth: int = 10_000) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every distinct prefix.

    With `rebuild` the conversations are first rebuilt to share heads (`rebuilt`).
    """
    spark = messages.sparkSession
    prepare(spark)
    own = stage(turns_of(messages), "turns")
    turns = stage(rebuilt(own), "rebuilt") if rebuild else own
    members = sequence_classes(own.select("conv").distinct(), turns)
    classes = members.where("conv = cls").select("cls", "len", "weight")
    lengths = classes.agg(F.sum("len").alias("turns"), F.sum("weight").alias("convs"), F.min("cls").alias("least")).first()
    if not lengths.convs:
        return spark.createDataFrame([], ", ".join(f"{c} long" for c in NODE.names[:7]) + ", ends_sha256 string")

    # Turns of the classes, all in the part of the root.
    zero = F.lit(0).cast("long")
    paths = hot_join(turns.withColumnRenamed("conv", "cls"), classes.where("len > 0"), ["cls"], "len", lengths.turns)
    open_rows = stage(paths.select(zero.alias("g1"), zero.alias("g2"), F.lit(lengths.least).cast("long").alias("up"), "cls", "pos", "t1", "t2", "bytes", "len", "weight"), "open")
    root = classes.agg(F.min("cls").alias("conv_id"), F.sum("weight").alias("n_convs"), F.max(F.when(F.col("len") == 0, F.col("cls"))).alias("ends"))
    null = F.lit(None).cast("long")
    crown = stage(root.select(zero.alias("c1"), zero.alias("c2"), null.alias("p1"), null.alias("p2"), "conv_id", null.alias("parent_conv_id"), "n_convs", zero.alias("own"), "ends"), "crown")

    crowns, found = [crown], []
    for depth in range(1, max_depth + 1):
        heads = open_rows.where(F.col("pos") == depth)
        name = ["g1", "g2", "t1", "t2"]
        kids = heads.groupBy(*name).agg(
            F.min("cls").alias("conv_id"), F.max("up").alias("parent_conv_id"), F.sum("weight").alias("n_convs"), F.count(F.lit(1)).alias("k"),
            F.sum(F.col("len") - depth + 1).alias("rows"), F.max("bytes").alias("bytes"), F.max(F.when(F.col("len") == depth, F.col("cls"))).alias("ends"),
        )
        kind = F.when(F.col("k") == 1, "chain").when(F.col("rows") <= limit, "trie").otherwise("crown")
        kids = stage(kids.withColumns({"c1": F.xxhash64("g1", "t1", "t2"), "c2": F.xxhash64(F.lit(1), "g2", "t2", "t1"), "kind": kind}), "kids")
        totals = kids.agg(F.sum("k").alias("k"), F.sum("rows").alias("rows"), F.sum(F.when(F.col("kind") == "trie", F.col("rows"))).alias("tries"), F.count_if(F.col("kind") == "crown").alias("crowns")).first()
        if not totals.k:
            break
        # Which part each class goes to, then its turns.
        placed = hot_join(heads.select(*name, "cls", "len"), kids.select(*name, "k", "c1", "c2", "kind", F.col("conv_id").alias("child")), name, "k", totals.k)
        placed = stage(placed.select("cls", (F.col("len") - depth + 1).alias("left"), "c1", "c2", "kind", "child"), "placed")
        moved = stage(hot_join(open_rows.where(F.col("pos") >= depth), placed, ["cls"], "left", totals.rows).withColumnsRenamed({"g1": "p1", "g2": "p2"}), "moved")
        found.append(stage(chains(moved.where("kind = 'chain'"), depth), "nodes"))
        if totals.tries:
            dealt = moved.where("kind = 'trie'").withColumn("deal", F.pmod(F.xxhash64("c1", "c2"), F.lit(max(1, totals.tries // limit))))
            dealt = dealt.select("deal", "c1", "c2", "p1", "p2", "up", "cls", "pos", "t1", "t2", "bytes", "len", "weight")
            found.append(stage(dealt.groupBy("deal").applyInPandas(lambda pdf: build_tries(pdf), NODE), "nodes"))
        if totals.crowns:
            crowns.append(stage(kids.where("kind = 'crown'").select("c1", "c2", F.col("g1").alias("p1"), F.col("g2").alias("p2"), "conv_id", "parent_conv_id", "n_convs", ((F.col("n_convs") - 1) * F.col("bytes")).alias("own"), "ends"), "crown"))
            deeper = moved.where((F.col("kind") == "crown") & (F.col("pos") > depth))
            rest = stage(deeper.select(F.col("c1").alias("g1"), F.col("c2").alias("g2"), F.col("child").alias("up"), "cls", "pos", "t1", "t2", "bytes", "len", "weight"), "open")
        for table in (open_rows, kids, placed, moved):
            unstage(table)
        if not totals.crowns:
            break
        open_rows = rest
    else:
        raise RuntimeError("subtries of more than `limit` turns are nested deeper than max_depth")

    # Totals of the crown, from its deepest level up.
    parts = reduce(DataFrame.unionByName, found) if found else None
    tops = None if parts is None else parts.where("p1 is not null").select("p1", "p2", "n_leaves", "saved_tokens")
    nodes = parts
    for depth in range(len(crowns) - 1, -1, -1):
        level = crowns[depth]
        if tops is None:
            sums = level.select("c1", "c2", null.alias("n_children"), null.alias("leaves"), null.alias("below"))
        else:
            sums = tops.groupBy(F.col("p1").alias("c1"), F.col("p2").alias("c2")).agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("below"))
        whole = level.join(sums, ["c1", "c2"], "left").select(
            "conv_id", F.lit(depth).cast("long").alias("depth"), "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"),
            F.coalesce("leaves", F.lit(1).cast("long")).alias("n_leaves"), (F.col("own") + F.coalesce("below", zero)).alias("saved_tokens"), "ends", "p1", "p2",
        )
        whole = stage(whole, "nodes")
        nodes = whole if nodes is None else nodes.unionByName(whole)
        if tops is not None:
            tops = tops.unionByName(whole.where("p1 is not null").select("p1", "p2", "n_leaves", "saved_tokens"))

    hashes = joined_ids(members)
    out = NODE.names[:7]
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    ended = nodes.where("ends is not null").join(hashes.withColumnRenamed("cls", "ends"), "ends").select(*out, "ends_sha256")
    return ended.unionByName(nodes.where("ends is null").select(*out, empty.alias("ends_sha256")))
