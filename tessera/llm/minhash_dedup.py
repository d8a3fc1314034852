"""MinHash near-dedup by fast similarity sketching.

A document is the set of its word shingles (ASCII lower case; words are runs without ASCII white space). Its
sketch has `T_BINS` coordinates: in round i every shingle is thrown into a hashed bin with the value
(i, hash), a bin keeps its least value, and rounds i >= T_BINS throw every shingle into bin i - T_BINS, so each
coordinate fills for certain. Coordinates agree with a chance equal to the Jaccard similarity, concentrated as
for independent ones. Bands of `ROWS` coordinates make candidates: at similarity 0.8 all 40 bands of 3 miss
with a chance of about 1e-12.

Links are exact: documents of equal sets form classes, and each candidate pair of classes is confirmed on full
sets. A bucket first links its members to its most central member (a star). Buckets that still span several
components then compare members of different components, in two exact parts. Pairs that share a shingle held by
2 to `RARE` candidates are found by joining on those shingles, which costs at most RARE rows a shingle. Other
pairs can only share shingles held by more candidates; with c the smaller number of those, their similarity is
at most c / (|a| + |b| - c), and bucket mates below the threshold by that bound are not paired. Nothing is
capped; a pair inside one component needs no look.

Rows of equal sets are one class, named by a 128-bit hash of the set; nothing is keyed by doc_id, which only names
components in the end. A class, bucket or component of many rows is joined by broadcast (`hot_join`).

Defined results: null, empty and blank texts have an empty set and link with nothing; a text of fewer words
than a shingle is one shingle; rows that repeat a doc_id are documents of their own, linked by their texts alone, so
they may lie in different components; rows without a doc_id link with nothing and are kept; an empty table gives an
empty result. `keep_one` leaves one row of each component: the one of least doc_id (ties: of least set name, then of
least text name; equal rows count once).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, components, hot_join, prepare, same, stage, text_bytes, tidy, unstage

T_BINS, ROWS = 120, 3
#: A shingle held by at most so many candidates is joined on directly.
RARE = 32
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < 100_000:
            self[word] = h
        return h


def shingle_set(text: bytes, k: int, known: WordHashes | None = None) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a text."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    look = xxhash.xxh3_64_intdigest if known is None else known.__getitem__
    ids = np.fromiter(map(look, words), np.uint64, len(words))
    k = min(k, len(ids))
    n = len(ids) - k + 1
    h = ids[:n] * _ODD[0]
    for j in range(1, k):
        h = mix(h) + ids[j : j + n] * _ODD[j % len(_ODD)]
    return np.unique(mix(h + np.uint64(k)))


def sketch(items: np.ndarray) -> np.ndarray:
    """Fast similarity sketch of a non-empty set."""
    t, n = T_BINS, len(items)
    out = np.full(t, np.iinfo(np.uint64).max, np.uint64)
    step = max(1, min(t, 1500 // n))
    for first in range(0, t, step):
        rounds = np.arange(first, min(first + step, t), dtype=np.uint64)
        h = mix(items[None, :] + (rounds[:, None] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        value = (rounds[:, None] << np.uint64(56)) | (h >> np.uint64(8))
        bins = ((h & np.uint64(0xFFFFFFFF)) * np.uint64(t)) >> np.uint64(32)
        np.minimum.at(out, bins.ravel().astype(np.int64), value.ravel())
        # A later round cannot lower a filled bin, so stop once all are filled.
        if out.max() != np.iinfo(np.uint64).max:
            return out
    for b in np.flatnonzero(out == np.iinfo(np.uint64).max):
        h = mix(items + np.array([t + int(b) + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        out[b] = (np.uint64(t) << np.uint64(56)) | (h.min() >> np.uint64(8))
    return out


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    rows = coordinates.reshape(-1, ROWS)
    h = np.arange(1, len(rows) + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for j in range(ROWS):
        h = mix(h + rows[:, j] * _ODD[j])
    return h.view(np.int64)


def set_name(items: np.ndarray) -> tuple[int, int]:
    one, two = np.frombuffer(xxhash.xxh3_128_digest(items.tobytes()), np.int64)
    return int(one), int(two)


def named_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text, t1, t2): t1, t2 name the text."""
    body = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", "text", F.xxhash64(body).alias("t1"), F.xxhash64(F.lit(1), body).alias("t2"))


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, t1, t2, n_shingles, s1, s2, bands): s1, s2 name the shingle set (null for an empty one)."""

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        sizes, first, second, bands, known = [], [], [], [], WordHashes()
        for text in text_bytes(batch.column(1)):
            own = shingle_set(text, k, known)
            sizes.append(len(own))
            one, two = set_name(own) if len(own) else (None, None)
            first.append(one), second.append(two), bands.append(band_keys(sketch(own)) if len(own) else None)
        return {
            "n_shingles": pa.array(sizes, pa.int64()),
            "s1": pa.array(first, pa.int64()),
            "s2": pa.array(second, pa.int64()),
            "bands": pa.array(bands, pa.list_(pa.int64())),
        }

    outputs = T.StructType(
        [T.StructField(n, T.LongType()) for n in ("n_shingles", "s1", "s2")] + [T.StructField("bands", T.ArrayType(T.LongType()))]
    )
    return arrow_map(named_texts(docs), run, outputs, keep=["doc_id", "t1", "t2"])


def candidate_sets(docs: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """(rep, n, items): the set of each class (rep, lead, s1, s2), made from the texts of the leading documents."""
    ids = classes.select(F.col("lead.doc_id").alias("doc_id")).distinct()
    own = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi")

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        known = WordHashes()
        sets = [shingle_set(t, k, known) for t in text_bytes(batch.column(1))]
        names = [set_name(s) for s in sets]
        return {
            "s1": pa.array([x[0] for x in names], pa.int64()),
            "s2": pa.array([x[1] for x in names], pa.int64()),
            "n": pa.array([len(s) for s in sets], pa.int64()),
            "items": pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
        }

    outputs = T.StructType([T.StructField(n, T.LongType()) for n in ("s1", "s2", "n")] + [T.StructField("items", T.ArrayType(T.LongType()))])
    made = arrow_map(own, run, outputs).dropDuplicates(["s1", "s2"])
    return made.join(classes.select("rep", "s1", "s2"), ["s1", "s2"]).select("rep", "n", "items")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    one = sets.select(F.col("rep").alias("a"), F.col("items").alias("x"))
    two = sets.select(F.col("rep").alias("b"), F.col("items").alias("y"))
    both = pairs.join(one, "a").join(two, "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            x, y = batch.column(2), batch.column(3)
            for i in range(batch.num_rows):
                u, v = x[i].values.to_numpy(), y[i].values.to_numpy()
                if 100 * min(len(u), len(v)) < percent * max(len(u), len(v)):
                    keep.append(False)
                    continue
                # Both are sorted as unsigned numbers and distinct.
                joint = np.concatenate([u, v])
                joint.sort(kind="stable")
                common = int((joint[1:] == joint[:-1]).sum())
                keep.append(100 * common >= percent * (len(u) + len(v) - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    schema = T.StructType([T.StructField("a", sets.schema["rep"].dataType), T.StructField("b", sets.schema["rep"].dataType)])
    return both.select("a", "b", "x", "y").mapInArrow(tidy(run), schema)


def _can_reach(n: str, c: str, m: str, d: str, percent: int) -> Column:
    """Whether sets of n and m shingles, of which at most c and d can be shared, may reach the threshold."""
    both = F.least(c, d)
    return 100 * both >= percent * (F.col(n) + F.col(m) - both)


def _across(rows: DataFrame, key: str, shared: str, percent: int) -> DataFrame:
    """Pairs (a, b) of rows of equal key in different components that may reach the threshold. Keys are held by few."""
    names = ["rep", "n", shared, "comp"]
    left = rows.select(key, *[F.col(c).alias(f"a_{c}") for c in names])
    right = rows.select(key, *[F.col(c).alias(f"b_{c}") for c in names])
    apart = (F.col("a_rep") < F.col("b_rep")) & (F.col("a_comp") != F.col("b_comp"))
    wanted = apart & _can_reach("a_n", f"a_{shared}", "b_n", f"b_{shared}", percent)
    return left.join(right, key).where(wanted).select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b"))


def _between(rows: DataFrame, key: str, shared: str, percent: int, every: str) -> DataFrame:
    """Pairs as those of `_across`, for keys held by many. A pair is made only at the least key in `every` of both.

    Each key's largest component meets the rest, and the rest meets itself. No two members of the largest component meet,
    and the rest has no larger one, so at most twice as many pairs are looked at as lie in different components.
    """
    names = ["rep", "n", shared, "comp", every]
    sizes = rows.groupBy(key, "comp").agg(F.count(F.lit(1)).alias("k"))
    largest = sizes.groupBy(key).agg(F.max(F.struct("k", "comp")).alias("top")).select(key, F.col("top.comp").alias("_top"))
    parted = stage(rows.join(largest, key).withColumn("_lead", F.col("comp") == F.col("_top")), "parted")
    left = parted.select(key, F.col("_lead").alias("a_lead"), *[F.col(c).alias(f"a_{c}") for c in names])
    right = parted.where(~F.col("_lead")).select(key, *[F.col(c).alias(f"b_{c}") for c in names])
    once = F.array_min(F.array_intersect(f"a_{every}", f"b_{every}")) == F.col(key)
    apart = (F.col("a_comp") != F.col("b_comp")) & (F.col("a_lead") | (F.col("a_rep") < F.col("b_rep")))
    met = left.join(right, key).where(apart & _can_reach("a_n", f"a_{shared}", "b_n", f"b_{shared}", percent) & once)
    return met.select(F.least("a_rep", "b_rep").alias("a"), F.greatest("a_rep", "b_rep").alias("b"))


def link_classes(docs: DataFrame, k: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, t1, t2, n_shingles, s1, s2) and classes (s1, s2, rows, lead), staged.

    lead is the first row (doc_id, s1, s2, t1, t2) of the class's whole component.
    """
    prepare(docs.sparkSession)
    made = stage(sketches(docs, k), "sketch")
    # An id made while the table is written is unique whatever tasks are run again.
    classes = (
        made.where("s1 is not null and doc_id is not null")
        .groupBy("s1", "s2")
        .agg(F.count(F.lit(1)).alias("rows"), F.min(F.struct("doc_id", "s1", "s2", "t1", "t2")).alias("lead"), F.first("bands").alias("bands"))
        .withColumn("rep", F.monotonically_increasing_id())
    )
    classes = stage(classes, "classes")
    n_cells = classes.count() * (T_BINS // ROWS)
    cells = classes.select("rep", F.explode("bands").alias("cell"))
    shared = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    cells = stage(hot_join(cells, shared, ["cell"], "m", n_cells), "cells")

    near = classes.join(cells.select("rep").distinct(), "rep", "left_semi").select("rep", "s1", "s2", "lead")
    sets = stage(candidate_sets(docs, near, k), "sets")
    # Shingles by the number of candidates that hold them: alone, a few, or more.
    tokens = sets.select("rep", F.explode("items").alias("item"))
    held = tokens.groupBy("item").agg(F.count(F.lit(1)).alias("m"), F.min("rep").alias("only")).where(F.col("m") <= RARE)
    held = stage(held, "held")
    lonely = held.where("m = 1").groupBy(F.col("only").alias("rep")).agg(F.count(F.lit(1)).alias("u"))
    few = stage(tokens.join(held.where("m > 1").select("item"), "item"), "few")
    fewer = few.groupBy("rep").agg(F.count(F.lit(1)).alias("w"))
    zero = F.lit(0).cast("long")
    sizes = sets.select("rep", "n").join(lonely, "rep", "left").join(fewer, "rep", "left")
    # c: shingles that some other candidate holds; g: those that more than a few hold.
    sizes = sizes.select("rep", "n", (F.col("n") - F.coalesce("u", zero)).alias("c"), (F.col("n") - F.coalesce("u", zero) - F.coalesce("w", zero)).alias("g"))
    sizes = stage(sizes, "sizes")
    able = F.col("c") * 100 >= F.col("n") * percent
    cells_sized = cells.join(sizes.where(able), "rep").select("cell", "m", "rep", "n", "c", "g")

    # Star: the bucket's most central member, by its share of sharable shingles.
    centre = cells_sized.groupBy("cell").agg(F.max("m").alias("m"), F.max(F.struct((F.col("c") / F.col("n")).alias("share"), (-F.col("rep")).alias("id"), "n", "c")).alias("top"))
    centre = stage(centre.select("cell", "m", (-F.col("top.id")).alias("pivot"), F.col("top.n").alias("pn"), F.col("top.c").alias("pc")), "centre")
    star = (
        hot_join(cells_sized.drop("m"), centre, ["cell"], "m", n_cells)
        .where((F.col("rep") != F.col("pivot")) & _can_reach("n", "c", "pn", "pc", percent))
        .select(F.col("pivot").alias("a"), F.col("rep").alias("b"))
        .distinct()
    )
    links = stage(confirm(star, sets, percent), "links")
    found = stage(components(links), "comp")

    # Members of different components that could still reach the threshold.
    label = F.coalesce("component", "rep").alias("comp")
    comp = sizes.where(able).join(found, sizes["rep"] == found["id"], "left").select("rep", "n", "c", "g", label)
    comp = stage(comp, "labels")
    labelled = cells.join(comp.where(F.col("g") * 100 >= F.col("n") * percent), "rep")
    mixed = labelled.groupBy("cell").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("k")).where("lo <> hi").select("cell", "k")
    open_cells = hot_join(labelled, mixed, ["cell"], "k", n_cells).join(classes.select("rep", "bands"), "rep")
    open_cells = stage(open_cells.select("cell", "rep", "n", "g", "comp", "bands"), "open")
    mates = _between(open_cells, "cell", "g", percent, every="bands")
    sharers = _across(few.join(comp, "rep").select("item", "rep", "n", "c", "comp"), "item", "c", percent)
    rest = mates.union(sharers).distinct()
    more = stage(confirm(rest, sets, percent), "links")
    final = stage(components(more, known=found), "comp")

    leads = classes.select("rep", "s1", "s2", "rows", "lead").join(final.withColumnRenamed("id", "rep"), "rep", "left")
    linked = leads.where("component is not null")
    first = linked.groupBy("component").agg(F.min("lead").alias("first"), F.count(F.lit(1)).alias("k"))
    linked = hot_join(linked, first, ["component"], "k", n_cells).select("s1", "s2", "rows", F.col("first").alias("lead"))
    out = stage(linked.union(leads.where("component is null").select("s1", "s2", "rows", "lead")), "leads")
    for table in (classes, cells, sets, held, few, sizes, centre, links, found, comp, open_cells, more, final):
        unstage(table)
    return made.drop("bands"), out


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document; kept: the component's smallest doc_id."""
    made, classes = link_classes(docs, k, percent)
    alone = F.col("s1").isNull() | F.col("doc_id").isNull()
    named = made.where(~alone).select("doc_id", "n_shingles", "s1", "s2")
    linked = hot_join(named, classes.select("s1", "s2", "rows", F.col("lead.doc_id").alias("component_id")), ["s1", "s2"], "rows", classes.count() + made.count())
    rest = made.where(alone).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = linked.select("doc_id", "n_shingles", "component_id").union(rest)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs without rows that are near copies of a kept one."""
    made, classes = link_classes(docs, k, percent)
    row = ["doc_id", "t1", "t2"]
    named = made.where("s1 is not null and doc_id is not null").select(*row, "s1", "s2")
    placed = hot_join(named, classes, ["s1", "s2"], "rows", made.count())
    leading = (F.col("doc_id") == F.col("lead.doc_id")) & (F.col("t1") == F.col("lead.t1")) & (F.col("t2") == F.col("lead.t2"))
    gone = placed.where(~leading).select(*[F.col(c).alias(f"_gone_{c}") for c in row]).distinct()
    body = F.coalesce(docs["text"], F.lit(""))
    hit = (docs["doc_id"] == gone["_gone_doc_id"]) & (F.xxhash64(body) == gone["_gone_t1"]) & (F.xxhash64(F.lit(1), body) == gone["_gone_t2"])
    left = docs.join(gone, hit, "left_anti")
    # Equal rows lead together; where there are any, one of each stays.
    twice = named.groupBy(*row).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*[F.col(c).alias(f"_gone_{c}") for c in row])
    if not twice.limit(1).count():
        return left
    twice = stage(twice, "twice")
    hit = (left["doc_id"] == twice["_gone_doc_id"]) & (F.xxhash64(left["text"]) == twice["_gone_t1"]) & (F.xxhash64(F.lit(1), left["text"]) == twice["_gone_t2"])
    return left.join(twice, hit, "left_anti").unionByName(left.join(twice, hit, "left_semi").dropDuplicates(["doc_id", "text"]))
