"""Ranked lexical search: postings by term bucket, joined with the terms of the items, summed and cut to the top k.

Terms are the runs of ASCII digits, ASCII letters and characters beyond ASCII, with A-Z lower-cased. The index is one
staged table of postings (bucket, term, row, doc_id, tf, n), dealt by term bucket and sorted by bucket and term, so that a
search skips the row groups of other terms; each document also has one row of the empty term, from which N and L are
summed. A bucket is spread over tasks by document, so a term that most documents hold is in many of them.

A posting's score does not depend on the item that asks: it is computed once for each posting, and the scored postings are
dealt by document. There they meet the item terms, (item, document) is summed where it lies, and only each
task's best k rows of an item travel to the window that ranks them. Items are searched in blocks of at most
`block_terms` (item, term) rows, which bounds what is broadcast; an item stands whole in one block.

All numbers are 64-bit integers but a term's weight, floor(1000 * ln((2N + 2) / (2df + 1))) in doubles. The document
factor is 50 + (50 * n * N) div L; a match adds weight * ((10^9 * tf) div (1000 * tf + 20 * factor)).

Defined results: null and empty texts and texts without a term count for nothing; rows that repeat a doc_id, or have
none, are documents of their own and are ranked one by one (equal scores and ids in any order); rows of one item_id
(null too) are one item with the terms of all of them; an item without a match has no row; an empty table on either
side gives an empty result; other columns are not returned.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_flat, prepare, same, stage, text_bytes, unstage

#: Every byte that is no part of a term becomes a space; A-Z becomes a-z. Bytes beyond ASCII stay as they are.
_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz"
TABLE = bytes(b if b > 127 or bytes([b]) in _KEPT else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
#: Term buckets; bytes of text whose postings one task of the index writes; scored postings that one task sums.
BUCKETS, SHARE, DEAL = 32, 32 << 20, 200_000


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def counted_terms(rows: DataFrame, own: list[str]) -> DataFrame:
    """(own columns, term, tf, n) of rows with a text; the empty term stands for the row itself, its tf is n."""

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        at, terms, tf, total = [], [], [], []
        for i, text in enumerate(text_bytes(batch.column(batch.schema.get_field_index("text")))):
            words = terms_of(text)
            if words:
                counts = Counter(words)
                at += [i] * (len(counts) + 1)
                terms.append(b"")
                terms += counts
                tf.append(len(words))
                tf += counts.values()
                total += [len(words)] * (len(counts) + 1)
        places = pa.array(at, pa.int64())
        carried = {c: batch.column(batch.schema.get_field_index(c)).take(places) for c in own}
        return carried | {"term": pa.array(terms, pa.binary()).cast(pa.string()), "tf": pa.array(tf, pa.int64()), "n": pa.array(total, pa.int64())}

    outputs = T.StructType([rows.schema[c] for c in own] + [T.StructField("term", T.StringType()), T.StructField("tf", T.LongType()), T.StructField("n", T.LongType())])
    return arrow_flat(rows.select(*own, "text"), run, outputs)


def bucket(term: str) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def build_index(docs: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """The staged postings (bucket, term, row, doc_id, tf, n) of all documents; `only` (term) leaves out other terms."""
    prepare(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length("text")).alias("b")).first().b or 0
    parts = max(1, min(100_000, size // SHARE))
    rows = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    found = counted_terms(rows, ["row", "doc_id"])
    if only is not None:
        found = found.join(only.union(only.sparkSession.range(1).select(F.lit("").alias("term"))), "term", "left_semi")
    # A bucket is dealt by document over its share of the tasks and more, whatever the share of its commonest term.
    spread = F.pmod(F.xxhash64("row"), F.lit(4 + 4 * parts // BUCKETS))
    found = found.withColumn("bucket", bucket("term")).repartition(parts, "bucket", spread)
    return stage(found.sortWithinPartitions("bucket", "term").select("bucket", "term", "row", "doc_id", "tf", "n"), "postings")


def item_terms(items: DataFrame) -> DataFrame:
    """Staged (item_no, item_id, term): the distinct terms of each item. Item numbers are distinct, not dense."""
    made = counted_terms(items.select("item_id", "text"), ["item_id"]).where("term <> ''").select("item_id", "term").distinct()
    made = stage(made, "terms")
    numbers = stage(made.select("item_id").distinct().withColumn("item_no", F.monotonically_increasing_id()), "items")
    own = numbers.select(F.col("item_id").alias("_own"), "item_no")
    out = stage(made.join(own, same(F.col("item_id"), F.col("_own"))).select("item_no", "item_id", "term"), "item_terms")
    unstage(made), unstage(numbers)
    return out


def item_blocks(terms: DataFrame, block_terms: int) -> list[DataFrame]:
    """The item terms cut by item into blocks; an item lies in one block."""
    size = terms.count()
    blocks = -(-size // block_terms)
    return [terms.where(F.pmod(F.xxhash64("item_no"), F.lit(blocks)) == b) for b in range(blocks)]


def impact(tf: Column, n: Column, documents: int, tokens: int) -> Column:
    factor = F.lit(50).cast("long") + F.call_function("div", F.lit(50).cast("long") * n * F.lit(documents).cast("long"), F.lit(tokens).cast("long"))
    return F.call_function("div", F.lit(1_000_000_000).cast("long") * tf, F.lit(1000).cast("long") * tf + F.lit(20).cast("long") * factor)


def search(index: DataFrame, terms: DataFrame, top: int = 50, block_terms: int = 100_000) -> DataFrame:
    """(item_id, rank, doc_id, score) of the `top` documents of each item (item_no, item_id, term)."""
    totals = index.where("term = ''").agg(F.count(F.lit(1)).alias("n"), F.sum("tf").alias("l")).first()
    documents, tokens = totals.n, totals.l
    asked = terms.select("term").distinct()
    weight = F.floor(1000 * F.ln((2 * F.lit(documents).cast("double") + 2) / (2 * F.col("df").cast("double") + 1))).cast("long")
    df = index.where("term <> ''").join(asked, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weights = stage(df.select("term", weight.alias("w")).where("w > 0").withColumn("term_no", F.monotonically_increasing_id()), "weights")
    out = None
    for block in item_blocks(terms, block_terms):
        asks = block.join(weights, "term").select("item_no", "item_id", "term_no")
        # Both sides have at most block_terms rows.
        own = weights.join(block.select("term").distinct(), "term", "left_semi")
        scored = index.where("term <> ''").join(F.broadcast(own), "term")
        scored = scored.select("row", "doc_id", "term_no", (F.col("w") * impact(F.col("tf"), F.col("n"), documents, tokens)).alias("s")).where("s > 0")
        scored = stage(scored, "scored")
        parts = max(1, min(100_000, scored.count() // DEAL))
        met = scored.repartition(parts, "row").join(F.broadcast(asks.select("item_no", "term_no")), "term_no")
        summed = met.groupBy("row", "item_no").agg(F.sum("s").alias("score"), F.first("doc_id").alias("doc_id"))
        best = Window.partitionBy("item_no").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "row")
        ranked = summed.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
        named = ranked.join(F.broadcast(asks.select("item_no", "item_id").distinct()), "item_no").select("item_id", "rank", "doc_id", "score")
        done = stage(named, "ranked")
        unstage(scored)
        out = done if out is None else out.unionByName(done)
    unstage(weights)
    if out is None:
        empty = T.StructType([terms.schema["item_id"], T.StructField("rank", T.IntegerType()), index.schema["doc_id"], T.StructField("score", T.LongType())])
        return index.sparkSession.createDataFrame([], empty)
    return out


def ranked_search(docs: DataFrame, items: DataFrame, top: int = 50, block_terms: int = 100_000) -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` documents of each item."""
    prepare(docs.sparkSession)
    terms = item_terms(items)
    index = build_index(docs, terms.select("term").distinct())
    out = search(index, terms, top, block_terms)
    unstage(index), unstage(terms)
    return out
