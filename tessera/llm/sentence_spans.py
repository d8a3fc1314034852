"""Substring dedup by sliding sentence spans.

A text is cut into sentences (after . ! ? and white space, and at line ends); runs of consecutive sentences with
at least `min_words` words in all are hashed over their words in lower case. Runs are joined globally by hash:
the run at the smallest (doc_id, sentence) is the first, and every sentence covered by any other run of the same
hash is removed. Runs are judged on the input, not on what is left.

With `lengthen`, as the registered query has it, the runs are the shortest of `span` sentences or more that reach
min_words from each first sentence, and those that reach it back from each last sentence. Any repeated stretch of
at least span sentences and min_words words is covered by such runs inside it, so all of it is found, however
short its sentences are. Without it only runs of exactly `span` sentences are hashed.

Defined results: null and empty texts have no sentence; a text with fewer sentences than a span, or fewer words
than min_words, loses nothing; rows that repeat a doc_id hold their runs first together, so each keeps those that no
lower doc_id has (a run twice in one row goes at its second place); rows without a doc_id come before all others and are
such rows to each other; operator columns replace input columns of the
same name; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_flat, arrow_map, hot_join, prepare, same, stage, without

CUT = re.compile(r"[.!?]+[\"')\]]*\s+|\s*\n\s*")
KEY = ["h1", "h2"]
#: What a row is known by: its id and the name of its text.
ROW = ["doc_id", "t1", "t2"]


def text_name() -> list[Column]:
    return [F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2")]


def sentences(text: str) -> list[str]:
    """The sentences with the white space after them; together they are the text."""
    ends = [m.end() for m in CUT.finditer(text)]
    starts = [0, *ends]
    out = [text[a:b] for a, b in zip(starts, [*ends, len(text)]) if b > a]
    # Leading white space belongs to the first sentence.
    if len(out) > 1 and not out[0].strip():
        out[:2] = [out[0] + out[1]]
    return out


def runs(sizes: list[int], span: int, min_words: int, lengthen: bool) -> list[tuple[int, int]]:
    """(first sentence, sentence after the last) of the runs to hash, in order; sizes are words a sentence."""
    ends = list(accumulate(sizes, initial=0))
    n = len(sizes)
    if not lengthen:
        return [(i, i + span) for i in range(n - span + 1) if ends[i + span] - ends[i] >= min_words]
    found = set()
    j = 0
    for i in range(n - span + 1):
        j = max(j, i + span)
        while j <= n and ends[j] - ends[i] < min_words:
            j += 1
        if j > n:
            break
        found.add((i, j))
    i = 0
    for j in range(span, n + 1):
        while i + 1 + span <= j and ends[j] - ends[i + 1] >= min_words:
            i += 1
        if ends[j] - ends[i] >= min_words:
            found.add((i, j))
    return sorted(found)


def span_hashes(parts: list[str], span: int, min_words: int, lengthen: bool = False) -> list[tuple[int, int, bytes]]:
    """(first sentence, sentences, 128-bit hash) of each run that is long enough."""
    words = [p.lower().split() for p in parts]
    bodies = [" ".join(w).encode() for w in words]
    found = runs([len(w) for w in words], span, min_words, lengthen)
    return [(i, j - i, xxhash.xxh3_128_digest(b"\n".join(bodies[i:j]))) for i, j in found]


def document_spans(docs: DataFrame, span: int, min_words: int, lengthen: bool = False) -> DataFrame:
    """(h1, h2, doc_id, t1, t2, pos, size, again): every run; t1, t2 name the text; again: it holds the run at an earlier
    place too."""

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        rows, places, counts, found, again = [], [], [], [], []
        for i, text in enumerate(batch.column(3).to_pylist()):
            seen: set[bytes] = set()
            for pos, size, key in span_hashes(sentences(text), span, min_words, lengthen) if text else ():
                rows.append(i), places.append(pos), counts.append(size), found.append(key), again.append(key in seen)
                seen.add(key)
        pair = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
        return {
            "h1": pa.array(pair[:, 0]),
            "h2": pa.array(pair[:, 1]),
            **{n: batch.column(k).take(pa.array(rows, pa.int64())) for k, n in enumerate(ROW)},
            "pos": pa.array(places, pa.int32()),
            "size": pa.array(counts, pa.int32()),
            "again": pa.array(again, pa.bool_()),
        }

    outputs = T.StructType([T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), docs.schema["doc_id"], T.StructField("t1", T.LongType()), T.StructField("t2", T.LongType()), T.StructField("pos", T.IntegerType()), T.StructField("size", T.IntegerType()), T.StructField("again", T.BooleanType())])
    return arrow_flat(docs.select("doc_id", *text_name(), "text"), run, outputs)


def drop_repeated_spans(docs: DataFrame, span: int = 2, min_words: int = 12, lengthen: bool = False) -> DataFrame:
    """docs with repeated sentences gone from text, and n_sentences, n_removed, n_spans."""
    prepare(docs.sparkSession)
    spans = stage(document_spans(docs, span, min_words, lengthen), "runs")
    # A null doc_id comes first: min() skips nulls, so their number is counted too.
    first = spans.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("low"), F.count("doc_id").alias("numbered"))
    first = first.where("n > 1").select(*KEY, "n", F.when(F.col("numbered") == F.col("n"), F.col("low")).alias("first"))
    first = stage(first, "first-runs")
    later = (
        hot_join(spans, first, KEY, "n", spans.count())
        .where(F.col("again") | ~same(F.col("doc_id"), F.col("first")))
        .groupBy(*ROW)
        .agg(F.collect_set(F.struct("pos", "size")).alias("_gone"))
        .select(*[F.col(c).alias(f"_gone_{c}") for c in ROW], "_gone")
    )
    made = ["text", "n_sentences", "n_removed", "n_spans"]
    carried = without(docs, [*made, "_gone", *[f"_gone_{c}" for c in ROW]])
    one, two = text_name()
    hit = same(F.col("doc_id"), F.col("_gone_doc_id")) & (one == F.col("_gone_t1")) & (two == F.col("_gone_t2"))
    joined = docs.select(*carried, "text").join(later, hit, "left")

    def cut(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        texts, counts, removed, runs = [], [], [], []
        gone = batch.column(batch.schema.get_field_index("_gone")).to_pylist()
        for text, starts in zip(batch.column(batch.schema.get_field_index("text")).to_pylist(), gone):
            parts = sentences(text) if text else []
            counts.append(len(parts))
            if not starts:
                texts.append(text), removed.append(0), runs.append(0)
                continue
            drop = {i for run in starts for i in range(run["pos"], run["pos"] + run["size"])}
            texts.append("".join(p for i, p in enumerate(parts) if i not in drop))
            removed.append(len(drop))
            runs.append(sum(i - 1 not in drop for i in drop))
        return {"text": pa.array(texts, pa.string()), **{n: pa.array(v, pa.int64()) for n, v in zip(made[1:], (counts, removed, runs))}}

    outputs = T.StructType([T.StructField("text", T.StringType())] + [T.StructField(n, T.LongType()) for n in made[1:]])
    return arrow_map(joined, cut, outputs, keep=carried)
