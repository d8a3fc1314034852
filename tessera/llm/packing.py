"""Cost-balanced packing of tokenised documents into fixed-length sequences.

A piece of n tokens costs n + n*n/scale: linear work plus attention inside the piece. Documents are dealt to
groups by a hash of doc_id, text and the row's place in its input part, so that neither rows without a doc_id nor
repeated rows meet in one group (a part that is read again has the same rows in the same places). In a group, whole windows of `length` tokens are cut off long documents and stand
alone; the rests go, dearest first, each to the sequence of lowest cost that still has room, and a rest that
fits nowhere is cut to fill what room is left. Groups hold about `group_tokens` tokens, whatever the corpus
size, so memory is bounded and each group leaves less than one sequence of padding.

Defined results: a null text counts as empty and packs as the end id alone; rows that repeat a doc_id are
packed one by one; a null doc_id is packed as any other; an empty table gives no pieces.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, drop_kept, kept, prepare
from .wordbpe import encoder

END_ID = 1


def tokenize(docs: DataFrame, tokenizer_path: str, keep: list[str]) -> DataFrame:
    """(columns of keep, n, ids) of rows with a text: ids as little-endian unsigned 16-bit numbers, the end id last."""

    def encode(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        run = kept("wordbpe " + tokenizer_path, lambda: encoder(tokenizer_path))
        end = np.uint16(END_ID).tobytes()
        ids = [run(t or "") + end for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
        return {"n": pa.array([len(x) // 2 for x in ids], pa.int64()), "ids": pa.array(ids, pa.binary())}

    outputs = T.StructType([T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType())])
    return arrow_map(docs.select(*keep, "text"), encode, outputs, keep=keep, keeps=True)


def cost(n: int, scale: float) -> float:
    return n + n * n / scale


def pack_lengths(lengths: list[int], length: int, scale: float) -> list[tuple[int, int, int, int]]:
    """Pieces (document, start, size, sequence) of one group; sequences are filled without gaps."""
    pieces: list[tuple[int, int, int, int]] = []
    rests: list[tuple[int, int, int]] = []
    sequence = 0
    for doc, n in enumerate(lengths):
        full = n // length
        for k in range(full):
            pieces.append((doc, k * length, length, sequence))
            sequence += 1
        if n % length:
            rests.append((n % length, doc, full * length))
    rests.sort(key=lambda r: (-r[0], r[1]))
    total = sum(r[0] for r in rests)
    open_count = -(-total // length)
    room = {sequence + k: length for k in range(open_count)}
    heap = [(0.0, s) for s in room]
    for size, doc, start in rests:
        aside = []
        while size:
            while heap:
                spent, s = heapq.heappop(heap)
                if room[s] >= size:
                    break
                if room[s]:
                    aside.append((spent, s))
            else:
                # No sequence takes it whole: cut it, the cheapest sequence first.
                spent, s = heapq.heappop(aside)
            put = min(size, room[s])
            pieces.append((doc, start, put, s))
            room[s] -= put
            start, size = start + put, size - put
            if room[s]:
                aside.append((spent + cost(put, scale), s))
                heapq.heapify(aside)
        for entry in aside:
            heapq.heappush(heap, entry)
    return pieces


def pack(docs: DataFrame, tokenizer_path: str, length: int = 2048, scale: float = 2048.0, group_tokens: int = 1_000_000) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, cost, ids."""
    spark = docs.sparkSession
    prepare(spark)
    # A token takes at least about two bytes of text here; only the number of groups follows from this.
    size = docs.select(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("b"), F.count(F.lit(1)).alias("n")).first()
    groups = max(1, int((size.b or 0) / 2.5 / group_tokens))
    spread = F.xxhash64(F.lit(7), "doc_id", "text", F.monotonically_increasing_id())
    dealt = tokenize(docs.select("doc_id", "text").withColumn("grp", F.pmod(spread, F.lit(groups))), tokenizer_path, ["doc_id", "grp"])

    def pack_group(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        drop_kept()  # the encoder's tables are not needed any more
        order = sorted(range(len(pdf)), key=lambda i: (pd.isna(pdf["doc_id"].iat[i]), pdf["doc_id"].iat[i], pdf["ids"].iat[i]))
        ids = [pdf["ids"].iat[i] for i in order]
        names = [pdf["doc_id"].iat[i] for i in order]
        lengths = [len(x) // 2 for x in ids]
        pieces = pack_lengths(lengths, length, scale)
        pieces.sort(key=lambda p: (p[3],))
        rows, at, last = [], 0, -1
        for doc, start, n, sequence in pieces:
            at = 0 if sequence != last else at
            part = np.frombuffer(ids[doc], np.uint16)[start : start + n].astype("<u4").tobytes()
            rows.append((names[doc], start, n, zlib.crc32(part), lengths[doc], int(key[0]) << 32 | sequence, at, cost(n, scale), part))
            at, last = at + n, sequence
        return pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "cost", "ids"])

    schema = T.StructType(
        [docs.schema["doc_id"]]
        + [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
        + [T.StructField("cost", T.DoubleType()), T.StructField("ids", T.BinaryType())]
    )
    # One partition holds a few groups, whatever the session's number of shuffle partitions.
    dealt = dealt.select("grp", "doc_id", "ids").repartition(max(1, min(groups, 100_000)), "grp")
    return dealt.groupBy("grp").applyInPandas(pack_group, schema)
