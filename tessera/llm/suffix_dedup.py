"""Suffix-array dedup of long byte strings by deep-shallow sorting.

A byte is removed if a `LENGTH`-byte string that covers it also starts anywhere else. The suffixes of a whole
corpus need not be compared with each other: of the `GRAM`-byte grams in a `LENGTH`-byte string the leftmost
one of least hash is its anchor, so equal strings have equal anchors at equal offsets. Only suffixes at anchors
whose gram occurs twice are sorted, anchor by anchor: multikey quicksort over 8-byte characters to a shallow
depth, then blind tries for the groups that still share a prefix. The same order of the reversed left contexts
gives the common extension to the left. Occurrences x, y with l bytes of common left context and r bytes of
common right context share the r + l bytes around the anchor, which is a repeat if r + l >= LENGTH.

Equal texts are one class: its bytes are all covered if it has a copy, and one member stands for it among the
sorted suffixes. An anchor with more than `hot` members (some 60 MB of contexts) is not sorted in one task: its
members are keyed by every string whose anchor it is, counted with partial aggregation, and joined back.

Defined results: null and short texts lose nothing; strings never cross documents; rows that repeat a doc_id
are separate documents; operator columns replace input columns of the same name; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_flat, arrow_map, free_shuffles, hot_join, prepare, same, stage, text_bytes, tidy, unstage, without

LENGTH, GRAM = 200, 64
LEFT = LENGTH - GRAM
#: Depth in 8-byte characters, past the common gram, to which multikey quicksort goes.
SHALLOW = 3
#: Bytes of text that one vectorised pass holds.
PASS_BYTES = 300_000
TEXT_KEY = ["t1", "t2"]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def gram_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """64-bit hashes of all strings of `length` (a power of two) bytes."""
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    base, size = np.uint64(0xD6E8FEB86659FD93), 1
    with np.errstate(over="ignore"):
        while size < length:
            h = h[:-size] * base + h[size:]
            base, size = base * base, size * 2
    return mix(h)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(positions, gram hashes, first starts, starts) of the anchors of each text: an anchor is that of the
    strings at a run of consecutive starts."""
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    out = [none] * len(texts)
    todo: list[int] = []

    def run(rows: list[int]) -> None:
        data = np.frombuffer(b"".join(texts[i] for i in rows), np.uint8)
        sizes = np.array([len(texts[i]) for i in rows])
        ends = np.cumsum(sizes)
        h = gram_hashes(data, GRAM)
        key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        low = sliding_min(key, LENGTH - GRAM + 1)
        for i, a, b in zip(rows, ends - sizes, ends):
            at, first, starts = np.unique((low[a : b - LENGTH + 1] & np.uint64(0xFFFFFFFF)).astype(np.int64), return_index=True, return_counts=True)
            out[i] = at - a, h[at], first, starts

    held = 0
    for i, text in enumerate(texts):
        if len(text) >= LENGTH:
            todo.append(i)
            held += len(text)
            if held >= PASS_BYTES:
                run(todo)
                todo, held = [], 0
    if todo:
        run(todo)
    return out


def lcp(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class BlindTrie:
    """Compacted trie that keeps only branching depths and bytes; strings are looked up blindly, then checked."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: list | int = -1

    def _byte(self, s: bytes, depth: int) -> int:
        return s[depth] if depth < len(s) else -1

    def insert(self, i: int) -> None:
        s = self.strings[i]
        if self.root == -1:
            self.root = [None, {}, [i]]
            return
        node = self.root
        while node[0] is not None:
            node = node[1].get(self._byte(s, node[0])) or next(iter(node[1].values()))
        common = lcp(s, self.strings[node[2][0]])
        if common == len(s) == len(self.strings[node[2][0]]):
            node[2].append(i)
            return
        parent, key, node = None, None, self.root
        while node[0] is not None and node[0] < common:
            key = self._byte(s, node[0])
            parent, node = node, node[1][key]
        if node[0] == common:
            node[1][self._byte(s, common)] = [None, {}, [i]]
            return
        leaf = node
        while leaf[0] is not None:
            leaf = next(iter(leaf[1].values()))
        fork = [common, {self._byte(self.strings[leaf[2][0]], common): node, self._byte(s, common): [None, {}, [i]]}, []]
        if parent is None:
            self.root = fork
        else:
            parent[1][key] = fork

    def order(self) -> tuple[list[int], list[int]]:
        """Sorted indices, and the common prefix of each with the one before (-1 for the first)."""
        out, common = [], []
        stack = [(self.root, -1)]
        while stack:
            node, before = stack.pop()
            if node[0] is None:
                for n, i in enumerate(node[2]):
                    out.append(i)
                    common.append(before if n == 0 else len(self.strings[i]))
                continue
            kids = [node[1][k] for k in sorted(node[1])]
            stack.extend((kid, node[0]) for kid in kids[:0:-1])
            stack.append((kids[0], before))
        return out, common


def deep_shallow_order(strings: list[bytes], depth: int = 0) -> tuple[list[int], list[int]]:
    """Sorted indices of strings that share `depth` bytes, and common prefixes with the predecessor."""
    out: list[int] = []
    # Parts still to be sorted, the first one last; without a depth they are equal to their end.
    stack: list[tuple[list[int], int | None]] = [(list(range(len(strings))), 0)]
    while stack:
        rows, d = stack.pop()
        if len(rows) < 2 or d is None:
            out.extend(rows)
            continue
        if d == SHALLOW:
            trie = BlindTrie(strings)
            for i in rows:
                trie.insert(i)
            out.extend(trie.order()[0])
            continue
        a = depth + 8 * d
        # The median of three strings from hashed places, so that no order of the input is a bad one.
        pivot = sorted(strings[rows[k * 0x9E3779B97F4A7C15 % 0xFFFFFFFFFFFFFFC5 % len(rows)]][a : a + 8] for k in (1, 2, 3))[1]
        less, equal, more = [], [], []
        for i in rows:
            c = strings[i][a : a + 8]
            (less if c < pivot else equal if c == pivot else more).append(i)
        stack += [(more, d), (equal, d + 1 if len(pivot) == 8 else None), (less, d)]
    common = [-1] + [lcp(strings[a], strings[b]) for a, b in zip(out, out[1:])]
    return out, common


def repeats(left: list[bytes], right: list[bytes], need: list[bool]) -> list[list[tuple[int, int]]]:
    """For each occurrence the (l, r) around its anchor that repeat at another occurrence.

    left holds the reversed left contexts, right the right contexts; rows not needed only serve as partners.
    """
    m = len(left)
    found: list[list[tuple[int, int]]] = [[] for _ in range(m)]
    if m == 2:
        l, r = lcp(left[0], left[1]), lcp(right[0], right[1])
        if l + r >= LENGTH:
            found[0].append((l, r)), found[1].append((l, r))
        return found
    order, common = deep_shallow_order(right, GRAM)
    if m <= 24:
        for i in range(m):
            r, x = LENGTH, order[i]
            for j in range(i + 1, m):
                r = min(r, common[j])
                if r < GRAM:
                    break
                y = order[j]
                if need[x] or need[y]:
                    l = lcp(left[x], left[y])
                    if l + r >= LENGTH:
                        found[x].append((l, r)), found[y].append((l, r))
        return found
    left_order, left_common = deep_shallow_order(left)
    place = np.empty(m, np.int64)
    place[left_order] = np.arange(m)
    # Sparse table of minima over left_common, for common left context of any two ranks.
    table = [np.array(left_common, np.int64)]
    while 2 << (len(table) - 1) <= m:
        step = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-step], table[-1][step:]))

    def shared_left(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Minimum of left_common over (p, q]."""
        level = np.frexp((q - p).astype(np.float64))[1] - 1
        out = np.empty(len(p), np.int64)
        for k in np.unique(level):
            at = level == k
            row = table[k]
            out[at] = np.minimum(row[p[at] + 1], row[q[at] - (1 << k) + 1])
        return out

    rank, gap = place[order], np.array(common[1:], np.int64)
    for r in np.unique(gap[gap >= GRAM]):
        segment = np.concatenate([[0], np.cumsum(gap < r)])
        by = np.lexsort((rank, segment))
        near = segment[by[1:]] == segment[by[:-1]]
        pair = np.flatnonzero(near)
        if not len(pair):
            continue
        l = shared_left(rank[by[pair]], rank[by[pair + 1]])
        ok = l + r >= LENGTH
        for p, v in zip(pair[ok].tolist(), l[ok].tolist()):
            found[order[by[p]]].append((v, int(r)))
            found[order[by[p + 1]]].append((v, int(r)))
    return found


def group_spans(held: list[tuple]) -> list[tuple[int, int, int, int]]:
    """(t1, t2, start, end) of what repeats around the anchors of one hash: rows (t1, t2, multi, h, pos, body).

    The hash only brings rows together. They are told apart by the bytes of their grams, so grams that share a hash do not
    get between each other's members.
    """
    grams: dict[bytes, list[tuple]] = {}
    for row in held:
        cut = min(row[4], LEFT)
        grams.setdefault(row[5][cut : cut + GRAM], []).append(row)
    out = []
    for rows in grams.values():
        if len(rows) < 2 or all(row[2] for row in rows):
            continue
        cuts = [min(row[4], LEFT) for row in rows]
        left = [row[5][:c][::-1] for row, c in zip(rows, cuts)]
        right = [row[5][c:] for row, c in zip(rows, cuts)]
        for row, pairs in zip(rows, repeats(left, right, [not row[2] for row in rows])):
            if pairs and not row[2]:
                out += [(row[0], row[1], a, b) for a, b in merge([(row[4] - l, row[4] + r) for l, r in pairs])]
    return out


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = out[-1][0], b
        else:
            out.append((a, b))
    return out


def longs(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.LongType()) for n in names]


def named_texts(docs: DataFrame) -> DataFrame:
    """docs with t1, t2 (a 128-bit name of the text) and n_bytes."""
    body = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns({"t1": F.xxhash64(body), "t2": F.xxhash64(F.lit(1), body), "n_bytes": F.octet_length(body).cast("long")})


def text_anchors(docs: DataFrame) -> DataFrame:
    """(h, t1, t2, pos) of every anchor of every document."""

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        made = anchors(text_bytes(batch.column(2)))
        counts = [len(m[0]) for m in made]
        rows = np.repeat(np.arange(len(made)), counts)
        return {
            "h": pa.array(np.concatenate([m[1] for m in made]).view(np.int64) if made else np.zeros(0, np.int64)),
            "t1": batch.column(0).take(pa.array(rows)),
            "t2": batch.column(1).take(pa.array(rows)),
            "pos": pa.array(np.concatenate([m[0] for m in made]) if made else np.zeros(0, np.int64), pa.int64()),
        }

    return arrow_flat(docs.select("t1", "t2", "text"), run, T.StructType(longs("h", "t1", "t2", "pos")))


def repeated_spans(named: DataFrame, hot: int = 50_000) -> DataFrame:
    """(t1, t2, start, end): byte ranges of texts that are covered by repeated strings."""
    classes = stage(
        named.where(F.col("n_bytes") >= LENGTH)
        .groupBy(*TEXT_KEY)
        .agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("lead"), F.max("n_bytes").alias("n_bytes")),
        "classes",
    )
    spark = named.sparkSession
    # Copies of a text share all anchors, so counting rows finds every gram that occurs twice.
    found = stage(text_anchors(named.where(F.col("n_bytes") >= LENGTH)), "anchors")
    twice = found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    twice = stage(twice, "grams")
    marked = hot_join(found, twice, ["h"], "n", found.count()).select("t1", "t2", F.struct("pos", "h", (F.col("n") > hot).alias("hot")).alias("at"))
    wanted = stage(marked.groupBy("t1", "t2").agg(F.collect_set("at").alias("at")), "wanted")
    unstage(found)
    unstage(twice)
    del found, twice, marked
    free_shuffles(spark)

    lead = classes.select(F.col("t1").alias("_k1"), F.col("t2").alias("_k2"), "lead", "copies")
    lead = lead.join(wanted, (lead["_k1"] == wanted["t1"]) & (lead["_k2"] == wanted["t2"])).select("_k1", "_k2", "lead", "copies", "at")
    texts = (
        named.select("doc_id", "t1", "t2", "text")
        .join(lead, (F.col("t1") == F.col("_k1")) & (F.col("t2") == F.col("_k2")) & same(F.col("doc_id"), F.col("lead")))
        .select("t1", "t2", (F.col("copies") > 1).alias("multi"), F.col("at.pos").alias("pos"), F.col("at.h").alias("h"), F.col("at.hot").alias("hot"), "text")
    )

    def contexts(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        rows, columns = [], ([], [], [], [], [], [])
        places, grams, hots = (batch.column(c).to_pylist() for c in (3, 4, 5))
        for i, text in enumerate(text_bytes(batch.column(6))):
            runs = {}
            if any(hots[i]):
                at, _, first, starts = anchors([text])[0]
                runs = dict(zip(at.tolist(), zip(first.tolist(), starts.tolist())))
            for p, h, is_hot in zip(places[i], grams[i], hots[i]):
                rows.append(i)
                for column, value in zip(columns, (h, p, is_hot, *runs.get(p, (0, 0)), text[max(0, p - LEFT) : p + LENGTH])):
                    column.append(value)
        rows = pa.array(rows, pa.int64())
        made = {n: batch.column(k).take(rows) for k, n in enumerate(("t1", "t2", "multi"))}
        return made | {n: pa.array(c, t) for n, c, t in zip(("h", "pos", "hot", "first", "starts", "body"), columns, (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()))}

    fields = [*longs("t1", "t2"), T.StructField("multi", T.BooleanType()), *longs("h", "pos"), T.StructField("hot", T.BooleanType()), *longs("first", "starts"), T.StructField("body", T.BinaryType())]
    around = stage(arrow_flat(texts, contexts, T.StructType(fields)), "contexts")
    del lead, texts
    unstage(wanted)
    free_shuffles(spark)

    def sort_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: tuple[list, list, list, list] = ([], [], [], [])
        held: list[tuple] = []

        def close() -> None:
            for span in group_spans(held):
                for column, value in zip(made, span):
                    column.append(value)
            held.clear()

        def take() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in made], names=["t1", "t2", "start", "end"])
            for c in made:
                c.clear()
            return batch

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][3] != row[3]:
                    close()
                held.append(row)
            if len(made[0]) > 2000:
                yield take()
        close()
        yield take()

    span = T.StructType(longs("t1", "t2", "start", "end"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    calm = around.where(~F.col("hot")).select("t1", "t2", "multi", "h", "pos", "body")
    sorted_spans = calm.repartition(parts, "h").sortWithinPartitions("h").mapInArrow(tidy(sort_groups), span)
    out, used = [sorted_spans], [classes, around]
    if around.where("hot").limit(1).count():
        spans, staged = hot_spans(around.where("hot"))
        out.append(spans)
        used += staged
    whole = classes.where("copies > 1").select("t1", "t2", F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end"))
    result = whole
    for part in out:
        result = result.union(part)
    result = stage(result, "spans")
    del sorted_spans, out, calm
    for table in used:
        unstage(table)
    free_shuffles(spark)
    return result


def hot_spans(around: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Spans of anchors with very many members: count every string around the anchor, join the counts back. With the
    staged tables that the spans are read from."""

    def strings(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        rows, starts, names = [], [], []
        for i, (p, first, n, body) in enumerate(zip(*(batch.column(k).to_pylist() for k in (3, 4, 5, 6)))):
            shift = p - min(p, LEFT)
            for s in range(first, first + n):
                rows.append(i), starts.append(s), names.append(xxhash.xxh3_128_digest(body[s - shift : s - shift + LENGTH]))
        pair = np.frombuffer(b"".join(names), np.int64).reshape(-1, 2)
        index = pa.array(rows, pa.int64())
        made = {n: batch.column(k).take(index) for k, n in enumerate(("t1", "t2", "multi"))}
        return made | {"start": pa.array(starts, pa.int64()), "w1": pa.array(pair[:, 0]), "w2": pa.array(pair[:, 1])}

    fields = [*longs("t1", "t2"), T.StructField("multi", T.BooleanType()), *longs("start", "w1", "w2")]
    places = arrow_flat(around.select("t1", "t2", "multi", "pos", "first", "starts", "body"), strings, T.StructType(fields), text="body")
    places = stage(places, "strings")
    counts = places.groupBy("w1", "w2").agg(F.sum(F.when(F.col("multi"), 2).otherwise(1)).alias("n"), F.count(F.lit(1)).alias("k"))
    counts = stage(counts.where("n > 1").select("w1", "w2", "k"), "string-counts")
    found = hot_join(places.where(~F.col("multi")), counts, ["w1", "w2"], "k", places.count())
    return found.select("t1", "t2", "start", (F.col("start") + LENGTH).alias("end")), [places, counts]


def remove_repeats(docs: DataFrame, hot: int = 50_000) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans and kept (binary): the bytes that no repeated string covers."""
    prepare(docs.sparkSession)
    made = ["n_bytes", "n_removed", "n_spans", "kept"]
    carried = without(docs, [*made, "t1", "t2", "text", "_cuts", "_k1", "_k2"])
    named = named_texts(docs.select(*carried, "text"))
    spans = repeated_spans(named, hot)
    cuts = spans.groupBy("t1", "t2").agg(F.collect_list(F.struct("start", "end")).alias("_cuts"))
    cuts = cuts.select(F.col("t1").alias("_k1"), F.col("t2").alias("_k2"), F.col("_cuts.start").alias("_from"), F.col("_cuts.end").alias("_to"))
    joined = named.join(cuts, (F.col("t1") == F.col("_k1")) & (F.col("t2") == F.col("_k2")), "left")
    joined = joined.select(*carried, "text", "_from", "_to")

    def cut(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        sizes, removed, counts, kept = [], [], [], []
        starts, ends = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("_from", "_to"))
        for text, a, b in zip(text_bytes(batch.column(batch.schema.get_field_index("text"))), starts, ends):
            spans = merge(list(zip(a, b))) if a else []
            rest, at = [], 0
            for x, y in spans:
                rest.append(text[at:x])
                at = y
            rest.append(text[at:])
            body = b"".join(rest)
            sizes.append(len(text)), removed.append(len(text) - len(body)), counts.append(len(spans)), kept.append(body)
        return {n: pa.array(v, t) for n, v, t in zip(made, (sizes, removed, counts, kept), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))}

    outputs = T.StructType([*longs(*made[:3]), T.StructField("kept", T.BinaryType())])
    return arrow_map(joined, cut, outputs, keep=carried)
