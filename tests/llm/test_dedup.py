"""Line, substring and near dedup against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tessera.llm import line_dedup, minhash_dedup, sentence_spans, suffix_dedup
from tessera.llm.common import components


def sha(data):
    return hashlib.sha256(data).hexdigest()


def brute_lines(plain, min_chars=20, min_docs=3):
    parts = {d: (t or "").encode().split(b"\n") for d, t in plain.items()}
    key = lambda x: x.strip(b" \t\n\x0b\x0c\r").lower()
    held = defaultdict(set)
    for d, lines in parts.items():
        for x in lines:
            if len(key(x).decode()) >= min_chars:
                held[key(x)].add(d)
    out = {}
    for d, lines in parts.items():
        kept = [x for x in lines if len(held.get(key(x), ())) < min_docs or max(held[key(x)]) == d]
        out[d] = (len(lines), len(lines) - len(kept), sha(b"\n".join(kept)))
    return out


def test_line_dedup_equals_brute_force(docs, plain):
    want = brute_lines(plain)
    for batches, fanout in ((4, 3), (1, 2), (6, 2)):
        got = line_dedup.dedup_lines(docs, batches=batches, fanout=fanout).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256)).collect()
        assert {r[0]: tuple(r[1:]) for r in got} == want
    assert sum(v[1] for v in want.values()) > 5


def rows_with_other_texts(spark, odd):
    """The odd rows, and rows of known ids (and none) that hold other texts."""
    more = [(0, "Another text of document zero.\n  A LINE that many documents share, word for word.  "), (None, "A line that many documents share, word for word.\nand words of its own"), (0, None)]
    out = odd.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    return out, [(r.doc_id, r.text) for r in out.collect()]


def test_line_dedup_odd_input(spark, odd, empty):
    assert line_dedup.dedup_lines(empty).count() == 0
    frame, rows = rows_with_other_texts(spark, odd)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    held = defaultdict(list)
    for d, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 20:
                held[k].append(d)
    want = Counter()
    for d, t in rows:
        lines = (t or "").split("\n")
        gone = [len(held[key(x)]) >= 3 and max((i for i in held[key(x)] if i is not None), default=None) != d if key(x) in held else False for x in lines]
        want[(d, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g))] += 1
    got = line_dedup.dedup_lines(frame)
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()) == want
    assert got.schema["n_lines"].dataType.simpleString() == "bigint" and got.columns.count("n_lines") == 1


def brute_suffix(plain, length=200):
    data = {d: (t or "").encode() for d, t in plain.items()}
    seen = Counter(t[i : i + length] for t in data.values() for i in range(len(t) - length + 1))
    out = {}
    for d, t in data.items():
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(t, gone) if not g)
        runs = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[d] = (len(t), len(t) - len(kept), runs, sha(kept))
    return out


def test_suffix_dedup_equals_brute_force(docs, plain):
    want = brute_suffix(plain)
    for hot in (20_000, 2):
        got = suffix_dedup.remove_repeats(docs, hot).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
        assert {r[0]: tuple(r[1:]) for r in got} == want
    assert sum(v[1] for v in want.values()) > 5000


def test_suffix_dedup_odd_input(spark, odd, empty):
    assert suffix_dedup.remove_repeats(empty).count() == 0
    frame, rows = rows_with_other_texts(spark, odd)
    brute = brute_suffix(dict(enumerate(t for _, t in rows)))
    want = Counter((rows[i][0], *v) for i, v in brute.items())
    got = suffix_dedup.remove_repeats(frame).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert Counter(tuple(r) for r in got) == want


def test_sorting_has_no_bad_order():
    """Organ-pipe, sorted and equal strings, as many as a group may hold."""
    up = [b"%08d" % i + b"x" * 20 for i in range(0, 50_000, 2)]
    for strings in (up + up[::-1], sorted(up + up), up[::-1], [b"same" * 9] * 3000):
        order, common = suffix_dedup.deep_shallow_order(strings)
        assert [strings[i] for i in order] == sorted(strings) and len(set(order)) == len(strings)
        assert common[1] == len(suffix_dedup_lcp(strings[order[0]], strings[order[1]]))


def suffix_dedup_lcp(a, b):
    n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[:n]


def test_grams_that_share_a_hash_keep_apart():
    """Groups of one hash that hold several grams find what each gram's own group finds."""
    rng = random.Random(12)
    word = lambda n: bytes(rng.choice(b"ab") for _ in range(n))
    rows, want = [], []
    for g in range(6):
        gram = word(suffix_dedup.GRAM)
        own = []
        for i in range(rng.choice([2, 5, 40])):
            left, right = b"l%d" % g * 80 + word(rng.randint(0, 9)), b"r%d" % g * 80
            right = right[: rng.randint(0, 140)] + word(140)
            body = left[-suffix_dedup.LEFT :] + gram + right[: suffix_dedup.LENGTH - suffix_dedup.GRAM]
            pos = min(len(left), suffix_dedup.LEFT)
            own.append((g, i, rng.random() < 0.1, 7, pos, body))
        rows += own
        want += suffix_dedup.group_spans(own)
    rng.shuffle(rows)
    assert sorted(suffix_dedup.group_spans(rows)) == sorted(want) and want


def test_deep_shallow_order_sorts():
    rng = random.Random(1)
    for k in range(60):
        strings = [b"x" * (k % 3 * 20) + bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(1, 50))]
        order, common = suffix_dedup.deep_shallow_order(strings)
        assert [strings[i] for i in order] == sorted(strings)
        trie = suffix_dedup.BlindTrie(strings)
        for i in range(len(strings)):
            trie.insert(i)
        assert trie.order()[1] == common


def test_large_groups_take_the_level_path():
    rng = random.Random(2)
    core = bytes(rng.choice(b"abcd") for _ in range(64))
    left = [bytes(rng.choice(b"ab") for _ in range(4)) * rng.randint(0, 34) for _ in range(60)]
    right = [core + bytes(rng.choice(b"ab") for _ in range(3)) * rng.randint(0, 45) for _ in range(60)]
    got = suffix_dedup.repeats(left, right, [True] * 60)
    for i in range(60):
        want = {(suffix_dedup.lcp(left[i], left[j]), suffix_dedup.lcp(right[i], right[j])) for j in range(60) if j != i}
        cover = lambda pairs: {x for l, r in pairs if l + r >= 200 for x in range(-l, r)}  # noqa: E731, E741
        assert cover(got[i]) == cover(want)


def test_sentence_spans_equal_brute_force(docs, plain):
    seen, gone, parts = {}, defaultdict(set), {d: sentence_spans.sentences(t or "") for d, t in plain.items()}
    for d in sorted(parts):
        assert "".join(parts[d]) == (plain[d] or "")
        for i in range(len(parts[d]) - 1):
            words = [x.lower().split() for x in parts[d][i : i + 2]]
            if sum(map(len, words)) >= 12:
                key = str(words)
                if key in seen:
                    gone[d] |= {i, i + 1}
                seen.setdefault(key, d)
    want = {d: "".join(x for i, x in enumerate(p) if i not in gone[d]) for d, p in parts.items()}
    got = {r.doc_id: (r.text or "", r.n_removed) for r in sentence_spans.drop_repeated_spans(docs).collect()}
    assert got == {d: (t, len(gone[d])) for d, t in want.items()} and sum(map(len, gone.values())) > 10


def test_sentence_spans_odd_input(spark, odd, empty):
    assert sentence_spans.drop_repeated_spans(empty).count() == 0
    frame, rows = rows_with_other_texts(spark, odd)
    parts = [sentence_spans.sentences(t or "") for _, t in rows]
    runs = [(r, i, str([x.lower().split() for x in p[i : i + 2]])) for r, p in enumerate(parts) for i in range(len(p) - 1) if sum(len(x.split()) for x in p[i : i + 2]) >= 12]
    held = defaultdict(list)
    for r, i, key in runs:
        held[key].append((r, i))
    want = Counter()
    for r, (d, t) in enumerate(rows):
        gone = set()
        for q, i, key in runs:
            if q == r and len(held[key]) > 1:
                ids = [rows[x][0] for x, _ in held[key]]
                first = None if None in ids else min(ids)
                if d != first or any(x == r and j < i for x, j in held[key]):
                    gone |= {i, i + 1}
        want[(d, "".join(x for i, x in enumerate(parts[r]) if i not in gone), len(gone))] += 1
    got = sentence_spans.drop_repeated_spans(frame).collect()
    assert Counter((r.doc_id, r.text or "", r.n_removed) for r in got) == want


def test_sentence_spans_find_passages_of_short_sentences(spark, docs, plain):
    rng = random.Random(8)
    four = lambda: " ".join("".join(rng.choice("qrstuv") for _ in range(5)) for _ in range(4))
    passage = "".join(four() + ".\n" for _ in range(13))
    rows = [(i, f"Own start of {i} and its words.\n{passage}Own end of {i} with a few words of its own.") for i in range(3)]
    got = {r.doc_id: (r.text, r.n_removed, r.n_spans) for r in sentence_spans.drop_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"), lengthen=True).collect()}
    assert got == {i: (x if i == 0 else x.replace(passage, ""), 13 if i else 0, 1 if i else 0) for i, x in rows}

    # Every run of two sentences or more and 12 words or more, all lengths up to 25 sentences.
    seen, gone, parts = {}, defaultdict(set), {d: sentence_spans.sentences(t or "") for d, t in plain.items()}
    for d in sorted(parts):
        words = [tuple(x.lower().split()) for x in parts[d]]
        for i in range(len(words)):
            for j in range(i + 2, min(len(words), i + 25) + 1):
                if sum(map(len, words[i:j])) >= 12:
                    key = tuple(words[i:j])
                    if key in seen:
                        gone[d] |= set(range(i, j))
                    seen.setdefault(key, d)
    got = {r.doc_id: (r.text or "", r.n_removed) for r in sentence_spans.drop_repeated_spans(docs, lengthen=True).collect()}
    assert got == {d: ("".join(x for i, x in enumerate(p) if i not in gone[d]), len(gone[d])) for d, p in parts.items()}


def shingle_set(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def brute_near(plain, k=4):
    sets, up = {d: shingle_set(t, k) for d, t in plain.items()}, {d: d for d in plain}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    names = sorted(sets)
    for i, a in enumerate(names):
        for b in names[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in names}


def test_minhash_equals_brute_force(spark):
    rng = random.Random(9)
    base = [[str(rng.randint(0, 10**6)) for _ in range(rng.randint(4, 150))] for _ in range(30)]
    rows = []
    for i in range(260):
        words = list(base[min(int(rng.expovariate(0.2)), 29)])
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            words[rng.randrange(len(words))] = str(rng.randint(0, 50))
        rows.append((1000 - i, " ".join(words)))
    rows += [(2000, None), (2001, ""), (2002, "a"), (2003, "A"), (2004, "a b c"), (2005, "a  b\tC"), (2006, " ")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(frame, k=4).collect()}
    want = brute_near(dict(rows))
    assert got == {d: (n, c, d == c) for d, (n, c) in want.items()}
    assert len({c for _, c in want.values()}) < 200


def near_rows(rows, k):
    """The first row (doc_id, text) of each row's component by brute force over rows; null ids and empty sets alone."""
    sets = [shingle_set(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and None not in (rows[i][0], rows[j][0]) and 100 * both >= 80 * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    return [[rows[j] for j in groups[find(i)]] for i in range(len(rows))]


def test_minhash_odd_input(odd, empty):
    assert minhash_dedup.near_duplicates(empty).count() == 0
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    groups = near_rows(rows, 5)
    want = Counter((d, len(shingle_set(t, 5)), min((x for x, _ in g if x is not None), default=None)) for (d, t), g in zip(rows, groups))
    got = minhash_dedup.near_duplicates(odd).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)
    kept = minhash_dedup.keep_one(odd)
    assert kept.columns == odd.columns
    texts = [(r.doc_id, r.text) for r in kept.collect()]
    grouped = {(d, t): g for (d, t), g in zip(rows, groups) if shingle_set(t, 5) and d is not None}
    apart = [x for x in texts if x in grouped]
    assert sorted(min(d for d, _ in grouped[x]) for x in apart) == sorted(x[0] for x in apart) and len({id(grouped[x]) for x in apart}) == len(apart)
    assert len(apart) == len({id(g) for g in grouped.values()}) or len(apart) == len({min(map(str, g)) for g in grouped.values()})
    assert Counter(x for x in texts if x not in grouped) == Counter(x for x in rows if x not in grouped)


def test_minhash_rows_of_one_doc_id_are_documents_of_their_own(spark):
    rng = random.Random(14)
    body = lambda: [str(rng.randint(0, 10**6)) for _ in range(60)]
    a, z, y = body(), body(), body()
    near = lambda w: " ".join([*w[:59], "changed"])
    a_, z_, y_ = (" ".join(w) for w in (a, z, y))
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    left = minhash_dedup.keep_one(frame([(1, a_), (2, a_), (2, z_), (3, y_)])).collect()
    assert {tuple(r) for r in left} == {(1, a_), (2, z_), (3, y_)} and len(left) == 3
    rows = [(1, a_), (1, z_), (5, near(a)), (6, near(z)), (1, a_)]
    assert {(r.doc_id, r.component_id) for r in minhash_dedup.near_duplicates(frame(rows)).collect()} == {(1, 1), (5, 1), (6, 1)}
    left = minhash_dedup.keep_one(frame(rows)).collect()
    assert {tuple(r) for r in left} == {(1, a_), (1, z_)} and len(left) == 2
    assert {r.doc_id for r in minhash_dedup.keep_one(frame([(7, a_), (9, near(a)), (None, a_), (8, z_)])).collect()} == {7, 8, None}


def test_minhash_does_not_depend_on_what_counts_as_rare_or_heavy(spark, monkeypatch):
    from tessera.llm import common

    rng = random.Random(19)
    rows = []
    for i in range(60):
        words = [f"s{j}" for j in range(40)] + [f"r{i % 12}-{j}" for j in range(60)]
        for _ in range(rng.randint(0, 8)):
            words[rng.randrange(100)] = str(rng.randint(0, 99))
        rows.append((i, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = {d: c for d, (_, c) in brute_near(dict(rows)).items()}
    for rare, heavy in ((1, 1000), (2, 10**9)):
        monkeypatch.setattr(minhash_dedup, "RARE", rare)
        monkeypatch.setattr(common, "HEAVY", heavy)
        assert {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(frame, k=4).collect()} == want


def test_sketch_estimates_similarity():
    import numpy as np

    rng = np.random.default_rng(3)
    for size in (3, 40, 900):
        both = rng.integers(0, 2**63, size, dtype=np.uint64)
        rest = rng.integers(0, 2**63, max(1, size // 4), dtype=np.uint64)
        a, b = minhash_dedup.sketch(both), minhash_dedup.sketch(np.concatenate([both, rest]))
        assert abs((a == b).mean() - size / (size + len(rest))) < 0.2


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.id: r.component for r in components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
