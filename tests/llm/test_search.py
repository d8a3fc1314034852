"""Embedding near-dedup, ranked search and prefix tries against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import embedding_dedup, lexical_search, prefix_trie

VECTORS = "vec_id long, embedding array<float>, label int"


def brute_near(rows, threshold=0.93):
    """(vec_id, n_links, component_id, kept) by all pairs of a label."""

    def able(vec, x, label):
        return vec is not None and label is not None and bool(x) and all(v is not None and math.isfinite(v) for v in x) and any(x)

    live = [i for i, (v, x, label) in enumerate(rows) if able(v, x, label)]
    links, root = Counter(), {i: i for i in live}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(live):
        for j in live[k + 1 :]:
            (_, x, a), (_, y, b) = rows[i], rows[j]
            if a == b and len(x) == len(y):
                x, y = np.array(x, np.float32).astype(float), np.array(y, np.float32).astype(float)
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    root[find(i)] = find(j)
    least = {}
    for i in live:
        least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    out = []
    for i, (vec, _, _) in enumerate(rows):
        component = least[find(i)] if i in root else vec
        out.append((vec, links[i], component, vec is None or vec == component))
    return sorted(out, key=str)


def noisy(rng, centre, size):
    x = centre + rng.normal(size=len(centre)) * size
    return [float(v) for v in x.astype(np.float32)]


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(3)
    rows = [(i, noisy(rng, rng.normal(size=64), 0), int(i % 2)) for i in range(500)]
    hub, chain = rng.normal(size=64), rng.normal(size=64)
    rows += [(1000 + i, noisy(rng, hub, 0.12), 0) for i in range(150)]
    rows += [(2000 + i, noisy(rng, np.array(rows[i][1]), 0.1), int(i % 2)) for i in range(60)]
    for i in range(12):  # neighbours are linked, the ends are not
        chain = chain / np.linalg.norm(chain) + rng.normal(size=64) * 0.03
        rows.append((3000 + i, noisy(rng, chain, 0), 1))
    return rows + [(4000 + i, rows[3][1], 1) for i in range(5)] + [(5000, [2 * v for v in rows[3][1]], 1)]


def result(frame):
    return sorted((tuple(r) for r in frame.select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


def test_near_vectors_equal_all_pairs(spark, clustered):
    assert result(embedding_dedup.near_vectors(spark.createDataFrame(clustered, VECTORS))) == brute_near(clustered)


def test_near_vectors_in_bands_and_blocks(spark, clustered, monkeypatch):
    """Narrow cells cut into many blocks: the same links."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    got = result(embedding_dedup.near_vectors(spark.createDataFrame(clustered, VECTORS).repartition(3), bucket=32))
    assert embedding_dedup.bands(400, 0.93, 32, 1e-4)[0] == 4
    assert got == brute_near(clustered)


def test_bands_find_pairs_at_the_threshold():
    """Recall of pairs that barely reach the threshold, when bands are ten bits wide."""
    rng = np.random.default_rng(8)
    a = rng.normal(size=(2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.normal(size=a.shape)
    side -= (side * a).sum(1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    b = 0.931 * a + math.sqrt(1 - 0.931**2) * side
    bits, count = embedding_dedup.bands(1 << 20, 0.93, 1024, 1e-4)
    one, two = embedding_dedup.encode(a), embedding_dedup.encode(b)
    hit = embedding_dedup.band_keys(one["pool"], 64, bits, count) == embedding_dedup.band_keys(two["pool"], 64, bits, count)
    assert bits == 10 and hit.any(1).mean() > 0.998
    for band in (0, 1, count // 2):
        assert embedding_dedup.apart_before(one["pool"], two["pool"], 64, bits, band).tolist() == np.flatnonzero(~hit[:, :band].any(1)).tolist()


@pytest.mark.parametrize("dim", [1, 3, 64, 100])
def test_upper_bounds_hold(dim):
    rng = np.random.default_rng(dim)
    a = rng.normal(size=(300, dim))
    b = a + rng.normal(size=a.shape) * rng.uniform(0, 1, (300, 1))
    unit = [x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b)]
    one, two = embedding_dedup.encode(a), embedding_dedup.encode(b)
    i, j = (x.ravel() for x in np.indices((300, 300)))
    bound = embedding_dedup.upper_bounds(one, two, i, j, embedding_dedup.padded(dim))
    true = (unit[0] @ unit[1].T).ravel()
    assert (bound >= true - 1e-9).mean() > 0.999
    # Together with the signs of all maps it rules out most pairs, and no link.
    found = {(u, v) for x in embedding_dedup.open_pairs(one, two, dim, 0.93) for u, v in zip(*(y.tolist() for y in x), strict=True)}
    links = {(u, v) for u, v, t in zip(i.tolist(), j.tolist(), true, strict=True) if t >= 0.93}
    assert links <= found and len(found) < len(links) + (true < 0.93).sum() * 0.2


def test_near_vectors_odd_input(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (3, [1.0, 0.0], None), (None, [1.0, 0.0], 0), (4, None, 0), (5, [], 0), (6, [0.0, 0.0], 0)]
    rows += [(7, [nan, 1.0], 0), (8, [inf, 1.0], 0), (9, [None, 1.0], 0), (9, [None, 1.0], 0), (10, [1.0, 0.0, 0.0], 0), (11, [1.0, 0.01], 0), (1, [0.0, 1.0], 0), (1, [1.0, 0.0], 0), (12, [-1.0, 0.0], 0), (13, [1e-30, 0.0], 0), (14, [3e38, 0.0], 0)]
    frame = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit("clash") for c in ("cls", "n", "k", "key", "band", "members", "component", "of")})
    assert result(embedding_dedup.near_vectors(frame)) == brute_near(rows)
    assert embedding_dedup.near_vectors(frame.where("vec_id > 99")).collect() == []


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_search(docs, items, top):
    low = lambda t: TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    tfs = [(d, Counter(low(t))) for d, t in docs]
    tfs = [(d, c) for d, c in tfs if c]
    total, number = sum(sum(c.values()) for _, c in tfs), len(tfs)
    df = Counter(t for _, c in tfs for t in c)
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= set(low(text))
    out = []
    for item, terms in asked.items():
        scores = []
        for d, c in tfs:
            m = 50 + (50 * sum(c.values()) * number) // total
            score = sum(math.floor(1000 * math.log((2 * number + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            scores += [(-score, d)] if score > 0 else []
        scores.sort(key=lambda x: (x[0], x[1] is None, x[1]))
        out += [(item, i + 1, d, -s) for i, (s, d) in enumerate(scores[:top])]
    return sorted(out, key=str)


def found(frame):
    return sorted((tuple(r) for r in frame.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.mark.parametrize("block_terms", [100_000, 25])
def test_ranked_search_equals_brute_force(spark, docs, plain, block_terms):
    rng = random.Random(9)
    words = [w for t in plain.values() for w in (t or "").split()]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12))) + " nowhere") for i in range(25)]
    items += [(100, None), (101, " .,! "), (102, "日本語, ÉÉ éé ß A line"), (103, items[0][1]), (7, "One more line of seven"), (None, "an item without id: line")]
    got = found(lexical_search.ranked_search(docs, spark.createDataFrame(items, "item_id long, text string"), 7, block_terms))
    want = brute_search(list(plain.items()), items, 7)
    assert got == want and len(want) > 100


def test_ranked_search_ties_and_odd_input(spark):
    docs = [(3, "Same words here"), (1, "same WORDS here"), (None, "same words here"), (1, "same words"), (9, None), (10, ""), (11, "-- !"), (12, "x1 y2 " * 20_000), (13, "other x1")]
    items = [(1, "words, same"), (2, "X1"), (3, "absent")]
    extra = {c: F.lit("clash") for c in ("term", "tf", "n", "row", "w", "s", "score", "rank", "item_no", "bucket")}
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns(extra)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumns(extra)
    assert found(lexical_search.ranked_search(frame, asked, 3)) == brute_search(docs, items, 3)
    for a, b in ((frame.limit(0), asked), (frame, asked.limit(0)), (frame.where("doc_id in (9, 10)"), asked)):
        assert lexical_search.ranked_search(a, b).collect() == []


def brute_rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in own.items()}
    head = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    return {c: own.get(c - math.copysign(abs(c) % 5, c), [])[: head[c]] + t[head[c] :] for c, t in own.items()}


def brute_trie(paths):
    members = defaultdict(list)
    for conv in sorted(paths):
        for d in range(len(paths[conv]) + 1):
            members[tuple(paths[conv][:d])].append(conv)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in m if len(paths[c]) == len(p))
        up = members[p[:-1]][0] if p else None
        out.append((m[0], len(p), up, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def nodes(frame):
    return sorted((tuple(r) for r in frame.select(*NAMES).collect()), key=str)


def talk(rng, convs, roots, depth):
    """Conversations that share heads, some ending inside others, some equal."""
    said = [[("user", f"root {i}")] for i in range(roots)]
    rows = []
    for conv in range(convs):
        path = list(rng.choice(said))
        path = path[: rng.randint(1, len(path))] + [(rng.choice(["user", "assistant"]), rng.choice(["yes", "no", "é" * rng.randint(1, 3)])) for _ in range(rng.randint(0, depth))]
        said.append(path)
        rows += [(conv, i * 2, role, text) for i, (role, text) in enumerate(path)]
    return rows


@pytest.mark.parametrize("limit", [20_000, 40, 1])
def test_trie_equals_brute_force(spark, limit):
    """Down to a limit at which every subtrie but chains is dealt again, turn by turn."""
    rows = talk(random.Random(limit), 120, 3, 6)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    paths = defaultdict(list)
    for conv, _, role, text in rows:
        paths[conv].append((role, text))
    assert nodes(prefix_trie.trie_nodes(frame, limit=limit)) == brute_trie(paths)


@pytest.mark.parametrize("limit", [20_000, 10])
def test_rebuilt_trie_equals_brute_force(spark, limit):
    rng = random.Random(77)
    rows = talk(rng, 150, 2, 12)
    rows = [r for r in rows if r[0] % 10 != 5] + [(-7, 1, "u", "x"), (-5, 1, None, None), (-5, None, "u", "first"), (3, 0, None, "again"), (3, 0, None, "again"), (None, 1, "u", "lost"), (2**40, None, None, None)]
    extra = {c: F.lit("clash") for c in ("pos", "cls", "len", "weight", "t1", "up", "deal", "kind", "base", "h")}
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns(extra)
    want = brute_trie(brute_rebuilt(rows))
    assert nodes(prefix_trie.trie_nodes(frame, rebuild=True, limit=limit)) == want
    assert any(r[3] > 1 and r[7] != hashlib.sha256(b"").hexdigest() for r in want)
    assert prefix_trie.trie_nodes(frame.limit(0), rebuild=True).collect() == []


def test_one_conversation_that_is_most_of_the_table(spark, monkeypatch):
    """A long conversation, held by two, is a chain whose totals are scanned in parts."""
    from tessera.operators import scans

    monkeypatch.setattr(scans.running_total, "__defaults__", (200,))
    monkeypatch.setattr(scans.numbered, "__defaults__", (200,))
    rows = [(c, i, "u", f"turn {i}") for c in (10, 11) for i in range(1500)] + [(20, 0, "u", "short")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = {(r.conv_id, r.depth): r for r in prefix_trie.trie_nodes(frame, limit=50).collect()}
    assert len(got) == 1502
    for d in (1, 2, 700, 1500):
        r = got[10, d]
        assert (r.n_convs, r.n_leaves, r.saved_tokens) == (2, 1, sum(len(f"turn {i}") for i in range(d - 1, 1500)))
    assert got[10, 0].n_leaves == 2 and got[10, 1500].ends_sha256 == hashlib.sha256(b"10,11").hexdigest()


def test_ids_are_hashed_over_pieces(spark):
    rows = [(c, 5, 3000) for c in range(5, 3005)] + [(c, 9000, 2) for c in (9000, 9900)] + [(7000, 7000, 1)]
    members = spark.createDataFrame(rows, "conv long, cls long, weight long").repartition(4)
    got = {r.cls: r.ends_sha256 for r in prefix_trie.joined_ids(members, piece=64, share=300).collect()}
    digest = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert got == {5: digest(range(5, 3005)), 9000: digest([9000, 9900]), 7000: digest([7000])}
