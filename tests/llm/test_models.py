"""Fingerprints, language ID, toxicity, decontamination and packing."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import decontamination, edit_embedding, language_id, packing, toxicity
from tessera.llm.queries import tokenizer_path
from tessera.llm.wordbpe import encoder


def test_edit_embedding_equals_direct_computation(docs, plain):
    names = sorted(plain)
    texts = [plain[d] or "" for d in names]
    edited = [t[: len(t) - len(t) // 2] + texts[(i + 1) % len(texts)][: len(t) // 2] for i, t in enumerate(texts)]
    own, moved = edit_embedding.embed_texts(texts), edit_embedding.embed_texts(edited)
    got = {r.doc_id: r for r in edit_embedding.neighbours(docs).collect()}
    assert sorted(got) == names
    for i, d in enumerate(names):
        r, following = got[d], own[(i + 1) % len(texts)]
        assert (r.n_chars, r.edited_sha256) == (len(texts[i]), hashlib.sha256(edited[i].encode()).hexdigest())
        assert r.fingerprint == edit_embedding.render(*own[i][:2]) and r.edited_fingerprint == edit_embedding.render(*moved[i][:2])
        assert r.near_edited == edit_embedding.likeness(own[i][:2], moved[i][:2])
        assert r.near_next == edit_embedding.likeness(own[i][:2], following[:2])


def test_walk_follows_the_shared_bits():
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdé 日") for _ in range(n)) for n in [0, 1, 7, 300, *rng.choices(range(900), k=60)]]
    table = edit_embedding._walk_table()
    for text, steps in zip(texts, edit_embedding.walk([edit_embedding.classes(t) for t in texts], [0] * len(texts))):
        here = 0
        for c, s in zip(edit_embedding.classes(text), steps):
            assert s == here
            here += int(table[c][here % edit_embedding.PERIOD])
        assert steps[-1] == here


def test_likeness_falls_with_edits():
    rng = random.Random(6)
    text = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    scores = []
    for edits in (0, 3, 60, 1500):
        changed = list(text)
        for _ in range(edits):
            at = rng.randrange(len(changed))
            changed[at : at + 1] = rng.choice([[], ["x"], ["x", changed[at]]])
        a, b = edit_embedding.embed_texts([text, "".join(changed)])
        scores.append(edit_embedding.likeness(a[:2], b[:2]))
    assert scores[0] == 1 and scores[0] >= scores[1] > scores[2] > scores[3] and scores[1] > 0.9
    assert edit_embedding.parse(edit_embedding.render(*a[:2]))[0] == a[0]


def test_edit_distance_within():
    def full(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rng = random.Random(8)
    for _ in range(300):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randint(0, 9))) for _ in range(2))
        for most in range(5):
            assert edit_embedding.edit_distance_within(a, b, most) == (full(a, b) <= most)


def test_edit_distance_of_long_texts():
    """Pairs of two million characters: unlike ones are told by their grams, like ones walked, in seconds."""
    import time

    rng = np.random.default_rng(9)
    text = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    one, other = text(2_000_000), text(2_000_000)
    near = list(one)
    for at in sorted(rng.integers(0, len(near), 2000).tolist(), reverse=True):
        near[at : at + 1] = [["x"], [], ["y", near[at]]][at % 3]
    near = "".join(near)
    start = time.time()
    assert not edit_embedding.edit_distance_within(one, other, 40_000)
    assert edit_embedding.edit_distance_within(one, near, 2000) and not edit_embedding.edit_distance_within(one, near, 1000)
    assert edit_embedding.edit_distance_within("a" * 300_000, "a" * 299_000, 1000) and not edit_embedding.edit_distance_within("a" * 3000, "b" + "a" * 2990, 9)
    assert time.time() - start < 60


def test_edit_distance_of_middling_texts():
    """Around the true distance, for texts on both sides of the gram filter."""
    def full(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rng = random.Random(28)
    for size in (40, 300, 2100):
        for _ in range(2):
            a = "".join(rng.choice("abcd é") for _ in range(size))
            b = list(a)
            for _ in range(rng.randint(0, 12)):
                at = rng.randrange(len(b))
                b[at : at + rng.randint(0, 2)] = rng.choice([[], ["x"], ["y", "z"]])
            b, true = "".join(b), full(a, "".join(b))
            for most in {0, true - 1, true, true + 3} - {-1}:
                assert edit_embedding.edit_distance_within(a, b, most) == (true <= most)


def test_near_documents_link_small_edits(spark):
    rng = random.Random(10)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(600)) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, t[:300] + "XY" + t[300:]) for i, t in enumerate(texts)] + [(200, texts[0])]
    got = {r.doc_id: r.component for r in edit_embedding.near_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i for i in range(12)} | {100 + i: i for i in range(12)} | {200: 0}


def slow_fingerprint(text):
    """The walk and its sampled bits written out step by step, from the shared random numbers alone."""
    moves = np.random.default_rng(20240229).integers(0, 2, (256, 4096), dtype=np.uint8)
    moves[:, -1] = 1
    shown = np.random.default_rng(77).integers(0, 2, (256, 64), dtype=np.uint8)
    mask = (1 << 64) - 1
    j, out = 0, []
    for c in text:
        k = (ord(c) ^ ((ord(c) >> 8) * 151 & 0xFFFFFFFF)) & 255
        while True:
            out.append(int(shown[k, j % 64]))
            j += 1
            if moves[k, (j - 1) % 4096]:
                break

    def priority(p):
        h = (p + 1) * 0x9E3779B97F4A7C15 & mask
        h = (h ^ h >> 29) * 0xBF58476D1CE4E5B9 & mask
        return h ^ h >> 32

    size = 512
    while size < j:
        size *= 2
    places = sorted(sorted(range(size), key=lambda p: (priority(p), p))[:512])
    bits = [out[p] if p < j else 0 for p in places]
    return f"{j:08x}" + bytes(sum(b << (7 - i) for i, b in enumerate(bits[a : a + 8])) for a in range(0, 512, 8)).hex()


def test_fingerprints_equal_a_walk_step_by_step(docs, plain):
    got = {r.doc_id: r.fingerprint for r in edit_embedding.fingerprints(docs).collect()}
    for d, t in plain.items():
        if len(t or "") < 5000:
            assert got[d] == slow_fingerprint(t or ""), d


def test_near_documents_recall_and_equal_texts(spark):
    """20,000 equal texts and 3,000 distinct short ones beside 200 pairs of one or two edits in 100 characters."""
    rng = random.Random(41)
    make = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    rows = [(i, "the same words in every row of this group, long enough for an edit or two") for i in range(20_000)]
    rows += [(30_000 + i, make(rng.randint(5, 45))) for i in range(3000)]
    pairs = []
    for i in range(200):
        body = make(rng.choice([150, 400, 1200]))
        other = list(body)
        for _ in range(len(body) // 100):
            at = rng.randrange(len(other))
            other[at : at + 1] = rng.choice([[], ["x"], ["y", other[at]]])
        rows += [(50_000 + 2 * i, body), (50_001 + 2 * i, "".join(other))]
        pairs.append((50_000 + 2 * i, 50_001 + 2 * i))
    got = {r.doc_id: r.component for r in edit_embedding.near_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert len(got) == len(rows) and {got[i] for i in range(20_000)} == {0}
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.95 * len(pairs)
    assert all(got[d] in (d, d - 1) for d in got if d >= 50_000)
    first: dict = {}
    for d, t in rows:
        first.setdefault(t, d)
    assert all(got[d] == first[t] for d, t in rows if 30_000 <= d < 50_000)


def test_near_documents_odd_input(odd, empty):
    assert edit_embedding.near_documents(empty).count() == 0
    rows = [(r.doc_id, r.text or "") for r in odd.collect()]
    got = edit_embedding.near_documents(odd).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(d) for d, _ in rows)
    links: dict = {}
    for d, t in rows:
        if d is not None:
            links.setdefault(t, set()).add(d)
    component = {}
    for r in got:
        assert component.setdefault(r.doc_id, r.component) == r.component and (r.component is None) == (r.doc_id is None)
    assert all(len({component[d] for d in held}) == 1 for held in links.values())
    assert all(component[d] <= d for d in component if d is not None)


def test_edit_embedding_odd_input(odd, docs, empty):
    """Every column by value: rows follow each other by (doc_id, text); rows without an id by text, then the first document."""
    assert edit_embedding.neighbours(empty).count() == 0
    rows = [(r.doc_id, r.text or "") for r in odd.select("doc_id", "text").collect()]
    named, lost = sorted(r for r in rows if r[0] is not None), sorted((r for r in rows if r[0] is None), key=lambda r: r[1])
    pairs = list(zip(named, [*named[1:], named[0]])) + list(zip(lost, [*lost[1:], named[0]]))
    edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for (_, t), (_, n) in pairs]
    own, after, moved = (edit_embedding.embed_texts(x) for x in ([p[0][1] for p in pairs], [p[1][1] for p in pairs], edited))
    want = Counter(
        (str(d), len(t), hashlib.sha256(e.encode()).hexdigest(), edit_embedding.render(*o[:2]), edit_embedding.render(*m[:2]), edit_embedding.likeness(o[:2], m[:2]), edit_embedding.likeness(o[:2], f[:2]))
        for ((d, t), _), e, o, f, m in zip(pairs, edited, own, after, moved)
    )
    got = Counter((str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in edit_embedding.neighbours(odd).collect())
    assert got == want


def test_language_id_on_held_out_rows(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.identify(frame).where("held_out and lang is not null")
    right = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.97


def grams(text):
    """Hashed n-grams of a text by definition: a set of places among 2^15."""
    mask, low, out = (1 << 32) - 1, text.lower(), set()
    for n in (1, 2, 3):
        for i in range(len(low) - n + 1):
            h = ord(low[i]) * 0x9E3779B1 & mask
            for k in range(1, n):
                h = ((h ^ h >> 15) * 0x85EBCA77 + ord(low[i + k]) * 0xC2B2AE3D) & mask
            h = (h ^ h >> 13) * (0x27D4EB2F + 2 * n) & mask
            out.add(h >> 17)
    return out


def dense_vector(text):
    """The mean of the normalised presence vectors of a text's windows."""
    size, low = language_id.WINDOW, text.lower()
    out = np.zeros(1 << 15)
    parts = [low[a : a + size + 2] for a in range(0, max(1, len(low) - 2), size)]
    for part in parts:
        own = np.array(sorted(grams(part)), int)
        if not len(own):
            continue
        out[own] += 1 / np.sqrt(len(own)) / len(parts)
    return out


def test_many_languages_share_the_landmarks(spark):
    """Each of 600 languages is learned and told apart by its letters, with no more landmarks than for few."""
    rng = random.Random(5)
    letters = [chr(0x4E00 + 30 * i) for i in range(600)]
    rows = [(6 * i + j, " ".join(x * rng.randint(1, 3) for _ in range(9)), f"l{i:03}") for i, x in enumerate(letters) for j in range(6)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = language_id.fit(frame, landmarks=40, most_rows=1200)
    taught = {r[2] for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1}
    assert model["land"].shape[1] == 40 and model["map"].shape == (40, len(taught)) and set(model["names"]) == taught
    out = language_id.predict(frame, model).collect()
    assert {r.lang_pred for r in out} <= taught and all(0 <= r.score <= 1 for r in out)


def test_language_id_equals_a_dense_kernel_ridge_regression(spark):
    """Kernel ridge regression with Nystroem features, written out with dense vectors and a normal equation."""
    rng = random.Random(23)
    alphabets = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "ijklmnop"}
    text = lambda a, n: " ".join("".join(rng.choice(a) for _ in range(rng.randint(2, 6))) for _ in range(n))
    rows = [(i, text(alphabets[x], rng.choice([1, 3, 20])), x) for i, x in enumerate(rng.choices(sorted(alphabets), k=120))]
    rows += [(500, text("abcdefgh", 9000), "aa"), (501, "", "aa"), (502, "1234", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    learn = [r for r in rows if r[2] and zlib.crc32(str(r[0]).encode()) % 3 != 1 and any(map(str.isalpha, r[1]))]
    model = language_id.fit(frame, landmarks=12)
    v = {r[0]: dense_vector(r[1]) for r in rows}
    land = np.array([x / np.linalg.norm(x) for x in model["land"].T])
    # The landmarks are training texts, four of each language.
    near = [max(learn, key=lambda r: v[r[0]] @ x / np.linalg.norm(v[r[0]])) for x in land]
    assert all(v[r[0]] @ x / np.linalg.norm(v[r[0]]) > 0.9999 for r, x in zip(near, land)) and sorted(r[2] for r in near) == ["aa"] * 4 + ["bb"] * 4 + ["cc"] * 4
    value, vector = np.linalg.eigh(land @ land.T)
    root = vector / np.sqrt(np.maximum(value, 1e-6)) @ vector.T
    phi = np.array([[*(land @ v[r[0]] @ root), 1.0] for r in learn])
    names = sorted(alphabets)
    y = np.array([[1.0 if r[2] == n else -1.0 for n in names] for r in learn])
    weight = np.array([1 / sum(q[2] == r[2] for q in learn) for r in learn])
    weight *= len(learn) / weight.sum()
    w = np.linalg.solve(phi.T @ np.diag(weight) @ phi + 1e-3 * len(learn) * np.eye(phi.shape[1]), phi.T @ np.diag(weight) @ y)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(frame, model).collect()}
    for d, t, _ in rows:
        if not any(map(str.isalpha, t)):
            assert got[d] == ("und", 0.0)
            continue
        margin = np.array([*(land @ v[d] @ root), 1.0]) @ w
        p = np.exp(4 * (margin - margin.max()))
        p /= p.sum()
        assert abs(got[d][1] - p.max()) < 1e-3 and (got[d][0] == names[int(p.argmax())] or np.sort(p)[-2] > p.max() - 1e-3)


def test_language_id_learns_every_language(spark):
    rng = random.Random(29)
    rows = []
    for k in range(70):
        letters = [chr(0x4E00 + 40 * k + j) for j in range(40)]
        rows += [(k * 20 + i, "".join(rng.choice(letters) for _ in range(60)), f"l{k:02d}") for i in range(20)]
    out = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    truth = {r[0]: r[2] for r in rows}
    assert len({r.lang_pred for r in out}) == 70
    assert sum(r.lang_pred == truth[r.doc_id] for r in out if r.held_out) > 0.97 * sum(r.held_out for r in out)


def test_language_id_tells_very_long_texts_apart(spark):
    rng = random.Random(31)
    words = {x: ["".join(rng.choice(a) for _ in range(rng.randint(2, 7))) for _ in range(4000)] for x, a in (("aa", "abcdefghijklmnopqr"), ("bb", "cdefghijklmnopqrst"))}
    rows = [(i, " ".join(rng.choices(words[x], k=30)), x) for i, x in enumerate(rng.choices(["aa", "bb"], k=200))]
    rows += [(1000 + i, " ".join(rng.choices(words[x], k=100_000)), x) for i, x in enumerate(["aa", "bb"])]
    got = {r.doc_id: r.lang_pred for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert (got[1000], got[1001]) == ("aa", "bb")


def test_language_id_odd_input(odd, empty, docs):
    assert language_id.identify(empty).count() == 0
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs).collect()}
    assert got[500] == ("und", 0.0) and got[501] == ("und", 0.0) and got[502] == ("und", 0.0)
    assert {v[0] for v in got.values()} <= {"und", "en", "fr"} and all(0 <= v[1] <= 1 for v in got.values())
    out = language_id.identify(odd)
    # Repeated rows change neither the sample nor the scores; operator columns replace the clashing ones.
    assert all(r.lang_pred == got[r.doc_id][0] and abs(r.score - got[r.doc_id][1]) < 1e-4 for r in out.where("doc_id is not null").collect())
    assert out.count() == odd.count() and out.where("doc_id is null and (held_out or lang_pred is null)").count() == 0


def toxic_rows(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    rows, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.3
        words = [word() for _ in range(rng.randint(5, 60))]
        if bad:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "moron", "scum", "xqz" + word(), "xqz" + word()]))
        rows.append((i, " ".join(words)))
        if i % 2 == 0:
            labels.append((i, int(bad)))
    return rows, labels


def test_toxicity_learns_lexicon_and_patterns(spark):
    rows, labels = toxic_rows(1200, 3)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    out = toxicity.toxicity(frame, spark.createDataFrame(labels, "doc_id long, toxic int")).where("held_out")
    truth = dict(labels)
    got = [(truth[r.doc_id], r.predicted) for r in out.collect() if r.doc_id in truth]
    assert sum(a == b for a, b in got) / len(got) > 0.95
    assert sum(b for a, b in got if not a) <= 1


def test_toxicity_never_reads_held_out_labels(spark):
    rows, labels = toxic_rows(300, 5)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    flipped = [(d, 1 - y if zlib.crc32(str(d).encode()) % 5 == 0 else y) for d, y in labels]
    a, b = (toxicity.fit(frame, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, flipped))
    assert a == b


def test_toxicity_odd_input(odd, docs, empty, spark):
    labels = spark.createDataFrame([(0, 0), (3, None)], "doc_id long, toxic int")
    assert toxicity.toxicity(empty, labels).count() == 0
    out = toxicity.toxicity(odd, labels)
    assert out.count() == odd.count() and out.where("score is null or score < 0 or score > 1").count() == 0
    want = {r.doc_id: (round(r.score, 9), r.predicted) for r in toxicity.toxicity(docs, labels).collect()}
    assert {r.doc_id: (round(r.score, 9), r.predicted) for r in out.where("doc_id is not null").collect()} == want
    # Without labels the lexicon decides.
    rows = spark.createDataFrame([(1, "what an idiot"), (2, "a fine day"), (3, None), (4, "")], "doc_id long, text string")
    assert {r.doc_id: r.predicted for r in toxicity.toxicity(rows, labels.where("toxic > 5")).collect()} == {1: 1, 2: 0, 3: 0, 4: 0}


def test_label_model_finds_poor_voters():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 2000)
    good = np.where(rng.random(2000) < 0.9, 2 * y - 1, 1 - 2 * y)
    noise = rng.choice([-1, 1], 2000)
    vote = np.stack([good, noise, noise, noise, np.where(rng.random(2000) < 0.85, 2 * y - 1, 1 - 2 * y)], axis=1).astype(np.int8)
    gold = np.where(np.arange(2000) < 200, y, -1)
    posterior = toxicity.label_model(vote, np.full(2000, 0.5), gold)
    assert ((posterior > 0.5) == y)[200:].mean() > 0.85


def test_label_model_learns_from_votes_without_gold():
    """Three fair voters and two copies of a poor one: accuracies and the copy are found from unlabelled votes."""
    rng = np.random.default_rng(4)
    y = (rng.random(4000) < 0.4).astype(int)
    cast = lambda right: np.where(rng.random(4000) < right, 2 * y - 1, 1 - 2 * y)
    poor = cast(0.6)
    vote = np.stack([cast(0.85), cast(0.8), cast(0.9), poor, np.where(rng.random(4000) < 0.97, poor, -poor)], axis=1).astype(np.int8)
    none = np.full(4000, -1)
    posterior = toxicity.label_model(vote, np.full(4000, 0.4), none)
    assert ((posterior > 0.5) == y).mean() > 0.92
    # A few wrong gold labels name no posterior: rows are judged by their votes.
    gold = none.copy()
    gold[:100] = y[:100]
    gold[:5] = 1 - y[:5]
    again = toxicity.label_model(vote, np.full(4000, 0.4), gold)
    assert ((again > 0.5) == (posterior > 0.5)).mean() > 0.97
    sure = [i for i in range(5) if len(set(vote[i, :3])) == 1]
    assert all((again[i] > 0.5) != (gold[i] == 1) for i in sure if (vote[i, 0] > 0) == (y[i] == 1))


def test_posteriors_equal_enumeration():
    """The forest model's posterior against sums over both labels of the joint probability, table by table."""
    rng = np.random.default_rng(6)
    vote = rng.choice([-1, 0, 1], (50, 5))
    parent = [-1, 0, 1, 1, -1]
    tables = toxicity.vote_tables(vote, parent, rng.random(50))
    assert np.allclose(np.exp(tables).sum(axis=3), 1)
    prior = rng.uniform(0.1, 0.9, 50)
    got = toxicity.posteriors(vote, parent, tables, prior)
    for row, p, g in zip(vote, prior, got):
        joint = [1 - p, p]
        for label in (0, 1):
            for j, x in enumerate(row):
                above = row[parent[j]] if parent[j] >= 0 else 0
                joint[label] *= float(np.exp(tables[j, label, above + 1, x + 1]))
        assert abs(g - joint[1] / sum(joint)) < 1e-9


def test_forest_takes_the_strongest_correlations():
    rng = np.random.default_rng(8)
    y = rng.random(5000) < 0.5
    a, b = rng.choice([-1, 0, 1], 5000), rng.choice([-1, 1], 5000)
    vote = np.stack([a, np.where(rng.random(5000) < 0.9, a, 0), b, np.where(rng.random(5000) < 0.8, b, -b), np.where(y, 1, -1)], axis=1)
    onehot = np.stack([vote == v for v in (-1, 0, 1)], axis=2).astype(np.float32)
    strength = toxicity.correlations(onehot, y.astype(float))
    # Mutual information by definition, one pair.
    want = 0.0
    for label in (False, True):
        own = vote[y == label]
        for u in (-1, 0, 1):
            for v in (-1, 0, 1):
                p = ((own[:, 0] == u) & (own[:, 1] == v)).mean()
                if p:
                    want += (y == label).mean() * p * np.log(p / (own[:, 0] == u).mean() / (own[:, 1] == v).mean())
    assert abs(strength[0, 1] - want) < 1e-3
    parent = toxicity.strongest_forest(strength, 15 / 5000)
    assert {frozenset((i, p)) for i, p in enumerate(parent) if p >= 0} == {frozenset((0, 1)), frozenset((2, 3))}


def brute_hits(texts, items, threshold=0.8):
    """All windows of each item's size, weighted shingle similarity, by definition."""
    import math
    from collections import Counter

    words = lambda t: decontamination.WORD.findall((t or "").lower())
    grams = lambda w, k: Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    item_words = {i: words(t) for i, t in items.items() if words(t)}
    k_of = {i: min(5, len(w)) for i, w in item_words.items()}
    held = Counter(g for i, w in item_words.items() for g in set(grams(w, k_of[i])))
    weight = lambda g: 1 + math.log(1 + len(item_words) / held[g]) if g in held else 1 + math.log(1 + len(item_words))
    out = set()
    for d, t in texts.items():
        w = words(t)
        for i, own in item_words.items():
            a = grams(own, k_of[i])
            for s in range(max(1, len(w) - len(own) + 1)):
                b = grams(w[s : s + len(own)], k_of[i])
                both = sum(weight(g) * min(c, b[g]) for g, c in a.items())
                total = sum(weight(g) * c for g, c in a.items()) + sum(weight(g) * c for g, c in b.items()) - both
                if b and both >= threshold * total - 1e-9:
                    out.add((d, i))
                    break
    return out


def test_decontamination_equals_brute_force(spark, docs, plain):
    rng = random.Random(12)
    items, texts = {}, dict(plain)
    for i in range(12):
        body = " ".join("".join(rng.choice("qrstuv") for _ in range(5)) for _ in range(rng.choice([3, 5, 30, 60])))
        items[i] = body
        words = body.split()
        if len(words) > 40:
            words[1] = "different"
        texts[1000 + i] = f"{(plain[3] or '')[:200]} {' '.join(words)}! {(plain[6] or '')[:100]}"
    items |= {50: None, 51: "", 52: "..."}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    want = brute_hits(texts, items)
    for block in (20_000, 4):
        got = decontamination.find_hits(frame, bench, block_items=block).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    assert len(want) >= 12
    left = {r.doc_id for r in decontamination.decontaminate(frame, bench).collect()}
    assert left == set(texts) - {d for d, _ in want}


def test_multi_index_finds_all_within_radius_and_little_else():
    rng = random.Random(2)
    bits = decontamination.BITS
    for radius, blocks in ((3, 4), (26, 9), (20, 11)):
        items = [rng.getrandbits(bits) for _ in range(2000)]
        index = decontamination.MultiIndex(items, radius, blocks)
        passed = 0
        for _ in range(60):
            at = rng.randrange(len(items))
            b = items[at]
            for bit in rng.sample(range(bits), radius):
                b ^= 1 << bit
            assert at in index.within(b)
            assert sorted(index.within(b)) == [i for i, x in enumerate(items) if (x ^ b).bit_count() <= radius]
            passed += len(index.near(rng.getrandbits(bits)))
        assert passed / (60 * len(items)) < 0.1


def test_rolled_fingerprints_are_those_of_each_window():
    rng = np.random.default_rng(5)
    h = rng.integers(0, 2**63, 5000, dtype=np.uint64)
    starts = np.array([0, 1, 2, 900, 901, 2500, 4960])
    got = decontamination.window_fingerprints(h, 40, starts)
    assert got == [decontamination.simhash(h[s : s + 40]) for s in starts]
    for s, f in zip(starts, got):
        total = decontamination.signs(h[s : s + 40]).sum(axis=0)
        assert [f >> j & 1 for j in range(decontamination.BITS)] == [int(x > 0) for x in total]


def test_simhash_candidates_recall_windows_of_similarity_from_the_threshold(spark):
    """1,500 items, each planted once with edits that leave a similarity of 0.8 to 0.92: recall against brute force."""
    rng = random.Random(77)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    items, texts, pairs = {}, {}, []
    for i in range(1500):
        words = [word() for _ in range(rng.choice([60, 70, 80]))]
        items[i] = " ".join(words)
        changed = list(words)
        # One changed word in the middle spoils five shingles, one at the end only one.
        changed[rng.choice([0, -1, 30])] = word()
        if rng.random() < 0.5:
            changed[-2] = word()
        own = {tuple(words[j : j + 5]) for j in range(len(words) - 4)}
        new = {tuple(changed[j : j + 5]) for j in range(len(words) - 4)}
        if len(own & new) >= 0.8 * len(own | new) + 0.01:
            pairs.append((i, i))
        texts[i] = " ".join([word() for _ in range(20)] + changed + [word() for _ in range(20)])
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    found = {(r.doc_id, r.item_id) for r in decontamination.find_hits(frame, spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()}
    assert len(pairs) > 1000 and len(set(pairs) & found) >= 0.95 * len(pairs)


def test_decontamination_does_not_depend_on_the_blocks(spark):
    """400 items that share a beginning, against 400 edited documents: the same hits however items are divided."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    head = [word() for _ in range(12)]
    items, texts = {}, {}
    for i in range(400):
        words = head + [word() for _ in range(28)]
        items[i] = " ".join(words)
        for _ in range(rng.choice([1, 1, 2])):
            words[rng.choice([0, 3, 11, 20, 38, 39])] = word()
        texts[i] = " ".join(words)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    want = brute_hits({d: texts[d] for d in range(0, 400, 4)}, items)
    results = []
    for block in (20_000, 100):
        rows = decontamination.find_hits(frame, bench, block_items=block).collect()
        results.append({(r.doc_id, r.item_id): (r.start, r.n_words, round(r.similarity, 9), r.distance) for r in rows})
        found = {x for x in results[-1] if x[0] % 4 == 0}
        assert found <= want and len(found) >= 0.9 * len(want)
    assert results[0] == results[1] and len(results[0]) > 100


def test_decontamination_judges_rows_without_an_id_or_of_one_id_apart(spark):
    leak = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(None, leak), (None, "clean words only here"), (3, "clean too and more of it"), (4, leak), (4, "clean of id four"), (5, None), (6, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_leak": F.lit("clash"), "item_id": F.lit("clash")})
    bench = spark.createDataFrame([(1, leak), (None, "clean words only here"), (1, leak)], "item_id long, text string")
    left = decontamination.decontaminate(frame, bench)
    assert left.columns == frame.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in left.collect()))) == sorted(map(str, (rows[i] for i in (1, 2, 4, 5, 6))))


def test_decontamination_of_documents_shorter_than_the_items(spark):
    long = [f"w{i}" for i in range(33)]
    other = long[:5] + [f"v{i}" for i in range(26)]
    text = " ".join(long[:30])
    bench = spark.createDataFrame([(1, " ".join(other)), (2, " ".join(long))], "item_id long, text string")
    found = decontamination.find_hits(spark.createDataFrame([(7, text), (8, text)], "doc_id long, text string"), bench).collect()
    assert {(r.doc_id, r.item_id, r.start, r.n_words) for r in found} == {(7, 2, 0, 33), (8, 2, 0, 33)}


def test_decontamination_odd_input(odd, empty, spark):
    bench = spark.createDataFrame([(1, "A line that many documents share, word for word.")], "item_id long, text string")
    assert decontamination.find_hits(empty, bench).count() == 0
    assert decontamination.find_hits(odd, bench.where("item_id < 0")).count() == 0
    items = {1: "A line that many documents share, word for word."}
    rows = odd.select("doc_id", "text").collect()
    want = {rows[i].doc_id for i, _ in brute_hits({i: r.text for i, r in enumerate(rows)}, items)}
    assert {r.doc_id for r in decontamination.find_hits(odd, bench).collect()} == want and len(want) > 5
    assert decontamination.decontaminate(odd, bench).count() == sum(r.doc_id not in want for r in rows)


def test_word_bpe_equals_the_tokenizer(plain):
    exact, fast = Tokenizer.from_file(tokenizer_path()), encoder(tokenizer_path())
    texts = [t or "" for t in plain.values()]
    texts += ["a<|endoftext|>b It's THE I'LL x_y 12ab ½ ﬁ İ é ́x 日本 ÀÉ ß ſ a\x1cb\xa0c d ''' 's'tre", "ªº µ ×÷ _a_ --==", "é" * 200, "don't 'tis rock'n'roll '''re"]
    for t in texts:
        assert fast(t) == np.array(exact.encode(t, add_special_tokens=False).ids, "<u2").tobytes(), t[:80]


def test_packing_is_an_exact_round_trip(docs, plain):
    exact = Tokenizer.from_file(tokenizer_path())
    want = {d: [*exact.encode(t or "", add_special_tokens=False).ids, 1] for d, t in plain.items()}
    for length, groups in ((2048, 1_000_000), (64, 500)):
        rows = packing.pack(docs, tokenizer_path(), length=length, group_tokens=groups).collect()
        made = {d: [] for d in want}
        room: dict = {}
        for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
            ids = np.frombuffer(bytes(r.ids), "<u4")
            assert r.start == len(made[r.doc_id]) and r.length == len(ids) > 0 and r.doc_tokens == len(want[r.doc_id])
            assert r.ids_crc32 == zlib.crc32(np.array(want[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
            made[r.doc_id] += ids.tolist()
            room.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert made == want
        padding: dict = {}
        for sequence, parts in room.items():
            end = 0
            for offset, n in sorted(parts):
                assert offset == end
                end += n
            assert end <= length
            padding[sequence >> 32] = padding.get(sequence >> 32, 0) + length - end
        # A group leaves less than one sequence of padding in all.
        assert all(p < length for p in padding.values())


def test_packing_balances_cost():
    rng = random.Random(1)
    lengths = [rng.choice([30, 60, 500, 1500]) for _ in range(400)]
    pieces = packing.pack_lengths(lengths, 2048, 2048.0)
    cost: dict = {}
    for _, _, n, s in pieces:
        cost[s] = cost.get(s, 0) + packing.cost(n, 2048.0)
    assert max(cost.values()) < 2 * sum(cost.values()) / len(cost)


def packed_texts(frame, **options):
    """The token ids of every packed row, put together again, by doc_id; checks that pieces do not overlap."""
    rows = packing.pack(frame, tokenizer_path(), **options).collect()
    pieces, places = {}, set()
    for r in rows:
        assert (r.sequence_id, r.offset) not in places and r.ids_crc32 == zlib.crc32(r.ids)
        places.add((r.sequence_id, r.offset))
        pieces.setdefault(str(r.doc_id), []).append((r.start, r.length, r.doc_tokens, r.ids))
    return rows, pieces


def test_packing_odd_input(odd, empty):
    """Each row's ids come out once: rows that repeat an id, rows without one, empty and very long texts."""
    assert packing.pack(empty, tokenizer_path()).count() == 0
    run = Tokenizer.from_file(tokenizer_path())
    want = {}
    for r in odd.select("doc_id", "text").collect():
        ids = np.array([*run.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        want.setdefault(str(r.doc_id), Counter())[ids] += 1
    _, pieces = packed_texts(odd)
    assert pieces.keys() == want.keys()
    for doc, own in pieces.items():
        # Pieces of equal rows are interchangeable: as many of each as there are rows of the text.
        left = Counter(own)
        for ids, n in want[doc].items():
            if sum(want[doc].values()) == n:  # one text for this id
                size = len(ids) // 4
                assert all(t == size and ids[4 * s : 4 * (s + k)] == part for s, k, t, part in own)
                covered = Counter(i for s, k, _, _ in own for i in range(s, s + k))
                assert covered == Counter({i: n for i in range(size)})
        assert sum(k for _, k, _, _ in left.elements()) == sum(len(i) // 4 * n for i, n in want[doc].items())


def test_rows_without_an_id_are_dealt_to_all_groups(spark):
    frame = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("same words for every row "), (F.col("id") % 3).cast("string")).alias("text")).repartition(4)
    rows, pieces = packed_texts(frame, group_tokens=10_000)
    groups = {r.sequence_id >> 32 for r in rows}
    n = sum(r.length for r in rows)
    assert sum(r.start == 0 for r in rows) == 20_000 and len(groups) > 10
    held = Counter(r.sequence_id >> 32 for r in rows)
    assert max(held.values()) < 2 * len(rows) / len(groups)
    assert n == sum(r.doc_tokens for r in rows if r.start == 0)


@pytest.mark.parametrize("n", [0, 1, 2047, 2048, 2049, 10_000])
def test_single_document_lengths(n):
    pieces = packing.pack_lengths([n], 2048, 2048.0)
    assert sum(p[2] for p in pieces) == n and all(0 < p[2] <= 2048 for p in pieces)


def test_near_documents_unlike_texts_make_no_rows(spark, monkeypatch):
    """Unlike texts of like lengths share no buckets by chance, and crowded buckets give out only pairs that may be near."""
    rng = random.Random(77)
    make = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    rows = [(i, make(rng.randint(1000, 1019))) for i in range(3000)]
    cells = [c for i in rows for c in set(cells_of(i[1]))]
    assert len(cells) - len(set(cells)) < 300  # bands of 16 sampled bits met 21,799 times here
    # Near copies of one text that are too far from one another to link, but for a few pairs.
    monkeypatch.setattr(edit_embedding, "PIECE", 50)
    base, rows = make(800), []
    for i in range(300):
        words = list(base)
        for _ in range(40):
            words[rng.randrange(800)] = rng.choice("ABCDEFGH")
        rows.append((2 * i, "".join(words)))
        if i % 10 == 0:
            rows.append((2 * i + 1, "".join(words[:400] + ["x"] + words[400:])))
    asked = []
    verify = edit_embedding.verified
    monkeypatch.setattr(edit_embedding, "verified", lambda texts, pairs, distance: asked.append(pairs.count()) or verify(texts, pairs, distance))
    got = {r.doc_id: r.component for r in edit_embedding.near_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: d - d % 2 for d, _ in rows}
    assert sum(asked) < 1000, asked


def cells_of(text):
    end, _, own, steps = edit_embedding.embed_texts([text])[0]
    return edit_embedding.bands_of(end, own, steps, 32, 0.02)


def test_sketches_never_rule_out_near_texts():
    rng = random.Random(78)
    for size in (60, 400, 3000):
        a = "".join(rng.choice("abc é日") for _ in range(size))
        for edits in (1, size // 50):
            b = list(a)
            for _ in range(edits):
                at = rng.randrange(len(b))
                b[at : at + 1] = rng.choice([[], ["x"], ["y", b[at]]])
            x, y = (edit_embedding.sketched(pa.array([edit_embedding.sketch(t)], pa.binary())) for t in (a, "".join(b)))
            assert edit_embedding.sketches_allow(x, y, np.array([edits])).all()
            assert set(edit_embedding.length_groups(size, 0.02)) & set(edit_embedding.length_groups(len(b), 0.02))
