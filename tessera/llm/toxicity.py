"""Toxicity by weak supervision.

Many voters look at a text: lexicon words, words and stems found in the labelled rows, and marks of style. A generative
label model explains their votes on a sample of rows with and without labels. Given the hidden label, each voter's vote
depends on one other voter at most (a forest of the strongest correlations that the label leaves unexplained), so the
model has a table of accuracies and correlations for each voter. Expectation maximisation fits them to the votes of all
sampled rows. Gold labels are no votes: they suggest word patterns, give the share of label 1 and the tables that the
fit starts from, and so say which class is which; no posterior is held to its gold label. A linear
classifier over words and stems is then trained on the posterior labels and scores every whole text.

Bounds: `per_label` labelled rows of each label and `unlabelled` further rows outside the held-out fold are learned
from (one row of a doc_id: the least text), and `most` features and `most_patterns` patterns are used. Their texts stay
in the tasks; the driver gets votes and positions of chosen features only. Defined results: null and empty texts score
the classifier's intercept; without any labelled document the lexicon alone decides; rows that repeat a doc_id are scored
one by one; operator columns replace input columns of the same name.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, prepare, stage, unstage, without
from .sampling import bounded_sample, fold, sampled_rows

#: Everyday English insults that voters start from.
LEXICON = (
    "idiot idiots moron morons stupid loser losers pathetic worthless scum trash clown disgusting "
    "dumb garbage jerk fool imbecile filthy vermin"
).split()
WORD = re.compile(r"\w+")
STEMS = (4, 5)


def features(text: str) -> set[str]:
    """Distinct words and word stems (marked with *) of a text."""
    words = set(WORD.findall(text.lower()))
    out = set(words)
    for n in STEMS:
        out.update(w[:n] + "*" for w in words if len(w) > n)
    return out


def style(text: str) -> tuple[bool, bool]:
    """Whether a text shouts with marks, and with capitals."""
    letters = sum(map(str.isalpha, text))
    return "!!" in text, letters > 20 and sum(map(str.isupper, text)) > 0.5 * letters


def learning_rows(docs: DataFrame, sample: list[tuple]) -> DataFrame:
    """(row, label, feats, marks, caps) of the sampled documents, staged; label -1: not to be looked at."""

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        styles = [style(t) for t in texts]
        return {
            "feats": pa.array([sorted(features(t)) for t in texts], pa.list_(pa.string())),
            "marks": pa.array([x[0] for x in styles], pa.bool_()),
            "caps": pa.array([x[1] for x in styles], pa.bool_()),
        }

    outputs = T.StructType([T.StructField("feats", T.ArrayType(T.StringType())), T.StructField("marks", T.BooleanType()), T.StructField("caps", T.BooleanType())])
    rows = sampled_rows(docs, sample).select(F.col("_stratum").alias("label"), "text")
    made = arrow_map(rows.select("label", "text"), run, outputs, keep=["label"])
    return stage(made.withColumn("row", F.monotonically_increasing_id()), "toxic-rows")


def induced_patterns(rows: DataFrame, n: dict[int, int], most_patterns: int, support: int = 4) -> list[str]:
    """Words and stems that labelled rows of label 1 hold far more often than those of label 0."""
    held = rows.where("label >= 0").select("label", F.explode("feats").alias("f"))
    counts = held.groupBy("f").agg(F.sum(F.col("label")).alias("bad"), F.sum(1 - F.col("label")).alias("good")).where(F.col("bad") >= support)
    odds = F.log((F.col("bad") + 0.5) / (n.get(1, 0) + 1.0)) - F.log((F.col("good") + 0.5) / (n.get(0, 0) + 1.0))
    ranked = counts.withColumn("odds", odds).where("odds > 2").orderBy(F.desc(F.col("odds") * F.sqrt("bad")), "f")
    return [r["f"] for r in ranked.limit(most_patterns).collect()]


def held_positions(rows: DataFrame, names: list[str]) -> DataFrame:
    """(row, label, marks, caps, at): positions among `names` of the features that a row has."""
    place = {f: i for i, f in enumerate(names)}

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        lists = batch.column(4).to_pylist()
        return {"at": pa.array([sorted(place[f] for f in x if f in place) for x in lists], pa.list_(pa.int32()))}

    kept = ["row", "label", "marks", "caps"]
    return arrow_map(rows.select(*kept, "feats", F.lit("").alias("text")), run, T.StructType([T.StructField("at", T.ArrayType(T.IntegerType()))]), keep=kept)


def matrix(lists: list[list[int]], width: int, kind: type = np.float32) -> np.ndarray:
    out = np.zeros((len(lists), width), kind)
    for i, at in enumerate(lists):
        out[i, at] = 1
    return out


def votes(held: np.ndarray, marks: list[bool], caps: list[bool]) -> np.ndarray:
    """Rows of votes: 1 toxic, -1 clean, 0 abstains. The last voter calls a row clean that holds no word of the others."""
    return np.concatenate([held, np.array([marks, caps, -1 * ~held.any(axis=1)], np.int8).reshape(3, -1).T], axis=1).astype(np.int8)


def correlations(onehot: np.ndarray, posterior: np.ndarray) -> np.ndarray:
    """Mutual information of each pair of voters given the label."""
    n, m, _ = onehot.shape
    flat = onehot.reshape(n, m * 3)
    out = np.zeros((m, m))
    for weight in (posterior, 1 - posterior):
        total = max(float(weight.sum()), 1e-9)  # of n rows
        joint = ((flat * weight[:, None]).T @ flat / total).reshape(m, 3, m, 3).transpose(0, 2, 1, 3)
        single = (flat * weight[:, None]).sum(axis=0).reshape(m, 3) / total
        apart = single[:, None, :, None] * single[None, :, None, :]
        ratio = np.log(np.maximum(joint, 1e-12)) - np.log(np.maximum(apart, 1e-12))
        out += total / n * np.where(joint > 0, joint * ratio, 0).sum(axis=(2, 3))
    np.fill_diagonal(out, 0)
    return out


def strongest_forest(strength: np.ndarray, least: float) -> list[int]:
    """The parent of each voter (-1: none) in the maximum spanning forest of correlations over `least`."""
    m = len(strength)
    parent, reach, done = [-1] * m, np.zeros(m), np.zeros(m, bool)
    nearest = np.full(m, -1)
    for _ in range(m):
        i = int(np.where(done, -1.0, reach).argmax())
        done[i] = True
        parent[i] = int(nearest[i])
        better = ~done & (strength[i] > np.maximum(reach, least))
        reach[better], nearest[better] = strength[i][better], i
    return parent


def vote_tables(vote: np.ndarray, parent: list[int], posterior: np.ndarray) -> np.ndarray:
    """log P(vote of j | label, vote of j's parent) as [voter, label, parent's vote, vote]."""
    n, m = vote.shape
    out = np.zeros((m, 2, 3, 3))
    for j in range(m):
        state = (vote[:, parent[j]] + 1 if parent[j] >= 0 else np.ones(n, np.int64)) * 3 + vote[:, j] + 1
        for label, weight in enumerate((1 - posterior, posterior)):
            out[j, label] = np.bincount(state, weight, 9).reshape(3, 3)
    # Few rows say little: a table leans to what the voter does on all rows, and a vote for a label to that label.
    usual = np.stack([(vote == v).mean(axis=0) for v in (-1, 0, 1)], axis=1)
    out += usual[:, None, None, :] + np.array([[0.05, 0.1, 0.01], [0.01, 0.1, 0.05]])[None, :, None, :]
    return np.log(out / out.sum(axis=3, keepdims=True))


def posteriors(vote: np.ndarray, parent: list[int], tables: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """P(label 1 | votes) of each row."""
    logit = np.log(prior) - np.log(1 - prior)
    for j in range(vote.shape[1]):
        above = vote[:, parent[j]] + 1 if parent[j] >= 0 else np.ones(len(vote), np.int64)
        logit = logit + tables[j, 1, above, vote[:, j] + 1] - tables[j, 0, above, vote[:, j] + 1]
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def label_model(vote: np.ndarray, prior: np.ndarray, gold: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Posterior of label 1 for each row, from its votes. Tables and correlations start from the rows of known gold
    (1, 0, or -1) if there are 20, else from the balance of votes, and are then fitted to all rows."""
    vote = vote.astype(np.int64)
    known = gold >= 0
    if known.sum() >= 20:
        used, posterior = known, (gold[known] == 1).astype(float)
    else:
        balance = (vote > 0).sum(axis=1) - (vote < 0).sum(axis=1)
        used, posterior = np.ones(len(vote), bool), np.where(balance > 0, 0.9, np.where(balance < 0, 0.05, prior))
    for step in range(rounds):
        if step < 2:
            # 2 n times the information is near chi-squared, with few degrees of freedom, where there is no correlation.
            onehot = np.stack([vote[used] == v for v in (-1, 0, 1)], axis=2).astype(np.float32)
            parent = strongest_forest(correlations(onehot, posterior), 15.0 / max(len(posterior), 1))
        posterior = posteriors(vote, parent, vote_tables(vote[used], parent, posterior), prior)
        used = np.ones(len(vote), bool)
    return posterior


def linear_classifier(x: np.ndarray, y: np.ndarray, row_weight: np.ndarray, l2: float = 1e-4, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by accelerated gradient descent."""
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    v, vb = w.copy(), b
    row = (row_weight / max(row_weight.sum(), 1e-9)).astype(np.float32)
    rate = 4.0 / (1 + float((row[:, None] * x * x).sum(axis=0).max()) * min(x.shape[1], 8))
    for k in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ v + vb, -30, 30)))
        g = row * (p - y)
        new, nb = v - rate * (x.T @ g + l2 * v), vb - rate * float(g.sum())
        v, vb = new + (new - w) * (k / (k + 3)), nb + (nb - b) * (k / (k + 3))
        w, b = new.astype(np.float32), nb
    return w, b


def train(rows: DataFrame, n: dict[int, int], prior: float, most: int, most_patterns: int) -> tuple[dict[str, float], float]:
    """(weight of each feature, intercept), at the label's true share `prior`."""
    spark = rows.sparkSession
    prior = min(max(prior, 1e-4), 1 - 1e-4)
    share = min(max(n.get(1, 0) / max(1, n.get(0, 0) + n.get(1, 0)), 1e-3), 1 - 1e-3)
    patterns = induced_patterns(rows, n, most_patterns)
    voters = [*LEXICON, *[p for p in patterns if p not in LEXICON]]
    seen = sorted(held_positions(rows, voters).select("row", "label", "marks", "caps", "at").collect())
    gold = np.array([r["label"] for r in seen], np.int64)
    vote = votes(matrix([r["at"] for r in seen], len(voters), np.int8), [r["marks"] for r in seen], [r["caps"] for r in seen])
    # Labelled rows are drawn by label, the others as they come.
    posterior = label_model(vote, np.where(gold >= 0, share, prior), gold)

    # Features by how far their posterior-weighted shares differ.
    known = spark.createDataFrame([(r["row"], float(p)) for r, p in zip(seen, posterior)], "row long, p double")
    bad, good = max(float(posterior.sum()), 1.0), max(float((1 - posterior).sum()), 1.0)
    held = rows.join(F.broadcast(known), "row").select("p", F.explode("feats").alias("f"))
    counts = held.groupBy("f").agg(F.sum("p").alias("bad"), F.sum(1 - F.col("p")).alias("good"), F.count(F.lit(1)).alias("k")).where("k >= 3")
    gap = F.abs(F.col("bad") / bad - F.col("good") / good) / F.sqrt((F.col("k") + 5) / float(len(seen)))
    names = [r["f"] for r in counts.orderBy(F.desc(F.round(gap, 9)), "f").limit(most).collect()]
    names += [w for w in LEXICON if w not in set(names)]
    x = matrix([r["at"] for r in sorted(held_positions(rows, names).select("row", "at").collect())], len(names))
    # Each row counts as often as its label is among all documents.
    w, b = linear_classifier(x, posterior.astype(np.float32), np.ones(len(seen)))
    mixed = float(np.where(gold >= 0, share, prior).mean())
    b += math.log(prior / (1 - prior)) - math.log(mixed / (1 - mixed))
    return {f: float(v) for f, v in zip(names, w) if abs(v) > 1e-4}, float(b)


def fit(docs: DataFrame, labels: DataFrame, per_label: int = 2500, unlabelled: int = 5000, most: int = 1000, most_patterns: int = 60, parts: int = 5, held: int = 0) -> tuple[dict[str, float], float]:
    """Learn from bounded samples of labelled and unlabelled rows outside the held-out fold."""
    use = labels.select("doc_id", F.col("toxic").cast("long").alias("toxic")).where((fold("doc_id", parts) != held) & F.col("toxic").isin(0, 1))
    sample = bounded_sample(use, "doc_id", "toxic", per_label)
    alone = {w: 6.0 for w in LEXICON}, -4.0
    if not sample:
        return alone
    shares = {r["toxic"]: r["count"] for r in use.groupBy("toxic").count().collect()}
    others = docs.select("doc_id", F.lit(-1).cast("long").alias("label")).where(fold("doc_id", parts) != held)
    known = {key for key, _ in sample}
    sample += [x for x in bounded_sample(others, "doc_id", "label", unlabelled, seed=29) if x[0] not in known]
    rows = learning_rows(docs, sample)
    n = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    model = alone if not n else train(rows, n, shares.get(1, 0) / max(1, sum(shares.values())), most, most_patterns)
    unstage(rows)
    return model


def score(docs: DataFrame, model: tuple[dict[str, float], float]) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from 0.5 on)."""
    weights, intercept = model
    whole = {f: w for f, w in weights.items() if not f.endswith("*")}
    stems = {n: {f[:-1]: w for f, w in weights.items() if f.endswith("*") and len(f) == n + 1} for n in STEMS}

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        out = []
        for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
            z = intercept
            if text:
                words = set(WORD.findall(text.lower()))
                z += sum(map(whole.__getitem__, words & whole.keys()))
                for n, table in stems.items():
                    own = {w[:n] for w in words if len(w) > n}
                    z += sum(map(table.__getitem__, own & table.keys()))
            out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
        p = np.array(out)
        return {"score": pa.array(p), "predicted": pa.array((p >= 0.5).astype(np.int32))}

    outputs = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return arrow_map(docs, run, outputs, keep=without(docs, ["score", "predicted"]))


def toxicity(docs: DataFrame, labels: DataFrame, per_label: int = 2500, unlabelled: int = 5000) -> DataFrame:
    """docs with held_out, score and predicted."""
    prepare(docs.sparkSession)
    out = score(docs.select(*without(docs, ["held_out"])), fit(docs, labels, per_label, unlabelled))
    return out.withColumn("held_out", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)))
