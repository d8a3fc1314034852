"""The corpus pipeline: toxicity, line dedup, near-dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows as Parquet in the
shared folder and reads them again as the next stage's documents. All stages but the last return the columns of
documents, in their order; extra columns are carried, also under names that an operator uses.

Odd input, for every stage: a null text counts as empty and is kept by the filters; rows that repeat a doc_id are judged
one by one; rows without a doc_id are judged by their own text (near-dedup keeps them); an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontamination, line_dedup, minhash_dedup, packing, toxicity
from tessera.llm.common import stage, unstage
from tessera.llm.queries import tokenizer_path
from tessera.sources import load


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic. Null and empty texts score the intercept, which keeps them;
    columns of docs that are called like those of the operator come out as they came in."""
    own = {c: f"_own_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    scored = toxicity.toxicity(docs.withColumnsRenamed(own), load(spark, sf_dir, "labels"))
    return scored.where(F.col("predicted") == 0).select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that others hold too; n_chars, where there is one, follows the text. No row goes: a
    document that loses every line stays with an empty text."""
    own = {c: f"_own_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text", "n_chars")}
    out = line_dedup.dedup_lines(docs.withColumnsRenamed(own))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: shingles of five words, similarity 0.8 or more (op6 takes four words, as
    its contract says). Texts without a word and rows without a doc_id stay; of equal rows one stays."""
    return minhash_dedup.keep_one(docs).select(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; each row is judged by its own text."""
    return decontamination.decontaminate(docs, load(spark, sf_dir, "benchmark")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens; an empty text is its end id alone."""
    return packing.pack(docs, tokenizer_path()).drop("ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack_sequences),
]

#: A classifier, a label model and a tokenizer are not SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    before = None
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
        unstage(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
