"""Corpus pipeline: documents to packed training sequences.

Toxic documents go, then lines that earlier documents have, then near copies (five-word shingles, Jaccard
0.8), then documents that hold benchmark items; what is left is tokenised and packed. Each stage takes all
that the one before kept and returns the columns of documents, the last returns one row per packed piece.

Null and empty texts pass every filter. Documents without an id are never near copies of others; rows of
one id count as one document there and stay or go together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlens.llm import line_neighbourhood, partition_join, seed_alignment, toxicity_subwords
from recordlens.llm.queries import TOXIC_SCORE, held_out, pack_digest, table
from recordlens.session import cut

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SHINGLE_WORDS, SHINGLE_PERCENT = 5, 80


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the limit."""
    model = toxicity_subwords.train(docs, table(spark, sf_dir, "labels").where(~held_out()))
    scored = toxicity_subwords.score_texts(docs.select(COLUMNS), model)
    return scored.where(F.col("score") < TOXIC_SCORE).select(COLUMNS)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that earlier ones have; those with nothing left go."""
    kept = line_neighbourhood.dedup_lines(docs.select(COLUMNS))
    kept = kept.where("n_removed = 0 OR trim(BOTH ' \t\n\r' FROM text) <> ''")
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies."""
    groups = partition_join.near_sets(docs.select("doc_id", "text"), size=SHINGLE_WORDS, percent=SHINGLE_PERCENT)
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.select(COLUMNS).join(gone, "doc_id", "left_anti")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a benchmark item."""
    found = seed_alignment.benchmark_matches(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))
    return found.where(F.size("matches") == 0).select(COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document with its place in a training sequence."""
    return pack_digest(docs.select("doc_id", "text"))


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("near_copies", without_near_copies),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

# The toxicity model and the tokenizer have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each on the stored result of the one before."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
