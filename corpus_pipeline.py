"""A corpus pipeline of five operators; each stage is written as Parquet and read again by the next.

Every stage judges each row by its own text, so rows that repeat an id, or have none, are judged apart; of equal rows
the stages that deduplicate leave one. A null text is an empty one. Ties stay with the smallest id, a null id being
smallest. Very long texts are judged whole. All but the last stage return the columns of their documents, whatever
these are called beside ``doc_id`` and ``text``; the last returns the id and digests. An empty table passes through
as an empty one; without labels no row is toxic beyond the prior, and without a benchmark none is contaminated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lanternfish.llm import decontaminate, exact_dedup, queries, sentencepiece_bpe, simhash, toxicity
from lanternfish.llm.store import new_path


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.keep_best(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each SimHash component."""
    return simhash.keep_first(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the token ids and of the decoded text of each document."""
    return sentencepiece_bpe.token_digests(docs, queries.model_path())


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("simhash_near_dedup", without_near_copies),
    ("decontamination", without_benchmark),
    ("sentencepiece", tokens),
]

#: SQL has no toxicity model and no SentencePiece; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
