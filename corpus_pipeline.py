"""From raw documents to token ids: five operators in a row, each over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm import bpe, mixing, near_dedup, pii, quality
from fathom.llm.common import Stage, read


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained quality classifier rejects go."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays (five-word shingles, similarity 0.8 or more)."""
    return near_dedup.deduplicate(docs, shingle=5, percent=80)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts gives way to its kind; n_chars follows the new text."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order of the mixture of sources."""
    return mixing.mixed(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and what they decode to, as digests with the number of tokens, beside the ids themselves.

    Rows come in the order of the mixture and carry their slot and place in it.
    """
    path = bpe.tokenizer_path()
    # reading files again does not keep their order, so the same rows are scheduled again and carry their place on
    placed = mixing.ordered(docs.select("doc_id", "source", "text")).select("doc_id", "source", "mix.slot", "mix.place", "text")
    coded = bpe.encode(placed, path, hashed=True)
    return coded.select("doc_id", "source", "slot", "place", F.size("token_ids").cast("long").alias("n_tokens"), "ids_sha256", "decoded_sha256", "token_ids")


STAGES = [
    ("quality classifier", classify),
    ("MinHash near-dedup", deduplicate),
    ("PII", redact),
    ("mixing sources to target weights", mix),
    ("BPE encoding and decoding", tokenize),
]

#: Training and expectation-maximisation cannot be written in SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next."""
    stage = Stage(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for i, (_, function) in enumerate(STAGES[:-1]):
        docs = stage.write(function(spark, docs, sf_dir), f"stage-{i}")
    return STAGES[-1][1](spark, docs, sf_dir)
