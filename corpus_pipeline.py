"""A training-corpus pipeline: toxicity, quality, near-duplicates, mixing, packing.

Each stage works on all documents that the stage before it kept; all but the last return the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marginalia.llm import mixing, near_copies, packing, quality, simhash, toxicity
from marginalia.llm.common import written
from marginalia.llm.queries import GOOD_FROM, TOXIC_FROM
from marginalia.llm.tokenization import vocabulary


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches the threshold go."""
    return toxicity.without_toxic(docs, toxicity.learn(docs, _labels(spark, sf_dir)), TOXIC_FROM)


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is below the threshold go."""
    return quality.only_good(docs, quality.learn(docs, _labels(spark, sf_dir)), GOOD_FROM)


def drop_alike_fingerprints(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of SimHash fingerprints that differ in 3 bits or fewer stays: its smallest doc_id."""
    return simhash.deduplicated(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The exact check behind SimHash, whose 3 bits don't reach it: one document of each group of near-duplicates (five-word
    shingles alike to 0.8 or more) stays, its smallest doc_id."""
    return near_copies.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What near-duplicates the fingerprints left go first; then sources are repeated, sampled or cut down to their target weights."""
    return mixing.mixed_documents(written(drop_near_duplicates(spark, docs, sf_dir), "pipeline-distinct"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences of at most 1024 tokens."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), length=1024, end_id=0)


STAGES = [
    ("toxicity", reject_toxic),
    ("quality", reject_poor),
    ("simhash", drop_alike_fingerprints),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Learned scores, seeded hashes and tokenizers can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
