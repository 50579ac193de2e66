"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import hmm, html_text, media, mixing, packing, quality, simhash, token_store, topk, toxicity
from marginalia.llm.common import doc_remainder, scratch_path, written
from marginalia.llm.tokenization import vocabulary


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), length=1024, end_id=0)


#: From these scores on a document counts as toxic, and as good.
TOXIC_FROM, GOOD_FROM = 0.7, 0.3


def _judged(scores: DataFrame, modulus: int, held_out: int, least: float) -> DataFrame:
    return scores.withColumn("held_out", F.coalesce(doc_remainder("doc_id", modulus) == held_out, F.lit(False))).withColumn("predicted", (F.col("score") >= least).cast("int"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), modulus=3, held_out=1)
    return _judged(toxicity.score(docs, model), 3, 1, TOXIC_FROM).select("doc_id", "held_out", "score", "predicted", "clauses", "strongest")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), modulus=5, held_out=0)
    return _judged(quality.score(docs, model), 5, 0, GOOD_FROM).select("doc_id", "held_out", "score", "predicted")


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = scratch_path(spark, "token-store")
    token_store.write_store(_documents(spark, sf_dir), store, vocabulary("word_bpe_49k.json"), end_id=2)
    return token_store.verify_store(spark, store)


def op5_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(_documents(spark, sf_dir), modulus=5, held_out=1)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir), shingle=3, distance=3, seed=42)


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0, k=5)


#: Bytes at the end of a stored payload that ``tail_crc32`` is of.
TAIL_BYTES = 32


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = media.decode_media(written(media.encode_texts(_documents(spark, sf_dir)), "media", compression="zstd"))
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("pcm").cast("long").alias("payload_bytes"),
        F.sha2("pcm", 256).alias("payload_sha256"),
        F.crc32(F.expr(f"substring(pcm, -{TAIL_BYTES}, {TAIL_BYTES})")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        F.size("block_offsets").cast("long").alias("blocks"),
    )


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_toxicity": op2_toxicity,
    "op4_quality": op4_quality,
    "op3_token_store": op3_token_store,
    "op5_hmm": op5_hmm,
    "op6_simhash": op6_simhash,
    "op7_top_k": op7_top_k,
    "op8_media": op8_media,
    "op9_mixing": op9_mixing,
    "op10_html_text": op10_html_text,
}

#: op7 can be put in SQL; the others can't (tokenizers, seeded hashes, parsers) and are held against brute force in tests.
ORACLE_SQL: dict[str, str] = {
    "op7_top_k": """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS ints
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.ints, c.ints), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM vectors q JOIN vectors c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
""",
}
