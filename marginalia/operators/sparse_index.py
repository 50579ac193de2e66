"""A stored BM25 index: postings by buckets of the term, document frequencies and the corpus' statistics.

It is built once, when documents are written; a question reads the buckets of its own terms and no text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.text import search_tokens
from marginalia.operators.analysis import Tokenizer
from marginalia.operators.retrieval import B, K1, top_ranked
from marginalia.sources.scratch import exists, remove_path, scratch_path, version

BUCKETS = 64
#: Buckets are named in the plan for up to so many different terms; beyond, their join finds them.
NAMED_TERMS = 2_000


def build(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", tokenizer: Tokenizer = search_tokens) -> None:
    """Writes the index of ``docs`` (key, text) under ``path``. Null texts and texts without tokens don't count."""
    spark = docs.sparkSession
    tokens = docs.select(F.col(key).alias("key"), tokenizer(F.col(text)).alias("tokens")).withColumn("dl", F.size("tokens").cast("long")).where("dl > 0")
    rows = tokens.select("key", "dl", F.explode("tokens").alias("term")).groupBy("term", "key", "dl").agg(F.count("*").alias("tf"))
    bucketed = rows.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)))
    # frequent terms are spread over several files of their bucket; each file is sorted, so its row groups can be passed by
    dealt = bucketed.repartition("bucket", F.pmod(F.xxhash64("key"), F.lit(4))).sortWithinPartitions("bucket", "term", "key")
    dealt.write.partitionBy("bucket").parquet(f"{path}/postings")
    _read(spark, path, "postings", rows.schema["key"].dataType.simpleString()).groupBy("bucket", "term").agg(F.count("*").alias("df")).repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/terms")
    tokens.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).write.parquet(f"{path}/stats")


_SCHEMAS = {"postings": "term string, key {key}, dl long, tf long, bucket long", "terms": "term string, df long, bucket long", "stats": "n long, avgdl double"}


def _read(spark: SparkSession, path: str, table: str, key_type: str = "long") -> DataFrame:
    return spark.read.schema(_SCHEMAS[table].replace("{key}", key_type)).parquet(f"{path}/{table}")


def search(spark: SparkSession, path: str, questions: DataFrame, limit: int, tokenizer: Tokenizer = search_tokens, key_type: str = "long") -> DataFrame:
    """qid, rank, key, score: each question's (qid, text) best documents; a term counts as often as the question has it.
    Equal scores go to the smaller key."""
    asked = questions.select("qid", F.explode(tokenizer(F.col("text"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))
    asked = asked.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)))
    postings, terms = _read(spark, path, "postings", key_type), _read(spark, path, "terms")
    named = [r["term"] for r in asked.select("term").distinct().limit(NAMED_TERMS + 1).collect()]
    if len(named) <= NAMED_TERMS:
        buckets = [r["bucket"] for r in asked.select("bucket").distinct().collect()]  # at most BUCKETS
        postings, terms = (x.where(F.col("bucket").isin(buckets) & F.col("term").isin(named)) for x in (postings, terms))
    stats = _read(spark, path, "stats").first()
    if stats is None or not stats["n"]:
        return postings.limit(0).select(F.lit(0).alias("qid"), F.lit(0).alias("rank"), "key", F.lit(0.0).alias("score"))
    n, avgdl = F.lit(stats["n"]), F.lit(stats["avgdl"])
    weighted = asked.join(terms, ["bucket", "term"]).withColumn("weight", F.col("qtf") * F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / avgdl))
    scored = postings.join(weighted.select("bucket", "term", "qid", "weight"), ["bucket", "term"]).groupBy("qid", "key").agg(F.sum(F.col("weight") * tf).alias("score"))
    return top_ranked(scored.withColumn("score", F.round("score", 6)).where("score > 0"), F.col("score").desc(), limit, "key")


_BUILT: dict[tuple, str] = {}


def of_table(spark: SparkSession, path: str) -> str:
    """The index of a table of documents; built on first use, and again when the table's files have changed. The index before is
    removed then."""
    mark = (spark.sparkContext.applicationId, path)
    state = version(spark, path)
    for known, folder in list(_BUILT.items()):
        if known[:2] == mark and known[2] != state:
            remove_path(spark, folder)
            del _BUILT[known]
    if not exists(spark, _BUILT.get((*mark, state), "/no index")):
        folder = scratch_path(spark, "sparse-index")
        build(spark.read.parquet(path).select("doc_id", "text"), folder)
        _BUILT[(*mark, state)] = folder
    return _BUILT[(*mark, state)]
