"""Sparse and dense retrieval: BM25 postings and scores, exact vector top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.text import search_tokens

K1, B = 1.5, 0.75


def postings(chunks: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """term, key, tf, dl: one row for each term of each chunk, with the chunk's token count."""
    tokens = chunks.select(F.col(key), search_tokens(F.col(text)).alias("tokens")).withColumn("dl", F.size("tokens").cast("long"))
    return tokens.select(key, "dl", F.explode("tokens").alias("term")).groupBy("term", key, "dl").agg(F.count("*").alias("tf"))


def top_ranked(scored: DataFrame, order: Column, limit: int, key: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(order, F.col(key)))
    return scored.withColumn("rank", rank).where(F.col("rank") <= limit).select("qid", "rank", key, "score")


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def nearest(vectors: DataFrame, query: list[float], limit: int) -> DataFrame:
    """vec_id and distance of the vectors nearest to one query, by squared Euclidean distance."""
    own = F.array(*(F.lit(float(x)) for x in query))
    scored = vectors.select("vec_id", F.round(squared_distance(F.col("embedding"), own), 6).alias("distance"))
    return scored.orderBy("distance", "vec_id").limit(limit)


def vector_norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
