"""Chunk statistics, repeated lines and page ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.text import collapse_space

SHORT_CHARS = 300


def chunk_stats(chunks: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Count, sum, mean, least, nearest-rank 50th and 90th percentile, most, and short chunks, by key."""
    n = F.length(text)
    rank = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY length({text}))").cast("long")
    return chunks.groupBy(key).agg(
        F.count("*").alias("chunks"), F.sum(n).cast("long").alias("total"), F.round(F.avg(n), 6).alias("mean"), F.min(n).cast("long").alias("least"),
        rank(0.5).alias("p50"), rank(0.9).alias("p90"), F.max(n).cast("long").alias("most"), F.count_if(n < SHORT_CHARS).alias("short_chunks"),
    )


def duplicate_lines(chunks: DataFrame, least: int = 8, most: int = 120) -> DataFrame:
    """One row: lines of that length, distinct lines that repeat, repeats, and their share."""
    lines = chunks.select(F.explode(F.split("text", "\n")).alias("line")).select(collapse_space(F.col("line")).alias("line")).where(F.length("line").between(least, most))
    counts = lines.groupBy("line").agg(F.count("*").alias("n"))
    repeats = F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n") - 1)), F.lit(0))
    return counts.agg(F.sum("n").alias("candidates"), F.count_if(F.col("n") > 1).alias("repeated_lines"), repeats.alias("repeats"), F.round(repeats / F.sum("n"), 6).alias("ratio"))


def adjacent_duplicates(docs: DataFrame, key: str) -> DataFrame:
    """key, n_lines, dropped: lines equal to the one before them, white space collapsed; blank lines stay."""
    lines = docs.select(key, F.posexplode(F.split("text", "\n")).alias("pos", "raw")).withColumn("line", collapse_space(F.col("raw")))
    same = (F.col("line") != "") & F.lag("line").over(Window.partitionBy(key).orderBy("pos")).eqNullSafe(F.col("line"))
    return lines.withColumn("same", same).groupBy(key).agg(F.count("*").alias("n_lines"), F.count_if("same").alias("dropped"))


def page_ranges(snippets: DataFrame, pages: DataFrame, key: str, *more: str) -> DataFrame:
    """key, more, page_start, page_end: the pages of the same document that hold any of the snippets."""
    hit = F.exists("snippets", lambda s: F.contains(F.col("content"), s))
    return snippets.join(pages, key).where(hit).groupBy(key, *more).agg(F.min("page").cast("long").alias("page_start"), F.max("page").cast("long").alias("page_end"))
