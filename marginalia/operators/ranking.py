"""Fusion and re-ranking of retrieved chunks.

Candidates are keyed by ``qid``; many questions run as one batch. Nothing is gathered beyond one question's hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.text import search_form
from marginalia.operators import evidence
from marginalia.operators.analysis import words


def subject_score(text: Column, primary: list[str], subject: list[str], weak: list[str]) -> Column:
    """24 for each of up to four occurrences of a primary term and 12 for each of up to five of a subject term (4 and 3
    for weak terms); 20 more if all subject terms occur and one of them isn't weak. Null text: 0."""
    own = F.coalesce(text, F.lit(""))
    # the text's forms are worked out once for all terms
    forms = F.array(F.named_struct(F.lit("low"), F.lower(own), F.lit("packed"), search_form(own)))
    return F.transform(forms, lambda f: evidence.subject_score(f["low"], f["packed"], words(primary), words(subject), weak))[0].cast("long")


def expanded(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """qid, pos, result_id, text, facts: hits of several sources in one list, facts replaced by their parents.

    ``hits`` holds qid, source (its place in the order of sources), rank, chunk_id, parent_id (null unless a fact),
    parent_text (of a parent that isn't stored; may be null) and text; ``chunks`` holds chunk_id and text. A result
    stands where its first hit does; its facts are kept once each, in order. A fact without parent stands for itself.
    """
    parents = chunks.select(F.col("chunk_id").alias("stored_id"), F.col("text").alias("stored_text"))
    parent_text = F.coalesce("stored_text", "parent_text")
    joined = hits.join(parents, F.col("parent_id") == F.col("stored_id"), "left").withColumn("lifted", parent_text.isNotNull())
    keyed = joined.select(
        "qid",
        F.struct("source", "rank", "chunk_id").alias("at"),
        F.when(F.col("lifted"), F.col("parent_id")).otherwise(F.col("chunk_id")).alias("result_id"),
        F.coalesce(parent_text, "text").alias("text"),
        F.when(F.col("parent_id").isNotNull(), F.col("text")).alias("fact"),
    )
    facts = F.transform(F.array_sort(F.collect_list(F.when(F.col("fact").isNotNull(), F.struct("at", "fact")))), lambda x: x["fact"])
    grouped = keyed.groupBy("qid", "result_id").agg(F.min("at").alias("at"), F.min_by("text", "at").alias("text"), F.array_distinct(facts).alias("facts"))
    pos = F.row_number().over(Window.partitionBy("qid").orderBy("at")).cast("long")
    return grouped.select("qid", pos.alias("pos"), "result_id", "text", "facts")


def _renumbered(rows: DataFrame, *order: Column) -> DataFrame:
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy(*order)).cast("long"))


def reranked(candidates: DataFrame) -> DataFrame:
    """``candidates`` (qid, pos, score, ...) by falling score, then as they stood; pos is numbered anew."""
    return _renumbered(candidates, F.col("score").desc(), F.col("pos"))


def prioritized(candidates: DataFrame) -> DataFrame:
    """As ``reranked``, without weak candidates: with a best score of 40 or more, those over 15 below it; of 20 or more,
    those of score 0. A question whose best score isn't positive keeps all, in their order."""
    best = F.max("score").over(Window.partitionBy("qid"))
    kept = candidates.withColumn("best", best).where(~((F.col("best") >= 40) & (F.col("score") < F.col("best") - 15)) & ~((F.col("best") >= 20) & (F.col("score") == 0)))
    return _renumbered(kept, F.when(F.col("best") > 0, -F.col("score")), F.col("pos")).drop("best")


def focused(candidates: DataFrame, has_evidence: Column) -> DataFrame:
    """A question's candidates that have evidence, or all of them if none has; the order stays."""
    own = F.coalesce(has_evidence, F.lit(False))
    marked = candidates.withColumn("own", own).withColumn("any_own", F.max("own").over(Window.partitionBy("qid")))
    return _renumbered(marked.where(F.col("own") | ~F.col("any_own")), F.col("pos")).drop("own", "any_own")


def header_path(*headers: Column) -> Column:
    """The headings that aren't empty, outermost first."""
    return F.array_join(F.filter(F.array(*headers), lambda h: h.isNotNull() & (F.trim(h) != "")), " > ")


def context(blocks: DataFrame) -> DataFrame:
    """qid, context: one question's blocks (qid, pos, block), numbered by pos, between blank lines."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "block")))
    return blocks.groupBy("qid").agg(F.array_join(F.transform(ordered, lambda x: F.concat(F.lit("["), x["pos"].cast("string"), F.lit("] "), x["block"])), "\n\n").alias("context"))
