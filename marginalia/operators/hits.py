"""Hits for a batch of questions: nearest vectors, and facts of tables by their words. Questions go in blocks of bounded
size, each against all rows; each task keeps its best rows per question, so little is shuffled."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from marginalia.functions import lexicon as L
from marginalia.operators.analysis import lexical_terms

#: Bytes of a block of questions, which is broadcast; distances that are held at a time.
BLOCK_BYTES, CELLS = 16_000_000, 4_000_000


def retrieval_limit(k: int) -> int:
    """How many vectors are fetched for the ``k`` results wanted."""
    return min(20, max(k, 3 * k))


def _blocks(questions: DataFrame, size: Column) -> Iterator[list]:
    """The questions' rows in blocks of about BLOCK_BYTES."""
    total = questions.agg(F.sum(size).alias("n")).first()["n"] or 0
    blocks = max(1, -(-int(total) // BLOCK_BYTES))
    for block in range(blocks):
        rows = questions.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == block).collect()
        if rows:
            yield rows


def _ranked(found: list[DataFrame], order: Column, limit: int) -> DataFrame:
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(order, "chunk_id"))
    return every.withColumn("rank", rank).where(F.col("rank") <= limit)


def nearest(vectors: DataFrame, questions: DataFrame, limit: int) -> DataFrame:
    """qid, chunk_id, distance, rank: each question's (qid, embedding) ``limit`` nearest rows of ``vectors`` (chunk_id,
    embedding) by squared Euclidean distance; equal ones by chunk_id. Null vectors, and those of another length, take no part.
    """
    spark, found = vectors.sparkSession, []
    types = [to_arrow_type(questions.schema["qid"].dataType), to_arrow_type(vectors.schema["chunk_id"].dataType), pa.float64()]
    schema = f"qid {questions.schema['qid'].dataType.simpleString()}, chunk_id {vectors.schema['chunk_id'].dataType.simpleString()}, distance double"
    for rows in _blocks(questions.where("embedding IS NOT NULL"), F.size("embedding") * 8):
        shared = spark.sparkContext.broadcast(([r["qid"] for r in rows], np.array([r["embedding"] for r in rows], np.float64)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            qids, asked = shared.value
            step = max(1, CELLS // (len(qids) * max(1, asked.shape[1])))
            best: list[list[tuple[float, object]]] = [[] for _ in qids]
            for batch in batches:
                for begin in range(0, batch.num_rows, step):
                    part = batch.slice(begin, step)
                    ids, own = part.column(0).to_pylist(), part.column(1)
                    matrix = np.asarray(own.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(ids), -1)
                    apart = ((asked[:, None, :] - matrix[None, :, :]) ** 2).sum(2)
                    for q, distances in enumerate(apart):
                        least = np.sort(distances)[: limit][-1]
                        best[q] = sorted([*best[q], *((float(distances[i]), ids[i]) for i in np.flatnonzero(distances <= least))])[:limit]
            out = list(zip(*((qid, chunk, d) for qid, own in zip(qids, best) for d, chunk in own))) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["qid", "chunk_id", "distance"])

        usable = vectors.where((F.size("embedding") == len(rows[0]["embedding"])) & F.forall("embedding", lambda x: x.isNotNull()))
        found.append(usable.select("chunk_id", F.col("embedding").cast("array<double>")).mapInArrow(run, schema))
    if not found:
        return spark.createDataFrame([], schema + ", rank int")
    return _ranked(found, F.col("distance"), limit)


def facts_by_words(facts: DataFrame, questions: DataFrame, limit: int = 5) -> DataFrame:
    """qid, chunk_id, score, rank: each question's (qid, text) best facts (chunk_id, place, text), as ``evidence.fact_score`` has
    them; equal ones by their place. Only questions that name a subject and a word of tables have any.

    The words of all questions of a block are found in a fact in one pass, so a fact meets just the questions whose subject it names.
    """
    spark, found, qid_type = facts.sparkSession, [], to_arrow_type(questions.schema["qid"].dataType)
    terms = lexical_terms(F.coalesce("text", F.lit("")))
    asked = questions.select("qid", terms.alias("t")).select("qid", F.col("t.subject").alias("subject"), F.col("t.intent").alias("intent")).where("size(subject) > 0 AND size(intent) > 0")
    schema = f"qid {questions.schema['qid'].dataType.simpleString()}, chunk_id string, place long, score int"
    for rows in _blocks(asked, (F.size("subject") + F.size("intent")) * 40):
        shared = spark.sparkContext.broadcast([(r["qid"], set(r["subject"]), set(r["intent"])) for r in rows])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            by_subject, words = defaultdict(list), ahocorasick.Automaton()
            for i, (_, subject, intent) in enumerate(shared.value):
                for k in subject:
                    by_subject[k].append(i)
                for k in subject | intent:
                    words.add_word(k, k)
            words.make_automaton()
            column = re.compile(L.COUNT_COLUMN)
            best: dict[int, list] = defaultdict(list)
            for batch in batches:
                for chunk_id, place, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    low = text.lower()
                    # terms are tokens, so they are the same in the search form
                    held = {k for _, k in words.iter(low)} | {k for _, k in words.iter(re.sub("[^0-9a-z가-힣]+", "", low))}
                    counts, statistic = bool(column.search(low)), any(x in low for x in L.STATISTICS)
                    for i in {i for k in held for i in by_subject.get(k, ())}:
                        qid, subject, intent = shared.value[i]
                        counting = not intent.isdisjoint(L.COUNT_ASKS)
                        score = 12 * len(subject & held) + 4 * len(intent & held) + (20 if counting and counts else 0) - (10 if counting and statistic else 0)
                        if score > 0:
                            best[i] = sorted([*best[i], (-score, place, chunk_id)])[:limit]
            out = [(shared.value[i][0], chunk_id, place, -score) for i, own in best.items() for score, place, chunk_id in own]
            columns = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], qid_type), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int32())], ["qid", "chunk_id", "place", "score"])

        own = facts.where("text IS NOT NULL").select(F.col("chunk_id").cast("string"), F.col("place").cast("long"), "text")
        found.append(own.mapInArrow(run, schema))
    if not found:
        return spark.createDataFrame([], schema + ", rank int").drop("place")
    every = _ranked([f.withColumn("order", F.struct(-F.col("score"), "place")) for f in found], F.col("order"), limit)
    return every.select("qid", "chunk_id", "score", "rank")
