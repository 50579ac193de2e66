"""Queries over hits for batches of questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.operators import hits
from marginalia.plans import evidence_queries as E
from marginalia.plans.analysis_queries import questions
from marginalia.plans.registry import query


@query("q_vector_batch", "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL), s AS (SELECT q.vec_id AS qid, v.vec_id AS chunk_id, list_sum(list_transform(list_zip(q.e, v.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v q JOIN v ON q.vec_id % 100 = 0), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY d, chunk_id) AS INTEGER) AS rank FROM s) SELECT qid, chunk_id, rank, round(d, 6) AS distance FROM r WHERE rank <= 15")
def q_vector_batch(t):
    vectors = t("embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    asked = vectors.where("chunk_id % 100 = 0").withColumnRenamed("chunk_id", "qid")
    return hits.nearest(vectors, asked, hits.retrieval_limit(5)).select("qid", "chunk_id", "rank", F.round("distance", 6).alias("distance"))


@query("q_fact_hits", E.FACT_SCORE_SQL.split("sc AS (SELECT")[0].replace("FROM ln WHERE head IS NULL", "FROM (SELECT i.qid, x.cid, x.pos, x.line, x.low, x.packed FROM intents i, (SELECT DISTINCT cid, pos, line, low, packed FROM ln WHERE head IS NULL) x)")
    + "sc AS (SELECT" + E.FACT_SCORE_SQL.split("sc AS (SELECT")[1].split("SELECT qid, cid, CAST(pos")[0]
    + f""", ok AS (SELECT qid, cid, pos, 12 * ns + 4 * ni + CASE WHEN counting AND regexp_matches(low, '{E.L.COUNT_COLUMN}') THEN 20 ELSE 0 END - CASE WHEN counting AND regexp_matches(low, '{"|".join(E.L.STATISTICS)}') THEN 10 ELSE 0 END AS score FROM sc WHERE ns > 0 AND EXISTS (SELECT 1 FROM lex_intent x WHERE x.qid = sc.qid)),
rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, cid * 1000 + pos) AS INTEGER) AS rank FROM ok WHERE score > 0)
SELECT qid, concat(CAST(cid AS VARCHAR), '_', CAST(pos AS VARCHAR)) AS chunk_id, CAST(score AS INTEGER) AS score, rank FROM rk WHERE rank <= 5""")  # fmt: skip
def q_fact_hits(t):
    """The lines of all guides stand for facts."""
    from marginalia.operators import evidence

    rows = E.guides(t).select("cid", F.posexplode(evidence.filled_lines(F.col("text"))).alias("pos", "text")).where(~evidence.is_heading(F.col("text")))
    pos = F.col("pos") + 1
    facts = rows.select(F.concat_ws("_", F.col("cid").cast("string"), pos.cast("string")).alias("chunk_id"), (F.col("cid") * 1000 + pos).alias("place"), "text")
    return hits.facts_by_words(facts, questions(t).select("qid", "text"))
