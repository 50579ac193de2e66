"""Queries over fusion, re-ranking and context; events stand in for retrieved hits."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.operators import ranking
from marginalia.plans.registry import query


def _count(term: str) -> str:
    plain = f"(length(low) - length(replace(low, '{term}', ''))) // {len(term)}"
    return f"CASE WHEN {plain} > 0 THEN {plain} WHEN contains(packed, '{term.replace(' ', '')}') THEN 1 ELSE 0 END"


@query("q_subject_score", f"WITH t AS (SELECT doc_id, lower(coalesce(text, '')) AS low, regexp_replace(lower(coalesce(text, '')), '[^0-9a-z가-힣]+', '', 'g') AS packed FROM documents), c AS (SELECT doc_id, {_count('in the')} AS p, {_count('the')} AS a, {_count('hand')} AS b FROM t) SELECT doc_id, CAST(least(p, 4) * 24 + least(a, 5) * 3 + least(b, 5) * 12 + CASE WHEN a > 0 AND b > 0 THEN 20 ELSE 0 END AS BIGINT) AS score FROM c")
def subject_score(t):
    return t("documents").select("doc_id", ranking.subject_score(F.col("text"), ["in the"], ["the", "hand"], ["the"]).alias("score"))


@query("q_subject_score_weak", f"WITH t AS (SELECT doc_id, lower(coalesce(text, '')) AS low, regexp_replace(lower(coalesce(text, '')), '[^0-9a-z가-힣]+', '', 'g') AS packed FROM documents), c AS (SELECT doc_id, {_count('hand')} AS p, {_count('the')} AS a FROM t) SELECT doc_id, CAST(least(p, 4) * 24 + least(a, 5) * 3 AS BIGINT) AS score FROM c")
def subject_score_weak(t):
    """All subject terms are weak: a strong primary term doesn't add what only a strong subject term does."""
    return t("documents").select("doc_id", ranking.subject_score(F.col("text"), ["hand"], ["the"], ["the"]).alias("score"))


_HITS = "SELECT user_id AS qid, event_id % 3 AS source, event_id AS rank, event_id AS chunk_id, CASE WHEN event_id % 2 = 0 THEN event_id % 90 - 10 END AS parent_id, CASE WHEN event_id % 8 = 0 THEN 'held' END AS parent_text, event_type AS text FROM events"


@query("q_expand_hits", f"WITH k AS (SELECT qid, h.source, rank, CASE WHEN coalesce(d.text, parent_text) IS NOT NULL THEN parent_id ELSE chunk_id END AS result_id, coalesce(d.text, parent_text, h.text) AS text, CASE WHEN parent_id IS NOT NULL THEN h.text END AS fact FROM ({_HITS}) h LEFT JOIN documents d ON d.doc_id = h.parent_id), f AS (SELECT qid, result_id, fact, min((source, rank)) AS place FROM k WHERE fact IS NOT NULL GROUP BY ALL), j AS (SELECT qid, result_id, string_agg(fact, '|' ORDER BY place) AS facts FROM f GROUP BY ALL), g AS (SELECT qid, result_id, min((source, rank)) AS place, arg_min(text, (source, rank)) AS text FROM k GROUP BY ALL) SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY place) AS BIGINT) AS pos, result_id, md5(text) AS digest, coalesce(facts, '') AS facts FROM g LEFT JOIN j USING (qid, result_id)")
def expand_hits(t):
    n = F.col("event_id")
    hits = t("events").select(F.col("user_id").alias("qid"), (n % 3).alias("source"), n.alias("rank"), n.alias("chunk_id"), F.when(n % 2 == 0, n % 90 - 10).alias("parent_id"), F.when(n % 8 == 0, "held").alias("parent_text"), F.col("event_type").alias("text"))
    found = ranking.expanded(hits, t("documents").select(F.col("doc_id").alias("chunk_id"), "text"))
    return found.select("qid", "pos", "result_id", F.md5("text").alias("digest"), F.array_join("facts", "|").alias("facts"))


_CANDIDATES = "SELECT user_id AS qid, event_id AS id, event_id AS pos, event_id * 7 % (user_id % 50 + 1) AS score, event_type = 'purchase' AS evidence FROM events"


def _candidates(t):
    n, u = F.col("event_id"), F.col("user_id")
    return t("events").select(u.alias("qid"), n.alias("id"), n.alias("pos"), (n * 7 % (u % 50 + 1)).alias("score"), (F.col("event_type") == "purchase").alias("evidence"))


@query("q_rerank", f"SELECT qid, id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, pos) AS BIGINT) AS pos FROM ({_CANDIDATES})")
def rerank(t):
    return ranking.reranked(_candidates(t)).select("qid", "id", "score", "pos")


@query("q_prioritize", f"WITH b AS (SELECT *, max(score) OVER (PARTITION BY qid) AS best FROM ({_CANDIDATES})) SELECT qid, id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN best > 0 THEN -score ELSE 0 END, pos) AS BIGINT) AS pos FROM b WHERE NOT (best >= 40 AND score < best - 15) AND NOT (best >= 20 AND score = 0)")
def prioritize(t):
    return ranking.prioritized(_candidates(t)).select("qid", "id", "score", "pos")


@query("q_focus", f"WITH b AS (SELECT *, bool_or(evidence AND qid % 2 = 0) OVER (PARTITION BY qid) AS found FROM ({_CANDIDATES})) SELECT qid, id, CAST(row_number() OVER (PARTITION BY qid ORDER BY pos) AS BIGINT) AS pos FROM b WHERE NOT found OR (evidence AND qid % 2 = 0)")
def focus(t):
    return ranking.focused(_candidates(t), F.col("evidence") & (F.col("qid") % 2 == 0)).select("qid", "id", "pos")


@query("q_header_path", "SELECT doc_id, array_to_string(list_filter([source, CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END, CASE WHEN doc_id % 2 = 0 THEN 'even' END], x -> trim(x) <> ''), ' > ') AS path FROM documents".replace("x -> ", "lambda x: "))
def header_path(t):
    n = F.col("doc_id")
    return t("documents").select("doc_id", ranking.header_path(F.col("source"), F.when(n % 3 == 0, "").otherwise(F.col("lang")), F.when(n % 2 == 0, "even")).alias("path"))


@query("q_context", "SELECT conv_id AS qid, string_agg(concat('[', CAST(turn AS VARCHAR), '] ', text), E'\\n\\n' ORDER BY turn) AS context FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def context(t):
    return ranking.context(t("conversations").where("text IS NOT NULL").select(F.col("conv_id").alias("qid"), F.col("turn").alias("pos"), F.col("text").alias("block")))
