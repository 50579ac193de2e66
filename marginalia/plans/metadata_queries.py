"""Queries over the metadata: catalogue, sessions, messages, feedback, progress, streams in batch form."""

from __future__ import annotations

from marginalia.plans.registry import relational

_FEEDBACK = "SELECT doc_id AS message_id, CASE WHEN quality = 1 THEN 1 ELSE -1 END AS score FROM {labels}"
_CATALOGUE = "SELECT d.doc_id AS id, d.source, d.lang, d.n_chars, coalesce(l.toxic, 0) = 0 AS is_active, l.quality AS category_id FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id"
_SESSIONS = "SELECT conv_id AS session_id, min(CASE WHEN role = 'user' THEN turn END) AS first_turn, max(turn) AS last_turn FROM {conversations} GROUP BY conv_id"
_MESSAGES = "SELECT conv_id AS session_id, turn, text AS question, CASE WHEN next_role = 'assistant' THEN next_text END AS answer FROM (SELECT conv_id, turn, role, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM {conversations}) WHERE role = 'user'"

relational("q_doc_list", f"SELECT id, source, n_chars, CASE WHEN category_id IS NULL THEN NULL WHEN category_id = 1 THEN 'good' ELSE 'poor' END AS category, coalesce(CAST(NULL AS VARCHAR(10)), 'READY') AS status FROM ({_CATALOGUE}) WHERE is_active", f"SELECT id, source, n_chars, CASE WHEN category_id IS NULL THEN NULL WHEN category_id = 1 THEN 'good' ELSE 'poor' END AS category, coalesce(CAST(NULL AS STRING), 'READY') AS status FROM ({_CATALOGUE}) WHERE is_active")
relational("q_doc_get", f"SELECT id, source, n_chars FROM ({_CATALOGUE}) WHERE id = 7 AND is_active")
relational("q_doc_by_category", f"SELECT coalesce(CASE WHEN category_id = 1 THEN 'good' WHEN category_id = 0 THEN 'poor' END, 'uncategorised') AS category, count(*) AS n, sum(coalesce(n_chars, 0)) AS chars FROM ({_CATALOGUE}) GROUP BY 1".replace("sum(coalesce(n_chars, 0))", "CAST(sum(coalesce(n_chars, 0)) AS BIGINT)"))
relational("q_uncategorised", f"SELECT id FROM ({_CATALOGUE}) WHERE category_id IS NULL")
relational("q_any_processing", f"SELECT source, max(CASE WHEN is_active THEN 0 ELSE 1 END) = 1 AS any_inactive, CAST(sum(coalesce(n_chars, 0)) AS BIGINT) AS total FROM ({_CATALOGUE}) GROUP BY source")
relational("q_index_inventory", "SELECT source, count(*) AS n, min(doc_id) AS first_id, max(n_chars) AS longest FROM {documents} GROUP BY source")
relational("q_session_list", f"SELECT s.session_id, s.last_turn, left(trim(c.text), 50) AS title FROM ({_SESSIONS}) s LEFT JOIN {{conversations}} c ON c.conv_id = s.session_id AND c.turn = s.first_turn")
relational("q_session_detail", f"SELECT session_id, turn, question, answer FROM ({_MESSAGES}) WHERE session_id = 3")
relational("q_feedback_in", f"SELECT message_id, score FROM ({_FEEDBACK}) WHERE message_id IN (SELECT conv_id FROM {{conversations}})")
relational("q_feedback_count", f"SELECT count(*) AS n FROM ({_FEEDBACK}) WHERE score = 1")
relational("q_category_exists", "SELECT r_name, EXISTS (SELECT 1 FROM {nation} n WHERE n.n_name = r.r_name) AS found FROM {region} r")
relational("q_category_sorted", "SELECT r_regionkey, r_name, row_number() OVER (ORDER BY r_name) AS nth FROM {region}".replace("row_number() OVER (ORDER BY r_name)", "CAST(row_number() OVER (ORDER BY r_name) AS INTEGER)"))
relational("q_score_label", f"SELECT message_id, CASE score WHEN 1 THEN 'positive' WHEN -1 THEN 'negative' END AS label FROM ({_FEEDBACK})")
