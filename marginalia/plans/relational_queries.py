"""Queries over metadata tables. Orders stand for sessions, events for messages and progress, documents for the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.operators import relational as R
from marginalia.plans.registry import query
from marginalia.streaming import sessions as S

_SESSIONS = "SELECT o_orderkey AS session_id, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS user_id, CASE WHEN o_orderkey % 3 = 1 THEN concat('k', CAST(o_custkey % 40 AS VARCHAR)) END AS session_key, o_orderdate AS updated_at FROM orders"
_MESSAGES = "SELECT event_id AS message_id, event_id % 400 AS session_id, ts AS created_at, event_type AS question FROM events"
_FEEDBACK = "SELECT doc_id AS message_id, CASE WHEN quality = 1 THEN 1 ELSE -1 END AS score, TIMESTAMP '2024-01-01 00:00:00' AS updated_at FROM labels"
_DOCS = "SELECT doc_id AS id, concat(source, '-', CAST(doc_id AS VARCHAR)) AS name, doc_id % 5 <> 0 AS is_active, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE CAST(doc_id % 4 AS INTEGER) END AS category_id, CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'PROCESSING' ELSE 'FAILED' END AS status, TIMESTAMP '2024-01-01 00:00:00' + to_milliseconds(doc_id * 250) AS created_at, n_chars FROM documents"


def _sessions(t):
    n = F.col("o_orderkey")
    return t("orders").select(n.alias("session_id"), F.when(n % 3 == 0, F.col("o_custkey")).alias("user_id"), F.when(n % 3 == 1, F.concat(F.lit("k"), (F.col("o_custkey") % 40).cast("string"))).alias("session_key"), F.col("o_orderdate").alias("updated_at"))


def _messages(t):
    return t("events").select(F.col("event_id").alias("message_id"), (F.col("event_id") % 400).alias("session_id"), F.col("ts").alias("created_at"), F.col("event_type").alias("question"))


def _feedback(t):
    return t("labels").select(F.col("doc_id").alias("message_id"), F.when(F.col("quality") == 1, 1).otherwise(-1).alias("score"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("updated_at"))


def _docs(t):
    n = F.col("doc_id")
    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=(n * 250 / 1000).cast("decimal(18,6)"))
    return t("documents").select(n.alias("id"), F.concat_ws("-", "source", n.cast("string")).alias("name"), (n % 5 != 0).alias("is_active"), F.when(n % 4 != 0, (n % 4).cast("int")).alias("category_id"), F.when(n % 3 == 1, "PROCESSING").when(n % 3 == 2, "FAILED").alias("status"), at.alias("created_at"), "n_chars")


def _categories(t):
    return t("region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))


@query("q_active_documents", f"SELECT d.id, d.name, r_name AS category, coalesce(d.status, 'READY') AS status, CAST(row_number() OVER (ORDER BY created_at DESC, d.id DESC) AS INTEGER) AS nth FROM ({_DOCS}) d LEFT JOIN region ON r_regionkey = category_id WHERE is_active")
def q_active_documents(t):
    from pyspark.sql import Window

    rows = R.active_documents(_docs(t), _categories(t))
    return rows.select("id", "name", "category", "status", F.row_number().over(Window.orderBy(F.desc("created_at"), F.desc("id"))).alias("nth"))


@query("q_reachable_sessions", f"SELECT 'user' AS way, session_id FROM ({_SESSIONS}) WHERE user_id = 7 UNION ALL SELECT 'key', session_id FROM ({_SESSIONS}) WHERE session_key = 'k7'")
def q_reachable_sessions(t):
    rows = _sessions(t)
    ways = {"user": R.reachable_sessions(rows, user_id=7, session_key="k9"), "key": R.reachable_sessions(rows, session_key="k7"), "none": R.reachable_sessions(rows)}
    every = None
    for way, found in ways.items():
        own = found.select(F.lit(way).alias("way"), "session_id")
        every = own if every is None else every.unionByName(own)
    return every


@query("q_message_owned", f"SELECT m.message_id, m.session_id, s.user_id, coalesce(s.session_key = 'k3', false) AS owned FROM ({_MESSAGES}) m JOIN ({_SESSIONS}) s ON s.session_id = m.session_id")
def q_message_owned(t):
    return R.with_owner(_messages(t), _sessions(t), session_key="k3").select("message_id", "session_id", "user_id", "owned")


@query("q_message_feedback", f"SELECT m.message_id, f.score FROM ({_MESSAGES}) m LEFT JOIN ({_FEEDBACK}) f ON f.message_id = m.message_id")
def q_message_feedback(t):
    return R.with_feedback(_messages(t), _feedback(t)).select("message_id", "score")


@query("q_feedback_stats", "SELECT count(*) AS total, count(*) FILTER (WHERE quality = 1) AS positive, count(*) FILTER (WHERE quality IS DISTINCT FROM 1) AS negative, round(count(*) FILTER (WHERE quality = 1) / count(*), 6) AS positive_rate FROM labels")
def q_feedback_stats(t):
    return R.feedback_statistics(_feedback(t)).withColumn("positive_rate", F.round("positive_rate", 6))


def _changes(t):
    return t("events").select((F.col("event_id") % 300).alias("message_id"), (F.col("event_id") % 3 - 1).cast("int").alias("score"), F.col("ts").alias("updated_at"))


_CHANGES = "SELECT event_id % 300 AS message_id, CAST(event_id % 3 - 1 AS INTEGER) AS score, ts AS updated_at FROM events"


@query("q_feedback_upsert", f"WITH c AS ({_CHANGES}), last AS (SELECT message_id, arg_max(score, updated_at) AS score FROM c WHERE score <> 0 GROUP BY message_id) SELECT message_id, score, false AS refused FROM last UNION ALL SELECT message_id, score, false FROM ({_FEEDBACK}) f WHERE message_id NOT IN (SELECT message_id FROM last) UNION ALL SELECT message_id, score, true FROM c WHERE score = 0")
def q_feedback_upsert(t):
    after, refused = R.feedback_upserted(_feedback(t), _changes(t))
    return after.select("message_id", "score", F.lit(False).alias("refused")).unionByName(refused.select("message_id", "score", F.lit(True).alias("refused")))


@query("q_cascade_delete", f"WITH gone AS (SELECT session_id FROM ({_SESSIONS}) WHERE session_id % 5 = 0) SELECT 'session' AS kind, session_id AS id FROM ({_SESSIONS}) WHERE session_id % 5 <> 0 UNION ALL SELECT 'message', message_id FROM ({_MESSAGES}) WHERE session_id NOT IN (SELECT session_id FROM gone) UNION ALL SELECT 'feedback', message_id FROM ({_FEEDBACK}) f WHERE NOT EXISTS (SELECT 1 FROM ({_MESSAGES}) m JOIN gone USING (session_id) WHERE m.message_id = f.message_id)")
def q_cascade_delete(t):
    ids = _sessions(t).where("session_id % 5 = 0").select("session_id")
    left = R.cascade_deleted(_sessions(t), _messages(t), _feedback(t), ids)
    every = None
    for kind, rows, key in zip(("session", "message", "feedback"), left, ("session_id", "message_id", "message_id")):
        own = rows.select(F.lit(kind).alias("kind"), F.col(key).alias("id"))
        every = own if every is None else every.unionByName(own)
    return every


@query("q_touch_session", f"SELECT session_id, greatest(updated_at, coalesce((SELECT max(created_at) FROM ({_MESSAGES}) m WHERE m.session_id = s.session_id), updated_at)) AS updated_at FROM ({_SESSIONS}) s")
def q_touch_session(t):
    return R.touched(_sessions(t), _messages(t)).select("session_id", "updated_at")


@query("q_get_or_create", f"""WITH q AS (SELECT event_id AS request_id, CASE WHEN event_id % 4 = 0 THEN user_id END AS user_id, CASE WHEN event_id % 4 <> 3 THEN concat('k', CAST(event_id % 60 AS VARCHAR)) END AS session_key FROM events)
SELECT request_id, CASE WHEN q.user_id IS NULL THEN s.session_id END AS session_id, CASE WHEN q.user_id IS NOT NULL OR session_key IS NULL THEN request_id WHEN s.session_id IS NULL THEN min(request_id) OVER (PARTITION BY q.user_id IS NULL, session_key) END AS new_key
FROM q LEFT JOIN (SELECT session_key, min(session_id) AS session_id FROM ({_SESSIONS}) WHERE session_key IS NOT NULL GROUP BY session_key) s USING (session_key)""")
def q_get_or_create(t):
    n = F.col("event_id")
    requests = t("events").select(n.alias("request_id"), F.when(n % 4 == 0, F.col("user_id")).alias("user_id"), F.when(n % 4 != 3, F.concat(F.lit("k"), (n % 60).cast("string"))).alias("session_key"))
    return R.got_or_created(requests, _sessions(t))


@query("q_category_insert", "WITH new AS (SELECT n_nationkey + 100 AS id, CASE WHEN n_nationkey % 6 = 5 THEN NULL WHEN n_nationkey % 2 = 0 THEN r_name ELSE concat('new ', CAST(n_nationkey % 4 AS VARCHAR)) END AS name FROM nation JOIN region ON r_regionkey = n_regionkey), ok AS (SELECT min(id) AS id, name FROM new WHERE name IS NOT NULL AND name NOT IN (SELECT r_name FROM region) GROUP BY name) SELECT r_regionkey AS id, r_name AS name, false AS refused FROM region UNION ALL SELECT id, name, false FROM ok UNION ALL SELECT id, name, true FROM new WHERE id NOT IN (SELECT id FROM ok)")
def q_category_insert(t):
    n = F.col("n_nationkey")
    name = F.when(n % 6 == 5, F.lit(None)).when(n % 2 == 0, F.col("r_name")).otherwise(F.concat(F.lit("new "), (n % 4).cast("string")))
    new = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select((n + 100).alias("id"), name.alias("name"))
    after, refused = R.inserted(_categories(t), new, "name")
    return after.withColumn("refused", F.lit(False)).unionByName(refused.withColumn("refused", F.lit(True)))


@query("q_soft_delete", f"SELECT 'document' AS kind, id, is_active AND id % 10 <> 3 AS is_active FROM ({_DOCS}) UNION ALL SELECT 'index', doc_id, NULL FROM documents WHERE doc_id % 10 <> 3")
def q_soft_delete(t):
    ids = _docs(t).where("id % 10 = 3").select("id")
    docs, index = R.soft_deleted(_docs(t), t("documents").select(F.col("doc_id").alias("document_id")), ids)
    return docs.select(F.lit("document").alias("kind"), "id", "is_active").unionByName(index.select(F.lit("index").alias("kind"), F.col("document_id").alias("id"), F.lit(None).cast("boolean").alias("is_active")))


@query("q_latest_prompt", "SELECT event_id, event_type, ts FROM events WHERE (ts, event_id) = (SELECT max((ts, event_id)) FROM events)")
def q_latest_prompt(t):
    return R.newest(t("events").select("event_id", "event_type", "ts"), "ts", "event_id")


@query("q_prompt_update", "SELECT event_id AS id, CASE WHEN (ts, event_id) = (SELECT max((ts, event_id)) FROM events) THEN 'be brief' ELSE event_type END AS text, CASE WHEN (ts, event_id) = (SELECT max((ts, event_id)) FROM events) THEN 5 ELSE user_id END AS updated_by FROM events")
def q_prompt_update(t):
    prompts = t("events").select(F.col("event_id").alias("id"), F.col("event_type").alias("text"), F.col("user_id").alias("updated_by"), F.col("ts").alias("updated_at"))
    return R.prompt_updated(prompts, "be brief", 5, F.lit("2030-01-01 00:00:00").cast("timestamp_ntz")).select("id", "text", "updated_by")


@query("q_source_enrich", f"SELECT e.event_id, d.name AS document_name, CASE WHEN d.id IS NOT NULL THEN coalesce(d.status, 'READY') END AS document_status, CASE WHEN d.id IS NOT NULL THEN concat(strftime(created_at, '%Y-%m-%dT%H:%M:%S'), CASE id * 250 % 1000 WHEN 0 THEN '' WHEN 250 THEN '.25' WHEN 500 THEN '.5' ELSE '.75' END) END AS document_created_at FROM (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'x' ELSE CAST(event_id % 1200 AS VARCHAR) END AS document_id FROM events) e LEFT JOIN (SELECT * FROM ({_DOCS}) WHERE is_active) d ON CAST(d.id AS VARCHAR) = e.document_id")
def q_source_enrich(t):
    n = F.col("event_id")
    sources = t("events").select("event_id", F.when(n % 4 == 0, "x").otherwise((n % 1200).cast("string")).alias("document_id"))
    return R.enriched(sources, _docs(t)).drop("document_id")


@query("q_json_sources", "SELECT event_id, CAST(CASE WHEN event_id % 5 IN (0, 1, 2) THEN 0 ELSE event_id % 5 - 2 END AS INTEGER) AS n, CASE WHEN event_id % 5 > 2 THEN CAST(event_id AS VARCHAR) END AS first FROM events")
def q_json_sources(t):
    """Lists of one or two objects; null, blank and damaged texts."""
    n, item = F.col("event_id"), F.to_json(F.struct(F.col("event_id").cast("string").alias("id"), F.lit("x").alias("name")))
    text = F.when(n % 5 == 0, F.lit(None)).when(n % 5 == 1, " ").when(n % 5 == 2, "{damaged").when(n % 5 == 3, F.concat(F.lit("["), item, F.lit("]"))).otherwise(F.concat(F.lit("["), item, F.lit(","), item, F.lit("]")))
    parsed = R.parsed_sources(text)
    return t("events").select("event_id", F.size(parsed).alias("n"), F.try_element_at(F.get(parsed, F.lit(0)), F.lit("id")).alias("first"))


@query("q_progress_precedence", f"SELECT id, CAST(CASE WHEN status IS NULL OR status = 'FAILED' THEN 100 ELSE greatest(0, least(100, n_chars % 160 - 20)) END AS INTEGER) AS percent, CASE WHEN status IS NULL THEN 'completed' WHEN status = 'FAILED' THEN 'failed' ELSE 'processing' END AS shown FROM ({_DOCS})")
def q_progress_precedence(t):
    shown = R.shown_progress(F.col("status"), F.col("n_chars") % 160 - 20)
    return _docs(t).select("id", shown["percent"].alias("percent"), shown["status"].alias("shown"))


@query("q_validation", "SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 'question' WHEN event_id % 25 > 20 OR event_id % 25 = 0 THEN 'top_k' WHEN event_id % 4 = 1 THEN 'mime_type' END AS reason FROM events")
def q_validation(t):
    n = F.col("event_id")
    ok, refused = R.validated(t("events").select("event_id", F.when(n % 6 == 0, " ").otherwise("q").alias("question"), (n % 25).alias("top_k"), F.when(n % 4 == 0, "application/pdf").when(n % 4 == 1, "text/plain").alias("mime_type")))
    return ok.select("event_id", F.lit(None).cast("string").alias("reason")).unionByName(refused.select("event_id", "reason"))


_SOURCES = "SELECT user_id AS qid, event_id AS pos, CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 7 AS VARCHAR) WHEN event_id % 3 = 1 THEN '' END AS document_id, CASE WHEN event_id % 3 = 1 AND event_id % 2 = 0 THEN concat('o', CAST(event_id % 5 AS VARCHAR)) END AS original_name, CASE WHEN event_id % 4 = 1 THEN event_type ELSE '' END AS source, CASE WHEN event_id % 4 = 3 THEN 'file' END AS filename, CASE WHEN event_id % 2 = 1 THEN concat('p', CAST(event_id AS VARCHAR)) ELSE '' END AS path FROM events"


@query("q_source_groups", f"WITH k AS (SELECT *, coalesce(nullif(document_id, ''), original_name, nullif(source, ''), filename, concat('source-', CAST(pos AS VARCHAR))) AS key, coalesce(original_name, nullif(source, ''), filename, concat('참조 문서 ', CAST(pos + 1 AS VARCHAR))) AS title FROM ({_SOURCES})) SELECT qid, key, min(pos) AS first_seen, arg_min(title, pos) AS title, arg_min(path, pos) FILTER (WHERE path <> '') AS path, string_agg(CAST(pos AS VARCHAR), '|' ORDER BY pos) AS chunks FROM k GROUP BY qid, key")
def q_source_groups(t):
    n, s = F.col("event_id"), lambda c: c.cast("string")
    rows = t("events").select(
        F.col("user_id").alias("qid"), n.alias("pos"), F.when(n % 3 == 0, s(n % 7)).when(n % 3 == 1, "").alias("document_id"), F.when((n % 3 == 1) & (n % 2 == 0), F.concat(F.lit("o"), s(n % 5))).alias("original_name"),
        F.when(n % 4 == 1, F.col("event_type")).otherwise("").alias("source"), F.when(n % 4 == 3, "file").alias("filename"), F.when(n % 2 == 1, F.concat(F.lit("p"), s(n))).otherwise("").alias("path"), n.alias("chunk_index"),
    )
    return R.source_groups(rows).withColumn("chunks", F.array_join(F.transform("chunks", lambda x: x.cast("string")), "|"))


@query("q_labels", """SELECT event_id, CASE WHEN size <= 0 THEN '-' WHEN size < 1048576 THEN concat(CAST(CAST(floor(size / 1024 + 0.5) AS BIGINT) AS VARCHAR), 'KB') ELSE printf('%.1fMB', size / 1048576) END AS size,
CASE WHEN ms < 0 THEN NULL WHEN ms < 1000 THEN concat(CAST(ms AS VARCHAR), 'ms') WHEN ms < 60000 THEN printf('%.1f초', ms / 1000) ELSE concat(CAST(ms // 60000 AS VARCHAR), '분 ', lpad(CAST(CAST(floor(ms % 60000 / 1000 + 0.5) AS BIGINT) AS VARCHAR), 2, '0'), '초') END AS duration,
concat(CAST(CAST(floor(event_id % 41 / 40 * 100 + 0.5) AS BIGINT) AS VARCHAR), '%') AS share, CAST(CASE WHEN event_id % 7 = 0 THEN 100 WHEN p >= 95 THEN 99 WHEN p >= 90 THEN 97 WHEN p >= 70 THEN 92 WHEN p >= 30 THEN 86 WHEN p >= 18 THEN 34 WHEN p >= 5 THEN 18 ELSE greatest(p, 3) END AS INTEGER) AS ceiling, strftime(ts, '%Y-%m-%d %H:%M') AS shown
FROM (SELECT *, event_id * event_id * 13 - 50 AS size, event_id * 97 - 900 AS ms, least(100, greatest(0, event_id % 130 - 10)) AS p FROM events)""")
def q_labels(t):
    n = F.col("event_id")
    ceiling = R.progress_ceiling(n % 130 - 10, F.when(n % 7 == 0, "failed").otherwise("processing"))
    return t("events").select("event_id", R.size_label(n * n * 13 - 50).alias("size"), R.duration_label(n * 97 - 900).alias("duration"), R.percent_label(n % 41 / 40).alias("share"), ceiling.alias("ceiling"), R.shown_time(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("shown"))


def _updates(t):
    n = F.col("event_id")
    return t("events").select(F.col("user_id").alias("document_id"), (n % 160 - 20).alias("percent"), F.col("event_type").alias("stage"), F.lit("processing").alias("status"), F.col("ts").alias("updated_at"))


@query("q_latest_progress", "WITH u AS (SELECT user_id, arg_max(event_id % 160 - 20, ts) AS p, arg_max(event_type, ts) AS stage FROM events GROUP BY user_id) SELECT x AS document_id, CAST(CASE WHEN p IS NULL THEN 0 ELSE greatest(0, least(100, p)) END AS BIGINT) AS percent, coalesce(stage, 'unknown') AS stage, CASE WHEN p IS NULL THEN 'unknown' ELSE 'processing' END AS status FROM (SELECT unnest(range(0, 200)) AS x) LEFT JOIN u ON user_id = x")
def q_latest_progress(t):
    """Documents of which nothing is told are unknown."""
    asked = t("events").sparkSession.range(200).select(F.col("id").alias("document_id"))
    return S.progress_of(asked, S.latest_progress(_updates(t)))


_COMMANDS = "SELECT user_id AS stream_id, CASE WHEN event_type = 'signup' THEN 'save' ELSE 'consume' END AS op, event_id, ts FROM events WHERE event_type IN ('signup', 'click')"


@query("q_ttl_sessions", f"WITH c AS ({_COMMANDS}), p AS (SELECT *, lag(op) OVER w AS last_op, lag(ts) OVER w AS last_ts, lag(event_id) OVER w AS last_id FROM c WINDOW w AS (PARTITION BY stream_id ORDER BY ts, event_id)) SELECT stream_id, ts, last_op IS NOT DISTINCT FROM 'save' AND ts < last_ts + INTERVAL 30 MINUTE AS ok, CASE WHEN last_op = 'save' AND ts < last_ts + INTERVAL 30 MINUTE THEN CAST(last_id AS VARCHAR) END AS question FROM p WHERE op = 'consume'")
def q_ttl_sessions(t):
    rows = t("events").where(F.col("event_type").isin("signup", "click"))
    commands = rows.select(F.col("user_id").alias("stream_id"), F.when(F.col("event_type") == "signup", "save").otherwise("consume").alias("op"), F.col("event_id").cast("string").alias("question"), "ts", F.col("event_id").alias("seq"))
    return S.consumed(commands, 30 * 60.0)


@query("q_token_assemble", """WITH f AS (SELECT user_id AS message_id, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' WHEN 'logout' THEN 'disconnect' ELSE 'token' END AS kind, CASE WHEN event_type = 'purchase' AND event_id % 2 = 0 THEN concat('own ', CAST(event_id AS VARCHAR)) WHEN event_type = 'purchase' THEN '' ELSE event_type END AS payload FROM events),
e AS (SELECT message_id, min(seq) FILTER (WHERE kind <> 'token') AS stop FROM f GROUP BY message_id), t AS (SELECT f.message_id, string_agg(payload, '' ORDER BY seq) AS tokens FROM f JOIN e USING (message_id) WHERE kind = 'token' AND (stop IS NULL OR seq < stop) GROUP BY f.message_id)
SELECT e.message_id, CASE WHEN x.kind = 'done' THEN coalesce(nullif(x.payload, ''), tokens, '') WHEN x.kind = 'error' THEN 'The answer could not be completed.' ELSE tokens END AS answer, CASE WHEN x.kind = 'done' THEN 'complete' WHEN x.kind = 'error' THEN 'error' WHEN tokens IS NOT NULL THEN 'partial' ELSE 'none' END AS status FROM e LEFT JOIN f x ON x.message_id = e.message_id AND x.seq = e.stop LEFT JOIN t ON t.message_id = e.message_id""")
def q_token_assemble(t):
    kind = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "error").when(F.col("event_type") == "logout", "disconnect").otherwise("token")
    n = F.col("event_id")
    payload = F.when((F.col("event_type") == "purchase") & (n % 2 == 0), F.concat(F.lit("own "), n.cast("string"))).when(F.col("event_type") == "purchase", "").otherwise(F.col("event_type"))
    return S.assemble_tokens(t("events").select(F.col("user_id").alias("message_id"), n.alias("seq"), kind.alias("kind"), payload.alias("payload")))


@query("q_stream_frames", """SELECT event_id, CASE event_id % 5 WHEN 2 THEN 'token' WHEN 3 THEN 'done' WHEN 4 THEN 'error' END AS kind, CASE event_id % 5 WHEN 2 THEN event_type WHEN 3 THEN CASE WHEN event_id % 2 = 0 THEN 'whole' ELSE '' END WHEN 4 THEN 'bad' END AS payload FROM events WHERE event_id % 5 > 1""")
def q_stream_frames(t):
    """Frames as text: null, empty, a token, the end (with or without an answer), an error."""
    n = F.col("event_id")
    text = F.when(n % 5 == 0, F.lit(None)).when(n % 5 == 1, "").when(n % 5 == 2, F.to_json(F.struct(F.col("event_type").alias("token")))).when(n % 5 == 3, F.when(n % 2 == 0, '{"done": true, "answer": "whole"}').otherwise('{"done": true}')).otherwise('{"error": "bad"}')
    return S.read_frames(t("events").select("event_id", text.alias("data"))).select("event_id", "kind", "payload")
