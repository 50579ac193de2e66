"""Metadata as tables: documents, categories, sessions, messages, feedback, prompts. Changes give the table as it is after them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCORES = (-1, 1)
TITLE_CHARS, MOST_RESULTS = 50, 20
MIME_TYPES = (
    "application/pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
)


def _latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("nth_latest", nth).where("nth_latest = 1").drop("nth_latest")


def active_documents(documents: DataFrame, categories: DataFrame) -> DataFrame:
    """Active documents with their category's name (null: none) and their status (null: READY), the newest first."""
    names = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category"))
    rows = documents.where("is_active").join(names, "category_id", "left").withColumn("status", F.coalesce("status", F.lit("READY")))
    return rows.orderBy(F.desc("created_at"), F.desc("id"))


def one_by(rows: DataFrame, column: str, value: object) -> DataFrame:
    """The rows whose ``column`` equals a value; a null value finds none."""
    return rows.where(F.col(column) == F.lit(value))


def reachable_sessions(sessions: DataFrame, user_id: int | None = None, session_key: str | None = None) -> DataFrame:
    """A user's sessions, else those of a key, else none; the last touched first."""
    mine = F.col("user_id") == user_id if user_id is not None else F.col("session_key") == session_key if session_key is not None else F.lit(False)
    return sessions.where(mine).orderBy(F.desc("updated_at"), F.desc("session_id"))


def with_owner(messages: DataFrame, sessions: DataFrame, user_id: int | None = None, session_key: str | None = None) -> DataFrame:
    """Messages with their session's owner and key, and whether a user (or a key) owns them. Messages without a session go."""
    owner = F.col("user_id") == user_id if user_id is not None else F.col("session_key") == session_key if session_key is not None else F.lit(False)
    return messages.join(sessions.select("session_id", "user_id", "session_key"), "session_id").withColumn("owned", F.coalesce(owner, F.lit(False)))


def with_feedback(messages: DataFrame, feedback: DataFrame) -> DataFrame:
    return messages.join(feedback.select("message_id", "score"), "message_id", "left")


def feedback_statistics(feedback: DataFrame) -> DataFrame:
    """One row: total, positive, negative, positive_rate (0 where there is none)."""
    counts = feedback.agg(F.count_if(F.col("score") == 1).alias("positive"), F.count_if(F.col("score") == -1).alias("negative"))
    total = F.col("positive") + F.col("negative")
    return counts.select(total.alias("total"), "positive", "negative", F.when(total == 0, 0.0).otherwise(F.col("positive") / total).alias("positive_rate"))


def feedback_upserted(feedback: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Feedback (message_id, score, updated_at) after changes of the same columns, and the changes that are refused: scores other
    than 1 and -1. A message has one score, the one that was given last."""
    valid = F.coalesce(F.col("score").isin(*SCORES), F.lit(False))
    every = feedback.select("message_id", "score", "updated_at", F.lit(0).alias("turn")).unionByName(changes.where(valid).select("message_id", "score", "updated_at", F.lit(1).alias("turn")))
    return _latest(every, ["message_id"], F.desc("turn"), F.desc("updated_at"), F.desc("score")).drop("turn"), changes.where(~valid)


def newest(rows: DataFrame, *order: str) -> DataFrame:
    """The row that is last by ``order``."""
    return rows.orderBy(*(F.desc(c) for c in order)).limit(1)


def prompt_updated(prompts: DataFrame, text: str, updated_by: int, at: Column) -> DataFrame:
    """Prompts (id, text, updated_by, updated_at) after an update: the newest row changes; without any, the first is added."""
    last = newest(prompts, "updated_at", "id").select(F.col("id").alias("last_id"))
    changed = prompts.join(F.broadcast(last), F.col("id") == F.col("last_id"), "left")  # one row
    is_last = F.col("last_id").isNotNull()
    rows = changed.select("id", F.when(is_last, F.lit(text)).otherwise(F.col("text")).alias("text"), F.when(is_last, F.lit(updated_by)).otherwise(F.col("updated_by")).cast("long").alias("updated_by"), F.when(is_last, at).otherwise(F.col("updated_at")).alias("updated_at"))
    none = prompts.agg(F.count("*").alias("n")).where("n = 0")
    return rows.unionByName(none.select(F.lit(1).cast("long").alias("id"), F.lit(text).alias("text"), F.lit(updated_by).cast("long").alias("updated_by"), at.alias("updated_at")))


def inserted(rows: DataFrame, new: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The table after rows are added whose ``key`` it lacks, and the rows that are refused. Of new rows with equal keys the first by
    their columns is added; a null key is refused."""
    known = rows.select(F.col(key).alias("known_key")).distinct()
    marked = new.join(known, F.col(key) == F.col("known_key"), "left").withColumn("nth_new", F.row_number().over(Window.partitionBy(key).orderBy(*new.columns)))
    fits = F.col(key).isNotNull() & F.col("known_key").isNull() & (F.col("nth_new") == 1)
    return rows.unionByName(marked.where(fits).select(*new.columns)), marked.where(~fits).select(*new.columns)


def cascade_deleted(sessions: DataFrame, messages: DataFrame, feedback: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sessions, messages and feedback after sessions (``ids``: session_id) are deleted with all that hangs on them."""
    doomed = messages.join(ids, "session_id", "left_semi").select("message_id")
    return sessions.join(ids, "session_id", "left_anti"), messages.join(ids, "session_id", "left_anti"), feedback.join(doomed, "message_id", "left_anti")


def touched(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Sessions whose updated_at is that of their last message, if it is later."""
    last = messages.groupBy("session_id").agg(F.max("created_at").alias("last_at"))
    return sessions.join(last, "session_id", "left").withColumn("updated_at", F.greatest("updated_at", "last_at")).drop("last_at")


def soft_deleted(documents: DataFrame, index: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents of which those of ``ids`` (id) aren't active any more, and the index without their rows."""
    gone = ids.select(F.col("id").alias("gone_id")).distinct()
    rows = documents.join(gone, F.col("id") == F.col("gone_id"), "left").withColumn("is_active", F.col("is_active") & F.col("gone_id").isNull()).drop("gone_id")
    return rows, index.join(gone, F.col("document_id") == F.col("gone_id"), "left_anti")


def got_or_created(requests: DataFrame, sessions: DataFrame) -> DataFrame:
    """request_id, session_id (null: a new one), new_key: what session a request (request_id, user_id, session_key) goes to.

    A user's request, and one without a key, always gets a new session of its own (new_key: its request_id); other
    requests go to the session of their key, or, all of one key together, to a new one (new_key: their first request_id).
    """
    known = sessions.where("session_key IS NOT NULL").groupBy("session_key").agg(F.min("session_id").alias("session_id"))
    anonymous = F.col("user_id").isNull() & F.col("session_key").isNotNull()
    rows = requests.join(known, "session_key", "left").withColumn("session_id", F.when(anonymous, F.col("session_id")))
    first = F.min("request_id").over(Window.partitionBy(anonymous, "session_key"))
    return rows.select("request_id", "session_id", F.when(F.col("session_id").isNull(), F.when(anonymous, first).otherwise(F.col("request_id"))).alias("new_key"))


def title(question: Column) -> Column:
    return F.left(F.trim(question), F.lit(TITLE_CHARS))


def enriched(sources: DataFrame, documents: DataFrame) -> DataFrame:
    """Sources (document_id as text) with the name, status, creation time (ISO, without a fraction of zero) of their document, if it is
    active. An id that isn't a number finds none."""
    iso = F.regexp_replace(F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"(\.\d*?)0+$", "$1")
    own = documents.where("is_active").select(F.col("id").alias("found_id"), F.col("name").alias("document_name"), F.coalesce("status", F.lit("READY")).alias("document_status"), F.regexp_replace(iso, r"\.$", "").alias("document_created_at"))
    return sources.join(own, F.col("document_id").try_cast("long") == F.col("found_id"), "left").drop("found_id")


def parsed_sources(text: Column) -> Column:
    """A JSON list of flat objects; null, blank and damaged texts give an empty list."""
    kind = "array<map<string,string>>"
    return F.coalesce(F.from_json(F.when(F.trim(text).rlike(r"^\["), text), kind), F.array().cast(kind))


def shown_progress(status: Column, live: Column) -> Column:
    """struct(percent, status): what is stored about a document comes before what is told of its processing."""
    stored = F.coalesce(status, F.lit("READY"))
    percent = F.when(stored.isin("READY", "FAILED"), 100).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(live, F.lit(0)))))
    return F.struct(percent.cast("int").alias("percent"), F.when(stored == "READY", "completed").when(stored == "FAILED", "failed").otherwise("processing").alias("status"))


def validated(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests (question, top_k, mime_type; the last two may be null) that are valid, and the others with a reason."""
    reason = (
        F.when(F.coalesce(F.trim("question"), F.lit("")) == "", "question")
        .when(~F.coalesce(F.col("top_k").between(1, MOST_RESULTS), F.lit(True)), "top_k")
        .when(~F.coalesce(F.col("mime_type").isin(*MIME_TYPES), F.lit(True)), "mime_type")
    )
    rows = requests.withColumn("reason", reason)
    return rows.where("reason IS NULL").drop("reason"), rows.where("reason IS NOT NULL")


def _first_full(*columns: Column) -> Column:
    return F.coalesce(*(F.nullif(c.cast("string"), F.lit("")) for c in columns))


def source_groups(sources: DataFrame) -> DataFrame:
    """qid, key, first_seen, title, path, chunks: a question's sources (qid, pos from 0, document_id, original_name, source, filename,
    path, chunk_index) by document, as first seen; the path is the first that isn't empty.

    The key is the first of document_id, original_name, source and filename that isn't empty, else the source's own place.
    """
    key = _first_full(F.col("document_id"), F.col("original_name"), F.col("source"), F.col("filename"), F.concat(F.lit("source-"), F.col("pos").cast("string")))
    rows = sources.withColumn("key", key).withColumn("own_path", F.nullif("path", F.lit(""))).withColumn("own_title", source_title(F.col("original_name"), F.col("source"), F.lit(None), F.col("filename"), F.col("pos")))
    chunks = F.transform(F.array_sort(F.collect_list(F.struct("pos", "chunk_index"))), lambda x: x["chunk_index"])
    path = F.min(F.when(F.col("own_path").isNotNull(), F.struct("pos", "own_path")))["own_path"]
    return rows.groupBy("qid", "key").agg(F.min("pos").alias("first_seen"), F.min_by("own_title", "pos").alias("title"), path.alias("path"), chunks.alias("chunks"))


def source_title(original: Column, source: Column, name: Column, filename: Column, place: Column) -> Column:
    """What a source is called; without any name by its place (from 0)."""
    return _first_full(original, source, name, filename, F.concat(F.lit("참조 문서 "), (place + 1).cast("string")))


def _rounded(x: Column) -> Column:
    """Halves go up."""
    return F.floor(x + 0.5).cast("string")


def _one_decimal(x: Column) -> Column:
    """By the exact value of the double."""
    return F.replace(F.format_number(x, 1), F.lit(","), F.lit(""))


def size_label(size: Column) -> Column:
    """Bytes in KB, from a mebibyte on in MB with one decimal; a dash where there are none."""
    mib = 1024 * 1024
    return F.when(F.coalesce(size, F.lit(0)) <= 0, "-").when(size < mib, F.concat(_rounded(size / 1024), F.lit("KB"))).otherwise(F.concat(_one_decimal(size / mib), F.lit("MB")))


def duration_label(milliseconds: Column) -> Column:
    """Milliseconds, seconds with one decimal, or minutes and seconds; null where unknown or negative."""
    seconds = milliseconds / 1000
    long = F.concat(F.floor(seconds / 60).cast("string"), F.lit("분 "), F.lpad(_rounded(seconds % 60), 2, "0"), F.lit("초"))
    return F.when(milliseconds >= 0, F.when(milliseconds < 1000, F.concat(milliseconds.cast("string"), F.lit("ms"))).when(seconds < 60, F.concat(_one_decimal(seconds), F.lit("초"))).otherwise(long))


def percent_label(share: Column) -> Column:
    return F.coalesce(F.concat(_rounded(share * 100), F.lit("%")), F.lit("0%"))


def progress_ceiling(percent: Column, status: Column) -> Column:
    """How far a progress bar may run ahead before the next word of progress."""
    target = F.greatest(F.lit(0), F.least(F.lit(100), F.floor(F.coalesce(percent, F.lit(0)) + 0.5)))
    steps = ((95, 99), (90, 97), (70, 92), (30, 86), (18, 34), (5, 18))
    ceiling = F.when(status.isin("completed", "failed"), 100)
    for least, value in steps:
        ceiling = ceiling.when(target >= least, value)
    return ceiling.otherwise(F.greatest(target, F.lit(3))).cast("int")


def shown_time(iso: Column) -> Column:
    return F.coalesce(F.substring(F.replace(iso, F.lit("T"), F.lit(" ")), 1, 16), F.lit(""))
