"""Streaming operators: single-use sessions that expire, token streams, latest progress."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def consume_sessions(commands: DataFrame, ttl_seconds: float = 30.0) -> DataFrame:
    """stream_id, ts, ok, question for every ``consume`` in a stream of commands (stream_id, op, question, ts).

    A session can be consumed once, and only before its time to live has passed (the last moment is too late). Saving again
    starts anew. The cap on open sessions of a single process isn't kept: state is per stream_id.
    """
    limit = int(ttl_seconds * 1e6)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = state.get if state.exists else None
        out = []
        for row in pd.concat(list(frames)).sort_values(["ts", "op"], ascending=[True, False]).itertuples():
            at = row.ts.value // 1000
            if row.op == "save":
                held = (row.question, at)
            elif row.op == "consume":
                ok = held is not None and at < held[1] + limit
                out.append((key[0], row.ts, ok, held[0] if ok else None))
                held = None
        if held is None:
            if state.exists:
                state.remove()
        else:
            state.update(held)
            state.setTimeoutDuration(max(1, int(ttl_seconds * 1000)))
        yield pd.DataFrame(out, columns=["stream_id", "ts", "ok", "question"])

    return commands.groupBy("stream_id").applyInPandasWithState(step, "stream_id string, ts timestamp, ok boolean, question string", "question string, saved long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def assemble_tokens(frames: DataFrame) -> DataFrame:
    """message_id, answer, status from frames (message_id, seq, kind, payload) in batch form.

    Tokens up to the first end count. ``done`` answers with its payload, if it has one, else with the tokens;
    ``error`` with a fixed text; ``disconnect`` or no end with the tokens as a partial answer, if there are any.
    """
    end = F.min(F.when(F.col("kind") != "token", F.struct("seq", "kind", "payload")))
    ends = frames.groupBy("message_id").agg(end.alias("end"))
    kept = frames.join(ends, "message_id").where((F.col("kind") == "token") & (F.col("end").isNull() | (F.col("seq") < F.col("end.seq"))))
    tokens = kept.groupBy("message_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "payload"))), lambda r: r["payload"]), "").alias("tokens"))
    joined = ends.join(tokens, "message_id", "left").withColumn("tokens", F.coalesce("tokens", F.lit("")))
    kind, own = F.col("end.kind"), F.col("end.payload")
    answer = F.when(kind == "done", F.coalesce(F.nullif(own, F.lit("")), F.col("tokens"))).when(kind == "error", F.lit("The answer could not be completed.")).otherwise(F.nullif(F.col("tokens"), F.lit("")))
    status = F.when(kind == "done", "complete").when(kind == "error", "error").when(F.col("tokens") != "", "partial").otherwise("none")
    return joined.select("message_id", answer.alias("answer"), status.alias("status"))


def latest_progress(updates: DataFrame) -> DataFrame:
    """document_id, percent (0 to 100), stage, status: the last update wins. Works on batches and, in update mode, on streams."""
    last = F.max_by(F.struct(F.greatest(F.lit(0), F.least(F.lit(100), F.col("percent"))).alias("percent"), "stage", "status"), "updated_at")
    return updates.groupBy("document_id").agg(last.alias("last")).select("document_id", "last.percent", "last.stage", "last.status")


def progress_of(asked: DataFrame, progress: DataFrame) -> DataFrame:
    """The progress of the documents of ``asked`` (document_id); of one of which nothing is told, 0 and unknown."""
    told = asked.select("document_id").join(progress, "document_id", "left")
    return told.select("document_id", F.coalesce("percent", F.lit(0)).alias("percent"), F.coalesce("stage", F.lit("unknown")).alias("stage"), F.coalesce("status", F.lit("unknown")).alias("status"))


def consumed(commands: DataFrame, ttl_seconds: float = 30.0) -> DataFrame:
    """``consume_sessions`` in batch form, from commands (stream_id, op, question, ts, seq: their order at equal times): a session that
    was saved right before, and hasn't expired."""
    w = Window.partitionBy("stream_id").orderBy("ts", "seq")
    rows = commands.withColumn("last", F.lag(F.struct("op", "ts", "question")).over(w)).where("op = 'consume'")
    open_until = F.col("last.ts") + F.make_dt_interval(secs=F.lit(ttl_seconds).cast("decimal(18,6)"))
    ok = F.coalesce((F.col("last.op") == "save") & (F.col("ts") < open_until), F.lit(False))
    return rows.select("stream_id", "ts", ok.alias("ok"), F.when(ok, F.col("last.question")).alias("question"))


def read_frames(frames: DataFrame) -> DataFrame:
    """``frames`` with kind and payload of their data (JSON text): a token, the end with its answer if it has one, an error. Frames
    without data, and those that are none of these, go."""
    field = lambda name: F.get_json_object("data", f"$.{name}")
    full = lambda c: F.coalesce(c != "", F.lit(False))
    kind = F.when(full(field("token")), "token").when(F.coalesce(field("done") == "true", F.lit(False)), "done").when(full(field("error")), "error")
    payload = F.when(kind == "token", field("token")).when(kind == "done", F.coalesce(field("answer"), F.lit(""))).otherwise(field("error"))
    return frames.where("data IS NOT NULL AND data <> ''").withColumn("kind", kind).withColumn("payload", payload).where("kind IS NOT NULL").drop("data")


def with_outcomes(documents: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Documents (id, is_active, status, ...) after the end of their processing (id, ok): READY or FAILED, if they are still active."""
    ended = outcomes.groupBy("id").agg(F.max_by("ok", "at").alias("ok")) if "at" in outcomes.columns else outcomes.select("id", "ok")
    rows = documents.join(ended, "id", "left")
    return rows.withColumn("status", F.when(F.col("is_active") & F.col("ok").isNotNull(), F.when(F.col("ok"), "READY").otherwise("FAILED")).otherwise(F.col("status"))).drop("ok").select(*documents.columns)


def answer_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A sink for micro-batches of answers (message_id, answer, status): a batch that comes again replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch-{batch_id:012d}")

    return write


def stored_answers(spark: SparkSession, path: str) -> DataFrame:
    """The first answer that was stored for each message: later ends of a message don't count."""
    rows = spark.read.parquet(f"{path}/batch-*")
    nth = F.row_number().over(Window.partitionBy("message_id").orderBy("batch_id"))
    return rows.withColumn("nth", nth).where("nth = 1").drop("nth", "batch_id")


def ingest_stream(files: DataFrame, process: Callable[[DataFrame, int], None], checkpoint: str):
    """Hands each micro-batch of a stream of files to ``process(batch, batch_id)`` once; the checkpoint is the queue."""
    return files.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
