"""Golden fixtures for folds, streams and file sources."""

import pandas as pd
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators import chunking, ranking, tables
from marginalia.sources import files
from marginalia.streaming import sessions


def test_merge_matches_a_plain_loop(spark):
    parts = [(1, i, h, "x" * n) for i, (h, n) in enumerate([("a", 100), ("a", 150), ("a", 400), ("b", 10), ("b", 795), ("b", 5), (None, 5), (None, 350), (None, 20)])]
    got = [(r["text"], r["merged_chunk_count"]) for r in chunking.merged(spark.createDataFrame(parts, "k int, pos int, h1 string, text string"), "k", "pos").orderBy("chunk_index").collect()]
    want, held = [], None
    for _, _, h, t in parts:
        h = h or ""
        if held and held[0] == h and len(held[1]) < 300 and len(held[1]) + 2 + len(t) <= 800:
            held = (h, held[1] + "\n\n" + t, held[2] + 1)
        else:
            if held:
                want.append(held[1:])
            held = (h, t, 1)
    assert got == [*want, held[1:]]


def test_overlap_takes_whole_lines_and_stops_at_tables(spark):
    rows = [("a\n" + "b" * 60 + "\n" + "c" * 10,), ("z" * 100,), ("x\n| a | b |",), ("",)]
    got = [r[0] for r in spark.createDataFrame(rows, "text string").select(F.coalesce(chunking.overlap_tail(F.col("text")), F.lit(""))).collect()]
    assert got == ["a\n" + "b" * 60 + "\n" + "c" * 10, "z" * 80, "", ""]


def test_table_predicates_and_labels(spark):
    row = spark.range(1).select(
        chunking.is_table_row(F.lit("| a | b |")).alias("row"), chunking.is_table_separator(F.lit("|---|:-:|")).alias("no"), chunking.is_table_separator(F.lit("|:---|---:|")).alias("yes"),
        tables.column_labels(F.array(F.lit("A"), F.lit(""), F.lit("B")), F.array(F.lit("x"), F.lit("y"), F.lit("B"))).alias("labels"),
    ).first()
    assert (row["row"], row["no"], row["yes"], row["labels"]) == (True, False, True, ["A x", "A y", "B"])


def test_normalisation_of_unicode_space(spark):
    got = spark.range(1).select(T.collapse_space(F.lit(" a　 b \n")).alias("a"), T.normalize_text(F.lit("가\n\n\n나\n\n\n\nx")).alias("b")).first()
    assert (got["a"], got["b"]) == ("a b", "가나\n\nx")


def test_sessions_are_single_use_and_expire(spark, tmp_path):
    at = pd.Timestamp("2024-01-01")
    rows = [("a", "save", "q1", 0), ("a", "consume", None, 29), ("a", "consume", None, 29.5), ("b", "save", "q2", 0), ("b", "consume", None, 30), ("c", "consume", None, 1)]
    pdf = pd.DataFrame([(s, o, q, at + pd.Timedelta(seconds=t)) for s, o, q, t in rows], columns=["stream_id", "op", "question", "ts"])
    schema = "stream_id string, op string, question string, ts timestamp"
    spark.createDataFrame(pdf, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = sessions.consume_sessions(stream).writeStream.format("memory").queryName("consumed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r["stream_id"], r["ok"], r["question"]) for r in spark.table("consumed").collect())
    assert got == [("a", False, None), ("a", True, "q1"), ("b", False, None), ("c", False, None)] or sorted(got, key=str) == sorted([("a", True, "q1"), ("a", False, None), ("b", False, None), ("c", False, None)], key=str)


def test_token_streams(spark):
    frames = [(1, 1, "token", "a"), (1, 2, "token", "b"), (1, 3, "done", ""), (1, 4, "token", "x"), (2, 1, "token", "a"), (2, 2, "disconnect", None), (3, 1, "token", "t"), (3, 2, "done", "own"), (4, 1, "error", None), (5, 1, "disconnect", None)]
    got = {r["message_id"]: (r["answer"], r["status"]) for r in sessions.assemble_tokens(spark.createDataFrame(frames, "message_id int, seq int, kind string, payload string")).collect()}
    assert got == {1: ("ab", "complete"), 2: ("a", "partial"), 3: ("own", "complete"), 4: ("The answer could not be completed.", "error"), 5: (None, "none")}


def test_files_are_read_parsed_and_rewritten(spark, tmp_path):
    (tmp_path / "a.md").write_text("# x\ny")
    (tmp_path / "b.exe").write_text("no")
    parsed = files.parse_files(files.read_files(spark, str(tmp_path)))
    assert [(r["ordinal"], r["page"], r["text"]) for r in parsed.collect()] == [(0, None, "# x\ny")]
    chunks = parsed.select(F.lit(7).cast("long").alias("document_id"), "text")
    for _ in range(2):
        files.write_chunks(chunks, str(tmp_path / "chunks"))
    assert spark.read.parquet(str(tmp_path / "chunks")).count() == 1


def test_expanded_hits_take_the_first_place_and_keep_facts_in_order(spark):
    hits = [
        (1, 0, 1, "p_fact_0", "p", None, "f0"), (1, 0, 2, "o_fact_0", "o", None, "orphan"), (1, 0, 3, "s_fact_0", "s", "kept", "f2"),
        (1, 1, 1, "p", None, None, "raw p"), (1, 2, 1, "p_fact_1", "p", None, "f1"), (1, 2, 2, "p_fact_0", "p", None, "f0"), (1, 2, 3, "z", None, None, "raw z"),
    ]
    df = spark.createDataFrame(hits, "qid int, source int, rank int, chunk_id string, parent_id string, parent_text string, text string")
    got = ranking.expanded(df, spark.createDataFrame([("p", "raw p"), ("z", "raw z")], "chunk_id string, text string")).orderBy("pos").collect()
    assert [(r["result_id"], r["text"], r["facts"]) for r in got] == [("p", "raw p", ["f0", "f1"]), ("o_fact_0", "orphan", ["orphan"]), ("s", "kept", ["f2"]), ("z", "raw z", [])]
    assert ranking.expanded(df.limit(0), df.select("chunk_id", "text")).count() == 0


def test_priority_keeps_all_where_nothing_scores(spark):
    rows = [(1, 1, 0), (1, 2, 0), (2, 1, 0), (2, 2, 20), (3, 1, 24), (3, 2, 25), (3, 3, 40), (4, 1, 19), (4, 2, 0)]
    got = ranking.prioritized(spark.createDataFrame(rows, "qid int, pos long, score int")).orderBy("qid", "pos").collect()
    assert [(r["qid"], r["score"]) for r in got] == [(1, 0), (1, 0), (2, 20), (3, 40), (3, 25), (4, 19), (4, 0)]


def test_subject_scores_of_empty_and_null_texts(spark):
    score = ranking.subject_score(F.col("t"), ["red car"], ["red", "car"], ["red"])
    got = [r[0] for r in spark.createDataFrame([("red car",), ("RED-CAR",), ("red",), ("",), (None,)], "t string").select(score).collect()]
    assert got == [24 + 3 + 12 + 20, 24 + 3 + 12 + 20, 3, 0, 0]
