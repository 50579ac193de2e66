"""Nulls, empty tables and texts, ties and repeated rows through the engine's operators."""

import datetime

from pyspark.sql import functions as F

from marginalia.operators import analysis, answering, bridge, evidence, hits, ingest, relational, sparse_index, splitting, table_facts
from marginalia.sources import files
from marginalia.streaming import sessions


def test_questions_without_text(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "모집인원은 몇명인가요"), (3, "모집인원은 몇명인가요")], "qid int, text string")
    got = analysis.analyzed(rows).orderBy("qid").collect()
    assert [r["intent"] for r in got] == [None, None, "count", "count"] and got[0]["context_terms"] == [] and analysis.analyzed(rows.limit(0)).count() == 0
    terms = rows.select("qid", analysis.lexical_terms(F.col("text")).alias("t"), analysis.asks_table_value(F.col("text")).alias("v")).collect()
    assert {r["qid"]: r["v"] for r in terms} == {1: False, 2: False, 3: True}


def test_tables_without_separator_rows_or_text(spark):
    texts = [None, "", "| a | b |", "|---|---|\n| 1 | 2 |", "| a | b |\n|---|---|", "| 이름 | 수 |\n|---|---|\n| x | 1 |\n| | 2 |\n| - | - |\n| x | 1 |", "t\n| 이름 | |\n|---|---|\n| y | 3 | 4 |"]
    rows = spark.createDataFrame([(str(i), t, None) for i, t in enumerate(texts)], "chunk_id string, text string, path string")
    got = {(r["chunk_id"], r["fact_index"]): r["fact"] for r in table_facts.facts(rows).collect()}
    assert got == {
        ("5", 0): "문서 표: x 행 정보는 이름=x; 수=1이다.",  # the repeated row counts once
        ("5", 1): "문서 표: x 행 정보는 이름=x; 수=2이다.",  # the cell above fills the empty one
        ("6", 0): "t: y 행 정보는 이름=y; 이름=3; 이름=4이다.",  # a header cell goes on over empty ones
    }
    assert table_facts.facts(rows.limit(0)).count() == 0 and table_facts.facts(rows, most=1).count() == 2


def test_evidence_without_intent_or_lines(spark):
    rows = spark.createDataFrame([(1, None, [], [], []), (2, "list", [], [], ["x"]), (3, "location", ["a"], ["a"], [])], "i int, intent string, p array<string>, s array<string>, c array<string>")
    lines, none = F.array().cast("array<string>"), F.lit(None).cast("array<string>")
    found = evidence.evidence_lines(lines, none, F.col("intent"), F.col("p"), F.col("s"), F.col("c"))
    got = rows.select(F.size(found).alias("n"), evidence.evidence_score(found, none, F.col("intent")).alias("score"), evidence.excerpt(lines, F.col("p")).alias("e"), bridge.attribute_terms(F.col("intent"), F.col("c")).alias("t")).collect()
    assert [(r["n"], r["score"], r["e"]) for r in got] == [(0, 0, None)] * 3 and got[0]["t"] == []


def test_hits_of_empty_tables_and_ties(spark):
    vectors = spark.createDataFrame([(3, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (4, None), (5, [1.0]), (6, [None, 1.0])], "chunk_id int, embedding array<double>")
    asked = spark.createDataFrame([(7, [1.0, 0.0]), (8, None)], "qid int, embedding array<double>")
    assert [(r["chunk_id"], r["rank"]) for r in hits.nearest(vectors, asked, 2).orderBy("rank").collect()] == [(2, 1), (3, 2)]
    assert hits.nearest(vectors, asked.where("qid = 8"), 2).count() == 0 and hits.nearest(vectors.limit(0), asked, 2).count() == 0
    facts = spark.createDataFrame([("a", 1, "korea 모집인원=3명"), ("b", 2, "korea 모집인원=3명"), ("c", 3, None), ("d", 4, "other")], "chunk_id string, place long, text string")
    questions = spark.createDataFrame([(1, "korea 모집인원"), (2, "모집인원"), (3, None)], "qid int, text string")
    assert [(r["qid"], r["chunk_id"], r["score"]) for r in hits.facts_by_words(facts, questions).orderBy("rank").collect()] == [(1, "a", 16), (1, "b", 16)]


def test_an_empty_sparse_index_finds_nothing(spark, tmp_path):
    docs = spark.createDataFrame([(1, None), (2, "!")], "doc_id long, text string")
    sparse_index.build(docs, f"file://{tmp_path}/none")
    asked = spark.createDataFrame([(1, "word")], "qid int, text string")
    assert sparse_index.search(spark, f"file://{tmp_path}/none", asked, 3).count() == 0
    sparse_index.build(spark.createDataFrame([(5, "word"), (4, "word"), (6, "other word")], "doc_id long, text string"), f"file://{tmp_path}/some")
    assert [(r["key"], r["rank"]) for r in sparse_index.search(spark, f"file://{tmp_path}/some", asked, 2).orderBy("rank").collect()] == [(4, 1), (5, 2)]


def test_parts_without_text_give_no_chunks(spark):
    rows = spark.createDataFrame([(1, 0, None, None, "s"), (1, 1, None, " \n", "s")], "document_id long, ordinal int, page long, text string, source string")
    assert ingest.ingested(rows).count() == 0 and splitting.split(rows.limit(0)).count() == 0


def test_ingest_works_its_parts_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    text = "# A\n| N | V |\n|---|---|\n| x | 1 |\nline of text"
    rows = spark.createDataFrame([(d, o, o + 1, text, "s") for d in (1, 2) for o in (0, 1)], "document_id long, ordinal int, page long, text string, source string")
    got = ingest.ingested(rows.mapInArrow(count, rows.schema)).select("document_id", "chunk_role", "source", "path").distinct().collect()
    assert seen.value == 4 and sorted(map(tuple, got)) == [(d, role, "s", "A") for d in (1, 2) for role in ("raw", "table_fact")]


def test_answers_without_hits(spark):
    questions = spark.createDataFrame([(1, "korea 모집인원"), (2, "nothing")], "qid int, text string")
    index = spark.createDataFrame(
        [("1_0", "raw", None, None, "# korea\nkorea: 모집인원 3명", "korea", "s", 1, 2, 0, 1), ("1_0_fact_0", "table_fact", "1_0", None, "t: korea 행 정보는 모집인원=3명이다.", "korea", "s", 1, 2, 0, 1)],
        "chunk_id string, chunk_role string, parent_chunk_id string, parent_content string, text string, path string, source string, page_start int, page_end int, chunk_index int, document_id long",
    ).withColumn("fact_index", F.when(F.col("chunk_role") == "table_fact", 0))
    found = {answering.FACT_HIT: hits.facts_by_words(index.where("chunk_role = 'table_fact'").select("chunk_id", F.lit(0).alias("place"), "text"), questions)}
    result = answering.retrieve(questions, index, found)
    got = {r["qid"]: r for r in answering.answered(questions, result).collect()}
    assert got[2]["answer"] == answering.NO_ANSWER and got[2]["sources"] == []
    assert got[1]["answer"].startswith("- korea") and [s["chunk_id"] for s in got[1]["sources"]] == ["1_0"]
    context = answering.contexts(result.final).first()["context"]
    assert context.startswith("[출처 1]\n문서: s\n위치: PDF 1-2페이지\n청크: 문서 내 1번째 청크\n섹션: korea\n표 검색 정보:\nt: korea") and context.endswith("korea: 모집인원 3명")
    stages = {r["stage"] for r in answering.trace(result).collect()}
    assert stages == {"expanded", "prioritized", "focused", "final"}
    frames = answering.frames(answering.answered(questions, result)).where("qid = 2").collect()
    assert [(r["seq"], r["kind"], r["payload"]) for r in frames] == [(1, "done", answering.NO_ANSWER)]


def test_metadata_of_empty_tables(spark):
    at = F.lit(datetime.datetime(2024, 1, 1)).cast("timestamp_ntz")
    prompts = spark.createDataFrame([], "id long, text string, updated_by long, updated_at timestamp_ntz")
    assert [(r["id"], r["text"]) for r in relational.prompt_updated(prompts, "p", 3, at).collect()] == [(1, "p")]
    feedback = spark.createDataFrame([], "message_id long, score int, updated_at timestamp_ntz")
    assert tuple(relational.feedback_statistics(feedback).first()) == (0, 0, 0, 0.0)
    rows = spark.createDataFrame([(1, "a")], "id int, name string")
    after, refused = relational.inserted(rows, spark.createDataFrame([(2, "a"), (3, None), (4, "b"), (5, "b")], "id int, name string"), "name")
    assert sorted(r["id"] for r in after.collect()) == [1, 4] and sorted(r["id"] for r in refused.collect()) == [2, 3, 5]
    requests = spark.createDataFrame([(1, None, None), (2, None, None), (3, None, "k"), (4, None, "k"), (5, 9, "k")], "request_id int, user_id int, session_key string")
    none = spark.createDataFrame([], "session_id int, session_key string")
    assert sorted((r["request_id"], r["new_key"]) for r in relational.got_or_created(requests, none).collect()) == [(1, 1), (2, 2), (3, 3), (4, 3), (5, 5)]
    documents = spark.createDataFrame([(1, True, "PROCESSING"), (2, False, "PROCESSING"), (3, True, "PROCESSING"), (4, True, None)], "id int, is_active boolean, status string")
    ended = spark.createDataFrame([(1, True), (2, True), (3, False)], "id int, ok boolean")
    assert [r["status"] for r in sessions.with_outcomes(documents, ended).orderBy("id").collect()] == ["READY", "PROCESSING", "FAILED", None]


def test_a_batch_of_answers_that_comes_again_replaces_itself(spark, tmp_path):
    sink, path = sessions.answer_sink(str(tmp_path / "answers")), str(tmp_path / "answers")
    batch = lambda rows: spark.createDataFrame(rows, "message_id int, answer string, status string")
    sink(batch([(1, "a", "complete")]), 0)
    sink(batch([(1, "late", "error"), (2, "b", "partial")]), 1)
    sink(batch([(1, "late", "error"), (2, "b", "partial")]), 1)
    assert sorted(tuple(r) for r in sessions.stored_answers(spark, path).collect()) == [(1, "a", "complete"), (2, "b", "partial")]


def test_files_without_a_parser_are_told_apart(spark, tmp_path):
    (tmp_path / "a.md").write_text("# x")
    (tmp_path / "b.pdf").write_bytes(b"%PDF")
    (tmp_path / "c.html").write_text("<h1>T</h1><p>text</p>")
    (tmp_path / "d.txt").write_bytes(b"x" * 2000)
    read = files.read_files(spark, str(tmp_path), most_bytes=1000)
    parsed = {r["path"][-4:]: r["text"] for r in files.parse_files(read).collect()}
    assert parsed == {"a.md": "# x", "html": "# T\ntext"}
    assert sorted((r["path"][-5:], r["reason"]) for r in files.refused_files(read).collect()) == [("b.pdf", "no parser"), ("d.txt", "too large")]
