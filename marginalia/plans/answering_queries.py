"""Queries over the whole way from questions to answers, and over its parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.operators import answering as A
from marginalia.operators import ingest, sparse_index
from marginalia.plans import evidence_queries, table_queries
from marginalia.plans.analysis_queries import questions
from marginalia.plans.registry import query, stored
from marginalia.sources.scratch import exists, remove_path, scratch_path

_INDEXES: dict[tuple, str] = {}


def index(t):
    """Rows of an index: each nation's guide and its table of customers, with the facts of the tables."""
    tables = table_queries.chunks(t).select(F.split_part("chunk_id", F.lit("_"), F.lit(1)).cast("long").alias("document_id"), F.lit(0).alias("chunk_index"), "text", "path")
    guides = evidence_queries.guides(t).select(F.col("cid").cast("long").alias("document_id"), F.lit(1).alias("chunk_index"), "text", F.lit("안내").alias("path"))
    chunks = tables.unionByName(guides).withColumn("source", F.concat(F.lit("nation "), F.col("document_id").cast("string")))
    page = F.col("document_id") % 4 + 1
    return ingest.index_rows(chunks.withColumn("page_start", F.when(page > 1, page)).withColumn("page_end", F.when(page > 2, page + F.col("chunk_index"))))


def _retrieval(spark, sf_dir):
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    key = (spark.sparkContext.applicationId, sf_dir)
    if not exists(spark, _INDEXES.get(key, "/no index")):  # built once, as documents are written
        folder = scratch_path(spark, "answers")
        index(read).write.parquet(f"{folder}/rows")
        raw = spark.read.parquet(f"{folder}/rows").where("chunk_role = 'raw'")
        sparse_index.build(raw.select("chunk_id", A.search_text(F.col("text"), F.col("path")).alias("text")), f"{folder}/sparse", key="chunk_id")
        for known in [k for k in _INDEXES if k[0] == key[0]]:  # of another folder of tables
            remove_path(spark, _INDEXES.pop(known))
        _INDEXES[key] = folder
    rows = spark.read.parquet(f"{_INDEXES[key]}/rows")
    asked = questions(read).select("qid", "text").where("text <> ''")
    return asked, A.searched(spark, asked, rows, f"{_INDEXES[key]}/sparse")


@stored("q_retrieve")
def q_retrieve(spark, sf_dir):
    """Its steps have SQL each; tests hold the whole against a plain walk through them."""
    return _retrieval(spark, sf_dir)[1].final.select("qid", "pos", "result_id", "total", "fact_score", F.size("found").alias("found"), "selected")


@stored("q_answer")
def q_answer(spark, sf_dir):
    asked, result = _retrieval(spark, sf_dir)
    rows = A.answered(asked, result)
    return rows.select("qid", F.md5("answer").alias("digest"), F.transform("sources", lambda s: s["chunk_id"]).alias("chunk_ids"))


@stored("q_trace")
def q_trace(spark, sf_dir):
    return A.trace(_retrieval(spark, sf_dir)[1]).select("stage", "qid", "pos", "result_id", "total", F.array_join("methods", "|").alias("methods"), "selected_for_prompt")


_HITS = "SELECT user_id AS qid, event_id % 3 AS source, CAST(event_id AS INTEGER) AS rank, concat('c', CAST(event_id % 70 AS VARCHAR)) AS chunk_id, CASE WHEN event_id % 2 = 0 THEN 'table_fact' ELSE 'raw' END AS chunk_role, CASE WHEN event_id % 4 = 0 THEN concat('c', CAST(event_id % 30 AS VARCHAR)) END AS parent_id, value FROM events"


@query("q_provenance", f"""WITH h AS (SELECT *, CASE WHEN chunk_role = 'table_fact' AND parent_id IS NOT NULL THEN parent_id ELSE chunk_id END AS key FROM ({_HITS}))
SELECT qid, key, array_to_string(list_filter([CASE WHEN bool_or(source = 2) THEN 'vector' END, CASE WHEN bool_or(source = 1) THEN 'bm25' END, CASE WHEN bool_or(source = 0) THEN 'table_fact_lexical' END], lambda x: x IS NOT NULL), '|') AS methods,
min(CASE WHEN source = 2 THEN rank END) AS vector_rank, min(CASE WHEN source = 1 THEN rank END) AS bm25_rank, min(CASE WHEN source = 0 THEN rank END) AS table_fact_lexical_rank, arg_min(CASE WHEN source = 1 THEN value END, CASE WHEN source = 1 THEN rank END) AS bm25_value FROM h GROUP BY qid, key""")
def q_provenance(t):
    n = F.col("event_id")
    key = lambda of: F.concat(F.lit("c"), (n % of).cast("string"))
    rows = t("events").select(F.col("user_id").alias("qid"), (n % 3).cast("int").alias("source"), n.cast("int").alias("rank"), key(70).alias("chunk_id"), F.when(n % 2 == 0, "table_fact").otherwise("raw").alias("chunk_role"), F.when(n % 4 == 0, key(30)).alias("parent_id"), "value")
    return A.provenance(rows).select("qid", "key", F.array_join("methods", "|").alias("methods"), "vector_rank", "bm25_rank", "table_fact_lexical_rank", "bm25_value")


@query("q_context_blocks", """SELECT doc_id, concat('[출처 ', CAST(doc_id AS VARCHAR), ']', chr(10), '문서: ', CASE WHEN doc_id % 3 = 0 THEN '알 수 없는 문서' ELSE source END,
CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 5 IN (1, 2) THEN concat(chr(10), '위치: PDF ', CAST(doc_id % 5 AS VARCHAR), '페이지') ELSE concat(chr(10), '위치: PDF ', CAST(doc_id % 5 AS VARCHAR), '-', CAST(doc_id % 5 + 1 AS VARCHAR), '페이지') END,
chr(10), '청크: 문서 내 ', CAST(CASE WHEN doc_id % 2 = 0 THEN doc_id + 1 ELSE 8 END AS VARCHAR), '번째 청크', CASE WHEN doc_id % 4 = 0 THEN '' ELSE concat(chr(10), '섹션: ', lang) END,
CASE WHEN doc_id % 6 < 2 THEN '' ELSE concat(chr(10), '표 검색 정보:', chr(10), 'f1', chr(10), 'f2') END, CASE WHEN doc_id % 7 < 2 THEN '' ELSE concat(chr(10), '질문 의도 추출 정보:', chr(10), '- e') END, CASE WHEN doc_id % 2 = 0 THEN concat(chr(10), '질문 관련 발췌:', chr(10), 'ex') ELSE '' END, chr(10), '전체 내용:', chr(10), trim(left(text, 40))) AS block FROM documents""")
def q_context_blocks(t):
    n, none = F.col("doc_id"), F.array().cast("array<string>")
    return t("documents").select(
        "doc_id",
        A.context_block({
            "pos": n, "source": F.when(n % 3 != 0, F.col("source")), "page_start": F.when(n % 5 > 0, n % 5), "page_end": F.when(n % 5 == 1, n % 5).when(n % 5 > 2, n % 5 + 1), "chunk_index": F.when(n % 2 == 0, n), "chunk_id": F.lit("9_7"),
            "path": F.when(n % 4 != 0, F.col("lang")), "matched": F.when(n % 6 < 2, none).otherwise(F.array(F.lit("f1"), F.lit("f2"))), "found": F.when(n % 7 < 2, none).otherwise(F.array(F.lit("- e"))), "excerpt": F.when(n % 2 == 0, "ex"), "text": F.left("text", F.lit(40)),
        }).alias("block"),
    )


@query("q_answer_frames", r"""WITH w AS (SELECT conv_id * 1000 + turn AS qid, conv_id, text, CASE WHEN conv_id % 4 = 0 THEN [] ELSE regexp_extract_all(text, '[^\s]*\s|[^\s]+') END AS ws FROM conversations), e AS (SELECT qid, unnest(ws) AS payload, generate_subscripts(ws, 1) AS seq FROM w)
SELECT qid, CAST(seq AS INTEGER) AS seq, 'token' AS kind, payload FROM e UNION ALL SELECT qid, CAST(len(ws) + 1 AS INTEGER), 'done', CASE WHEN conv_id % 4 = 0 THEN text ELSE '' END FROM w""")
def q_answer_frames(t):
    sources = F.when(F.col("conv_id") % 4 == 0, F.array().cast("array<int>")).otherwise(F.array(F.lit(1)))
    return A.frames(t("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), F.col("text").alias("answer"), sources.alias("sources")))


@query("q_search_text", "SELECT doc_id, md5(CASE WHEN doc_id % 3 = 0 THEN text ELSE concat(source, chr(10), source, chr(10), text) END) AS digest FROM documents")
def q_search_text(t):
    return t("documents").select("doc_id", F.md5(A.search_text(F.col("text"), F.when(F.col("doc_id") % 3 != 0, F.col("source")))).alias("digest"))
