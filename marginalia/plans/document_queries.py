"""Queries over documents and pages: text, statistics, retrieval, chunks, tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators import chunking, retrieval, sparse_index, stats, tables
from marginalia.plans.registry import query, stored

_PART = "|".join(T.PARTICLES)
_TOK = f"list_filter(flatten(list_transform(regexp_extract_all(lower({{0}}), '[0-9A-Za-z가-힣]+'), lambda r: list_distinct([r, regexp_replace(r, '(.)({_PART})$', '\\1')]))), lambda k: length(k) >= 2)"
_TERMS = f"list_filter(list_transform(regexp_extract_all({{0}}, '[0-9A-Za-z가-힣]+'), lambda r: regexp_replace(lower(r), '(.)({_PART})$', '\\1')), lambda k: length(k) >= 2)"


@query("q_normalize_text", r"SELECT doc_id, regexp_replace(regexp_replace(text, '([가-힣])\n{3,}([가-힣])', '\1\2', 'g'), '\n{3,}', E'\n\n', 'g') AS norm FROM documents")
def normalize_text(t):
    return t("documents").select("doc_id", T.normalize_text(F.col("text")).alias("norm"))


@query("q_compact", r"SELECT doc_id, CAST(length(c) AS BIGINT) AS n, md5(c) AS digest FROM (SELECT doc_id, regexp_replace(text, '\s+', '', 'g') AS c FROM documents)")
def compact(t):
    c = T.without_space(F.col("text"))
    return t("documents").select("doc_id", F.length(c).cast("long").alias("n"), F.md5(c).alias("digest"))


@query("q_preview", r"SELECT doc_id, CASE WHEN length(s) > 360 THEN concat(regexp_replace(left(s, 360), '\s+$', ''), '...') ELSE s END AS preview FROM (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS s FROM documents)")
def preview(t):
    return t("documents").select("doc_id", T.preview(F.col("text")).alias("preview"))


@query("q_search_form", "SELECT doc_id, md5(regexp_replace(lower(text), '[^0-9a-z가-힣]+', '', 'g')) AS digest FROM documents")
def search_form(t):
    return t("documents").select("doc_id", F.md5(T.search_form(F.col("text"))).alias("digest"))


_ASKED = ["The", "hand of", "e-mail", "license"]


@query("q_term_in_text", f"SELECT doc_id, array_to_string(list_filter({_ASKED}, lambda k: contains(lower(text), lower(k)) OR contains(regexp_replace(lower(text), '[^0-9a-z가-힣]+', '', 'g'), regexp_replace(lower(k), '[^0-9a-z가-힣]+', '', 'g'))), '|') AS terms FROM documents")
def term_in_text(t):
    found = F.filter(F.array(*(F.when(T.contains_term(F.col("text"), F.lit(k)), k) for k in _ASKED)), lambda k: k.isNotNull())
    return t("documents").select("doc_id", F.array_join(found, "|").alias("terms"))


@query("q_first_line", r"SELECT doc_id, coalesce(list_filter(list_transform(string_split(text, E'\n'), lambda x: trim(x)), lambda x: x <> '')[1], '') AS line FROM documents")
def first_line(t):
    return t("documents").select("doc_id", T.first_line(F.col("text")).alias("line"))


_LINES = r"SELECT doc_id, unnest(string_split(text, E'\n')) AS raw, generate_subscripts(string_split(text, E'\n'), 1) AS pos FROM documents"


@query("q_dedupe_lines", rf"WITH l AS (SELECT doc_id, pos, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS line FROM ({_LINES})), k AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM l) SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE before IS NOT DISTINCT FROM line AND line <> '') AS BIGINT) AS dropped FROM k GROUP BY doc_id")
def dedupe_lines(t):
    return stats.adjacent_duplicates(t("documents"), "doc_id")


@query("q_page_snippets", r"WITH p AS (SELECT doc_id, regexp_replace(text, '\s+', '', 'g') AS c FROM documents), q AS (SELECT doc_id, c, least(120, length(c)) AS n FROM p) SELECT doc_id, array_to_string(list_filter(list_transform(list_distinct([0, (length(c) - n) // 2, length(c) - n]), lambda s: substring(c, s + 1, n)), lambda x: length(x) >= 8).list_sort(), '|') AS snippets FROM q")
def page_snippets(t):
    return t("documents").select("doc_id", F.array_join(F.array_sort(T.page_snippets(F.col("text"))), "|").alias("snippets"))


@query("q_chunk_stats", "SELECT source, CAST(count(*) AS BIGINT) AS chunks, CAST(sum(length(text)) AS BIGINT) AS total, round(avg(length(text)), 6) AS mean, CAST(min(length(text)) AS BIGINT) AS least, CAST(quantile_disc(length(text), 0.5) AS BIGINT) AS p50, CAST(quantile_disc(length(text), 0.9) AS BIGINT) AS p90, CAST(max(length(text)) AS BIGINT) AS most, CAST(count(*) FILTER (WHERE length(text) < 300) AS BIGINT) AS short_chunks FROM documents GROUP BY source")
def chunk_stats(t):
    return stats.chunk_stats(t("documents"), "source")


@query("q_duplicate_lines", r"WITH l AS (SELECT trim(regexp_replace(raw, '\s+', ' ', 'g')) AS line FROM (" + _LINES + r")), c AS (SELECT line, count(*) AS n FROM l WHERE length(line) BETWEEN 8 AND 120 GROUP BY line) SELECT CAST(sum(n) AS BIGINT) AS candidates, CAST(count(*) FILTER (WHERE n > 1) AS BIGINT) AS repeated_lines, CAST(coalesce(sum(n - 1) FILTER (WHERE n > 1), 0) AS BIGINT) AS repeats, round(coalesce(sum(n - 1) FILTER (WHERE n > 1), 0) / sum(n), 6) AS ratio FROM c")
def duplicate_lines(t):
    return stats.duplicate_lines(t("documents"))


@query("q_tokens", f"SELECT doc_id, CAST(len(k) AS BIGINT) AS n, md5(array_to_string(k, ' ')) AS digest FROM (SELECT doc_id, {_TOK.format('text')} AS k FROM documents)")
def tokens(t):
    k = T.search_tokens(F.col("text"))
    return t("documents").select("doc_id", F.size(k).cast("long").alias("n"), F.md5(F.array_join(k, " ")).alias("digest"))


@query("q_query_terms", f"SELECT item_id, array_to_string({_TERMS.format('text')}, ' ') AS terms FROM benchmark")
def query_terms(t):
    return t("benchmark").select("item_id", F.array_join(T.query_terms(F.col("text")), " ").alias("terms"))


@query("q_ngrams", f"WITH q AS (SELECT item_id, {_TERMS.format('text')} AS k FROM benchmark), g AS (SELECT item_id, unnest(list_transform(range(1, len(k)), lambda i: array_to_string(k[i:i+1], ''))) AS g FROM q UNION SELECT item_id, unnest(list_transform(range(1, len(k) - 1), lambda i: array_to_string(k[i:i+2], ''))) FROM q UNION SELECT item_id, unnest(list_transform(range(1, len(k) - 2), lambda i: array_to_string(k[i:i+3], ''))) FROM q) SELECT item_id, g AS gram FROM g WHERE length(g) >= 4")
def ngrams(t):
    return t("benchmark").select("item_id", F.explode(T.ngram_terms(T.query_terms(F.col("text")))).alias("gram"))


_INDEX = f"WITH d AS (SELECT doc_id, {_TOK.format('text')} AS k FROM documents), p AS (SELECT doc_id, len(k) AS dl, unnest(k) AS term FROM d), tf AS (SELECT term, doc_id, dl, count(*) AS tf FROM p GROUP BY ALL)"


@query("q_postings", _INDEX + " SELECT term, doc_id, CAST(tf AS BIGINT) AS tf, CAST(dl AS BIGINT) AS dl FROM tf")
def postings(t):
    return retrieval.postings(t("documents")).select("term", "doc_id", "tf", "dl")


@query("q_doc_freq", _INDEX + " SELECT term, CAST(count(*) AS BIGINT) AS df FROM tf GROUP BY term")
def doc_freq(t):
    return retrieval.postings(t("documents")).groupBy("term").agg(F.count("*").alias("df"))


def _bm25_sql(questions: str, limit: int) -> str:
    return (
        _INDEX
        + f""", s AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM (SELECT DISTINCT doc_id, dl FROM tf)), f AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT qid, unnest({_TOK.format('text')}) AS term FROM ({questions})), qt AS (SELECT qid, term, count(*) AS qtf FROM q GROUP BY ALL),
r AS (SELECT qid, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM tf JOIN f USING (term) JOIN qt USING (term), s GROUP BY qid, doc_id),
k AS (SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0)
SELECT qid, rank, doc_id, score FROM k WHERE rank <= {limit}"""
    )


@stored("q_bm25_topk", _bm25_sql("SELECT 0 AS qid, 'the tion hand of entin' AS text", 5))
def bm25_topk(spark, sf_dir):
    """The index is built on first use; the question reads the buckets of its terms."""
    question = spark.createDataFrame([(0, "the tion hand of entin")], "qid int, text string")
    index = sparse_index.of_table(spark, f"{sf_dir}/documents.parquet")
    return sparse_index.search(spark, index, question, 5).withColumnRenamed("key", "doc_id")


@stored("q_bm25_batch", _bm25_sql("SELECT item_id AS qid, text FROM benchmark", 5))
def bm25_batch(spark, sf_dir):
    questions = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("qid"), "text")
    index = sparse_index.of_table(spark, f"{sf_dir}/documents.parquet")
    return sparse_index.search(spark, index, questions, 5).withColumnRenamed("key", "doc_id")


@query("q_vector_topk", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: (CAST(x AS DOUBLE) - 0.125) * (CAST(x AS DOUBLE) - 0.125))), 6) AS distance FROM embeddings ORDER BY 2, 1 LIMIT 20")
def vector_topk(t):
    return retrieval.nearest(t("embeddings"), [0.125] * 64, 20)


@query("q_vector_norm", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS norm FROM embeddings")
def vector_norm(t):
    return t("embeddings").select("vec_id", F.round(retrieval.vector_norm(F.col("embedding")), 6).alias("norm"))


_MD = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<(script|style|nav|title)[^>]*>.*?</(script|style|nav|title)>', '', 'gsi'), '<h1[^>]*>', E'\n# ', 'gi'), '<li[^>]*>', E'\n- ', 'gi'), '<(p|br|/p|/h1|/li|div|/div|footer)[^>]*>', E'\n', 'gi'), '<[^>]*>', '', 'g'), '\n{2,}', E'\n', 'g')"
_PLINES = rf"WITH m AS (SELECT page_id, string_split({_MD}, E'\n') AS ls FROM pages), e AS (SELECT page_id, unnest(ls) AS raw, generate_subscripts(ls, 1) - 1 AS pos FROM m), l AS (SELECT page_id, pos, trim(raw) AS line FROM e WHERE trim(raw) <> '')"


def _page_lines(t):
    return chunking.line_rows(t("pages"), "page_id", chunking.page_markdown(F.col("html")))


@query("q_sections", _PLINES + r", s AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^#{1,6}\s+') THEN 1 ELSE 0 END) OVER w AS section, last_value(CASE WHEN regexp_matches(line, '^#\s+') THEN regexp_replace(line, '^#\s+', '') END IGNORE NULLS) OVER w AS h1 FROM l WINDOW w AS (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT page_id, CAST(section AS BIGINT) AS section, max(h1) AS h1, CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM s GROUP BY page_id, section")
def sections(t):
    return chunking.sections(_page_lines(t), "page_id").groupBy("page_id", "section").agg(F.max("h1").alias("h1"), F.count("*").alias("n_lines"), F.sum(F.length("line")).cast("long").alias("chars"))


@query("q_merge_chunks")
def merge_chunks(t):
    """Folds are not put in SQL; tests hold them against a plain loop."""
    lines = chunking.sections(_page_lines(t), "page_id").select("page_id", "pos", "h1", F.col("line").alias("text"))
    return chunking.merged(lines, "page_id", "pos")


_TABLE = "SELECT n_nationkey, n_regionkey, concat('| ', CASE WHEN n_nationkey % 5 = 0 THEN r_name ELSE '-' END, ' | ', n_name, ' | ', CAST(n_nationkey * 3 AS VARCHAR), ' |') AS line FROM nation JOIN region ON n_regionkey = r_regionkey"


def _table_lines(t):
    first = F.when(F.col("n_nationkey") % 5 == 0, F.col("r_name")).otherwise(F.lit("-"))
    line = F.concat(F.lit("| "), first, F.lit(" | "), F.col("n_name"), F.lit(" | "), (F.col("n_nationkey") * 3).cast("string"), F.lit(" |"))
    return t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_regionkey", line.alias("line"))


@query("q_cells", f"SELECT n_nationkey, trim(string_split(line, '|')[2]) AS a, trim(string_split(line, '|')[3]) AS b, trim(string_split(line, '|')[4]) AS c FROM ({_TABLE})")
def cells(t):
    c = tables.split_cells(F.col("line"))
    return _table_lines(t).select("n_nationkey", c[0].alias("a"), c[1].alias("b"), c[2].alias("c"))


_FILLED = f"SELECT n_nationkey, coalesce(last_value(nullif(a, '-') IGNORE NULLS) OVER (ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a) AS a, b, c FROM (SELECT n_nationkey, trim(string_split(line, '|')[2]) AS a, trim(string_split(line, '|')[3]) AS b, trim(string_split(line, '|')[4]) AS c FROM ({_TABLE}))"


def _filled(t):
    return tables.forward_filled(cells(t).withColumn("t", F.lit(0)), "t", "n_nationkey", ["a"]).drop("t")  # one table of 25 rows


@query("q_forward_fill", _FILLED)
def forward_fill(t):
    return _filled(t)


@query("q_chunk_number", "SELECT k, TRY_CAST(nullif(regexp_extract(k, '(?:^|_)([0-9]+)$', 1), '') AS INTEGER) AS n FROM (SELECT concat(CAST(n_nationkey AS VARCHAR), CASE WHEN n_nationkey % 3 = 0 THEN '_4' WHEN n_nationkey % 3 = 1 THEN '_2_fact_3' ELSE '_x' END) AS k FROM nation)")
def chunk_number(t):
    n = F.col("n_nationkey")
    k = F.concat(n.cast("string"), F.when(n % 3 == 0, "_4").when(n % 3 == 1, "_2_fact_3").otherwise("_x"))
    return t("nation").select(k.alias("k"), tables.chunk_number(k).alias("n"))


@query("q_table_blocks", f"WITH l AS (SELECT 0 AS k, n_nationkey * 2 AS pos, line FROM ({_TABLE}) UNION ALL SELECT 0, n_nationkey * 2 + 1, concat('note ', n_name) FROM nation WHERE n_nationkey % 4 = 0), f AS (SELECT *, CASE WHEN line LIKE '|%|' THEN 'table' ELSE 'text' END AS kind FROM l), g AS (SELECT *, CASE WHEN kind IS DISTINCT FROM lag(kind) OVER (ORDER BY pos) THEN 1 ELSE 0 END AS new FROM f), b AS (SELECT *, sum(new) OVER (ORDER BY pos) AS block FROM g) SELECT CAST(block AS BIGINT) AS block, kind, CAST(count(*) AS BIGINT) AS n_lines, string_agg(line, E'\\n' ORDER BY pos) AS text FROM b GROUP BY block, kind")
def table_blocks(t):
    rows = _table_lines(t).select(F.lit(0).alias("k"), (F.col("n_nationkey") * 2).alias("pos"), "line")
    notes = t("nation").where("n_nationkey % 4 = 0").select(F.lit(0).alias("k"), (F.col("n_nationkey") * 2 + 1).alias("pos"), F.concat(F.lit("note "), "n_name").alias("line"))
    return chunking.blocks(rows.union(notes), "k").select("block", "kind", "n_lines", "text")
