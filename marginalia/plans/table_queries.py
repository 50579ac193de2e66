"""Queries over tables in text. Each nation's customers are a Markdown table; the SQL tells the facts without reading it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marginalia.operators import ingest, table_facts
from marginalia.plans.registry import query


def chunks(t):
    """chunk_id, text, path: one chunk for each nation that has customers. Some tables have two header rows, a sub-header row or a
    column of grades; segments stand only in some rows, keys lack in some, and a symbol marks some names."""
    n = F.col("n_nationkey")
    w = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    nth = F.row_number().over(w)
    row = F.concat(
        F.lit("| "), F.when((F.col("c_custkey") % 3 == 0) | (nth == 2), F.col("c_mktsegment")).otherwise(F.lit("-")), F.lit(" | "), F.col("c_name"), F.when(F.col("c_custkey") % 5 == 0, " ♣").otherwise(""),
        F.lit(" | "), F.floor("c_acctbal").cast("string"), F.lit(" | "), F.when(F.col("c_custkey") % 4 == 0, "").otherwise(F.col("c_custkey").cast("string")), F.lit(" |"),
    )
    body = t("customer").withColumn("row", row).groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", "row"))).alias("rows"))
    last = F.when(n % 2 == 0, "낮음").otherwise("비고")
    header = F.when(n % 3 == 0, F.concat(F.lit("| 구분 | 모집단위 | 금액 | |\n| | | 합계 | "), last, F.lit(" |"))).otherwise(F.concat(F.lit("| 구분 | 모집단위 | 금액 | "), last, F.lit(" |")))
    sub = F.when(n % 4 == 1, "\n| 계열 | 이름 | - | 등급 |").otherwise("")
    text = F.concat(
        F.lit("안내 글입니다\n- ♣ 표시 : 우대 "), "r_name", F.lit("\n\n표 "), n.cast("string"), F.lit(" 고객 현황\n\n"), header, F.lit("\n|---|:---:|---|---|"), sub, F.lit("\n"),
        F.array_join(F.transform("rows", lambda r: r["row"]), "\n"), F.lit("\n\n참고 문장"),
    )
    nations = t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))  # five regions
    return nations.join(body, n == F.col("c_nationkey")).select(F.concat(n.cast("string"), F.lit("_0")).alias("chunk_id"), text.alias("text"), F.col("r_name").alias("path"))


#: CTEs: r (one row for each customer, with what its fact says) and f (chunk_id, fact, place).
FACTS_SQL = """WITH c AS (
  SELECT n_nationkey AS n, r_name, c_custkey AS k, c_name, c_mktsegment, CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) AS bal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS nth
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), r AS (
  SELECT *, last_value(CASE WHEN k % 3 = 0 OR nth = 2 THEN c_mktsegment END IGNORE NULLS) OVER (PARTITION BY n ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seg,
    concat(c_name, CASE WHEN k % 5 = 0 THEN ' ♣' ELSE '' END) AS name,
    CASE WHEN n % 4 = 1 THEN '구분 계열' ELSE '구분' END AS l1, CASE WHEN n % 4 = 1 THEN '모집단위 이름' ELSE '모집단위' END AS l2,
    CASE WHEN n % 3 = 0 THEN '금액 합계' ELSE '금액' END AS l3,
    concat(CASE WHEN n % 3 = 0 THEN '금액 ' ELSE '' END, CASE WHEN n % 2 = 0 THEN '낮음' ELSE '비고' END, CASE WHEN n % 4 = 1 THEN ' 등급' ELSE '' END) AS l4
  FROM c
), s AS (
  SELECT *, concat('표 ', CAST(n AS VARCHAR), ' 고객 현황') AS title, coalesce(seg, name) AS subject FROM r
), f AS (
  SELECT n, nth * 10 AS place, concat(title, ': ', replace(subject, ' ♣', ''), ' 행 정보는 ', CASE WHEN k % 5 = 0 THEN concat('♣ 표시=우대 ', r_name, '; ') ELSE '' END, CASE WHEN seg IS NULL THEN '' ELSE concat(l1, '=', seg, '; ') END, l2, '=', name, '; ', l3, '=', bal, CASE WHEN k % 4 = 0 THEN '' ELSE concat('; ', l4, '=', CAST(k AS VARCHAR)) END, '이다.') AS fact FROM s
  UNION ALL
  SELECT n, nth * 10 + 1, concat(title, ': ', subject, '의 ', l3, ' 값은 ', bal, '이다. 행 정보: ', CASE WHEN seg IS NULL THEN '' ELSE concat(l1, '=', seg, ', ') END, l2, '=', name, CASE WHEN regexp_full_match(bal, '[0-9.,]+') THEN '' ELSE concat(', ', l3, '=', bal) END, '.') FROM s WHERE n % 2 = 0
  UNION ALL
  SELECT n, nth * 10 + 2, concat(title, ': ', subject, '의 ', l4, ' 값은 ', CAST(k AS VARCHAR), '이다. 행 정보: ', CASE WHEN seg IS NULL THEN '' ELSE concat(l1, '=', seg, ', ') END, l2, '=', name, CASE WHEN regexp_full_match(bal, '[0-9.,]+') THEN '' ELSE concat(', ', l3, '=', bal) END, '.') FROM s WHERE n % 2 = 0 AND k % 4 <> 0
), indexed AS (
  SELECT concat(CAST(n AS VARCHAR), '_0') AS chunk_id, fact, CAST(row_number() OVER (PARTITION BY n ORDER BY min(place)) - 1 AS INTEGER) AS fact_index FROM f GROUP BY n, fact
), kept AS (SELECT * FROM indexed WHERE fact_index < 40)"""


@query("q_table_facts", FACTS_SQL + " SELECT chunk_id, fact_index, fact FROM kept")
def q_table_facts(t):
    return table_facts.facts(chunks(t))


@query("q_table_rows", FACTS_SQL + " SELECT concat(CAST(n AS VARCHAR), '_0') AS chunk_id, '♣' AS symbol, concat('우대 ', r_name) AS description, concat(l1, '|', l2, '|', l3, '|', l4) AS labels, concat(coalesce(seg, '-'), '|', name, '|', bal, '|', CASE WHEN k % 4 = 0 THEN '' ELSE CAST(k AS VARCHAR) END) AS cells FROM r")
def q_table_rows(t):
    rows = table_facts.parsed_tables(chunks(t), "chunk_id")
    legend = F.col("legends")[0]
    return rows.select("chunk_id", legend["symbol"].alias("symbol"), legend["description"].alias("description"), F.array_join("labels", "|").alias("labels"), F.array_join("cells", "|").alias("cells"))


@query("q_fact_pairs", FACTS_SQL + """ SELECT chunk_id, replace(subject, ' ♣', '') AS subject, unnest(ks) AS k, unnest(vs) AS v FROM (
  SELECT concat(CAST(n AS VARCHAR), '_0') AS chunk_id, n, nth, subject, list_filter([CASE WHEN k % 5 = 0 THEN '♣ 표시' END, CASE WHEN seg IS NOT NULL THEN l1 END, l2, l3, CASE WHEN k % 4 <> 0 THEN l4 END], lambda x: x IS NOT NULL) AS ks,
  list_filter([CASE WHEN k % 5 = 0 THEN concat('우대 ', r_name) END, seg, name, bal, CASE WHEN k % 4 <> 0 THEN CAST(k AS VARCHAR) END], lambda x: x IS NOT NULL) AS vs FROM s) x
  WHERE EXISTS (SELECT 1 FROM f JOIN kept g ON g.fact = f.fact WHERE f.n = x.n AND f.place = x.nth * 10)""")
def q_fact_pairs(t):
    rows = table_facts.facts(chunks(t)).where(F.contains("fact", F.lit(table_facts.ROW_WORDS)))
    return rows.select("chunk_id", table_facts.fact_subject(F.col("fact")).alias("subject"), F.inline(table_facts.fact_pairs(F.col("fact"))))


@query("q_symbol_facts", FACTS_SQL + " SELECT concat(CAST(n AS VARCHAR), '_0') AS chunk_id, concat(title, ': ', subject, ' 행에는 ♣ 표시가 있으며, ♣ 표시는 우대 ', r_name, '를 의미한다. 행 정보: ', array_to_string(list_filter([CASE WHEN seg IS NOT NULL THEN concat(l1, '=', seg) END, concat(l2, '=', name), concat(l3, '=', bal), CASE WHEN seg IS NULL AND k % 4 <> 0 THEN concat(l4, '=', CAST(k AS VARCHAR)) END], lambda x: x IS NOT NULL), ', '), '.') AS fact FROM s WHERE k % 5 = 0")
def q_symbol_facts(t):
    rows = table_facts.parsed_tables(chunks(t), "chunk_id")
    return rows.select("chunk_id", F.explode(table_facts.symbol_facts(F.col("caption"), F.col("legends"), F.col("labels"), F.col("cells"))).alias("fact"))


_INDEX_SQL = FACTS_SQL + ", t AS (SELECT n, chunk_id FROM (SELECT DISTINCT n, concat(CAST(n AS VARCHAR), '_0') AS chunk_id FROM r))"


def _indexed(t, embed_raw):
    rows = chunks(t).select(F.split_part("chunk_id", F.lit("_"), F.lit(1)).cast("long").alias("document_id"), F.lit(0).alias("chunk_index"), "text", "path")
    return ingest.index_rows(rows, embed_raw)


@query("q_index_rows", _INDEX_SQL + " SELECT chunk_id, CAST(n AS BIGINT) AS document_id, 'raw' AS chunk_role, CAST(NULL AS VARCHAR) AS parent_chunk_id, CAST(NULL AS INTEGER) AS fact_index, NULL AS fact FROM t UNION ALL SELECT concat(chunk_id, '_fact_', CAST(fact_index AS VARCHAR)), CAST(split_part(chunk_id, '_', 1) AS BIGINT), 'table_fact', chunk_id, fact_index, fact FROM kept")
def q_index_rows(t):
    return _indexed(t, True).select("chunk_id", "document_id", "chunk_role", "parent_chunk_id", "fact_index", F.when(F.col("chunk_role") == "table_fact", F.col("text")).alias("fact"))


@query("q_listed_chunks", _INDEX_SQL + " SELECT CAST(n AS BIGINT) AS document_id, 0 AS chunk_index, chunk_id, true AS has_text FROM t")
def q_listed_chunks(t):
    """Chunks whose raw rows aren't stored are listed by the text that their facts hold."""
    rows = ingest.listed_chunks(_indexed(t, False))
    return rows.select("document_id", "chunk_index", "chunk_id", F.contains("text", F.lit("고객 현황")).alias("has_text"))


@query("q_index_delete", _INDEX_SQL + ", every AS (SELECT CAST(n AS BIGINT) AS document_id FROM t UNION ALL SELECT CAST(split_part(chunk_id, '_', 1) AS BIGINT) FROM kept) SELECT document_id, count(*) AS n, false AS gone FROM every WHERE document_id % 3 <> 0 GROUP BY document_id UNION ALL SELECT x, coalesce((SELECT count(*) FROM every e WHERE e.document_id = x), 0), true FROM (SELECT unnest([0, 3, 6, 9, 12, 15, 18, 21, 24, 27]) AS x)")
def q_index_delete(t):
    """Rows that stay by document, and how many each deleted document had."""
    ids = t("nation").sparkSession.range(0, 28, 3).select(F.col("id").alias("document_id"))
    left, counts = ingest.deleted(_indexed(t, True), ids)
    return left.groupBy("document_id").agg(F.count("*").alias("n")).withColumn("gone", F.lit(False)).unionByName(counts.select("document_id", F.col("deleted").alias("n"), F.lit(True).alias("gone")))
