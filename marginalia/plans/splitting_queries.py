"""Queries over chunking. Documents' lines stand for Markdown: some become headings, some rows of tables, some notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.operators import ingest, splitting
from marginalia.plans.registry import query


def pages(t):
    """document_id, ordinal, page, text: parts of fifteen lines; those of even documents are pages."""
    rows = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "x")).withColumn("x", F.trim("x"))
    i, x = F.col("i"), F.replace(F.col("x"), F.lit("|"), F.lit(""))
    cell = F.trim(F.left(F.trim(x), F.lit(30)))
    line = (
        F.when(i % 11 == 0, F.concat(F.lit("# T"), (i % 3).cast("string"), F.lit(" "), cell)).when(i % 11 == 4, F.concat(F.lit("## S"), (i % 4).cast("string"))).when(i % 11 == 5, F.concat(F.lit("### U"), (i % 2).cast("string")))
        .when(i % 11 == 6, "| A | B |").when(i % 11 == 7, "|---|---|").when(i % 11 == 8, F.concat(F.lit("| "), cell, F.lit(" | "), F.lpad(F.lit(""), 700, "y"), F.lit(" |")))
        .when(i % 11 == 9, F.concat(F.lit("| "), cell, F.lit(" | "), F.lpad(F.lit(""), 200, "z"), F.lit(" |"))).otherwise(F.col("x"))
    )
    part = F.floor(i / 15).cast("int")
    rows = rows.select(F.col("doc_id").alias("document_id"), part.alias("ordinal"), "i", line.alias("line"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda r: r["line"]), "\n")
    return rows.groupBy("document_id", "ordinal").agg(text.alias("text")).withColumn("page", F.when(F.col("document_id") % 2 == 0, F.col("ordinal").cast("long") + 1))


_CELL = "trim(left(trim(replace(x, '|', '')), 30))"
#: CTE p (document_id, nth, section, line, h1, h2, h3, page).
SECTIONS_SQL = f"""WITH l AS (SELECT doc_id AS document_id, unnest(ls) AS raw, generate_subscripts(ls, 1) - 1 AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
m AS (SELECT document_id, i, i // 15 AS ordinal, trim(CASE i % 11 WHEN 0 THEN concat('# T', CAST(i % 3 AS VARCHAR), ' ', {_CELL}) WHEN 4 THEN concat('## S', CAST(i % 4 AS VARCHAR)) WHEN 5 THEN concat('### U', CAST(i % 2 AS VARCHAR)) WHEN 6 THEN '| A | B |' WHEN 7 THEN '|---|---|'
  WHEN 8 THEN concat('| ', {_CELL}, ' | ', repeat('y', 700), ' |') WHEN 9 THEN concat('| ', {_CELL}, ' | ', repeat('z', 200), ' |') ELSE x END) AS line FROM (SELECT document_id, i, trim(raw) AS x FROM l)),
n AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY i) AS nth, CASE WHEN i % 11 = 0 THEN 1 WHEN i % 11 = 4 THEN 2 WHEN i % 11 = 5 THEN 3 WHEN regexp_matches(line, '^#{{1,6}}(\\s|$)') THEN length(regexp_extract(line, '^#+')) END AS level FROM m WHERE line <> ''),
s AS (SELECT *, CASE WHEN (level IS NOT NULL AND lag(level) OVER w IS NULL) OR (document_id % 2 = 0 AND ordinal IS DISTINCT FROM lag(ordinal) OVER w) THEN 1 ELSE 0 END AS opens,
  max(CASE WHEN level = 1 THEN nth END) OVER u AS p1, max(CASE WHEN level = 2 THEN nth END) OVER u AS p2, max(CASE WHEN level = 3 THEN nth END) OVER u AS p3 FROM n
  WINDOW w AS (PARTITION BY document_id ORDER BY nth), u AS (PARTITION BY document_id ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
h AS (SELECT document_id, nth, trim(regexp_replace(line, '^#+\\s*', '')) AS title FROM n WHERE level IS NOT NULL),
p AS (SELECT s.document_id, s.nth, s.line, CASE WHEN s.document_id % 2 = 0 THEN s.ordinal + 1 END AS page, CAST(sum(opens) OVER (PARTITION BY s.document_id ORDER BY s.nth) AS BIGINT) AS section, a.title AS h1, CASE WHEN p2 > coalesce(p1, 0) THEN b.title END AS h2, CASE WHEN p3 > greatest(coalesce(p1, 0), coalesce(p2, 0)) THEN c.title END AS h3
  FROM s LEFT JOIN h a ON a.document_id = s.document_id AND a.nth = p1 LEFT JOIN h b ON b.document_id = s.document_id AND b.nth = p2 LEFT JOIN h c ON c.document_id = s.document_id AND c.nth = p3)"""


@query("q_section_paths", SECTIONS_SQL + " SELECT document_id, CAST(nth AS INTEGER) AS nth, section, h1, h2, h3, page FROM p")
def q_section_paths(t):
    return splitting.sections(pages(t)).select("document_id", "nth", "section", "h1", "h2", "h3", "page")


def _fold(units: str, joint: str, head: str = "''") -> str:
    size = f"(CASE WHEN {head} = '' THEN 0 ELSE length({head}) + 1 END)"
    reduced = f"list_reduce(list_transform(CASE WHEN len({units}) > 0 THEN {units} END, lambda w: {{'done': CAST([] AS VARCHAR[]), 'held': w}}), lambda a, b: CASE WHEN {size} + length(a.held) + 1 + length(b.held) > 800 THEN {{'done': list_append(a.done, a.held), 'held': b.held}} ELSE {{'done': a.done, 'held': concat(a.held, {joint}, b.held)}} END)"
    return f"(SELECT list_append(r.done, r.held) FROM (SELECT {reduced} AS r))"


#: CTE c (document_id, chunk_index, text, h1, h2, h3, block_type, page).
SPLIT_SQL = (
    SECTIONS_SQL
    + f""", z AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY document_id, section) - 1 AS chars, starts_with(line, '|') AND ends_with(line, '|') AS bar FROM p),
b AS (SELECT *, CASE WHEN (bar AND chars > 800) IS DISTINCT FROM lag(bar AND chars > 800) OVER (PARTITION BY document_id, section ORDER BY nth) THEN 1 ELSE 0 END AS turn FROM z),
g AS (SELECT *, sum(turn) OVER (PARTITION BY document_id, section ORDER BY nth) AS block FROM b),
k AS (SELECT document_id, section, block, bool_or(bar AND chars > 800) AS tabular, min(nth) AS nth, max(chars) AS chars, min(page) AS page, list(line ORDER BY nth) AS ls, arg_max(coalesce(h1, ''), nth) AS h1, arg_max(coalesce(h2, ''), nth) AS h2, arg_max(coalesce(h3, ''), nth) AS h3 FROM g GROUP BY document_id, section, block),
uw AS (SELECT document_id, section, block, nth, list_transform(ls, lambda x: CASE WHEN length(x) <= 800 THEN [x] ELSE list_filter(string_split(x, ' '), lambda w: w <> '') END) AS parts, ls FROM k WHERE chars > 800 AND NOT tabular),
ux AS (SELECT document_id, section, block, unnest(parts) AS ws, unnest(ls) AS line, generate_subscripts(ls, 1) AS place FROM uw),
uy AS (SELECT document_id, section, block, flatten(list(CASE WHEN length(line) <= 800 THEN [line] ELSE {_fold('ws', "' '")} END ORDER BY place)) AS units FROM ux GROUP BY document_id, section, block),
v AS (SELECT k.document_id, k.nth, k.page, k.h1, k.h2, k.h3, CASE WHEN tabular THEN 'table' END AS block_type, CASE WHEN chars <= 800 THEN [array_to_string(ls, chr(10))] WHEN NOT tabular THEN {_fold('units', 'chr(10)')}
  WHEN length(array_to_string(ls, chr(10))) <= 800 THEN [array_to_string(ls, chr(10))] WHEN ls[1] = '| A | B |' AND ls[2] = '|---|---|' AND len(ls) > 2 THEN list_transform({_fold('ls[3:]', 'chr(10)', "concat(ls[1], chr(10), ls[2])")}, lambda x: concat(ls[1], chr(10), ls[2], chr(10), x)) ELSE {_fold('ls', 'chr(10)')} END AS ps
  FROM k LEFT JOIN uy USING (document_id, section, block)),
y AS (SELECT document_id, nth, page, nullif(h1, '') AS h1, nullif(h2, '') AS h2, nullif(h3, '') AS h3, block_type, unnest(ps) AS text, generate_subscripts(ps, 1) AS piece FROM v),
c AS (SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY nth, piece) - 1 AS chunk_index, text, h1, h2, h3, block_type, page FROM y)"""
)


@query("q_split_chunks", SPLIT_SQL + " SELECT document_id, CAST(chunk_index AS INTEGER) AS chunk_index, md5(text) AS digest, length(text) AS chars, h1, h2, h3, block_type, page FROM c".replace("length(text) AS chars", "CAST(length(text) AS INTEGER) AS chars"))
def q_split_chunks(t):
    return splitting.split(pages(t)).select("document_id", "chunk_index", F.md5("text").alias("digest"), F.length("text").alias("chars"), "h1", "h2", "h3", "block_type", "page")


_SIG = "[coalesce(h1, ''), coalesce(h2, ''), coalesce(h3, '')]"
MERGE_SQL = (
    SPLIT_SQL
    + f""", e AS (SELECT document_id, list({{'done': CAST([] AS STRUCT(text VARCHAR, n BIGINT, tabular BOOLEAN, h1 VARCHAR, page BIGINT)[]), 'sig': {_SIG}, 'kind': coalesce(block_type, 'text'), 'text': text, 'n': CAST(1 AS BIGINT), 'tabular': block_type IS NOT NULL, 'h1': h1, 'page': CAST(page AS BIGINT)}} ORDER BY chunk_index) AS cs FROM c GROUP BY document_id),
f AS (SELECT document_id, list_reduce(cs, lambda a, b: CASE WHEN a.sig <> b.sig OR length(a.text) >= 300
    OR (a.kind <> b.kind AND NOT (a.kind = 'text' AND b.kind = 'table' AND length(a.text) + 2 + length(b.text) <= 880)) OR (length(a.text) + 2 + length(b.text) > 800 AND NOT (a.kind = 'text' AND b.kind = 'table' AND length(a.text) + 2 + length(b.text) <= 880))
  THEN {{'done': list_append(a.done, {{'text': a.text, 'n': a.n, 'tabular': a.tabular, 'h1': a.h1, 'page': a.page}}), 'sig': b.sig, 'kind': b.kind, 'text': b.text, 'n': b.n, 'tabular': b.tabular, 'h1': b.h1, 'page': b.page}}
  ELSE {{'done': a.done, 'sig': a.sig, 'kind': b.kind, 'text': concat(a.text, chr(10), chr(10), b.text), 'n': a.n + 1, 'tabular': a.tabular OR b.tabular, 'h1': CASE WHEN a.h1 = b.h1 THEN a.h1 END, 'page': CASE WHEN a.page = b.page THEN a.page END}} END) AS r FROM e),
o AS (SELECT document_id, list_append(r.done, {{'text': r.text, 'n': r.n, 'tabular': r.tabular, 'h1': r.h1, 'page': r.page}}) AS ms FROM f),
mm AS (SELECT document_id, unnest(ms) AS x, generate_subscripts(ms, 1) - 1 AS chunk_index FROM o)"""
)


@query("q_merge_short", MERGE_SQL + " SELECT document_id, CAST(chunk_index AS INTEGER) AS chunk_index, md5(x.text) AS digest, x.n AS merged_chunk_count, CASE WHEN x.tabular THEN 'table' END AS block_type, x.h1 AS h1, x.page AS page FROM mm")
def q_merge_short(t):
    rows = splitting.merged(splitting.split(pages(t)))
    return rows.select("document_id", "chunk_index", F.md5("text").alias("digest"), "merged_chunk_count", "block_type", "h1", "page")


@query("q_without_repeats", """WITH l AS (SELECT doc_id, unnest(ls) AS raw, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)), d AS (SELECT doc_id, i * 10 + k AS i, raw FROM l, (VALUES (0), (1)) v(k) WHERE k = 0 OR i % 3 = 0),
f AS (SELECT *, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS flat FROM d), g AS (SELECT *, lag(flat) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM f)
SELECT doc_id, md5(regexp_replace(string_agg(raw, chr(10) ORDER BY i), '^\\s+|\\s+$', '', 'g')) AS digest FROM g WHERE flat = '' OR before IS DISTINCT FROM flat GROUP BY doc_id""")
def q_without_repeats(t):
    """Every third line stands twice; in runs of equal lines the first is kept."""
    twice = F.flatten(F.transform(F.split("text", "\n"), lambda x, i: F.when((i + 1) % 3 == 0, F.array(x, x)).otherwise(F.array(x))))
    return t("documents").select("doc_id", F.md5(splitting.without_repeats(F.array_join(twice, "\n"))).alias("digest"))


@query("q_page_ranges", SPLIT_SQL + r""", pg AS (SELECT document_id, page, regexp_replace(string_agg(line, '' ORDER BY nth), '\s+', '', 'g') AS content FROM p WHERE page IS NOT NULL GROUP BY document_id, page),
cc AS (SELECT document_id, chunk_index, regexp_replace(text, '\s+', '', 'g') AS c FROM c),
sn AS (SELECT document_id, chunk_index, unnest(list_filter(list_transform([0, (length(c) - least(120, length(c))) // 2, length(c) - least(120, length(c))], lambda s: substring(c, s + 1, least(120, length(c)))), lambda x: length(x) >= 8)) AS snip FROM cc)
SELECT cc.document_id, CAST(cc.chunk_index AS INTEGER) AS chunk_index, CAST(min(pg.page) AS BIGINT) AS page_start, CAST(max(pg.page) AS BIGINT) AS page_end FROM cc LEFT JOIN sn ON sn.document_id = cc.document_id AND sn.chunk_index = cc.chunk_index LEFT JOIN pg ON pg.document_id = cc.document_id AND contains(pg.content, sn.snip) GROUP BY ALL""")
def q_page_ranges(t):
    parts = pages(t)
    return ingest.page_ranges(splitting.split(parts), ingest.page_lookup(parts)).select("document_id", "chunk_index", "page_start", "page_end")


@query("q_stage_statistics", MERGE_SQL + """, st AS (SELECT document_id, 'split' AS stage, text FROM c UNION ALL SELECT document_id, 'merged', x.text FROM mm)
SELECT document_id, stage, CAST(count(*) AS BIGINT) AS chunks, CAST(sum(length(text)) AS BIGINT) AS total, CAST(quantile_disc(length(text), 0.9) AS BIGINT) AS p90, CAST(count(*) FILTER (WHERE length(text) < 300) AS BIGINT) AS short_chunks FROM st GROUP BY ALL""")
def q_stage_statistics(t):
    split = splitting.split(pages(t))
    return ingest.stage_statistics({"split": split, "merged": splitting.merged(split)}).select("document_id", "stage", "chunks", "total", "p90", "short_chunks")


@query("q_ingest")
def q_ingest(t):
    """All steps in a row; borders of chunks are held against expected texts in tests."""
    sources = t("documents").select(F.col("doc_id").alias("document_id"), "source")
    return ingest.ingested(pages(t).join(sources, "document_id")).select("chunk_id", "document_id", "chunk_index", "chunk_role", "parent_chunk_id", "fact_index", "page", "page_start", "page_end", "path", F.md5("text").alias("digest"))
