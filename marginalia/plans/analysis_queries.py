"""Queries over the analysis of questions. The questions name nations in sentences of every intent."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.functions import lexicon as L
from marginalia.functions.text import PARTICLES
from marginalia.operators import analysis
from marginalia.plans.registry import query

SENTENCES = [
    "{n} 모집인원은 몇명인가요", "{n} 위치가 어디에 있어", "{n}의 이용 시간 알려줘", "{n} 신청 방법은", "{n} 학과는 무엇이 있나요", "{n} {r} 서류 제출",
    "{n} 등록 비용은 얼마", "{n} 면접 복장", "{n}에서 {r}까지 일정", "전공심화 {n} 과목 목록", "{n} {r} 공식의 상수 값", "우리 학교 {n} 지원자격",
    "where is {n} in {r}", "{n} {r} 정원", "", "학과 {n} 어디에서", "{n} 어떤 시설 종류",
]
_VALUES = ", ".join(f"({i}, '{s}')" for i, s in enumerate(SENTENCES))
QUESTIONS_SQL = f"SELECT n_nationkey * 100 + i AS qid, replace(replace(s, '{{n}}', n_name), '{{r}}', r_name) AS text, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey, (VALUES {_VALUES}) t(i, s)"


def questions(t):
    sentences = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(s).alias("s")) for i, s in enumerate(SENTENCES))))
    rows = t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name", sentences.alias("t"))  # five regions
    text = F.replace(F.replace(F.col("t.s"), F.lit("{n}"), F.col("n_name")), F.lit("{r}"), F.col("r_name"))
    return rows.select((F.col("n_nationkey") * 100 + F.col("t.i")).alias("qid"), text.alias("text"), "n_name", "r_name")


def _literal(value: str | int) -> str:
    return str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"


def _table(name: str, rows: list[tuple], columns: str) -> str:
    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)})"


_PART = "|".join(PARTICLES)
_NORM = f"regexp_replace({{0}}, '(.)({_PART})$', '\\1')"
_LEXICON = ", ".join(
    [
        _table("asked", [(i, L.INTENTS.index(i), t) for i, ts in L.INTENT_TERMS.items() for t in ts], "intent, prio, term"),
        _table("evidence", [(i, t) for i, ts in L.EVIDENCE_TERMS.items() for t in ts], "intent, term"),
        _table("synonyms", [(k, t) for k, ts in L.SYNONYMS.items() for t in ts], "k, term"),
        _table("generic", [(t,) for t in L.GENERIC], "term"),
        _table("functional", [(t,) for t in L.FUNCTION_WORDS], "term"),
        _table("tabular", [(t,) for t in L.TABLE_INTENT], "term"),
        _table("patterns", [(p,) for p in L.NON_SUBJECTS], "p"),
        *(_table(name, [(t,) for t in ts], "term") for name, ts in (("collections", L.COLLECTIONS), ("places", L.PLACES), ("list_asks", L.LIST_ASKS), ("where_is", L.WHERE_IS), ("where_collections", L.WHERE_COLLECTIONS))),
    ]
)
#: CTEs: q (qid, text), raw (tokens with their place), norm, toks (search tokens), terms (with synonyms), intents.
ANALYSIS_SQL = f"""WITH {_LEXICON}, q AS ({QUESTIONS_SQL}),
squeezed AS (SELECT qid, replace(lower(text), ' ', '') AS s FROM q),
raw AS (SELECT qid, unnest(w) AS w, generate_subscripts(w, 1) AS place FROM (SELECT qid, regexp_extract_all(lower(text), '[0-9A-Za-z가-힣]+') AS w FROM q)),
norm AS (SELECT qid, place, w, {_NORM.format('w')} AS t FROM raw),
toks AS (SELECT DISTINCT qid, k FROM (SELECT qid, w AS k FROM norm UNION ALL SELECT qid, t FROM norm) WHERE length(k) >= 2),
terms AS (SELECT qid, t AS k FROM norm WHERE length(t) >= 2 UNION SELECT qid, s.term FROM norm JOIN synonyms s ON s.k = t WHERE length(t) >= 2),
collective AS (SELECT qid FROM squeezed x WHERE NOT EXISTS (FROM places WHERE contains(x.s, term)) AND EXISTS (FROM collections WHERE contains(x.s, term)) AND EXISTS (FROM list_asks WHERE contains(x.s, term))
  AND NOT (EXISTS (FROM where_is WHERE contains(x.s, term)) AND NOT EXISTS (FROM where_collections WHERE contains(x.s, term)))),
hits AS (SELECT qid, prio, intent FROM squeezed x JOIN asked a ON length(a.term) >= 2 AND contains(x.s, a.term) UNION SELECT qid, prio, intent FROM toks JOIN asked a ON a.term = k),
intents AS (SELECT q.qid, CASE WHEN c.qid IS NOT NULL THEN 'list' ELSE h.intent END AS intent FROM q LEFT JOIN collective c ON c.qid = q.qid LEFT JOIN (SELECT qid, arg_min(intent, prio) AS intent FROM hits GROUP BY qid) h ON h.qid = q.qid),
excluded AS (SELECT i.qid, a.term FROM intents i, (SELECT DISTINCT term FROM asked) a UNION SELECT i.qid, e.term FROM intents i JOIN evidence e ON e.intent = i.intent AND i.intent <> 'list'),
names AS (SELECT DISTINCT qid, k, length({_NORM.format('k')}) >= 2 AS long_enough, {_NORM.format('k')} AS n FROM toks),
candidates AS (SELECT qid, CASE WHEN long_enough THEN n ELSE k END AS k, 'subject' AS kind FROM names UNION SELECT qid, k, 'primary' FROM terms),
usable AS (SELECT c.* FROM candidates c WHERE length(k) >= 2 AND k NOT IN (SELECT term FROM generic) AND NOT EXISTS (FROM patterns WHERE regexp_matches(c.k, p))
  AND NOT EXISTS (FROM excluded e WHERE e.qid = c.qid AND (e.term = c.k OR (length(e.term) >= 2 AND contains(c.k, e.term))))),
plain AS (SELECT qid, t, row_number() OVER (PARTITION BY qid ORDER BY place) AS nth FROM norm n WHERE length(t) >= 2 AND t NOT IN (SELECT term FROM functional) AND NOT EXISTS (FROM patterns WHERE regexp_matches(n.t, p)) AND NOT EXISTS (FROM excluded e WHERE e.qid = n.qid AND e.term = n.t)),
grams AS (SELECT a.qid, string_agg(b.t, '' ORDER BY b.nth) AS k FROM plain a JOIN plain b ON a.qid = b.qid, (VALUES (2), (3), (4)) z(n) WHERE b.nth BETWEEN a.nth AND a.nth + n - 1 GROUP BY a.qid, a.nth, n HAVING count(*) = n),
main AS (SELECT qid, k FROM usable WHERE kind = 'primary' UNION SELECT qid, k FROM grams WHERE length(k) >= 4),
subjects AS (SELECT DISTINCT qid, k FROM usable WHERE kind = 'subject'),
everything AS (FROM (SELECT qid, k FROM toks UNION SELECT qid, k FROM terms UNION SELECT qid, k FROM subjects UNION SELECT qid, k FROM main) WHERE length(k) >= 2)"""


def joined(cte: str) -> str:
    return f"coalesce((SELECT string_agg(k, '|' ORDER BY k) FROM {cte} x WHERE x.qid = i.qid), '')"


@query("q_intent", ANALYSIS_SQL + " SELECT qid, intent FROM intents")
def q_intent(t):
    return analysis.analyzed(questions(t)).select("qid", "intent")


@query("q_query_analysis", ANALYSIS_SQL + f" SELECT qid, {joined('subjects')} AS subject_terms, {joined('main')} AS primary_terms, {joined('everything')} AS context_terms FROM intents i")
def q_query_analysis(t):
    rows = analysis.analyzed(questions(t))
    return rows.select("qid", *(F.array_join(c, "|").alias(c) for c in ("subject_terms", "primary_terms", "context_terms")))


@query("q_expanded_terms", ANALYSIS_SQL + f" SELECT qid, {joined('terms')} AS terms FROM intents i")
def q_expanded_terms(t):
    return questions(t).select("qid", F.array_join(analysis.expanded_terms(F.col("text")), "|").alias("terms"))


LEXICAL_SQL = """, each AS (SELECT n.qid, n.place, n.w AS k, n.t FROM norm n WHERE length(t) >= 2 OR t IN (SELECT term FROM tabular)),
wide AS (SELECT qid, place, k FROM each UNION SELECT qid, place, t FROM each UNION SELECT qid, place, s.term FROM each JOIN synonyms s ON s.k = t),
kinds AS (SELECT qid, place, bool_or(k IN (SELECT term FROM tabular)) AS asks FROM wide GROUP BY qid, place),
advanced AS (SELECT qid FROM squeezed WHERE contains(s, '전공심화') AND (contains(s, '과목') OR contains(s, '학과'))),
lex_subject AS (SELECT w.qid, k FROM wide w JOIN kinds USING (qid, place) WHERE NOT asks AND length(k) >= 3 AND k NOT IN (SELECT term FROM generic) UNION SELECT qid, unnest(['전공심화', '전공심화과정']) FROM advanced),
lex_intent AS (SELECT w.qid, k FROM wide w JOIN kinds USING (qid, place) WHERE asks AND length(k) >= 2 UNION SELECT qid, unnest(['학과', '개설학과', '모집단위']) FROM advanced)"""


@query("q_lexical_terms", ANALYSIS_SQL + LEXICAL_SQL + f" SELECT qid, {joined('lex_subject')} AS subject, {joined('lex_intent')} AS intent, EXISTS (FROM lex_subject x WHERE x.qid = i.qid) AND EXISTS (FROM lex_intent x WHERE x.qid = i.qid) AS table_value FROM intents i")
def q_lexical_terms(t):
    terms = analysis.lexical_terms(F.col("text"))
    return questions(t).select("qid", F.array_join(terms["subject"], "|").alias("subject"), F.array_join(terms["intent"], "|").alias("intent"), analysis.asks_table_value(F.col("text")).alias("table_value"))
