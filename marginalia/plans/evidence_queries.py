"""Queries over evidence in candidates. Each question meets two guides, that of its own nation and that of the next."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.functions import lexicon as L
from marginalia.functions.text import search_form
from marginalia.operators import analysis, evidence
from marginalia.plans.analysis_queries import ANALYSIS_SQL, LEXICAL_SQL, _table, questions
from marginalia.plans.registry import query

#: The guide of a nation: headings, items with and without a colon, places, times, counts and prices.
GUIDE = "# 안내 {n}\n소개 문장 {n}\n{n} 위치: 본관 {k}층 / 이용시간: 09:00~18:00\n- {r} 모집인원 = {k}명\n\n## {n} 시설 목록\n- {n} 도서관: {k}호관 2층\n- 체육관 운영\n* {r} 기숙사 복장 상의\n### 비용\n{n} 등록 비용 {k}00원\n- 이용시간 안내: 평일 9시\n## 학생 {r}\n우리 대학 {n}{k} 공식: a = b\n{r}에 필요한 서류 원본\n  끝 문장 "


def guides(t):
    """cid, text: one guide for each nation."""
    text = F.lit(GUIDE)
    for name, value in (("{n}", F.col("n_name")), ("{r}", F.col("r_name")), ("{k}", F.col("n_nationkey").cast("string"))):
        text = F.replace(text, F.lit(name), value)
    nations = t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))  # five regions
    return nations.select(F.col("n_nationkey").alias("cid"), text.alias("text"))


def candidates(t):
    """qid, cid, text and the question's analysis."""
    asked = analysis.analyzed(questions(t)).withColumnRenamed("text", "question")
    n = F.floor(F.col("qid") / 100)
    asked = asked.withColumn("cid", F.explode(F.array(n, (n + 1) % 25)))
    return asked.join(guides(t).withColumnRenamed("cid", "own"), F.col("cid") == F.col("own")).drop("own")


_GUIDE_SQL = "replace(replace(replace('" + GUIDE.replace("\n", "' || chr(10) || '") + "', '{n}', n_name), '{r}', r_name), '{k}', CAST(n_nationkey AS VARCHAR))"
#: CTEs: cand (qid, cid, intent, text, low, packed) and ln (qid, cid, pos, line, low, head: its level or null).
CANDIDATES_SQL = (
    ANALYSIS_SQL
    + LEXICAL_SQL
    + f""", {_table("weak", [(w,) for w in L.WEAK_SUBJECTS], "term")}, {_table("proof", [(i, p) for i, ps in L.EVIDENCE_PATTERNS.items() for p in ps], "intent, p")}, {_table("attire", [(w,) for w in L.ATTIRE], "term")}, {_table("locals", [(w,) for w in L.LOCAL_INTENTS], "intent")},
guide AS (SELECT n_nationkey AS cid, {_GUIDE_SQL} AS text FROM nation JOIN region ON n_regionkey = r_regionkey),
cand AS (SELECT i.qid, g.cid, i.intent, g.text, lower(g.text) AS low, regexp_replace(lower(g.text), '[^0-9a-z가-힣]+', '', 'g') AS packed FROM intents i JOIN guide g ON g.cid = i.qid // 100 OR g.cid = (i.qid // 100 + 1) % 25),
split AS (SELECT qid, cid, intent, trim(unnest(string_split(text, chr(10)))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS raw FROM cand),
ln AS (SELECT qid, cid, intent, row_number() OVER (PARTITION BY qid, cid ORDER BY raw) AS pos, line, lower(line) AS low, regexp_replace(lower(line), '[^0-9a-z가-힣]+', '', 'g') AS packed, CASE WHEN regexp_matches(line, '^#{{1,6}}\\s') THEN length(regexp_extract(line, '^#+')) END AS head FROM split WHERE line <> ''),
prime AS (SELECT qid, k, k IN (SELECT term FROM weak) AS soft FROM main), subj AS (SELECT qid, k, k IN (SELECT term FROM weak) AS soft FROM subjects)"""
)


def _has(text: str, k: str) -> str:
    """A term is in a text with the columns low and packed."""
    return f"(contains({text}.low, {k}) OR contains({text}.packed, regexp_replace({k}, '[^0-9a-z가-힣]+', '', 'g')))"


def _count(k: str) -> str:
    plain = f"((length(c.low) - length(replace(c.low, {k}, ''))) // length({k}))"
    return f"CASE WHEN {plain} > 0 THEN {plain} WHEN {_has('c', k)} THEN 1 ELSE 0 END"


SCORES_SQL = (
    CANDIDATES_SQL
    + f""", p AS (SELECT c.qid, c.cid, sum(least({_count('t.k')}, 4) * CASE WHEN soft THEN 4 ELSE 24 END) AS s FROM cand c JOIN prime t ON t.qid = c.qid GROUP BY ALL),
s AS (SELECT c.qid, c.cid, sum(least({_count('t.k')}, 5) * CASE WHEN soft THEN 3 ELSE 12 END) + CASE WHEN bool_and({_count('t.k')} > 0) AND bool_or(NOT soft) THEN 20 ELSE 0 END AS s FROM cand c JOIN subj t ON t.qid = c.qid GROUP BY ALL),
terms_ AS (SELECT c.qid, c.cid, 6 * count(*) AS s FROM cand c JOIN evidence e ON e.intent = c.intent AND contains(c.low, e.term) GROUP BY ALL),
proofs AS (SELECT c.qid, c.cid, sum(8 * least(5, len(regexp_extract_all(c.low, concat('(?m)', p.p))))) AS s FROM cand c JOIN proof p ON p.intent = c.intent GROUP BY ALL),
items AS (SELECT qid, cid, 8 * least(8, count(*)) AS s FROM ln WHERE intent = 'list' AND NOT starts_with(line, '#') AND (regexp_matches(line, '^[-*]\\s+') OR regexp_matches(line, '\\S+\\s*:\\s*\\S+')) GROUP BY ALL),
heads AS (SELECT l.qid, l.cid, sum(CASE WHEN EXISTS (SELECT 1 FROM prime t WHERE t.qid = l.qid AND NOT soft AND contains(l.low, k)) THEN 40 ELSE 0 END + CASE WHEN EXISTS (SELECT 1 FROM subj t WHERE t.qid = l.qid AND contains(l.low, k)) THEN 30 ELSE 0 END + CASE WHEN EXISTS (SELECT 1 FROM evidence e WHERE e.intent = l.intent AND contains(l.low, e.term)) THEN 10 ELSE 0 END) AS s FROM ln l WHERE head IS NOT NULL GROUP BY ALL)"""
)
_SUM = lambda *names: "CAST(" + " + ".join(f"coalesce({n}.s, 0)" for n in names) + " AS INTEGER)"
_JOINS = " ".join(f"LEFT JOIN {n} ON {n}.qid = c.qid AND {n}.cid = c.cid" for n in ("p", "s", "terms_", "proofs", "items", "heads"))


def _forms(text):
    return F.lower(text), search_form(text), evidence.filled_lines(text)


@query("q_candidate_scores", SCORES_SQL + f" SELECT c.qid, c.cid, {_SUM('p', 's')} AS subject_score, {_SUM('terms_', 'proofs', 'items')} AS intent_score, {_SUM('heads')} AS heading_score FROM cand c {_JOINS}")
def q_candidate_scores(t):
    rows = candidates(t)
    low, packed, own = _forms(F.col("text"))
    rows = rows.withColumn("low", low).withColumn("packed", packed).withColumn("own", own)
    subject = evidence.subject_score(F.col("low"), F.col("packed"), F.col("primary_terms"), F.col("subject_terms"))
    heading = evidence.heading_score(F.col("own"), F.col("intent"), F.col("primary_terms"), F.col("subject_terms"))
    return rows.select("qid", "cid", subject.alias("subject_score"), evidence.intent_score(F.col("low"), F.col("own"), F.col("intent")).alias("intent_score"), heading.alias("heading_score"))


_LABEL = "trim(regexp_extract(l.line, '^[^:：]*'))"
_MATCHES = (
    "(EXISTS (SELECT 1 FROM prime t WHERE t.qid = l.qid AND NOT soft AND length(k) >= 2 AND {0}) OR"
    " ((SELECT count(*) FROM subj t WHERE t.qid = l.qid) >= 2 AND NOT EXISTS (SELECT 1 FROM subj t WHERE t.qid = l.qid AND NOT {0})) OR"
    " ((SELECT count(*) FROM subj t WHERE t.qid = l.qid AND NOT soft) = 1 AND EXISTS (SELECT 1 FROM subj t WHERE t.qid = l.qid AND NOT soft AND {0})))"
)
_IN_LABEL = "(contains(l.label, t.k) OR contains(regexp_replace(l.label, '[^0-9a-z가-힣]+', '', 'g'), t.k))"
_EVIDENT = (
    "CASE WHEN l.intent = 'attire' THEN EXISTS (SELECT 1 FROM attire a WHERE contains(l.low, a.term)) ELSE EXISTS (SELECT 1 FROM evidence e WHERE e.intent = l.intent AND contains(l.low, e.term)) OR"
    " EXISTS (SELECT 1 FROM proof p WHERE p.intent = l.intent AND regexp_matches(l.low, concat('(?m)', p.p))) OR (l.intent = 'list' AND (regexp_matches(l.line, '^[-*]\\s+') OR regexp_matches(l.line, '\\S+\\s*:\\s*\\S+'))) END"
)
_BEHIND = "CASE WHEN contains(line, ':') THEN trim(regexp_replace(line, '^[^:]*:', '')) ELSE line END"
_FORMAT = (
    "CASE intent WHEN 'location' THEN concat('- ', label_, ' 위치: ', coalesce(nullif(trim(regexp_split_to_array(" + _BEHIND + r", '\s*/\s*|\s+이용\s*시간|\s+이용시간|\s+운영\s*시간|\s+운영시간|\s+\d{2,3}-\d{3,4}-\d{4}|\s+\d{1,2}\s*시간')[1]), ''), line))"
    r" WHEN 'time' THEN concat('- ', label_, ' 이용/운영시간: ', coalesce(nullif(trim(regexp_extract(line, '(?:이용\s*시간|이용시간|운영\s*시간|운영시간)[^:：]*[:：]\s*(.+)', 1)), ''), nullif(regexp_extract(line, '\d{1,2}\s*:\s*\d{2}\s*[~∼-]\s*\d{1,2}\s*:\s*\d{2}(?:\([^)]*\))?'), ''), line))"
    " WHEN 'list' THEN concat('- 관련 항목: ', line) ELSE concat('- 관련 근거: ', line) END"
)
EVIDENCE_SQL = (
    CANDIDATES_SQL
    + f""", wanted AS (SELECT qid, k FROM main UNION ALL SELECT qid, k FROM subjects WHERE qid NOT IN (SELECT qid FROM main) UNION ALL SELECT qid, k FROM everything WHERE qid NOT IN (SELECT qid FROM main) AND qid NOT IN (SELECT qid FROM subjects)),
opens AS (SELECT l.qid, l.cid, min(l.pos) AS pos FROM ln l JOIN wanted t ON t.qid = l.qid WHERE l.head IS NOT NULL AND l.intent = 'list' AND {_has('l', 't.k')} GROUP BY ALL),
shuts AS (SELECT o.qid, o.cid, o.pos, coalesce(min(l.pos), 1000) AS stop FROM opens o LEFT JOIN ln l ON l.qid = o.qid AND l.cid = o.cid AND l.pos > o.pos AND l.head IS NOT NULL GROUP BY ALL),
named AS (SELECT l.*, CASE WHEN contains(line, ':') OR contains(line, '：') THEN lower({_LABEL}) ELSE low END AS label FROM ln l WHERE head IS NULL AND intent IS NOT NULL),
about AS (SELECT l.*, CASE WHEN contains(line, ':') THEN trim(split_part(line, ':', 1)) ELSE coalesce((SELECT arg_min(k, (-length(k), k)) FROM main t WHERE t.qid = l.qid AND {_has('l', 't.k')}), (SELECT arg_min(k, (-length(k), k)) FROM subjects t WHERE t.qid = l.qid AND {_has('l', 't.k')}), '관련 항목') END AS label_
  FROM named l WHERE {_MATCHES.format(_IN_LABEL)} AND (l.intent NOT IN (SELECT intent FROM locals) OR {_EVIDENT})),
found AS (SELECT l.qid, l.cid, 1 AS part, l.pos, concat('- 관련 항목: ', l.line) AS fact FROM ln l JOIN shuts o ON l.qid = o.qid AND l.cid = o.cid AND l.pos > o.pos AND l.pos < o.stop UNION ALL SELECT qid, cid, 2, pos, {_FORMAT} FROM about),
firsts AS (SELECT qid, cid, fact, min((part, pos)) AS place FROM found GROUP BY ALL),
facts AS (SELECT *, row_number() OVER (PARTITION BY qid, cid ORDER BY place) AS nth FROM firsts)"""
)


def with_evidence(rows):
    """Candidates (text, analysis) with own (their lines) and found (their lines of evidence)."""
    rows = rows.withColumn("own", evidence.filled_lines(F.col("text")))
    none = F.array().cast("array<string>")
    return rows.withColumn("found", evidence.evidence_lines(F.col("own"), none, F.col("intent"), F.col("primary_terms"), F.col("subject_terms"), F.col("context_terms")))


@query("q_evidence_lines", EVIDENCE_SQL + " SELECT qid, cid, CAST(nth AS INTEGER) AS nth, fact FROM facts WHERE nth <= 5")
def q_evidence_lines(t):
    rows = with_evidence(candidates(t)).select("qid", "cid", F.posexplode("found").alias("nth", "fact"))
    return rows.withColumn("nth", F.col("nth") + 1)


@query("q_evidence_score", EVIDENCE_SQL + ", n AS (SELECT qid, cid, least(5, count(*)) AS n FROM facts GROUP BY ALL) SELECT c.qid, c.cid, CAST(CASE WHEN n.n IS NULL THEN 0 ELSE CASE WHEN c.intent IN (SELECT intent FROM locals) THEN 140 ELSE 90 END + 25 * least(4, n.n - 1) END AS INTEGER) AS score FROM cand c LEFT JOIN n ON n.qid = c.qid AND n.cid = c.cid")
def q_evidence_score(t):
    rows = with_evidence(candidates(t))
    return rows.select("qid", "cid", evidence.evidence_score(F.col("found"), F.lit(None).cast("array<string>"), F.col("intent")).alias("score"))


EXCERPT_SQL = (
    CANDIDATES_SQL
    + """, hit AS (SELECT l.*, EXISTS (SELECT 1 FROM {terms} t WHERE t.qid = l.qid AND contains(l.low, t.k)) AS hit FROM ln l),
h AS (SELECT qid, cid, min(pos) AS pos, arg_min(head, pos) AS level FROM hit WHERE hit AND head IS NOT NULL GROUP BY ALL),
hs AS (SELECT h.qid, h.cid, h.pos, coalesce(min(l.pos), 1000) AS stop FROM h LEFT JOIN ln l ON l.qid = h.qid AND l.cid = h.cid AND l.pos > h.pos AND l.head <= h.level GROUP BY ALL),
i AS (SELECT qid, cid, min(pos) AS pos FROM hit WHERE hit AND head IS NULL GROUP BY ALL),
ip AS (SELECT i.qid, i.cid, i.pos, coalesce(max(CASE WHEN l.pos < i.pos THEN l.pos END), 0) AS parent, coalesce(min(CASE WHEN l.pos > i.pos THEN l.pos END), 1000) AS stop FROM i LEFT JOIN ln l ON l.qid = i.qid AND l.cid = i.cid AND l.head IS NOT NULL GROUP BY ALL),
picked AS (SELECT l.qid, l.cid, l.pos, l.line FROM ln l JOIN hs ON l.qid = hs.qid AND l.cid = hs.cid AND l.pos >= hs.pos AND l.pos < hs.stop
  UNION ALL SELECT l.qid, l.cid, l.pos, l.line FROM ln l JOIN ip ON l.qid = ip.qid AND l.cid = ip.cid AND (l.pos = ip.parent OR (l.pos > ip.parent AND l.pos < ip.stop AND l.pos BETWEEN ip.pos - 2 AND ip.pos + 2)) WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.qid = l.qid AND h.cid = l.cid)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid, cid ORDER BY pos) AS nth FROM picked)
SELECT qid, cid, string_agg(line, chr(10) ORDER BY pos) AS excerpt FROM ranked WHERE nth <= 18 GROUP BY qid, cid"""
)


@query("q_excerpt", EXCERPT_SQL.replace("{terms}", "main"))
def q_excerpt(t):
    rows = candidates(t).withColumn("own", evidence.filled_lines(F.col("text")))
    return rows.select("qid", "cid", evidence.excerpt(F.col("own"), F.col("primary_terms")).alias("excerpt")).where("excerpt IS NOT NULL")


FACT_SCORE_SQL = CANDIDATES_SQL + f""", fact_ AS (SELECT qid, cid, pos, line, low, packed FROM ln WHERE head IS NULL),
sc AS (SELECT f.qid, f.cid, f.pos, f.low, (SELECT count(*) FROM lex_subject t WHERE t.qid = f.qid AND {_has('f', 't.k')}) AS ns, (SELECT count(*) FROM lex_intent t WHERE t.qid = f.qid AND {_has('f', 't.k')}) AS ni,
  EXISTS (SELECT 1 FROM lex_subject t WHERE t.qid = f.qid) AS any_s, EXISTS (SELECT 1 FROM lex_intent t WHERE t.qid = f.qid AND t.k IN ('모집', '인원', '정원', '모집인원', '모집정원')) AS counting FROM fact_ f)
SELECT qid, cid, CAST(pos AS INTEGER) AS pos, CAST(CASE WHEN any_s AND ns = 0 THEN 0 ELSE greatest(0, 12 * ns + 4 * ni + CASE WHEN counting AND regexp_matches(low, '{L.COUNT_COLUMN}') THEN 20 ELSE 0 END - CASE WHEN counting AND regexp_matches(low, '{"|".join(L.STATISTICS)}') THEN 10 ELSE 0 END) END AS INTEGER) AS score FROM sc"""


@query("q_fact_score", FACT_SCORE_SQL)
def q_fact_score(t):
    rows = candidates(t).withColumn("terms", analysis.lexical_terms(F.col("question")))
    each = rows.select("qid", "cid", "terms", F.posexplode(evidence.filled_lines(F.col("text"))).alias("pos", "line")).where(~evidence.is_heading(F.col("line")))
    return each.select("qid", "cid", (F.col("pos") + 1).alias("pos"), evidence.fact_score(F.col("line"), F.col("terms")).alias("score"))
