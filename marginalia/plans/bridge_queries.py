"""Queries over evidence that joins facts. Each question meets the facts of its own nation and of the next."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.functions import lexicon as L
from marginalia.operators import bridge
from marginalia.plans.analysis_queries import _literal, _table
from marginalia.plans.evidence_queries import CANDIDATES_SQL, candidates
from marginalia.plans.registry import query

#: Subject, and (key, value) of two or three pairs, of each nation's facts.
FACTS = [
    ("{n}", [("구분", "{n}"), ("모집인원", "{k}명"), ("비고", "{r}")]),
    ("제출 서류", [("구분", "서류"), ("내용", "- 원본 - 사본 {k}")]),
    ("면접 복장", [("구분", "복장"), ("착용", "- 상의: 흰색 - 하의: 바지")]),
    ("{r}", [("♣ 표시", "우대 {n} 시설"), ("위치", "본관 {k}층")]),
    ("일정", [("기간", "3월 {k}일"), ("등록 비용", "{k}00원")]),
    ("{n} 과정", [("♣ 표시", "우대 {n} 시설"), ("공식", "a {k}")]),
    ("끝", [("기간", "3월 {k}일"), ("이용시간", "9시")]),
]


def facts(t):
    """qid, cid, place, fact and the question's analysis."""
    rows = candidates(t).join(F.broadcast(t("nation").select("n_nationkey", F.col("n_name").alias("own"), "n_regionkey").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "own", F.col("r_name").alias("region_"))), F.col("cid") == F.col("n_nationkey"))  # 25 nations
    texts = [f"표: {s} 행 정보는 " + "; ".join(f"{k}={v}" for k, v in pairs) + "이다." for s, pairs in FACTS]
    rows = rows.withColumn("f", F.explode(F.array(*(F.struct(F.lit(i).alias("place"), F.lit(x).alias("fact")) for i, x in enumerate(texts)))))
    text = F.col("f.fact")
    for name, value in (("{n}", F.col("own")), ("{r}", F.col("region_")), ("{k}", F.col("cid").cast("string"))):
        text = F.replace(text, F.lit(name), value)
    return rows.select("qid", "cid", F.col("f.place").alias("place"), text.alias("fact"), "intent", "subject_terms", "primary_terms", "context_terms")


def _form(column: str) -> str:
    return f"replace(replace(replace({column}, '{{n}}', n_name), '{{r}}', r_name), '{{k}}', CAST(n_nationkey AS VARCHAR))"


def _in(text: str, term: str) -> str:
    return f"(contains(lower({text}), {term}) OR contains(regexp_replace(lower({text}), '[^0-9a-z가-힣]+', '', 'g'), regexp_replace({term}, '[^0-9a-z가-힣]+', '', 'g')))"


_CLEAN = r"trim(regexp_replace(regexp_replace(trim({0}), '^\s*-\s*', ''), '\s+-\s*', '; ', 'g'))"
_EVIDENT = (
    "(CASE WHEN x.intent = 'attire' THEN EXISTS (SELECT 1 FROM attire a WHERE contains(lower(x.v), a.term)) ELSE EXISTS (SELECT 1 FROM evidence e WHERE e.intent = x.intent AND contains(lower(x.v), e.term)) OR"
    " EXISTS (SELECT 1 FROM proof p WHERE p.intent = x.intent AND regexp_matches(lower(x.v), concat('(?m)', p.p))) OR (x.intent = 'list' AND (regexp_matches(x.v, '^[-*]\\s+') OR regexp_matches(x.v, '\\S+\\s*:\\s*\\S+'))) END)"
)
_PAIR_ROWS = ", ".join(f"({i}, {j}, {_literal(s)}, {_literal(k)}, {_literal(v)})" for i, (s, pairs) in enumerate(FACTS) for j, (k, v) in enumerate(pairs))
_LABEL_PARTS = [(i, p) for i, own in L.DEFAULT_LABELS.items() for p in own.split("/") if len(p) >= 2]
BRIDGE_SQL = (
    CANDIDATES_SQL
    + f""", {_table("label_parts", _LABEL_PARTS, "intent, term")}, {_table("defaults", list(L.DEFAULT_LABELS.items()), "intent, label")}, {_table("contexts", list(enumerate(L.CONTEXT_LABELS)), "nth, term")},
raw_pairs(place, i, s, k0, v0) AS (VALUES {_PAIR_ROWS}),
prs AS (SELECT n_nationkey AS cid, place, i, {_form('s')} AS subj, k0 AS k, {_form('v0')} AS v FROM raw_pairs, nation JOIN region ON n_regionkey = r_regionkey),
fx AS (SELECT cid, place, subj, concat('표: ', subj, ' 행 정보는 ', string_agg(concat(k, '=', v), '; ' ORDER BY i), '이다.') AS fact FROM prs GROUP BY cid, place, subj),
fc AS (SELECT c.qid, c.intent, f.*, lower(f.fact) AS low, regexp_replace(lower(f.fact), '[^0-9a-z가-힣]+', '', 'g') AS packed FROM cand c JOIN fx f ON f.cid = c.cid WHERE c.intent IS NOT NULL),
hold AS (SELECT f.qid, f.cid, f.place, bool_or(t.kind = 'p' AND NOT soft) AS p_hit, count(*) FILTER (WHERE t.kind = 's') AS s_hit, count(*) FILTER (WHERE t.kind = 's' AND NOT soft) AS firm_hit FROM fc f JOIN (SELECT qid, k, soft, 'p' AS kind FROM prime WHERE length(k) >= 2 UNION ALL SELECT qid, k, soft, 's' FROM subj) t ON t.qid = f.qid AND {_in('f.fact', 't.k')} GROUP BY ALL),
sizes AS (SELECT i.qid, (SELECT count(*) FROM prime t WHERE t.qid = i.qid AND NOT soft) AS firm_p, (SELECT count(*) FROM subj t WHERE t.qid = i.qid) AS all_s, (SELECT count(*) FROM subj t WHERE t.qid = i.qid AND NOT soft) AS firm_s FROM intents i),
strongly AS (SELECT f.*, coalesce(CASE WHEN firm_p > 0 THEN h.p_hit ELSE (all_s >= 2 AND h.s_hit = all_s) OR (firm_s = 1 AND h.firm_hit = 1) END, false) AS about FROM fc f JOIN sizes z ON z.qid = f.qid LEFT JOIN hold h ON h.qid = f.qid AND h.cid = f.cid AND h.place = f.place),
attrs AS (SELECT DISTINCT qid, term FROM (SELECT i.qid, i.intent, a.term FROM intents i JOIN asked a ON a.intent = i.intent UNION ALL SELECT i.qid, i.intent, e.term FROM intents i JOIN evidence e ON e.intent = i.intent UNION ALL SELECT i.qid, i.intent, x.k FROM intents i JOIN everything x ON x.qid = i.qid JOIN tabular t ON t.term = x.k UNION ALL SELECT i.qid, i.intent, l.term FROM intents i JOIN label_parts l ON l.intent = i.intent)
  WHERE length(term) >= 2 AND term NOT IN (SELECT term FROM functional) AND NOT (intent = 'count' AND term = '모집')),
px AS (SELECT f.qid, f.intent, f.about, p.* FROM strongly f JOIN prs p ON p.cid = f.cid AND p.place = f.place),
pe AS (SELECT x.*, EXISTS (SELECT 1 FROM attrs t WHERE t.qid = x.qid AND {_in('x.subj', 't.term')}) AS in_subj, EXISTS (SELECT 1 FROM attrs t WHERE t.qid = x.qid AND {_in('x.k', 't.term')}) AS in_k, EXISTS (SELECT 1 FROM attrs t WHERE t.qid = x.qid AND {_in("concat(x.k, ' ', x.v)", 't.term')}) AS in_pair, {_EVIDENT} AS evident,
  x.k IN ('구분', '분류', '유형') OR ends_with(replace(x.k, ' ', ''), '구분') OR EXISTS (SELECT 1 FROM asked a WHERE a.intent = x.intent AND a.term = replace(lower(x.v), ' ', '')) AS sorts FROM px x),
related AS (SELECT qid, cid FROM strongly GROUP BY qid, cid HAVING bool_or(about)),
worn AS (SELECT qid, cid, place, i, regexp_replace(regexp_replace(regexp_replace(v, '^\\s*-\\s*', ''), '\\s+-\\s*(상의|하의|신발)\\s*[:：]\\s*', '; \\1: ', 'g'), '^(상의|하의|신발)\\s*[:：]\\s*', '\\1: ') AS v FROM px WHERE EXISTS (SELECT 1 FROM attire a WHERE contains(px.v, a.term))),
vals AS (SELECT qid, cid, place, string_agg({_CLEAN.format('v')}, '; ' ORDER BY i) FILTER (WHERE NOT sorts AND (in_subj OR in_k OR evident)) AS value FROM pe WHERE intent <> 'attire' GROUP BY qid, cid, place HAVING bool_or(in_subj OR in_pair OR evident)
  UNION ALL SELECT qid, cid, place, string_agg(v, ' ' ORDER BY i) FROM worn WHERE qid IN (SELECT qid FROM intents WHERE intent = 'attire') GROUP BY qid, cid, place),
longest AS (SELECT e.qid, e.cid, e.place, e.i, e.k, arg_min(t.term, (-length(t.term), t.term)) AS term FROM pe e JOIN attrs t ON t.qid = e.qid AND {_in("concat(e.k, ' ', e.v)", 't.term')} GROUP BY e.qid, e.cid, e.place, e.i, e.k),
firstpair AS (SELECT qid, cid, place, arg_min(k, i) AS k, arg_min(term, i) AS term FROM longest GROUP BY qid, cid, place),
alabels AS (SELECT f.qid, f.cid, f.place, CASE WHEN f.intent = 'attire' THEN '복장' WHEN EXISTS (SELECT 1 FROM attrs t WHERE t.qid = f.qid AND {_in('f.subj', 't.term')}) THEN f.subj WHEN p.term IS NULL THEN d.label WHEN {_in('p.k', 'p.term')} THEN p.k ELSE p.term END AS label FROM fc f LEFT JOIN firstpair p ON p.qid = f.qid AND p.cid = f.cid AND p.place = f.place LEFT JOIN defaults d ON d.intent = f.intent),
firm AS (SELECT DISTINCT qid, k FROM (SELECT qid, k FROM prime WHERE NOT soft UNION ALL SELECT qid, k FROM subj WHERE NOT soft) WHERE length(k) >= 2),
words_ AS (SELECT qid, cid, place, unnest(w) AS w, generate_subscripts(w, 1) AS nth FROM (SELECT qid, cid, place, regexp_extract_all(fact, '[0-9A-Za-z가-힣]+') AS w FROM strongly WHERE about)),
cut AS (SELECT qid, cid, place, nth, regexp_replace(w, '(이다|입니다)$', '') AS w FROM words_),
weighed AS (SELECT c.qid, c.cid, c.place, c.nth, c.w, sum(length(t.k)) AS weight FROM cut c JOIN firm t ON t.qid = c.qid AND {_in('c.w', 't.k')} WHERE length(c.w) >= 2 GROUP BY ALL),
slabels AS (SELECT r.qid, r.cid, coalesce((SELECT arg_max(w, (weight, length(w), -place, -nth)) FROM weighed x WHERE x.qid = r.qid AND x.cid = r.cid), (SELECT arg_min(k, (-length(k), k)) FROM firm t WHERE t.qid = r.qid AND NOT EXISTS (SELECT 1 FROM intents i JOIN evidence e ON e.intent = i.intent WHERE i.qid = r.qid AND e.term = t.k)), '') AS label FROM related r),
chosen AS (SELECT v.qid, v.cid, v.place, v.value, s.label AS s, a.label AS a FROM vals v JOIN strongly f ON f.qid = v.qid AND f.cid = v.cid AND f.place = v.place JOIN slabels s ON s.qid = v.qid AND s.cid = v.cid JOIN alabels a ON a.qid = v.qid AND a.cid = v.cid AND a.place = v.place WHERE v.value <> '' AND (f.about OR f.intent NOT IN ('count', 'formula'))),
spoken AS (SELECT c.*, (SELECT arg_min(x.term, x.nth) FROM contexts x JOIN everything y ON y.qid = c.qid AND y.k = x.term WHERE NOT contains(c.s, x.term) AND NOT contains(c.a, x.term)) AS kind FROM chosen c),
bridge_lines AS (SELECT qid, cid, min(place) AS place, arg_min(concat('- ', array_to_string(list_filter([s, coalesce(kind, ''), a], lambda x: x <> ''), ' '), ': ', value), place) AS line FROM spoken GROUP BY qid, cid, value),
legend_rows AS (SELECT x.qid, x.cid, x.v, x.subj, min(x.place) AS place FROM px x WHERE x.intent = 'list' AND contains(x.k, '표시') AND EXISTS (SELECT 1 FROM everything t WHERE t.qid = x.qid AND length(t.k) >= 2 AND t.k NOT IN (SELECT term FROM generic) AND t.k NOT IN (SELECT term FROM functional) AND {_in('x.v', 't.k')}) GROUP BY ALL),
legend_lines AS (SELECT qid, cid, min(place) AS place, concat('- ', v, ': ', string_agg(subj, ', ' ORDER BY place)) AS line FROM legend_rows GROUP BY qid, cid, v),
final AS (SELECT * FROM legend_lines UNION ALL SELECT * FROM bridge_lines b WHERE NOT EXISTS (SELECT 1 FROM legend_lines l WHERE l.qid = b.qid AND l.cid = b.cid))"""
)


@query("q_bridge_evidence", BRIDGE_SQL + " SELECT qid, cid, CAST(row_number() OVER (PARTITION BY qid, cid ORDER BY place, line) AS INTEGER) AS nth, line FROM final")
def q_bridge_evidence(t):
    return bridge.bridged(facts(t))
