"""From questions to answers: hits of three kinds, one list of candidates, scores, context, answers, and a trace of all steps.

Many questions run as one batch; everything after the hits is dealt by question.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.functions import lexicon as L
from marginalia.functions.text import preview, search_form
from marginalia.operators import analysis, bridge, evidence, hits, ranking, sparse_index
from marginalia.operators.tables import chunk_number
from marginalia.sources.scratch import kept

#: The order of the kinds of hits in the list.
FACT_HIT, SPARSE_HIT, VECTOR_HIT = 0, 1, 2
#: Facts of a candidate's own tables that are shown with it, at most.
OWN_FACTS = 2
_EMPTY = "array<string>"

# The layout of context.
NO_SOURCE = "알 수 없는 문서"
BLOCK, SOURCE, PAGE, CHUNK, SECTION = "[출처 ", "문서: ", "위치: ", "청크: ", "섹션: "
MATCHED, FOUND, EXCERPT, WHOLE = "\n표 검색 정보:\n", "\n질문 의도 추출 정보:\n", "\n질문 관련 발췌:\n", "\n전체 내용:\n"

#: What an answer starts from, where no other policy is given, and what is always added to it.
POLICY = "Answer in the language of the question, briefly and by the sources below."
RULES = "Use only what the sources say. Name the source's number. Where they don't answer, say so."
NO_ANSWER = "The documents hold nothing on this question."


def page_label(start: Column, end: Column) -> Column:
    span = F.when(end.isNotNull() & (end != start), F.concat(start.cast("string"), F.lit("-"), end.cast("string"))).otherwise(start.cast("string"))
    return F.when(start.isNotNull(), F.concat(F.lit("PDF "), span, F.lit("페이지")))


def chunk_label(index: Column, chunk_id: Column) -> Column:
    """The chunk's place in its document, from 1; by its key where the index is missing."""
    nth = F.coalesce(index.cast("int"), chunk_number(chunk_id)) + 1
    return F.when(nth.isNotNull(), F.concat(F.lit("문서 내 "), nth.cast("string"), F.lit("번째 청크")))


def search_text(text: Column, path: Column) -> Column:
    """A chunk as it is searched: the path of its headings counts twice."""
    return F.when(F.coalesce(path, F.lit("")) != "", F.concat_ws("\n", path, path, text)).otherwise(text)


def trace_key(chunk_id: Column, role: Column, parent: Column) -> Column:
    """The key under which a hit is traced: its chunk's, for a fact."""
    return F.when((role == "table_fact") & (F.coalesce(parent, F.lit("")) != ""), parent).otherwise(chunk_id)


def context_block(row: dict[str, Column]) -> Column:
    """One candidate as a block of context, from pos, source, page_start, page_end, chunk_index, chunk_id, path, matched, found,
    excerpt and text. Parts that are missing are left out."""
    named = lambda head, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(head), value))
    source = F.coalesce(F.nullif(F.trim(row["source"]), F.lit("")), F.lit(NO_SOURCE))
    meta = F.concat_ws("\n", F.concat(F.lit(SOURCE), source), named(PAGE, page_label(row["page_start"], row["page_end"])), named(CHUNK, chunk_label(row["chunk_index"], row["chunk_id"])), named(SECTION, row["path"]))
    part = lambda head, value: F.coalesce(named(head, value), F.lit(""))
    return F.concat(F.lit(BLOCK), row["pos"].cast("string"), F.lit("]\n"), meta, part(MATCHED, F.array_join(row["matched"], "\n")), part(FOUND, F.array_join(row["found"], "\n")), part(EXCERPT, row["excerpt"]), F.lit(WHOLE), F.trim(row["text"]))


def prompt(context: Column, question: Column, policy: Column | None = None) -> Column:
    """Policy (the default where it is blank), rules, context and question."""
    own = F.lit(POLICY) if policy is None else F.coalesce(F.nullif(F.trim(policy), F.lit("")), F.lit(POLICY))
    return F.concat_ws("\n\n", own, F.lit(RULES), F.concat(F.lit("Sources:\n"), context), F.concat(F.lit("Question:\n"), question))


@dataclass
class Retrieval:
    """What the steps give. ``stages`` holds the candidates after each step: expanded, prioritized, focused, final."""

    analysis: DataFrame
    hits: DataFrame
    stages: dict[str, DataFrame] = field(default_factory=dict)

    @property
    def final(self) -> DataFrame:
        return self.stages["final"]


def gathered(index: DataFrame, found: dict[int, DataFrame]) -> DataFrame:
    """The hits of all kinds (qid, chunk_id, rank, and score or distance) with their rows of the index."""
    rows = None
    for kind, frame in found.items():
        value = F.col("distance") if "distance" in frame.columns else F.col("score")
        own = frame.select("qid", F.lit(kind).alias("source"), "rank", "chunk_id", value.cast("double").alias("value"))
        rows = own if rows is None else rows.unionByName(own)
    return rows.join(index.select("chunk_id", "chunk_role", F.col("parent_chunk_id").alias("parent_id"), F.col("parent_content").alias("parent_text"), "text"), "chunk_id")


def _scored(rows: DataFrame) -> DataFrame:
    """Candidates with their lines of evidence and the parts of their score."""
    searched = search_text(F.col("text"), F.col("path"))
    rows = rows.withColumn("searched", searched).withColumn("low", F.lower("searched")).withColumn("packed", search_form(F.col("searched")))
    rows = rows.withColumn("searched_lines", evidence.filled_lines(F.col("searched"))).withColumn("own_lines", evidence.filled_lines(F.col("text")))
    c = {n: F.col(n) for n in ("intent", "primary_terms", "subject_terms", "context_terms", "known")}
    rows = rows.withColumn("found", evidence.evidence_lines(F.col("own_lines"), c["known"], c["intent"], c["primary_terms"], c["subject_terms"], c["context_terms"]))
    rows = rows.withColumn("subject_score", evidence.subject_score(F.col("low"), F.col("packed"), c["primary_terms"], c["subject_terms"]))
    rows = rows.withColumn("intent_score", F.coalesce(evidence.intent_score(F.col("low"), F.col("searched_lines"), c["intent"]), F.lit(0)))
    rows = rows.withColumn("heading_score", evidence.heading_score(F.col("searched_lines"), c["intent"], c["primary_terms"], c["subject_terms"]))
    rows = rows.withColumn("evidence_score", evidence.evidence_score(F.col("found"), c["known"], c["intent"]))
    rows = rows.withColumn("fact_score", F.coalesce(F.array_max(F.transform("matched", lambda f: evidence.fact_score(f, F.col("terms")))), F.lit(0)))
    total = F.col("subject_score") + F.col("intent_score") + F.col("heading_score") + F.col("evidence_score") + F.col("fact_score")
    return rows.withColumn("total", total).drop("low", "packed", "searched", "searched_lines")


def _with_own_facts(candidates: DataFrame, asked: DataFrame, index: DataFrame) -> DataFrame:
    """Candidates with matched (facts that were hit, and the best of their own tables) and known (evidence that joins facts), where
    the question asks for a table's value or has an intent that tables answer."""
    facts = index.where("chunk_role = 'table_fact'").select(F.col("parent_chunk_id").alias("result_id"), (F.col("fact_index") + 1000).alias("place"), F.col("text").alias("fact"))
    extracted = candidates.select("qid", "result_id").join(facts, "result_id").select("qid", "result_id", "place", "fact")
    hit = candidates.select("qid", "result_id", F.posexplode("facts").alias("place", "fact"))
    every = hit.unionByName(extracted).join(asked.select("qid", "intent", "subject_terms", "primary_terms", "context_terms"), "qid")
    lines = bridge.bridged(every.withColumnRenamed("result_id", "cid")).withColumnRenamed("cid", "result_id")
    known = lines.groupBy("qid", "result_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "line"))), lambda x: x["line"]).alias("known"))
    worth = extracted.join(asked.select("qid", "terms", "table_value", "intent"), "qid").where(F.col("table_value") | F.col("intent").isin(*L.BRIDGE_INTENTS))
    worth = worth.withColumn("score", evidence.fact_score(F.col("fact"), F.col("terms"))).where("score > 0")
    best = F.row_number().over(Window.partitionBy("qid", "result_id").orderBy(F.desc("score"), "place"))
    own = worth.withColumn("nth", best).where(F.col("nth") <= OWN_FACTS).groupBy("qid", "result_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "fact"))), lambda x: x["fact"]).alias("own"))
    joined = candidates.join(known, ["qid", "result_id"], "left").join(own, ["qid", "result_id"], "left")
    none = F.array().cast(_EMPTY)
    return joined.withColumn("known", F.coalesce("known", none)).withColumn("matched", F.array_union("facts", F.coalesce("own", none))).drop("own", "facts")


def retrieve(questions: DataFrame, index: DataFrame, found: dict[int, DataFrame], k: int = 5) -> Retrieval:
    """The candidates for ``questions`` (qid, text) from the hits of each kind (``FACT_HIT`` and so on), best first.

    The facts of a candidate's tables are the index's rows. Facts are replaced by their chunks; for questions after a table's value, candidates whose facts match far worse than the best go;
    the others are ordered by their score, which a question without subject and intent doesn't change; if any has evidence,
    only such stay; the first ``k`` are final. ``index`` holds chunk_id, chunk_role, parent_chunk_id, parent_content, text, path,
    source, page_start, page_end, chunk_index, document_id.
    """
    terms = F.col("terms")
    asked = analysis.analyzed(questions).withColumn("terms", analysis.lexical_terms(F.coalesce("text", F.lit(""))))
    asked = kept(asked.withColumn("table_value", (F.size(terms["subject"]) > 0) & (F.size(terms["intent"]) > 0)), "asked")
    own_hits = kept(gathered(index, found), "hits")  # a few for each question
    raw = index.where("chunk_role = 'raw'")
    expanded = ranking.expanded(own_hits, raw.select("chunk_id", "text"))
    meta = ["path", "source", "page_start", "page_end", "chunk_index", "document_id"]
    # a fact whose chunk isn't stored brings its chunk's columns
    rows = index.withColumn("result_id", F.when(F.col("chunk_role") == "raw", F.col("chunk_id")).otherwise(F.coalesce("parent_chunk_id", "chunk_id"))).groupBy("result_id").agg(*(F.min_by(c, F.struct(F.col("chunk_role") != "raw", "chunk_id")).alias(c) for c in meta))
    candidates = kept(_with_own_facts(kept(expanded.join(rows, "result_id", "left"), "expanded"), asked, index), "candidates")
    candidates = kept(_scored(candidates.join(asked.select("qid", F.col("text").alias("question"), "intent", "subject_terms", "primary_terms", "context_terms", "terms", "table_value"), "qid")), "scored")
    result = Retrieval(asked, own_hits, {"expanded": candidates})
    valued = candidates.withColumn("score", F.when(F.col("table_value"), F.col("fact_score")).otherwise(0))
    result.stages["prioritized"] = ranking.prioritized(valued)
    decides = (F.size("subject_terms") > 0) | F.col("intent").isNotNull()
    reranked = ranking.reranked(result.stages["prioritized"].withColumn("score", F.when(decides, F.col("total")).otherwise(0)))
    result.stages["focused"] = ranking.focused(reranked, (F.size("found") > 0) & F.col("intent").isin(*L.FOCUSED_INTENTS))
    result.stages["final"] = result.stages["focused"].withColumn("selected", F.col("pos") <= k)
    return result


def contexts(final: DataFrame) -> DataFrame:
    """qid, question, context: the selected candidates as numbered blocks."""
    excerpt = F.coalesce(evidence.excerpt(F.col("own_lines"), F.col("primary_terms")), evidence.excerpt(F.col("own_lines"), F.col("context_terms")))
    rows = final.where("selected").withColumn("excerpt", excerpt).withColumn("chunk_id", F.col("result_id"))
    names = ("pos", "source", "page_start", "page_end", "chunk_index", "chunk_id", "path", "matched", "found", "excerpt", "text")
    blocks = rows.withColumn("block", context_block({n: F.col(n) for n in names}))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "block"))), lambda x: x["block"])
    return blocks.groupBy("qid", "question").agg(F.array_join(ordered, "\n\n").alias("context"))


def sources(final: DataFrame, chars: int = 200) -> DataFrame:
    """qid, pos and what is told of each selected candidate."""
    return final.where("selected").select("qid", "pos", F.col("result_id").alias("chunk_id"), "document_id", "source", "page_start", "page_end", F.coalesce(F.col("chunk_index").cast("int"), chunk_number(F.col("result_id"))).alias("chunk_index"), "path", F.left("text", F.lit(chars)).alias("content"))


#: An answerer gives answers (qid, answer) from prompts (qid, question, context, prompt).
Answerer = Callable[[DataFrame], DataFrame]


def extractive(final: DataFrame) -> DataFrame:
    """qid, answer: the best candidate's lines of evidence, or the beginning of its text."""
    first = final.where("selected AND pos = 1")
    return first.select("qid", F.when(F.size("found") > 0, F.array_join("found", "\n")).otherwise(preview(F.col("text"))).alias("answer"))


def answered(questions: DataFrame, result: Retrieval, answerer: Answerer | None = None, policy: str | None = None) -> DataFrame:
    """qid, answer, sources: for each question; without any candidate a fixed answer and no sources. The default answer quotes."""
    own = contexts(result.final).withColumn("prompt", prompt(F.col("context"), F.col("question"), None if policy is None else F.lit(policy)))
    answers = extractive(result.final) if answerer is None else answerer(own).select("qid", "answer")
    rows = sources(result.final)
    told = rows.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct(*(c for c in rows.columns if c != "qid")))).alias("sources"))
    joined = questions.select("qid").join(told, "qid", "left").join(answers, "qid", "left")
    empty = F.array().cast(told.schema["sources"].dataType)
    return joined.select("qid", F.when(F.col("sources").isNull(), NO_ANSWER).otherwise(F.col("answer")).alias("answer"), F.coalesce("sources", empty).alias("sources"))


def frames(answers: DataFrame) -> DataFrame:
    """qid, seq, kind, payload: an answer as a stream's frames, its words as tokens and a last frame that tells it is done. Without
    sources one last frame holds the answer; empty tokens are left out."""
    words = F.filter(F.split("answer", "(?<=\\s)"), lambda w: w != "")
    tokens = F.when(F.size("sources") > 0, F.transform(words, lambda w: F.named_struct(F.lit("kind"), F.lit("token"), F.lit("payload"), w))).otherwise(F.array().cast("array<struct<kind:string,payload:string>>"))
    last = F.array(F.named_struct(F.lit("kind"), F.lit("done"), F.lit("payload"), F.when(F.size("sources") > 0, "").otherwise(F.col("answer"))))
    rows = answers.select("qid", F.posexplode(F.concat(tokens, last)).alias("seq", "f"))
    return rows.select("qid", (F.col("seq") + 1).alias("seq"), "f.kind", "f.payload")


def provenance(own_hits: DataFrame) -> DataFrame:
    """qid, key, methods, and for each kind of hit its first rank and value: where a candidate came from."""
    names = {VECTOR_HIT: "vector", SPARSE_HIT: "bm25", FACT_HIT: "table_fact_lexical"}
    keyed = own_hits.withColumn("key", trace_key(F.col("chunk_id"), F.col("chunk_role"), F.col("parent_id")))
    method = F.create_map(*(x for kind, name in names.items() for x in (F.lit(kind), F.lit(name))))
    # the vector's hits are recorded first
    order = F.create_map(F.lit(VECTOR_HIT), F.lit(0), F.lit(SPARSE_HIT), F.lit(1), F.lit(FACT_HIT), F.lit(2))
    keyed = keyed.withColumn("method", F.element_at(method, F.col("source"))).withColumn("turn", F.element_at(order, F.col("source")))
    per_kind = []
    for kind, name in names.items():
        mine = F.when(F.col("source") == kind, F.struct("rank", "value", "chunk_id"))
        per_kind += [F.min(mine)["rank"].alias(f"{name}_rank"), F.min(mine)["value"].alias(f"{name}_value"), F.min(mine)["chunk_id"].alias(f"{name}_hit")]
    methods = F.transform(F.array_sort(F.collect_set(F.struct("turn", "method"))), lambda x: x["method"])
    return keyed.groupBy("qid", "key").agg(methods.alias("methods"), *per_kind)


def trace(result: Retrieval) -> DataFrame:
    """All candidates after each step in one table: stage, qid, pos, their scores, evidence and where they came from."""
    columns = ["qid", "pos", "result_id", "document_id", "source", "chunk_index", "path", "subject_score", "intent_score", "heading_score", "evidence_score", "fact_score", "total", "found", "matched"]
    every = None
    for stage, rows in result.stages.items():
        selected = F.col("selected") if "selected" in rows.columns else F.lit(False)
        own = rows.select(F.lit(stage).alias("stage"), *columns, preview(F.col("text")).alias("content_preview"), selected.alias("selected_for_prompt"))
        every = own if every is None else every.unionByName(own)
    return every.join(provenance(result.hits).withColumnRenamed("key", "result_id"), ["qid", "result_id"], "left")


def searched(spark: SparkSession, questions: DataFrame, index: DataFrame, sparse_path: str, k: int = 5, vectors: DataFrame | None = None, question_vectors: DataFrame | None = None) -> Retrieval:
    """``retrieve`` with hits by words of facts, by the stored BM25 index of the raw rows, and, where there are vectors of the index's
    rows (chunk_id, embedding) and of the questions (qid, embedding), by distance."""
    facts = index.where("chunk_role = 'table_fact'").withColumn("place", F.xxhash64("parent_chunk_id").bitwiseAND(F.lit((1 << 40) - 1)) * 64 + F.col("fact_index"))
    found = {FACT_HIT: hits.facts_by_words(facts.select("chunk_id", "place", "text"), questions), SPARSE_HIT: sparse_index.search(spark, sparse_path, questions, k, key_type="string").withColumnRenamed("key", "chunk_id")}
    if vectors is not None and question_vectors is not None:
        found[VECTOR_HIT] = hits.nearest(vectors, question_vectors, hits.retrieval_limit(k))
    return retrieve(questions, index, found, k)
