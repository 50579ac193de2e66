"""Evidence that joins facts of a candidate's tables: the subject's row with the row or cell that answers the intent.

Facts are rows beside their candidate (qid, cid, place: their order, fact) and the question's analysis. Nothing is gathered
beyond one candidate's facts.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import lexicon as L
from marginalia.functions.text import TOKEN, by_words, contains_term
from marginalia.operators.analysis import any_of, asked_terms, evidence_terms, words
from marginalia.operators.evidence import has_intent_evidence, looks_like_attire, strong, subject_strongly_matches
from marginalia.operators.table_facts import LEGEND, fact_pairs, fact_subject

# The label where none is found, the word for attire and that for kinds, and the ends of sentences.
SOME_LABEL, ATTIRE, KIND, SENTENCE_END, COUNT_WORD = "관련 정보", "복장", "구분", "(이다|입니다)$", "모집"
_EMPTY = "array<string>"


def attribute_terms(intent: Column, context: Column) -> Column:
    """Words by which the row or column that answers the intent is known, sorted."""
    label = F.create_map(*(x for name, own in L.DEFAULT_LABELS.items() for x in (F.lit(name), words([p for p in re.findall(TOKEN, own) if len(p) >= 2]))))
    known = F.concat(asked_terms(intent), evidence_terms(intent), F.array_intersect(context, words(L.TABLE_INTENT)), F.coalesce(F.try_element_at(label, intent), F.array().cast(_EMPTY)))
    usable = F.filter(F.array_distinct(known), lambda t: (F.length(t) >= 2) & ~t.isin(*L.FUNCTION_WORDS) & ~((intent == "count") & (t == COUNT_WORD)))
    return F.coalesce(F.array_sort(usable), F.array().cast(_EMPTY))


def _holds(text: Column, terms: Column) -> Column:
    return by_words(text, lambda has: F.exists(terms, has))


def _spoken(p: Column) -> Column:
    return F.concat(p["k"], F.lit(" "), p["v"])


def clean_value(value: Column) -> Column:
    flat = F.trim(F.regexp_replace(F.replace(value, F.lit("<br>"), F.lit(" ")), r"(?U)\s+", " "))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(flat, r"^\s*-\s*", ""), r"\s+-\s*", "; "), "^[ ;]+|[ ;]+$", "")


def has_attire(fact: Column, subject: Column, pairs: Column) -> Column:
    return (F.contains(subject, F.lit(ATTIRE)) & looks_like_attire(fact)) | F.exists(pairs, lambda p: (F.contains(_spoken(p), F.lit(ATTIRE)) & looks_like_attire(_spoken(p))) | looks_like_attire(p["v"]))


def attire_value(fact: Column, pairs: Column) -> Column:
    worn = F.transform(F.filter(pairs, lambda p: looks_like_attire(p["v"])), lambda p: p["v"])
    flat = F.trim(F.regexp_replace(F.replace(F.when(F.size(worn) > 0, F.array_join(worn, " ")).otherwise(fact), F.lit("<br>"), F.lit(" ")), r"(?U)\s+", " "))
    parts = F.regexp_replace(F.regexp_replace(flat, r"^\s*-\s*", ""), r"\s+-\s*(상의|하의|신발)\s*[:：]\s*", "; $1: ")
    return F.regexp_replace(F.regexp_replace(parts, r"^(상의|하의|신발)\s*[:：]\s*", "$1: "), "^[ ;]+|[ ;]+$", "")


def matches_attribute(fact: Column, subject: Column, pairs: Column, intent: Column, terms: Column) -> Column:
    """The fact's subject, a pair of it, or a value of it answers the intent."""
    by_pair = F.exists(pairs, lambda p: _holds(_spoken(p), terms) | has_intent_evidence(p["v"], intent))
    return F.when(intent == "attire", has_attire(fact, subject, pairs)).otherwise((F.size(terms) > 0) & (_holds(subject, terms) | by_pair))


def is_label_pair(p: Column, intent: Column) -> Column:
    """A pair that sorts rows rather than answers."""
    squeezed = lambda x: F.regexp_replace(F.lower(x), r"(?U)\s+", "")
    k, v = squeezed(p["k"]), squeezed(p["v"])
    return k.isin(*L.LABEL_KEYS) | F.endswith(k, F.lit(KIND)) | v.isin(*L.LABEL_VALUES) | F.array_contains(asked_terms(intent), v)


def attribute_value(fact: Column, subject: Column, pairs: Column, intent: Column, terms: Column) -> Column:
    """The fact's values that answer the intent, or empty; a fact without pairs as a whole."""
    own = F.filter(pairs, lambda p: ~is_label_pair(p, intent) & (_holds(subject, terms) | _holds(p["k"], terms) | has_intent_evidence(p["v"], intent)))
    values = F.filter(F.transform(own, lambda p: clean_value(p["v"])), lambda v: v != "")
    return F.when(intent == "attire", attire_value(fact, pairs)).when(F.size(pairs) == 0, clean_value(fact)).otherwise(F.array_join(values, "; "))


def by_length(terms: Column) -> Column:
    """The longest first, equal ones by letters."""
    return F.transform(F.array_sort(F.transform(terms, lambda t: F.named_struct(F.lit("n"), -F.length(t), F.lit("t"), t))), lambda x: x["t"])


def attribute_label(subject: Column, pairs: Column, intent: Column, terms: Column) -> Column:
    """What the answer is called: the row's subject, a pair's key, the word that matched, else the intent's own name."""
    default = F.create_map(*(x for name, own in L.DEFAULT_LABELS.items() for x in (F.lit(name), F.lit(own))))
    pair = F.try_element_at(F.filter(pairs, lambda p: _holds(_spoken(p), terms)), F.lit(1))
    term = F.try_element_at(by_length(by_words(_spoken(pair), lambda has: F.filter(terms, has))), F.lit(1))
    found = F.when(contains_term(pair["k"], term), pair["k"]).otherwise(term)
    return F.when(intent == "attire", ATTIRE).when(_holds(subject, terms), subject).otherwise(F.coalesce(found, F.try_element_at(default, intent), F.lit(SOME_LABEL)))


def bridge_label(subject: Column, attribute: Column, context: Column, intent: Column) -> Column:
    """Subject, the question's kind of admission if neither names it, and attribute."""
    default = F.create_map(*(x for name, own in L.DEFAULT_LABELS.items() for x in (F.lit(name), F.lit(own))))
    kind = F.try_element_at(F.filter(words(L.CONTEXT_LABELS), lambda k: F.array_contains(context, k) & ~F.contains(subject, k) & ~F.contains(attribute, k)), F.lit(1))
    parts = F.filter(F.array(F.trim(subject), F.coalesce(kind, F.lit("")), F.trim(attribute)), lambda x: x != "")
    return F.coalesce(F.nullif(F.array_join(parts, " "), F.lit("")), F.try_element_at(default, intent), F.lit(SOME_LABEL))


def _legend_lines(facts: DataFrame) -> DataFrame:
    """For lists: the subjects of rows with a symbol whose meaning the question names, by meaning."""
    every = F.filter(F.array_union(F.array_union("primary_terms", "subject_terms"), F.col("context_terms")), lambda t: (F.length(t) >= 2) & ~t.isin(*L.GENERIC) & ~t.isin(*L.FUNCTION_WORDS))
    rows = facts.where((F.col("intent") == "list") & (F.col("subject") != "")).select("qid", "cid", "place", "subject", every.alias("terms"), F.posexplode("pairs").alias("nth", "p"))
    rows = rows.where(F.contains("p.k", F.lit(LEGEND)) & _holds(F.col("p.v"), F.col("terms")))
    once = rows.groupBy("qid", "cid", F.col("p.v").alias("meaning"), "subject").agg(F.min(F.struct("place", "nth")).alias("at"))
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "subject"))), lambda x: x["subject"]), ", ")
    grouped = once.groupBy("qid", "cid", "meaning").agg(F.min("at").alias("at"), names.alias("names"))
    return grouped.select("qid", "cid", "at", F.concat(F.lit("- "), clean_value(F.col("meaning")), F.lit(": "), F.col("names")).alias("line"), F.lit(True).alias("legend"))


def _subject_labels(facts: DataFrame) -> DataFrame:
    """qid, cid, label: of the words of facts about the subject the one that holds most of its terms, else the longest term."""
    firm = F.filter(strong(F.array_union("primary_terms", "subject_terms")), lambda t: F.length(t) >= 2)
    rows = facts.select("qid", "cid", "place", "about", "intent", firm.alias("terms"), F.posexplode_outer(F.regexp_extract_all("fact", F.lit(TOKEN), 0)).alias("nth", "token"))
    rows = rows.withColumn("token", F.regexp_replace("token", SENTENCE_END, ""))
    matched = by_words(F.col("token"), lambda has: F.filter("terms", has))
    rows = rows.withColumn("weight", F.when(F.col("about") & (F.length("token") >= 2), F.aggregate(F.transform(matched, F.length), F.lit(0), lambda a, x: a + x)))
    best = F.max_by("token", F.when(F.col("weight") > 0, F.struct("weight", F.length("token").alias("n"), -F.col("place"), -F.col("nth"))))
    spare = F.try_element_at(F.filter(by_length(F.col("terms")), lambda k: ~F.array_contains(evidence_terms(F.col("intent")), k)), F.lit(1))
    return rows.withColumn("spare", spare).groupBy("qid", "cid").agg(F.coalesce(best, F.first("spare"), F.lit("")).alias("label"))


def bridged(facts: DataFrame) -> DataFrame:
    """qid, cid, nth (from 1), line: evidence from ``facts`` (qid, cid, place, fact, and the question's analysis). Lists of a
    legend's rows take the place of other evidence; a candidate of which no fact is about the subject has none, and so
    has a question without intent. Values that repeat count once."""
    own = facts.where(F.col("intent").isin(*L.BRIDGE_INTENTS)).withColumn("subject", fact_subject(F.col("fact"))).withColumn("pairs", fact_pairs(F.col("fact")))
    own = own.withColumn("terms", attribute_terms(F.col("intent"), F.col("context_terms"))).withColumn("about", subject_strongly_matches(F.col("fact"), F.col("primary_terms"), F.col("subject_terms")))
    args = [F.col(c) for c in ("fact", "subject", "pairs", "intent", "terms")]
    answers = own.withColumn("any_about", F.max("about").over(Window.partitionBy("qid", "cid"))).where("any_about")
    answers = answers.where(matches_attribute(*args) & (~F.col("intent").isin(*L.DIRECT_INTENTS) | F.col("about")))
    answers = answers.withColumn("value", attribute_value(*args)).where("value <> ''")
    label = bridge_label(F.col("label"), attribute_label(F.col("subject"), F.col("pairs"), F.col("intent"), F.col("terms")), F.col("context_terms"), F.col("intent"))
    spoken = answers.join(_subject_labels(own), ["qid", "cid"]).select("qid", "cid", "place", "value", F.concat(F.lit("- "), label, F.lit(": "), F.col("value")).alias("line"))
    spoken = spoken.groupBy("qid", "cid", "value").agg(F.min_by("line", "place").alias("line"), F.min(F.struct(F.col("place"), F.lit(0).alias("nth"))).alias("at"))
    every = spoken.select("qid", "cid", "at", "line", F.lit(False).alias("legend")).unionByName(_legend_lines(own))
    best = every.withColumn("any_legend", F.max("legend").over(Window.partitionBy("qid", "cid"))).where("legend = any_legend")
    return best.select("qid", "cid", F.row_number().over(Window.partitionBy("qid", "cid").orderBy("at", "line")).alias("nth"), "line")
