"""What a question asks for: its intent, its subject and the words to look for. Many questions run as one batch."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import lexicon as L
from marginalia.functions.text import TOKEN, normalized_token, query_terms, search_form, search_tokens

#: A tokenizer is a column function from a text to its search tokens; a morphological analyser can take its place.
Tokenizer = Callable[[Column], Column]

_WORDS = "array<string>"


def words(terms: list[str]) -> Column:
    return F.array(*map(F.lit, terms)) if terms else F.array().cast(_WORDS)


def any_of(text: Column, terms: list[str]) -> Column:
    """The text holds one of the terms."""
    return text.rlike("|".join(map(re.escape, terms)))


def _by_intent(lists: dict[str, list[str]], intent: Column) -> Column:
    table = F.create_map(*(x for name, terms in lists.items() for x in (F.lit(name), words(terms))))
    return F.coalesce(F.try_element_at(table, F.coalesce(intent, F.lit(""))), F.array().cast(_WORDS))


def asked_terms(intent: Column) -> Column:
    return _by_intent(L.INTENT_TERMS, intent)


def evidence_terms(intent: Column) -> Column:
    return _by_intent(L.EVIDENCE_TERMS, intent)


def with_synonyms(term: Column) -> Column:
    """The term and its synonyms, one hop."""
    table = F.create_map(*(x for name, terms in L.SYNONYMS.items() for x in (F.lit(name), words(terms))))
    return F.array_distinct(F.concat(F.array(term), F.coalesce(F.try_element_at(table, term), F.array().cast(_WORDS))))


def _set(terms: Column) -> Column:
    return F.array_sort(F.array_distinct(terms))


def expanded_terms(text: Column) -> Column:
    """The question's normalised terms with their synonyms, sorted."""
    return _set(F.flatten(F.transform(query_terms(text), with_synonyms)))


def asks_for_collection(text: Column) -> Column:
    """Words for "where" or "which" ask for a list if a collection is named and no place."""
    squeezed = F.replace(F.lower(text), F.lit(" "), F.lit(""))
    where_is = any_of(squeezed, L.WHERE_IS) & ~any_of(squeezed, L.WHERE_COLLECTIONS)
    return ~any_of(squeezed, L.PLACES) & any_of(squeezed, L.COLLECTIONS) & any_of(squeezed, L.LIST_ASKS) & ~where_is


def intent(text: Column, tokens: Column) -> Column:
    """The first intent, by priority, whose terms are a token, or stand in the question without its spaces."""
    squeezed = F.replace(F.lower(text), F.lit(" "), F.lit(""))
    hit = lambda terms: F.arrays_overlap(tokens, words(terms)) | any_of(squeezed, [t for t in terms if len(t) >= 2])
    return F.coalesce(F.when(asks_for_collection(text), "list"), *(F.when(hit(L.INTENT_TERMS[name]), name) for name in L.INTENTS))


def _excluded(intent: Column) -> Column:
    """Words that name an intent, and the evidence of the question's own (of lists none)."""
    every = sorted({t for terms in L.INTENT_TERMS.values() for t in terms})
    return F.concat(words(every), F.when(intent == "list", F.array().cast(_WORDS)).otherwise(evidence_terms(intent)))


def _is_function_word(token: Column) -> Column:
    return token.rlike("|".join(f"(?:{p})" for p in L.NON_SUBJECTS))


def _no_subject(token: Column, excluded: Column) -> Column:
    holds = F.exists(excluded, lambda x: (F.length(x) >= 2) & F.contains(token, x))
    return token.isin(*L.GENERIC) | F.array_contains(excluded, token) | _is_function_word(token) | holds


def compounds(text: Column, excluded: Column, least: int = 2, most: int = 4, chars: int = 4) -> Column:
    """Two to four neighbouring terms joined, of four characters or more; of the terms that name no intent and no function."""
    own = F.filter(query_terms(text), lambda t: ~(F.array_contains(excluded, t) | t.isin(*L.FUNCTION_WORDS) | _is_function_word(t)))
    joined = lambda n: F.transform(F.sequence(F.lit(1), F.size(own) - (n - 1)), lambda i: F.array_join(F.slice(own, i, F.lit(n)), ""))
    runs = [F.when(F.size(own) >= n, joined(n)).otherwise(F.array().cast(_WORDS)) for n in range(least, most + 1)]
    return F.filter(F.array_distinct(F.concat(*runs)), lambda g: F.length(g) >= chars)


def analyzed(questions: DataFrame, tokenizer: Tokenizer = search_tokens) -> DataFrame:
    """``questions`` (qid, text, ...) with tokens, intent (null: none), subject_terms, primary_terms and context_terms, sorted
    arrays. A null text has no terms and no intent."""
    text = F.coalesce(F.col("text"), F.lit(""))
    known = questions.withColumn("tokens", tokenizer(text)).withColumn("intent", intent(text, F.col("tokens"))).withColumn("excluded", _excluded(F.col("intent")))
    candidate = lambda t: F.when(F.length(normalized_token(t)) >= 2, normalized_token(t)).otherwise(t)
    own = lambda terms: F.filter(terms, lambda t: (F.length(t) >= 2) & ~_no_subject(t, F.col("excluded")))
    every = expanded_terms(text)
    known = known.withColumn("subject_terms", _set(own(F.transform("tokens", candidate)))).withColumn("primary_terms", _set(F.concat(own(every), compounds(text, F.col("excluded")))))
    context = F.concat("tokens", every, "subject_terms", "primary_terms")
    return known.withColumn("context_terms", _set(F.filter(context, lambda t: F.length(t) >= 2))).drop("excluded")


def lexical_terms(text: Column) -> Column:
    """struct(subject, intent): the words that a fact of a table is looked up by, sorted. A token whose synonyms touch the
    words of tables gives words of intent, any other words of the subject. A null text has none."""
    text = F.coalesce(text, F.lit(""))

    def parts(raw: Column) -> Column:
        norm = normalized_token(raw)
        every = F.array_distinct(F.concat(F.array(raw), with_synonyms(norm)))
        usable = (F.length(norm) >= 2) | norm.isin(*L.TABLE_INTENT)
        return F.struct(every.alias("terms"), usable.alias("usable"), F.arrays_overlap(every, words(L.TABLE_INTENT)).alias("asks"))

    tokens = F.filter(F.transform(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0), parts), lambda p: p["usable"])
    of = lambda asks: F.flatten(F.transform(F.filter(tokens, lambda p: p["asks"] == asks), lambda p: p["terms"]))
    packed = search_form(text)
    # the one rule that names a domain: advanced-major courses
    advanced = F.contains(packed, F.lit("전공심화")) & any_of(packed, ["과목", "학과"])
    more = lambda terms: F.when(advanced, words(terms)).otherwise(F.array().cast(_WORDS))
    subject = F.concat(F.filter(of(False), lambda t: (F.length(t) >= 3) & ~t.isin(*L.GENERIC)), more(["전공심화", "전공심화과정"]))
    asked = F.concat(F.filter(of(True), lambda t: F.length(t) >= 2), more(["학과", "개설학과", "모집단위"]))
    return F.struct(_set(subject).alias("subject"), _set(asked).alias("intent"))


def asks_table_value(text: Column) -> Column:
    """The question names a subject and a word that tables have."""
    terms = lexical_terms(text)
    return (F.size(terms["subject"]) > 0) & (F.size(terms["intent"]) > 0)
