"""Evidence for a question in a candidate's text: scores, lines that answer, excerpts. All are column functions.

A candidate's row holds the question's analysis beside the text: intent, subject_terms, primary_terms and
context_terms, as of ``analysis.analyzed``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions import lexicon as L
from marginalia.functions.text import by_words, lines, search_form
from marginalia.operators.analysis import any_of, evidence_terms

#: Lines of evidence, and of an excerpt, at most: the feature's own limits.
MOST_FACTS, MOST_LINES, AROUND = 5, 18, 2

# Weights of the scores, and the wording of evidence.
PRIMARY, SUBJECT, WEAK_PRIMARY, WEAK_SUBJECT, ALL_SUBJECTS = 24, 12, 4, 3, 20
EVIDENCE_TERM, EVIDENCE_PATTERN, LIST_ITEM = 6, 8, 8
HEADING_PRIMARY, HEADING_SUBJECT, HEADING_EVIDENCE = 40, 30, 10
FACT_SUBJECT, FACT_INTENT, FACT_COUNT, FACT_STATISTIC = 12, 4, 20, -10
KNOWN_LIST, LOCAL_EVIDENCE, OTHER_EVIDENCE, MORE_EVIDENCE = 520, 140, 90, 25
ITEM, GROUND, PLACE, TIME, SOME_ITEM = "- 관련 항목: ", "- 관련 근거: ", " 위치: ", " 이용/운영시간: ", "관련 항목"

_HEADING = r"^#{1,6}\s+"
_PLACE_END = r"\s*/\s*|\s+이용\s*시간|\s+이용시간|\s+운영\s*시간|\s+운영시간|\s+\d{2,3}-\d{3,4}-\d{4}|\s+\d{1,2}\s*시간"
_TIME_LABEL = r"(?:이용\s*시간|이용시간|운영\s*시간|운영시간)[^:：]*[:：]\s*(.+)"
_TIME_RANGE = r"\d{1,2}\s*:\s*\d{2}\s*[~∼-]\s*\d{1,2}\s*:\s*\d{2}(?:\([^)]*\))?"
_EMPTY = "array<string>"


def filled_lines(text: Column) -> Column:
    return F.filter(F.transform(lines(text), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")


def is_heading(line: Column) -> Column:
    return line.rlike(_HEADING)


def _level(line: Column) -> Column:
    return F.length(F.regexp_extract(line, r"^(#{1,6})\s", 1))


def _weak(term: Column, weak: list[str]) -> Column:
    return term.isin(*weak) if weak else F.lit(False)


def strong(terms: Column, weak: list[str] = L.WEAK_SUBJECTS) -> Column:
    return F.filter(terms, lambda t: ~_weak(t, weak))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _occurrences(low: Column, packed: Column, term: Column) -> Column:
    key = F.lower(term)
    plain = ((F.length(low) - F.length(F.replace(low, key, F.lit("")))) / F.length(key)).cast("int")
    return F.when(F.length(key) == 0, 0).when(plain > 0, plain).when((F.length(search_form(term)) > 0) & F.contains(packed, search_form(term)), 1).otherwise(0)


def subject_score(low: Column, packed: Column, primary: Column, subject: Column, weak: list[str] = L.WEAK_SUBJECTS) -> Column:
    """By occurrences of the primary and the subject terms in a text in lower case (``low``) and in its search form
    (``packed``); more if all subject terms occur and one of them isn't weak."""
    part = lambda terms, most, weight, less: _sum(F.transform(terms, lambda k: F.least(_occurrences(low, packed, k), F.lit(most)) * F.when(_weak(k, weak), less).otherwise(weight)))
    all_found = (F.size(strong(subject, weak)) > 0) & F.forall(subject, lambda k: _occurrences(low, packed, k) > 0)
    return (part(primary, 4, PRIMARY, WEAK_PRIMARY) + part(subject, 5, SUBJECT, WEAK_SUBJECT) + F.when(all_found, ALL_SUBJECTS).otherwise(0)).cast("int")


def is_item(line: Column) -> Column:
    return line.rlike(r"(?U)^[-*]\s+") | line.rlike(r"(?U)\S+\s*:\s*\S+")


def intent_score(low: Column, text_lines: Column, intent: Column) -> Column:
    """By terms and patterns of the intent's evidence, and for lists by lines that look like items; no intent: 0."""
    terms = _sum(F.transform(evidence_terms(intent), lambda k: F.when(F.contains(low, k), EVIDENCE_TERM).otherwise(0)))
    by_pattern = F.lit(0)
    for name, patterns in L.EVIDENCE_PATTERNS.items():
        found = sum((F.least(F.regexp_count(low, F.lit(f"(?mU){p}")), F.lit(5)) * EVIDENCE_PATTERN for p in patterns), F.lit(0))
        by_pattern = F.when(intent == name, found).otherwise(by_pattern)
    items = F.least(F.size(F.filter(text_lines, lambda x: ~F.startswith(x, F.lit("#")) & is_item(x))), F.lit(8)) * LIST_ITEM
    return (terms + by_pattern + F.when(intent == "list", items).otherwise(0)).cast("int")


def heading_score(text_lines: Column, intent: Column, primary: Column, subject: Column) -> Column:
    """By headings that hold a primary term that isn't weak, a subject term, or evidence of the intent."""
    holds = lambda line, terms, score: F.when(F.exists(terms, lambda k: F.contains(F.lower(line), k)), score).otherwise(0)
    one = lambda line: holds(line, strong(primary), HEADING_PRIMARY) + holds(line, subject, HEADING_SUBJECT) + holds(line, evidence_terms(intent), HEADING_EVIDENCE)
    return _sum(F.transform(F.filter(text_lines, is_heading), one)).cast("int")


def fact_score(fact: Column, terms: Column) -> Column:
    """How well a table's fact matches the words of ``analysis.lexical_terms``; 0 if no word of the subject does."""
    count = lambda words: by_words(fact, lambda has: F.size(F.filter(words, has)))
    subject, asked = terms["subject"], terms["intent"]
    counting = F.arrays_overlap(asked, F.array(*map(F.lit, L.COUNT_ASKS)))
    score = count(subject) * FACT_SUBJECT + count(asked) * FACT_INTENT
    score = score + F.when(counting & F.lower(fact).rlike(L.COUNT_COLUMN), FACT_COUNT).otherwise(0) + F.when(counting & any_of(F.lower(fact), L.STATISTICS), FACT_STATISTIC).otherwise(0)
    return F.when((F.size(subject) > 0) & (count(subject) == 0), 0).otherwise(F.greatest(score, F.lit(0))).cast("int")


def looks_like_attire(text: Column) -> Column:
    return any_of(F.lower(text), L.ATTIRE)


def has_intent_evidence(line: Column, intent: Column) -> Column:
    """A line holds a value that answers the intent."""
    low = F.lower(line)
    hit = F.exists(evidence_terms(intent), lambda k: F.contains(low, k))
    for name, patterns in L.EVIDENCE_PATTERNS.items():
        hit = hit | ((intent == name) & low.rlike("(?mU)" + "|".join(f"(?:{p})" for p in patterns)))
    hit = hit | ((intent == "list") & is_item(F.regexp_replace(line, r"(?U)^\s+|\s+$", "")))
    return F.coalesce(F.when(intent == "attire", looks_like_attire(line)).otherwise(hit), F.lit(False))


def _usable(terms: Column) -> Column:
    return F.filter(terms, lambda k: F.length(k) >= 2)


def subject_matches(text: Column, primary: Column, subject: Column) -> Column:
    """The text is about the subject: a strong primary term, all of two or more subject terms, or the only strong one."""
    own, firm = _usable(subject), strong(_usable(subject))
    return by_words(text, lambda has: F.exists(strong(_usable(primary)), has) | ((F.size(own) >= 2) & F.forall(own, has)) | ((F.size(firm) == 1) & F.exists(firm, has)))


def subject_strongly_matches(text: Column, primary: Column, subject: Column) -> Column:
    """As ``subject_matches``, by the strong primary terms alone if there are any."""
    firm = strong(_usable(primary))
    return F.when(F.size(firm) > 0, by_words(text, lambda has: F.exists(firm, has))).otherwise(subject_matches(text, primary, subject))


def _colon(line: Column) -> Column:
    return F.when(F.contains(line, F.lit(":")), F.lit(":")).when(F.contains(line, F.lit("：")), F.lit("："))


def item_label(line: Column, primary: Column, subject: Column) -> Column:
    """What stands before the colon; without one the longest term that the line holds (of equal ones the first)."""
    ranked = lambda own: F.array_sort(F.transform(own, lambda k: F.named_struct(F.lit("n"), -F.length(k), F.lit("k"), k)))
    term = lambda terms: F.try_element_at(ranked(by_words(line, lambda has: F.filter(terms, has))), F.lit(1))["k"]
    return F.coalesce(F.trim(F.split_part(line, _colon(line), F.lit(1))), term(primary), term(subject), F.lit(SOME_ITEM))


def colon_value(line: Column) -> Column:
    behind = F.trim(F.substring(line, F.locate(":", line) + 1, F.length(line)))
    wide = F.trim(F.substring(line, F.locate("：", line) + 1, F.length(line)))
    return F.when(F.contains(line, F.lit(":")), behind).when(F.contains(line, F.lit("：")), wide).otherwise(F.trim(line))


def place_value(line: Column) -> Column:
    """A place without what follows it: times, numbers, other columns."""
    return F.coalesce(F.nullif(F.trim(F.split(colon_value(line), f"(?U){_PLACE_END}", 2)[0]), F.lit("")), F.trim(line))


def time_value(line: Column) -> Column:
    labelled, spans = F.trim(F.regexp_extract(line, f"(?U){_TIME_LABEL}", 1)), F.trim(F.regexp_extract(line, f"(?U){_TIME_RANGE}", 0))
    return F.coalesce(F.nullif(labelled, F.lit("")), F.nullif(spans, F.lit("")), F.trim(line))


def formatted(line: Column, intent: Column, primary: Column, subject: Column) -> Column:
    """A line as evidence, in the words of its intent."""
    label = item_label(line, primary, subject)
    return (
        F.when(intent == "location", F.concat(F.lit("- "), label, F.lit(PLACE), place_value(line)))
        .when(intent == "time", F.concat(F.lit("- "), label, F.lit(TIME), time_value(line)))
        .when(intent == "list", F.concat(F.lit(ITEM), line))
        .otherwise(F.concat(F.lit(GROUND), line))
    )


def _first_where(rows: Column, test: Callable[[Column], Column]) -> Column:
    """The place (from 1) of the first line that passes, or 0."""
    return F.array_position(F.transform(rows, test), True).cast("int")


def _next_heading(rows: Column, place: Column) -> Column:
    """The place of the first heading behind ``place``, or one behind the last line."""
    found = F.array_position(F.transform(rows, lambda x, i: (i + 1 > place) & is_heading(x)), True).cast("int")
    return F.when(found > 0, found).otherwise(F.size(rows) + 1)


def section_items(rows: Column, intent: Column, primary: Column, subject: Column, context: Column) -> Column:
    """For lists: the lines under the first heading that holds a term of the question."""
    terms = F.when(F.size(primary) > 0, primary).when(F.size(subject) > 0, subject).otherwise(context)
    place = _first_where(rows, lambda x: is_heading(x) & by_words(x, lambda has: F.exists(terms, has)))
    own = F.slice(rows, place + 1, _next_heading(rows, place) - place - 1)
    return F.when((intent == "list") & (place > 0), F.transform(own, lambda x: F.concat(F.lit(ITEM), x))).otherwise(F.array().cast(_EMPTY))


def subject_lines(rows: Column, intent: Column, primary: Column, subject: Column) -> Column:
    """Lines about the subject, by their label if they have one; for values of a line's own only with such a value."""
    label = lambda x: F.coalesce(F.trim(F.split(x, "[:：]", 2)[0]), x)
    local = intent.isin(*L.LOCAL_INTENTS)
    own = F.filter(rows, lambda x: ~is_heading(x) & subject_matches(label(x), primary, subject) & (~local | has_intent_evidence(x, intent)))
    return F.transform(own, lambda x: formatted(x, intent, primary, subject))


def evidence_lines(rows: Column, known: Column, intent: Column, primary: Column, subject: Column, context: Column, most: int = MOST_FACTS) -> Column:
    """At most ``most`` lines of evidence, each once: known ones, items of a list's section, lines about the subject."""
    every = F.concat(F.coalesce(known, F.array().cast(_EMPTY)), section_items(rows, intent, primary, subject, context), subject_lines(rows, intent, primary, subject))
    return F.when(intent.isNull(), F.array().cast(_EMPTY)).otherwise(F.slice(F.array_distinct(every), 1, most))


def evidence_score(found: Column, known: Column, intent: Column) -> Column:
    base = F.when((F.size(F.coalesce(known, F.array().cast(_EMPTY))) > 0) & (intent == "list"), KNOWN_LIST).when(intent.isin(*L.LOCAL_INTENTS), LOCAL_EVIDENCE).otherwise(OTHER_EVIDENCE)
    return F.when(F.size(found) > 0, base + F.least(F.size(found) - 1, F.lit(4)) * MORE_EVIDENCE).otherwise(0).cast("int")


def excerpt(rows: Column, terms: Column, around: int = AROUND, most: int = MOST_LINES) -> Column:
    """The section under the first heading that holds a term; else the first line that holds one, its heading and its
    neighbours in the section. Null if no line holds a term."""
    holds = lambda x: F.exists(terms, lambda k: F.contains(F.lower(x), k))
    head = _first_where(rows, lambda x: is_heading(x) & holds(x))
    closes = F.array_position(F.transform(rows, lambda x, i: (i + 1 > head) & is_heading(x) & (_level(x) <= _level(F.try_element_at(rows, head)))), True).cast("int")
    section = F.slice(rows, head, F.when(closes > 0, closes).otherwise(F.size(rows) + 1) - head)

    item = _first_where(rows, lambda x: ~is_heading(x) & holds(x))
    parent = F.coalesce(F.array_max(F.transform(rows, lambda x, i: F.when((i + 1 < item) & is_heading(x), i + 1).otherwise(0))), F.lit(0))
    begin, stop = F.greatest(parent + 1, item - around), F.least(_next_heading(rows, item), item + around + 1)
    near = F.filter(F.slice(rows, begin, stop - begin), lambda x: ~is_heading(x))
    named = F.when(parent > 0, F.concat(F.array(F.element_at(rows, F.greatest(parent, F.lit(1)))), near)).otherwise(near)
    return F.when(head > 0, F.array_join(F.slice(section, 1, most), "\n")).when(item > 0, F.array_join(F.slice(named, 1, most), "\n"))
