"""Column functions: text normalisation, lines, search tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters of the search alphabet: digits, Latin letters, Hangul syllables.
HANGUL = "가-힣"
#: Suffix particles that a query token loses, the first that matches.
PARTICLES = "에게는 한테는 에서는 으로는 로는 에는 으로 에서 에게 한테 부터 까지 은 는 이 가 을 를 의 도 만 와 과 에 로".split()
TOKEN = f"[0-9A-Za-z{HANGUL}]+"


def normalize_text(text: Column) -> Column:
    """Joins Hangul syllables across runs of three or more line feeds, then cuts such runs to two."""
    return F.regexp_replace(F.regexp_replace(text, f"([{HANGUL}])\\n{{3,}}([{HANGUL}])", "$1$2"), "\\n{3,}", "\n\n")


def without_space(text: Column) -> Column:
    return F.regexp_replace(text, "(?U)\\s+", "")


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "(?U)\\s+", " "))


def search_form(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), f"[^0-9a-z{HANGUL}]+", "")


def preview(text: Column, limit: int = 360) -> Column:
    stripped = F.regexp_replace(text, "(?U)^\\s+|\\s+$", "")
    return F.when(F.length(stripped) > limit, F.concat(F.regexp_replace(F.left(stripped, F.lit(limit)), "(?U)\\s+$", ""), F.lit("..."))).otherwise(stripped)


def contains_term(text: Column, term: Column) -> Column:
    """The term occurs in lower case, or in the search form; an empty term doesn't."""
    return (F.length(term) > 0) & (F.contains(F.lower(text), F.lower(term)) | ((F.length(search_form(term)) > 0) & F.contains(search_form(text), search_form(term))))


def by_words(text: Column, test: Callable[[Callable[[Column], Column]], Column]) -> Column:
    """What ``test`` makes of a function that tells whether the text holds a word, as ``contains_term`` does; words are tokens in
    lower case, and the text's forms are worked out once for all of them."""
    forms = F.array(F.named_struct(F.lit("low"), F.lower(text), F.lit("packed"), search_form(text)))
    return F.transform(forms, lambda f: test(lambda k: F.contains(f["low"], k) | F.contains(f["packed"], k)))[0]


def lines(text: Column) -> Column:
    return F.split(text, "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")


def first_line(text: Column) -> Column:
    return F.coalesce(F.try_element_at(F.filter(F.transform(lines(text), collapse_ends), lambda x: x != ""), F.lit(1)), F.lit(""))


def collapse_ends(line: Column) -> Column:
    return F.regexp_replace(line, "(?U)^\\s+|\\s+$", "")


def page_snippets(text: Column, size: int = 120, least: int = 8) -> Column:
    """Beginning, middle and end of the text without white space, of ``size`` characters, if long enough."""
    packed = without_space(text)
    n = F.least(F.lit(size), F.length(packed))
    rest = F.length(packed) - n
    starts = F.array_distinct(F.array(F.lit(0), F.floor(rest / 2).cast("int"), rest))
    return F.filter(F.transform(starts, lambda s: F.substring(packed, s + 1, n)), lambda x: F.length(x) >= least)


def normalized_token(token: Column) -> Column:
    return F.regexp_replace(F.lower(token), f"(?<=.)(?:{'|'.join(PARTICLES)})$", "")


def search_tokens(text: Column) -> Column:
    """Each lower-case token and its normalised form (once, if equal), of two characters or more."""
    low = F.lower(text)
    raw = F.regexp_extract_all(low, F.lit(TOKEN), 0)
    both = F.filter(F.flatten(F.transform(raw, lambda r: F.array_distinct(F.array(r, normalized_token(r))))), lambda k: F.length(k) >= 2)
    # without Hangul there are no particles, and one pattern finds the tokens
    return F.when(low.rlike(f"[{HANGUL}]"), both).otherwise(F.regexp_extract_all(low, F.lit("[0-9A-Za-z]{2,}"), 0))


def query_terms(text: Column) -> Column:
    """Normalised tokens of two characters or more, in order."""
    raw = F.regexp_extract_all(text, F.lit(TOKEN), 0)
    return F.filter(F.transform(raw, normalized_token), lambda k: F.length(k) >= 2)


def ngram_terms(terms: Column, least: int = 2, most: int = 4, chars: int = 4) -> Column:
    """Neighbouring terms joined, two to four at a time, of four characters or more."""
    joined = lambda n: F.transform(F.sequence(F.lit(1), F.size(terms) - (n - 1)), lambda i: F.array_join(F.slice(terms, i, F.lit(n)), ""))
    grams = [joined(n) for n in range(least, most + 1)]
    usable = [F.when(F.size(terms) >= n, g).otherwise(F.array().cast("array<string>")) for n, g in zip(range(least, most + 1), grams)]
    return F.filter(F.array_distinct(F.concat(*usable)), lambda g: F.length(g) >= chars)
