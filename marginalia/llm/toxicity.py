"""Toxicity by a weighted finite-state pattern grammar.

Small transducers - targets, threats, insults, negation, reported speech, weights - are composed into one machine
that reads a clause's symbols and sums the weights of what it matches: an insult counts more when it is
aimed at someone, a threat only then, and both less when they are negated or reported. Clauses are scored, not words: a
document's score follows from its clauses' sums by a logistic curve. The machine's weights and the curve are fitted on
a bounded sample of labelled documents.

So is the insult lexicon: a word's share of toxic documents, drawn towards that of other words of the same beginning, of
seven letters down to four, and at last towards the share of all documents. Words and beginnings that raise the odds
enough are entries.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import column_of, fitted, holds, labelled_sample, rows_kept, text_slices, texts_of

#: Labelled documents that the lexicon and the curve are fitted on, at most about.
SAMPLE_ROWS = 8_000
#: A lexicon entry raises the log-odds by so much at least; by so much or more, it has the whole weight.
LEAST_GAIN, WHOLE_GAIN = 2.5, 4.0
#: So many documents' worth of evidence draws an entry towards the next shorter beginning.
PRIOR = 4.0
#: Lexicon entries, at most.
MOST_ENTRIES = 4_000
PREFIX_LENGTHS = (4, 5, 6, 7)
#: Words whose class a worker remembers.
MEMO_WORDS = 300_000

# Seed words, in English, French, German and Spanish.
INSULT_SEEDS = "idiot moron imbecile stupid loser worthless pathetic scum trash clown disgusting dumb fool crétin connard abruti salaud idiota estúpido imbécil basura dummkopf idioten arschloch abschaum".split()
THREAT_WORDS = "kill hurt destroy beat punch stab shoot burn tuer frapper mourir détruire töten schlagen sterben vernichten matar golpear morir destruir".split()
TARGET_WORDS = "you your yours youre they them he him she her tu te toi ton vous votre il elle ils du dich dir ihr sie er usted tú ti él ella ellos".split()
NEGATION_WORDS = "not no never isn't aren't don't doesn't without ne pas jamais sans nicht kein keine nie ohne nunca jamás sin".split()
REPORT_WORDS = "said says wrote claimed quoted called according dit écrit selon sagte schrieb laut dijo escribió según".split()

_STRIP = re.compile(r"^[\W_]+|[\W_]+$")
_CLAUSE_END = ".!?;:"
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, END = "xitynre"


@dataclass
class Transducer:
    """States are strings; an arc (state, symbol) leads to (state, symbol written, weight). A missing arc
    keeps the symbol and goes to ``fallback``'s state."""

    start: str
    arcs: dict[tuple[str, str], tuple[str, str, float]] = field(default_factory=dict)
    fallback: dict[str, str] = field(default_factory=dict)

    def step(self, state: str, symbol: str) -> tuple[str, str, float]:
        return self.arcs.get((state, symbol)) or (self.fallback.get(state, state), symbol, 0.0)


#: Written by the machine: an insult or a threat aimed at someone, and a target that an insult before it is aimed at.
AIMED_INSULT, AIMED_THREAT, AIMED_AT = "I", "T", "Y"
HITS = (INSULT, AIMED_INSULT, AIMED_THREAT, AIMED_AT)


def targets() -> Transducer:
    """Neighbouring words for someone ("you all") are one target."""
    return Transducer("0", {("0", TARGET): ("1", TARGET, 0.0), ("1", TARGET): ("1", OTHER, 0.0)}, {"1": "0"})


def threats() -> Transducer:
    """A verb of harm is a threat (T) with a target up to four words behind it, or anywhere before it in the clause."""
    t = Transducer("0", {}, {"t4": "t3", "t3": "t2", "t2": "t1", "t1": "0"})
    for state in ("0", "y", "t4", "t3", "t2", "t1"):
        t.arcs[state, END] = ("0", END, 0.0)
        t.arcs[state, THREAT] = ("y", AIMED_THREAT, 0.0) if state == "y" else ("t4", THREAT, 0.0)
        t.arcs[state, TARGET] = ("y", AIMED_THREAT if state[0] == "t" else TARGET, 0.0)
    return t


def insults() -> Transducer:
    """An insult behind a target is aimed (I); the first target behind an insult makes that one aimed (Y)."""
    t = Transducer("0")
    for state in ("0", "i", "y"):
        t.arcs[state, END] = ("0", END, 0.0)
        t.arcs[state, INSULT] = ("y", AIMED_INSULT, 0.0) if state == "y" else ("i", INSULT, 0.0)
        t.arcs[state, TARGET] = ("y", AIMED_AT if state == "i" else TARGET, 0.0)
        t.arcs[state, AIMED_THREAT] = ("y", AIMED_THREAT, 0.0)
    return t


def negation() -> Transducer:
    """Within three words after a negation what is matched is written as negated (N + symbol)."""
    t = Transducer("0", {}, {"3": "2", "2": "1", "1": "0"})
    for state in "0123":
        t.arcs[state, NEGATION] = ("3", NEGATION, 0.0)
        t.arcs[state, END] = ("0", END, 0.0)
        if state != "0":
            for s in HITS:
                t.arcs[state, s] = (str(int(state) - 1), "N" + s, 0.0)
    return t


def reported() -> Transducer:
    """From a verb of saying to the clause's end, what is matched is written as reported (R + symbol)."""
    t = Transducer("0", {("0", REPORT): ("1", REPORT, 0.0), ("1", END): ("0", END, 0.0)})
    for s in HITS:
        for symbol in (s, "N" + s):
            t.arcs["1", symbol] = ("1", "R" + symbol, 0.0)
    return t


def weighing(weights: dict[str, float]) -> Transducer:
    """The weights of what the other machines wrote."""
    t = Transducer("0")
    own = {INSULT: weights["insult"], AIMED_INSULT: weights["insult"] + weights["target"], AIMED_AT: weights["target"], AIMED_THREAT: weights["threat"]}
    for prefix, factor in (("", 1.0), ("N", weights["negated"]), ("R", weights["reported"]), ("RN", weights["negated"] * weights["reported"])):
        for s, weight in own.items():
            t.arcs["0", prefix + s] = ("0", prefix + s, factor * weight)
    return t


class Composed:
    """The composition of transducers in a row; its arcs are worked out once each, on first use."""

    def __init__(self, *parts: Transducer):
        self.parts = parts
        self.start = tuple(p.start for p in parts)
        self.arcs: dict[tuple[tuple[str, ...], str], tuple[tuple[str, ...], float]] = {}

    def step(self, state: tuple[str, ...], symbol: str) -> tuple[tuple[str, ...], float]:
        known = self.arcs.get((state, symbol))
        if known is None:
            states, weight, written = [], 0.0, symbol
            for part, own in zip(self.parts, state):
                new, written, w = part.step(own, written)
                states.append(new)
                weight += w
            known = self.arcs[state, symbol] = (tuple(states), weight)
        return known


@dataclass
class Model:
    words: dict[str, float]
    prefixes: dict[str, float]
    weights: dict[str, float]
    slope: float = 1.0
    offset: float = 0.0


def _plain(word: str) -> str:
    return _STRIP.sub("", word.lower())


class Lexer(dict):
    """Word -> (symbol, lexicon weight); the classes of ``MEMO_WORDS`` words are kept."""

    def __init__(self, model: Model):
        self.model = model
        self.closed = {w: s for words, s in ((THREAT_WORDS, THREAT), (TARGET_WORDS, TARGET), (NEGATION_WORDS, NEGATION), (REPORT_WORDS, REPORT)) for w in words}

    def __missing__(self, word: str) -> tuple[str, float, bool] | None:
        plain = _plain(word)
        ends = bool(word) and word[-1] in _CLAUSE_END
        weight = self.model.words.get(plain)
        if weight is None:  # the longest beginning decides
            weight = next((self.model.prefixes[plain[:n]] for n in reversed(PREFIX_LENGTHS) if plain[:n] in self.model.prefixes and len(plain) >= n), 0.0)
        found = (INSULT, weight, ends) if weight else (self.closed.get(plain, OTHER), 1.0, ends)
        value = None if found[0] == OTHER and not ends else found
        if len(self) < MEMO_WORDS and len(word) <= 40:
            self[word] = value
        return value


def machine(model: Model) -> Composed:
    return Composed(targets(), threats(), insults(), negation(), reported(), weighing(model.weights))


Clause = list[tuple[str, float, bool]]


def clauses(text: str, lexer: Lexer) -> Iterator[Clause]:
    """The symbols of the lines that hold an insult or a verb of harm: each with its lexicon weight, and whether a clause
    ends behind it (at .!?;: after a word)."""
    for line in text.split("\n"):
        classes = list(map(lexer.__getitem__, line.split()))
        if any(c is not None and c[0] in (INSULT, THREAT) for c in classes):
            yield [c or (OTHER, 1.0, False) for c in classes]


def line_scores(line: Clause, grammar: Composed) -> Iterator[float]:
    """The scores of a line's clauses that match anything."""
    state, total = grammar.start, 0.0
    for symbol, factor, ends in line:
        state, weight = grammar.step(state, symbol)
        total += weight * (factor if symbol == INSULT else 1.0)
        if ends:
            state, _ = grammar.step(state, END)
            if total:
                yield total
            total = 0.0
    if total:
        yield total


def clause_scores(text: str, lexer: Lexer, grammar: Composed) -> list[float]:
    """The scores of the clauses that match anything; a clause ends at .!?;: after a word, or with its line."""
    return [x for line in clauses(text, lexer) for x in line_scores(line, grammar)]


def evidence(scores: Iterable[float]) -> float:
    """One strong clause suffices; more raise the score slowly."""
    ordered = sorted(scores, reverse=True)
    return ordered[0] + math.log1p(sum(ordered[1:])) if ordered else 0.0


def probability(model: Model, value: float) -> float:
    z = max(-30.0, min(30.0, model.offset + model.slope * value))
    return 1 / (1 + math.exp(-z))


def _keys(text: str) -> set[str]:
    """A text's words, and their beginnings with a star."""
    words = {_plain(w) for w in text.split()} - {""}
    return words | {f"{w[:n]}*" for w in words for n in PREFIX_LENGTHS if len(w) >= n}


def _one_of_copies(texts: list[str]) -> list[str]:
    """One of the texts that share the least hash of their three-word shingles, as near-copies do: they count once."""
    kept: dict[int, str] = {}
    for t in texts:
        words = t.split()
        kept.setdefault(min((xxhash.xxh64_intdigest(" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))), default=0), t)
    return list(kept.values())


class Counts:
    """How many toxic and clean texts hold each word and each beginning; of keys that only clean texts hold, nothing."""

    def __init__(self) -> None:
        self.texts, self.held, self.other = [0, 0], Counter(), Counter()

    def __add__(self, more: Counts) -> Counts:
        out = Counts()
        out.texts = [a + b for a, b in zip(self.texts, more.texts)]
        out.held, out.other = self.held + more.held, self.other + more.other
        return out


def _half(text: str) -> int:
    return xxhash.xxh64_intdigest(" ".join(text.split()[:8])) % 2


def counted(sample: list[tuple[str, int]]) -> tuple[Counts, Counts]:
    """The counts of either half of the sample's texts, of keys that two toxic texts hold or more."""
    halves, often = (Counts(), Counts()), set()
    for label in (1, 0):
        for t in _one_of_copies(sorted({t for t, y in sample if bool(y) == bool(label)})):
            own, keys = halves[_half(t)], _keys(t)
            own.texts[1 - label] += 1
            (own.held if label else own.other).update(keys if label else keys & often)
        if label:
            one, other = (h.held for h in halves)
            often = {k for own, more in ((one, other), (other, one)) for k, n in own.items() if n > 1 or k in more}
            for h in halves:
                h.held = Counter({k: n for k, n in h.held.items() if k in often})
    return halves


def lexicon(counts: Counts) -> tuple[dict[str, float], dict[str, float]]:
    """Words and word beginnings that raise the odds of toxic texts, each with a weight of at most 1. A word of weight 0
    is one whose beginning is an entry and that isn't."""
    held, other = counts.held, counts.other
    base = min(0.5, max(0.001, counts.texts[0] / max(1, sum(counts.texts))))

    def gain(key: str) -> float:
        """How much the log-odds rise: from the shortest beginning on, each with what the next longer one doesn't hold."""
        letters = key.rstrip("*")
        chain = [f"{letters[:n]}*" for n in PREFIX_LENGTHS if len(letters) >= n and f"{letters[:n]}*" != key] + [key]
        share = base
        for own, longer in zip(chain, [*chain[1:], None]):
            k, c = (x[own] - (x[longer] if longer else 0) for x in (held, other))
            share = (k + PRIOR * share) / (k + c + PRIOR)
        return math.log(share / (1 - share)) - math.log(base / (1 - base))

    gains = {k: gain(k) for k, n in held.items() if n > 1}
    best = sorted((k for k, g in gains.items() if g >= LEAST_GAIN), key=lambda k: (-gains[k] * math.log1p(held[k]), k))[:MOST_ENTRIES]
    weight = {k: min(1.0, gains[k] / WHOLE_GAIN) for k in best}
    words = {w: 1.0 for w in INSULT_SEEDS} | {k: x for k, x in weight.items() if k[-1] != "*"}
    prefixes = {k[:-1]: x for k, x in weight.items() if k[-1] == "*"}
    for k in gains:
        if k[-1] != "*" and k not in words and any(k[:n] in prefixes for n in PREFIX_LENGTHS):
            words[k] = 0.0
    return words, prefixes


def induce(sample: list[tuple[str, int]]) -> tuple[dict[str, float], dict[str, float]]:
    """The lexicon of a sample of texts with their labels."""
    one, other = counted(sample)
    return lexicon(one + other)


#: The machine's weights before any sample is seen, and the values that are tried for each.
FIRST_WEIGHTS = {"insult": 2.0, "target": 0.5, "threat": 2.0, "negated": 0.4, "reported": 0.5}
TRIED = {"target": (0.1, 0.25, 0.5, 1.0, 2.0), "threat": (0.25, 0.5, 1.0, 2.0, 3.0), "negated": (0.1, 0.2, 0.4, 0.7, 1.0), "reported": (0.1, 0.3, 0.5, 0.7, 1.0)}
#: Evidence beyond it adds nothing.
MOST_EVIDENCE = 6.0


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Offset and slope of the logistic curve by damped Newton steps, and its loss."""
    theta, features = np.array([-3.0, 3.0]), np.stack([np.ones_like(x), x], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(features @ theta, -30, 30)))
        gradient = features.T @ (p - y) + 0.1 * theta
        hessian = features.T @ (features * (p * (1 - p))[:, None]) + 0.1 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        theta -= step * min(1.0, 2 / (np.abs(step).max() + 1e-9))
    theta[1] = max(theta[1], 0.1)
    z = features @ theta
    return float(theta[0]), float(theta[1]), float(np.mean(np.logaddexp(0, z) - y * z))


def fit(sample: list[tuple[str, int]]) -> Model:
    """The lexicon, then the machine's weights, one after the other, and the curve: what loses least. A value other than
    the one before any sample must gain something. Without labels of both kinds the seeds are all."""
    halves = counted(sample)
    words, prefixes = lexicon(halves[0] + halves[1])
    model = Model(words, prefixes, dict(FIRST_WEIGHTS), 3.0, -3.0)
    if len({y for _, y in sample}) < 2:
        return model
    # The lexicon has seen these texts: halves read by each other's lexicon show what it is worth on others.
    lexers = [Lexer(Model(*lexicon(halves[1 - own]), model.weights)) for own in (0, 1)]
    lines, y = [list(clauses(t, lexers[_half(t)])) for t, _ in sample], np.array([label for _, label in sample], float)

    def loss(weights: dict[str, float]) -> tuple[float, float, float]:
        grammar = machine(Model({}, {}, weights))
        x = np.array([min(MOST_EVIDENCE, evidence([s for line in own for s in line_scores(line, grammar)])) for own in lines])
        return _curve(x, y)

    best = loss(model.weights)
    for name, values in TRIED.items():
        for value in values:
            tried = model.weights | {name: value}
            found = loss(tried)
            if found[2] < best[2] - 1e-4:
                model.weights, best = tried, found
    model.offset, model.slope = best[:2]
    return model


def learn(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1, bound: int = SAMPLE_ROWS) -> Model:
    return fitted(labelled_sample(docs, labels, "toxic", modulus, held_out, bound), fit)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1), clauses (matched clauses) and strongest (the highest clause score) for every row.

    A null or empty text has no clause and the score of one without matches. Rows that repeat are scored
    each; null ids are kept; an empty table gives an empty result. Columns other than doc_id and text are
    not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MOST_ENTRIES lexicon entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holds("toxicity")
        model = shared.value
        lexer, grammar = Lexer(model), machine(model)
        for part in text_slices(batches):
            found = [clause_scores(t, lexer, grammar) for t in texts_of(part)]
            yield pa.RecordBatch.from_arrays(
                [
                    column_of(part, "doc_id"),
                    pa.array([probability(model, min(evidence(s), MOST_EVIDENCE)) for s in found], pa.float64()),
                    pa.array([len(s) for s in found], pa.int32()),
                    pa.array([max(s, default=0.0) for s in found], pa.float64()),
                ],
                ["doc_id", "score", "clauses", "strongest"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double, clauses int, strongest double")


def without_toxic(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows, in all columns of ``docs``, that score below ``least``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def decider():
        holds("toxicity")
        model = shared.value
        lexer, grammar = Lexer(model), machine(model)
        return lambda texts: [probability(model, min(evidence(clause_scores(t, lexer, grammar)), MOST_EVIDENCE)) < least for t in texts]

    return rows_kept(docs, decider)
