"""A quality classifier: random-indexing word vectors, pooled per document, under a two-layer network.

Each token has a sparse random index vector. A token's word vector sums the index vectors of its
neighbours in the sample; tokens that the sample doesn't hold often enough stand for their shape. A
document is the mean and the spread of its tokens' vectors. A word of more than 64 characters, or of more
runs than a shape shows, is cut into consecutive pieces, each a token of its own, so the whole text counts. The network is trained with numpy on a bounded
sample of labelled documents, and a temperature fitted on a part that it didn't see calibrates its
probabilities.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import column_of, fitted, holds, labelled_sample, rows_kept, text_slices, texts_of

#: Labelled documents that the vectors and the network are fitted on, at most about.
SAMPLE_ROWS = 6_000
DIMENSIONS, NONZERO, WINDOW = 48, 6, 2
LEAST_COUNT, MOST_WORDS = 20, 6_000
HIDDEN, EPOCHS, BATCH, RATE = 32, 40, 64, 3e-3
MEMO_WORDS = 300_000
REPEATED = "\x00same"

_RUNS = re.compile(r"[a-z]+|[A-Z]+|[0-9]+")


#: Characters and runs that a token has at most.
LONGEST, MOST_RUNS = 64, 8


def _kind(ch: str) -> str:
    return "a" if ch.islower() else "A" if ch.isupper() else "9" if ch.isdigit() else ch


def shape(token: str) -> str:
    """Runs of small letters, capitals and digits become one a, A or 9; runs of another sign one sign."""
    out = []
    for ch in token:
        c = _kind(ch)
        if not out or out[-1] != c:
            out.append(c)
    return "\x00" + "".join(out)


class Pieces(dict):
    """Word -> its consecutive pieces of at most LONGEST characters and MOST_RUNS runs."""

    def __missing__(self, word: str) -> list[str]:
        found, begin, runs, last = [], 0, 0, None
        for i, ch in enumerate(word):
            c = _kind(ch)
            if c != last:
                runs, last = runs + 1, c
            if runs > MOST_RUNS or i - begin == LONGEST:
                found.append(word[begin:i])
                begin, runs = i, 1
        found.append(word[begin:])
        if len(self) < MEMO_WORDS and len(word) <= 40:
            self[word] = found
        return found


_PIECES = Pieces()


def tokens(text: str) -> list[str]:
    """A text's words, cut into pieces where they are long."""
    words = text.split()
    return [p for w in words for p in (_PIECES[w] if len(w) > MOST_RUNS else (w,))]


def index_vector(token: str) -> np.ndarray:
    rng = np.random.default_rng(zlib.crc32(token.encode("utf-8", "surrogatepass")))
    v = np.zeros(DIMENSIONS, np.float32)
    v[rng.choice(DIMENSIONS, NONZERO, replace=False)] = rng.choice([-1.0, 1.0], NONZERO)
    return v


@dataclass
class Model:
    ids: dict[str, int]
    vectors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float


class TokenIds(dict):
    """Token -> row of the vectors: the word's own, else its shape's, else row 0."""

    def __init__(self, ids: dict[str, int]):
        self.known = ids

    def __missing__(self, word: str) -> int:
        found = self.known.get(word)
        if found is None:
            found = self.known.get(shape(word), 0)
        if len(self) < MEMO_WORDS and len(word) <= 40:
            self[word] = found
        return found


def token_rows(text: str, ids: TokenIds, same: int) -> np.ndarray:
    """Rows of the vectors for a text's tokens; a token equal to the one before it adds the row ``same``."""
    words = tokens(text)
    rows = np.fromiter(map(ids.__getitem__, words), np.int32, len(words))
    if len(rows) > 1:
        equal = np.flatnonzero(rows[1:] == rows[:-1])
        repeats = sum(words[i] == words[i + 1] for i in equal.tolist())
        if repeats:
            rows = np.concatenate([rows, np.full(repeats, same, np.int32)])
    return rows


def pooled(rows: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    n = len(rows)
    out = np.zeros(2 * DIMENSIONS + 2, np.float32)
    if n:
        counts = np.bincount(rows, minlength=len(vectors)) if n > 4 * len(vectors) else None
        if counts is None:
            own = vectors[rows]
            mean, square = own.mean(0), (own * own).mean(0)
        else:
            mean, square = counts @ vectors / n, counts @ (vectors * vectors) / n
        out[:DIMENSIONS] = mean
        out[DIMENSIONS : 2 * DIMENSIONS] = np.sqrt(np.maximum(square - mean * mean, 0))
        out[-2] = np.log1p(n)
        out[-1] = len(np.unique(rows)) / n
    return out


def word_vectors(texts: list[str]) -> tuple[dict[str, int], np.ndarray]:
    counts = Counter(w for t in texts for w in tokens(t))
    shapes = Counter()
    for w, c in counts.items():
        shapes[shape(w)] += c
    names = ["\x00other", REPEATED]
    names += [w for w, c in sorted(counts.items(), key=lambda x: (-x[1], x[0])) if c >= LEAST_COUNT][:MOST_WORDS]
    names += [s for s, c in sorted(shapes.items(), key=lambda x: (-x[1], x[0])) if c >= LEAST_COUNT][:MOST_WORDS]
    ids = {w: i for i, w in enumerate(names)}
    index = np.stack([index_vector(w) for w in names])
    look, context = TokenIds(ids), np.zeros((len(names), DIMENSIONS), np.float64)
    between = [-1] * WINDOW  # no window reaches from one text into the next
    stream = np.concatenate([np.append(np.fromiter(map(look.__getitem__, words), np.int64, len(words)), between) for words in map(tokens, texts)] or [np.empty(0, np.int64)])
    for off in range(1, WINDOW + 1):
        a, b = stream[:-off], stream[off:]
        ok = (a >= 0) & (b >= 0)
        pairs, times = np.unique(a[ok] * len(names) + b[ok], return_counts=True)
        left, right = pairs // len(names), pairs % len(names)
        for own, other in ((left, right), (right, left)):
            for d in range(DIMENSIONS):
                context[:, d] += np.bincount(own, weights=times * index[other, d], minlength=len(names))
    norm = np.linalg.norm(context, axis=1, keepdims=True)
    return ids, (context / np.where(norm > 0, norm, 1) + index / np.sqrt(NONZERO)).astype(np.float32)


def _forward(x: np.ndarray, m: Model) -> np.ndarray:
    return np.tanh((x - m.mean) / m.spread @ m.w1 + m.b1) @ m.w2 + m.b2


def probabilities(x: np.ndarray, m: Model) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_forward(x, m) / m.temperature, -30, 30)))


def fit(sample: list[tuple[str, int]], seed: int = 3) -> Model:
    """Vectors, network and temperature. Without labels of both kinds the score is their share (or a half)."""
    holds("quality", _PIECES.clear)
    ids, vectors = word_vectors([t for t, _ in sample])
    look = TokenIds(ids)
    y = np.array([label for _, label in sample], np.float64)
    x = np.stack([pooled(token_rows(t, look, ids[REPEATED]), vectors) for t, _ in sample]).astype(np.float64) if sample else np.zeros((0, 2 * DIMENSIONS + 2))
    width = 2 * DIMENSIONS + 2
    rng = np.random.default_rng(seed)
    share = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
    m = Model(ids, vectors, x.mean(0) if len(x) else np.zeros(width), x.std(0) + 1e-6 if len(x) else np.ones(width), rng.normal(0, width**-0.5, (width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), float(np.log(share / (1 - share))), 1.0)
    if len(set(y.tolist())) < 2:
        return m
    m.w2 = rng.normal(0, HIDDEN**-0.5, HIDDEN)
    order = rng.permutation(len(y))
    unseen, train = order[: len(y) // 5], order[len(y) // 5 :]
    params = [m.w1, m.b1, m.w2, np.array([m.b2])]
    first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    z = (x - m.mean) / m.spread
    for _ in range(EPOCHS):
        for at in np.array_split(rng.permutation(train), max(1, len(train) // BATCH)):
            h = np.tanh(z[at] @ params[0] + params[1])
            p = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -30, 30)))
            d = (p - y[at]) / len(at)
            dh = d[:, None] * params[2] * (1 - h * h)
            t += 1
            for i, g in enumerate((z[at].T @ dh + 1e-4 * params[0], dh.sum(0), h.T @ d + 1e-4 * params[2], np.array([d.sum()]))):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                params[i] -= RATE * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
    m.w1, m.b1, m.w2, m.b2 = params[0], params[1], params[2], float(params[3][0])
    if len(unseen):
        logits, truth = _forward(x[unseen], m), y[unseen]
        losses = {T: np.mean(np.logaddexp(0, logits / T) - truth * logits / T) for T in np.geomspace(0.25, 8, 41)}
        m.temperature = float(min(losses, key=losses.get))
    return m


def learn(docs: DataFrame, labels: DataFrame, modulus: int = 5, held_out: int = 0, bound: int = SAMPLE_ROWS) -> Model:
    return fitted(labelled_sample(docs, labels, "quality", modulus, held_out, bound), fit)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) for every row. A null or empty text is scored as one without tokens. Rows that
    repeat are scored each; null ids are kept; an empty table gives an empty result. Columns other than
    doc_id and text are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 2 * MOST_WORDS vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holds("quality", _PIECES.clear)
        model = shared.value
        look, same = TokenIds(model.ids), model.ids[REPEATED]
        for part in text_slices(batches):
            x = np.stack([pooled(token_rows(t, look, same), model.vectors) for t in texts_of(part)])
            yield pa.RecordBatch.from_arrays([column_of(part, "doc_id"), pa.array(probabilities(x, model), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def only_good(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows, in all columns of ``docs``, that score ``least`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def decider():
        holds("quality", _PIECES.clear)
        model = shared.value
        look, same = TokenIds(model.ids), model.ids[REPEATED]
        return lambda texts: (probabilities(np.stack([pooled(token_rows(t, look, same), model.vectors) for t in texts]), model) >= least).tolist()

    return rows_kept(docs, decider)
