"""Language-model scores by a hidden Markov model over word classes.

A word that is frequent in the training texts is a class of its own; other words fall into classes by
their ending. A class's words share its probability by their training counts, so that

    P(text) = P(class sequence) * product of count(word) / count(class)

with half a count added to each word and one word held back for unknown ones. The class sequence
is scored by a hidden Markov model. Baum-Welch trains it: each partition adds up expected counts, the sums
over all partitions give the next parameters. A text's likelihood is exact, by the scaled forward
recursion.

Only frequent words are broadcast; the counts of all others are joined by a shuffle.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import column_of, doc_remainder, forget, text_slices, utf8_of, written

#: Latent states; rounds of Baum-Welch; words that are classes of their own; classes of other words.
STATES, ROUNDS, OWN_CLASSES, ENDING_CLASSES = 8, 4, 2047, 1024
#: Words whose counts are broadcast, at most.
KNOWN_WORDS = 150_000
#: Words of texts that stand side by side in training, about, and of which forward values are held at a time; texts are
#: read whole, however long.
PACK_WORDS = 300_000
#: Words that a task counts before it hands the counts on.
COUNTED_WORDS = 300_000
MEMO_WORDS = 250_000
SLICE_DOCS = 1024
END = b""

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def tokens(utf8: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case, without the end token."""
    return utf8.translate(_LOWER).split()


def ending_class(word: bytes) -> int:
    """A class by the word's first byte pair's kind, last three letters and closing sign."""
    core = word.rstrip(b".,;:!?")
    return zlib.crc32(core[-3:] + b"\x00" + word[len(core) : len(core) + 1]) % ENDING_CLASSES


@dataclass
class Lexicon:
    """The broadcast words: word -> code; the first 1 + OWN_CLASSES codes (the end is 0) are classes of their own."""

    codes: dict[bytes, int]
    log_counts: np.ndarray  # log10(count + 0.5) by code
    own: int
    class_logs: np.ndarray  # log10 of each ending class's total


class Codes(dict):
    """Word -> code; a word that the lexicon lacks gets a code behind it by its ending class."""

    def __init__(self, lexicon: Lexicon):
        super().__init__(lexicon.codes)
        self.after, self.room = len(lexicon.codes), len(lexicon.codes) + MEMO_WORDS

    def __missing__(self, word: bytes) -> int:
        code = self.after + ending_class(word)
        if len(self) < self.room and len(word) <= 40:
            self[word] = code
        return code


def class_table(lexicon: Lexicon) -> np.ndarray:
    """The class of each code."""
    n = len(lexicon.codes)
    table = np.arange(n + ENDING_CLASSES)
    for word, code in lexicon.codes.items():
        if code >= lexicon.own:
            table[code] = lexicon.own + ending_class(word)
    table[n:] = lexicon.own + np.arange(ENDING_CLASSES)
    return table


@dataclass
class Chain:
    first: np.ndarray  # at a text's start
    middle: np.ndarray  # at the start of a piece that isn't a text's first, where training is given pieces
    move: np.ndarray
    emit: np.ndarray  # states x classes


class Packed:
    """Sequences side by side, longest first, laid out step by step: row r of step t stands at offset[t] + r."""

    def __init__(self, sequences: list[np.ndarray]):
        lengths = np.array([len(s) for s in sequences])
        self.order = np.argsort(-lengths, kind="stable")
        lengths = lengths[self.order]
        steps = int(lengths[0]) if len(lengths) else 0
        self.active = len(lengths) - np.searchsorted(lengths[::-1], np.arange(steps), side="right")
        self.offset = np.concatenate([[0], np.cumsum(self.active)]).astype(np.int64)
        flat = np.concatenate([sequences[i] for i in self.order]) if steps else np.empty(0, np.int64)
        starts = np.cumsum(lengths) - lengths
        step = np.repeat(np.arange(steps), self.active)
        row = np.arange(self.offset[-1]) - self.offset[step]
        self.classes, self.row = flat[starts[row] + step], row
        self.lengths, self.steps = lengths, steps

    def blocks(self) -> list[tuple[int, int]]:
        """Spans of steps that hold about PACK_WORDS words each."""
        cuts, begin = [], 0
        for t in range(1, self.steps + 1):
            if t == self.steps or self.offset[t + 1] - self.offset[begin] > PACK_WORDS:
                cuts.append((begin, t))
                begin = t
        return cuts


def _recursion(packed: Packed, begin: int, stop: int, a: np.ndarray, chain: Chain) -> tuple[np.ndarray, np.ndarray]:
    """The scaled forward values and the scales of some steps, from the values of the step before (or the starts)."""
    lo = packed.offset[begin]
    alphas = chain.emit.T[packed.classes[lo : packed.offset[stop]]]
    scales = np.empty(len(alphas))
    for t in range(begin, stop):
        at, n = packed.offset[t] - lo, packed.active[t]
        here = alphas[at : at + n]
        np.multiply(a[:n] if t == 0 else a[:n] @ chain.move, here, out=here)
        c = here.sum(1)
        here /= c[:, None]
        scales[at : at + n] = c
        a = here
    return alphas, scales


def forward(packed: Packed, starts: np.ndarray, chain: Chain, keep: bool) -> tuple[np.ndarray, list[np.ndarray]]:
    """Natural log-likelihood by row; with ``keep`` also the forward values that each block of steps begins with."""
    logs, entering, a = np.zeros(len(packed.lengths)), [], starts
    for begin, stop in packed.blocks():
        if keep:
            entering.append(a)
        alphas, scales = _recursion(packed, begin, stop, a, chain)
        a = alphas[len(alphas) - packed.active[stop - 1] :].copy()
        logs += np.bincount(packed.row[packed.offset[begin] : packed.offset[stop]], weights=np.log(scales), minlength=len(logs))
    return logs, entering


def expected_counts(packed: Packed, fresh: np.ndarray, chain: Chain, sums: list[np.ndarray]) -> float:
    """Adds the sequences' expected counts to ``sums`` (first, middle, move, emit); returns their log-likelihood.

    ``fresh`` tells the sequences that begin a text. Blocks of steps go backwards, each with its forward values
    worked out again from those that it begins with, so memory doesn't grow with the longest text.
    """
    own, blocks, total = fresh[packed.order], packed.blocks(), 0.0
    starts = np.where(own[:, None], chain.first, chain.middle)
    entering = forward(packed, starts, chain, True)[1] if len(blocks) > 1 else [starts]
    states, move, after = chain.move.shape[0], chain.move, None
    for (begin, stop), a in zip(reversed(blocks), reversed(entering)):
        lo, hi = packed.offset[begin], packed.offset[stop]
        classes, active, offset = packed.classes[lo:hi], packed.active, packed.offset - lo
        alphas, scales = _recursion(packed, begin, stop, a, chain)
        total += float(np.log(scales).sum())
        later = chain.emit.T[classes] / scales[:, None]  # becomes emission times backward value, over the scale
        betas = np.ones_like(alphas)
        for t in range(stop - 1, begin - 1, -1):
            at = offset[t]
            if t + 1 < packed.steps:
                n = active[t + 1]
                betas[at : at + n] = (after if t + 1 == stop else later[offset[t + 1] : offset[t + 1] + n]) @ move.T
            later[at : at + active[t]] *= betas[at : at + active[t]]
        inner = slice(active[begin], None)  # all but the block's first step
        before = np.repeat(offset[begin : stop - 1], active[begin + 1 : stop]) + packed.row[lo:hi][inner]
        moved = alphas[before].T @ later[inner]
        if begin:
            moved += a[: active[begin]].T @ later[: active[begin]]
        sums[2] += move * moved
        gamma = alphas * betas
        gamma /= gamma.sum(1, keepdims=True)
        if not begin:
            head = gamma[: active[0]]
            sums[0] += head[own].sum(0)
            sums[1] += head[~own].sum(0)
        for k in range(states):
            sums[3][k] += np.bincount(classes, weights=gamma[:, k], minlength=sums[3].shape[1])
        after = later[: active[begin]].copy()
    return total


def packs(texts: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """The texts by falling length, in packs of about PACK_WORDS words; a longer text is a pack of its own."""
    held, words = [], 0
    for text in sorted(texts, key=len, reverse=True):
        if held and words + len(text) > PACK_WORDS:
            yield held
            held, words = [], 0
        held.append(text)
        words += len(text)
    if held:
        yield held


def word_counts(docs: DataFrame) -> DataFrame:
    """w and c: how often each word, and the end (an empty word), stands in all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["w", "c"])

        for part in text_slices(batches):
            for text in utf8_of(part):
                found.update(tokens(text))
                found[END] += 1
            if len(found) > COUNTED_WORDS:
                yield rows()
                found = Counter()
        if found:
            yield rows()

    return docs.select("text").mapInArrow(count, "w binary, c long").groupBy("w").agg(F.sum("c").alias("c"))


def _most_frequent(vocabulary: DataFrame, most: int) -> list:
    """All words with at least some count, of which there are ``most`` or fewer."""
    by_count = vocabulary.groupBy(F.least("c", F.lit(1 << 40)).alias("c")).agg(F.count("*").alias("n"))
    bins = by_count.groupBy(F.when(F.col("c") < 4096, F.col("c")).otherwise(F.pow(F.lit(2.0), F.ceil(F.log2("c") * 16) / 16)).alias("least")).agg(F.sum("n").alias("n")).orderBy(F.desc("least")).collect()  # a few thousand
    total, least = 0, None
    for r in bins:
        total += r["n"]
        if total > most:
            break
        least = r["least"]
    if least is None:
        return []
    key = F.when(F.col("c") < 4096, F.col("c")).otherwise(F.pow(F.lit(2.0), F.ceil(F.log2("c") * 16) / 16))
    return vocabulary.where(key >= least).collect()


def build_lexicon(vocabulary: DataFrame) -> Lexicon:
    rows = {bytes(r["w"]): r["c"] for r in _most_frequent(vocabulary, KNOWN_WORDS)}
    ends = rows.pop(END, None)
    if ends is None:
        found = vocabulary.where(F.octet_length("w") == 0).first()
        ends = found["c"] if found else 0
    words = sorted(rows, key=lambda w: (-rows[w], w))
    counts = np.array([ends, *(rows[w] for w in words)], float)
    own = 1 + min(OWN_CLASSES, len(words))
    codes = {END: 0} | {w: i for i, w in enumerate(words, 1)}
    own_words = set(words[: own - 1]) | {END}

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, distinct = np.zeros(ENDING_CLASSES), np.zeros(ENDING_CLASSES)
        for batch in batches:
            for w, c in zip(column_of(batch, "w").to_pylist(), column_of(batch, "c").to_pylist()):
                if w not in own_words:
                    at = ending_class(w)
                    total[at] += c
                    distinct[at] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(ENDING_CLASSES)), pa.array(total), pa.array(distinct)], ["at", "total", "distinct"])

    sums = np.zeros((ENDING_CLASSES, 2))
    for r in vocabulary.mapInArrow(classes, "at long, total double, distinct double").groupBy("at").agg(F.sum("total").alias("total"), F.sum("distinct").alias("distinct")).collect():
        sums[r["at"]] = r["total"], r["distinct"]
    return Lexicon(codes, np.log10(counts + 0.5), own, np.log10(sums[:, 0] + 0.5 * (sums[:, 1] + 1)))


def first_chain(lexicon: Lexicon, seed: int = 11) -> Chain:
    """States that tend to stay, with emissions near the training shares, told apart by chance."""
    rng = np.random.default_rng(seed)
    share = np.zeros(lexicon.own + ENDING_CLASSES)
    share[: lexicon.own] = 10 ** lexicon.log_counts[: lexicon.own]
    share[lexicon.own :] = 10**lexicon.class_logs
    emit = share * rng.gamma(2.0, 0.5, (STATES, len(share)))
    move = np.full((STATES, STATES), 0.1 / (STATES - 1)) + np.eye(STATES) * (0.9 - 0.1 / (STATES - 1))
    even = np.full(STATES, 1 / STATES)
    return Chain(even, even, move, emit / emit.sum(1, keepdims=True))


def baum_welch(docs: DataFrame, lexicon_shared, chain: Chain, rounds: int = ROUNDS) -> Chain:
    """``rounds`` passes over all texts of ``docs``, whose classes are written once, two bytes a word."""
    spark = docs.sparkSession
    states, classes = chain.emit.shape
    bounds = np.cumsum([0, states, states, states * states, states * classes])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look, table = Codes(lexicon_shared.value), class_table(lexicon_shared.value).astype("<u2")
        for part in text_slices(batches, rows=SLICE_DOCS):
            out = []
            for text in utf8_of(part):
                words = tokens(text)
                words.append(END)
                out.append(table[np.fromiter(map(look.__getitem__, words), np.int64, len(words))].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["classes"])

    encoded = written(docs.select("text").mapInArrow(encode, "classes binary"), "lm-classes")

    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(chain)  # states x classes

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            chain = shared.value
            sums = [np.zeros(states), np.zeros(states), np.zeros((states, states)), np.zeros((states, classes))]
            for part in text_slices(batches, "classes", rows=16 * SLICE_DOCS):
                texts = [np.frombuffer(x, "<u2") for x in column_of(part, "classes").to_pylist()]
                for pack in packs(texts):
                    expected_counts(Packed([x.astype(np.int64) for x in pack]), np.ones(len(pack), bool), chain, sums)
            flat = np.concatenate([s.ravel() for s in sums])
            at = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(flat[at])], ["cell", "v"])

        flat = np.zeros(bounds[-1])
        for r in encoded.mapInArrow(expect, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).toLocalIterator():  # states x classes cells
            flat[r["cell"]] = r["v"]
        first, middle, move, emit = (flat[a:b] for a, b in zip(bounds, bounds[1:]))
        smooth = lambda x, by: (x + by) / (x + by).sum(-1, keepdims=True)
        shared.destroy()
        chain = Chain(smooth(first, 0.5), smooth(middle, 0.5), smooth(move.reshape(states, states), 0.1), smooth(emit.reshape(states, classes), 0.05))
    forget(encoded)
    return chain


def score(docs: DataFrame, modulus: int = 5, held_out: int = 1, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row.

    Learns from the rows whose crc32 of doc_id modulo ``modulus`` isn't ``held_out``; a null id is not held out.
    A null text is empty and has the end token alone. Rows that repeat are learned from and scored each. An
    empty table gives an empty result. Columns other than doc_id and text are not looked at.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    out = F.coalesce(doc_remainder("doc_id", modulus) == held_out, F.lit(False))
    training = rows.where(~out)
    vocabulary = written(word_counts(training), "lm-vocabulary")
    total = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    lexicon = build_lexicon(vocabulary)
    shared = spark.sparkContext.broadcast(lexicon)  # at most KNOWN_WORDS words
    chain = spark.sparkContext.broadcast(baum_welch(training, shared, first_chain(lexicon), rounds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, model = shared.value, chain.value
        look, table, known = Codes(lexicon), class_table(lexicon), len(lexicon.codes)
        # what a code adds: to both scores its count's log (rare words' counts come later by the join), to the score its class's
        logs = np.concatenate([lexicon.log_counts, np.zeros(ENDING_CLASSES)])
        shares = np.where(np.arange(len(table)) < lexicon.own, 0.0, -lexicon.class_logs[np.maximum(table - lexicon.own, 0)])
        counted = np.append(lexicon.log_counts > np.log10(0.75), np.zeros(ENDING_CLASSES, bool))
        own_logs = np.where(np.arange(len(table)) < lexicon.own, 0.0, logs)
        rid = TaskContext.get().partitionId() << 36
        for part in text_slices(batches, rows=SLICE_DOCS):
            sequences, heads, tail_rid, tail_word, tail_n = [], [], [], [], []
            for doc_id, text in zip(column_of(part, "doc_id").to_pylist(), utf8_of(part)):
                words = tokens(text)
                words.append(END)
                codes = np.fromiter(map(look.__getitem__, words), np.int64, len(words))
                rare = np.flatnonzero(codes >= known)
                for w, n in Counter([words[i] for i in rare.tolist()]).items():
                    tail_rid.append(rid)
                    tail_word.append(w)
                    tail_n.append(n)
                heads.append((rid, doc_id, len(words), int(counted[codes].sum()), logs[codes].sum(), (own_logs[codes] + shares[codes]).sum()))
                sequences.append(table[codes])
                rid += 1
            packed = Packed(sequences)
            likelihood = np.empty(len(sequences))
            likelihood[packed.order] = forward(packed, np.broadcast_to(model.first, (len(sequences), len(model.first))), model, False)[0] / np.log(10)
            n, tails = len(heads), len(tail_rid)
            none = [None] * tails
            ids, doc_ids, lengths, found, base, classes = zip(*heads)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*ids, *tail_rid], pa.int64()),
                    # a document's own row meets no word: no word holds a space
                    pa.array([*(b" %d" % i for i in ids), *tail_word], pa.binary()),
                    pa.array([None] * n + tail_n, pa.int64()),
                    pa.array([*doc_ids, *none], pa.int64()),
                    pa.array([*lengths, *none], pa.int64()),
                    pa.array([*found, *none], pa.int64()),
                    pa.array([*base, *none], pa.float64()),
                    pa.array([*(np.array(classes) + likelihood), *none], pa.float64()),
                ],
                ["rid", "w", "n", "doc_id", "n_tokens", "found", "base", "own"],
            )

    parts = rows.mapInArrow(run, "rid long, w binary, n long, doc_id long, n_tokens long, found long, base double, own double")
    joined = parts.join(vocabulary, "w", "left")
    rare = F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)
    summed = joined.groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("n_tokens").alias("n_tokens"),
        (F.max("found") + F.coalesce(F.sum(F.when(F.col("c") > 0, F.col("n"))), F.lit(0))).alias("n_known"),
        F.max("base").alias("base"),
        F.max("own").alias("own"),
        F.coalesce(F.sum(rare), F.lit(0.0)).alias("rare"),
    )
    log_all = float(np.log10(total["n"] + 0.5 * (total["v"] + 1)))
    return summed.select(
        "doc_id",
        F.coalesce(doc_remainder("doc_id", modulus) == held_out, F.lit(False)).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(total["n"]).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("rare") - F.col("n_tokens") * log_all).alias("base_score"),
        (F.col("own") + F.col("rare")).alias("score"),
    )
