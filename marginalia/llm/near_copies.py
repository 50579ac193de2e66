"""Near-duplicates by the Jaccard similarity of word shingles, found exactly.

Texts whose sets of five-word shingles have a similarity of 0.8 or more share a shingle among the first
fifth of each set, in any order that all sets follow (prefix filtering). Shingles that more than FEW texts hold come last
in that order, the most frequent ones at the end: all shingles are counted, and a sketch of fixed size keeps how often the
frequent ones occur. So at most FEW texts meet at a rare shingle, and only texts that hardly have any meet at a frequent
one. Sketch and sample decide on the work, never on the result. Equal texts count once.

Of the texts that meet at a shingle one is the centre, and the others are measured against it alone. What is
linked to a centre needs no further comparison: one component holds it. Pairs that meet and are in different
components after that are compared unless the triangle inequality tells them apart (one less the similarity is a
metric): so the work on a group of near-copies grows with the group, not with its pairs. Pairs are thinned by their
sizes, by the shingle's places and by parity bitmaps, whose distance never exceeds that of the sets.

A shingle is known by its 64-bit hash, and so is a text (its words, small ASCII letters).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import attached, column_of, fitted, forget, text_slices, utf8_of, written
from marginalia.llm.components import connected_components
from marginalia.llm.simhash import _LOWER, one_of_each, row_key

#: Words of a shingle; the least similarity is MANY / OF.
SHINGLE, MANY, OF = 5, 4, 5
#: Texts of a sample, at most about, whose counts tell equally frequent shingles apart, and shingles that it knows.
SAMPLE_ROWS, COMMON = 4_000, 500_000
#: A shingle that more texts hold is frequent. Its centre is found by partial aggregation.
FEW = 32
#: Cells of the sketch, a byte each, and texts whose shingles are counted in one group, about.
CELLS, GROUP_TEXTS = 1 << 24, 2_000
#: Shingles that a task counts before it hands the counts on.
COUNTED = 2_000_000
#: Bits of a parity bitmap.
BITMAP = 1024
#: Up to so many texts are fetched for comparison by a broadcast of their keys; beyond, by a shuffle.
BROADCAST_TEXTS = 1_000_000
#: Texts that are measured against a centre in one task, about; a centre of more is sent to several.
SPREAD = 2_000


def words_of(utf8: bytes) -> list[bytes]:
    return utf8.translate(_LOWER).split()


def shingle_hashes(words: list[bytes]) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending. A text of fewer words is one shingle; no words: none."""
    if not words:
        return np.array([], np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return np.array([digest(joined)], np.uint64)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    begins = [0, *stops[:-1].tolist()][: len(words) - SHINGLE + 1]
    return np.unique(np.array([digest(joined[a:b]) for a, b in zip(begins, (stops[SHINGLE - 1 :] - 1).tolist())], np.uint64))


@dataclass
class Order:
    """What all texts' shingles are ordered by: how frequent the sketch says they are, then the sample, then the hash."""

    hashes: np.ndarray  # ascending
    counts: np.ndarray
    sketch: np.ndarray
    groups: int

    def __iter__(self) -> Iterator[np.ndarray]:
        return iter((self.hashes, self.counts))


def common_shingles(sample: list[tuple[str, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that several texts of the sample hold, ascending, and in how many."""
    sets = {x: shingle_hashes(words_of(x)) for x in {b" ".join(words_of(text.encode("utf-8", "surrogatepass"))) for text, _ in sample}}
    hashes, counts = np.unique(np.concatenate([np.array([], np.uint64), *sets.values()]), return_counts=True)
    most = np.sort(np.argsort(-counts, kind="stable")[:COMMON])
    most = most[counts[most] > 1]
    return hashes[most], counts[most]


def _in_groups(hashes: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Each hash's group, its uppermost bits, and the 32 bits behind them, by which its group knows it."""
    bits = groups.bit_length() - 1
    return (hashes >> np.uint64(64 - bits)).astype(np.int64), (hashes >> np.uint64(32 - bits)).astype(np.uint32)


def _cells(lows: np.ndarray, groups: int) -> np.ndarray:
    """Where a group's hashes fall in its part of the sketch."""
    return (lows * np.uint32(2654435761) >> np.uint32(5)).astype(np.int64) % (CELLS // groups)


def frequency_sketch(docs: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """A byte for each cell: 0 if no frequent shingle falls on it, else how many bits the count of its most frequent one has,
    over FEW's; and into how many groups the hashes are dealt. Each task counts its own first, so a shingle of very many
    texts is a few numbers in its group; equal texts that a task counts together count once. The driver gets CELLS bytes at
    most.
    """
    groups = 1 << min(20, max(4, (size // GROUP_TEXTS).bit_length()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def handed_on() -> pa.RecordBatch:
            hashes, times = np.unique(np.concatenate(list(held.values())), return_counts=True)
            held.clear()
            group, lows = _in_groups(hashes, groups)
            ends = np.searchsorted(group, np.arange(groups + 1))
            used = np.flatnonzero(np.diff(ends))
            spans = [slice(ends[g], ends[g + 1]) for g in used]
            more = [np.flatnonzero(times[own] > 1).astype("<u4") for own in spans]
            columns = [[lows[own].astype("<u4").tobytes() for own in spans], [m.tobytes() for m in more], [times[own][m].astype("<u4").tobytes() for own, m in zip(spans, more)]]
            return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], ["part", "lows", "more", "times"])

        total = 0
        for part in text_slices(batches):
            for text in utf8_of(part):
                words = words_of(text)
                key = xxhash.xxh64_intdigest(b" ".join(words))
                if words and key not in held:
                    held[key] = shingle_hashes(words)
                    total += len(held[key])
            if total > COUNTED:
                yield handed_on()
                total = 0
        if held:
            yield handed_on()

    def frequent(key: tuple, rows: pa.Table) -> pa.Table:
        read = lambda name: [np.frombuffer(x, "<u4") for x in rows[name].to_pylist()]
        lows, weights = read("lows"), []
        for own, more, times in zip(lows, read("more"), read("times")):
            weights.append(np.ones(len(own), np.int64))
            weights[-1][more] = times
        found, of = np.unique(np.concatenate(lows), return_inverse=True)
        counts = np.bincount(of, weights=np.concatenate(weights)).astype(np.int64)
        often = counts > FEW
        cells = np.zeros(CELLS // groups, np.uint8)
        np.maximum.at(cells, _cells(found[often], groups), np.ceil(np.log2(counts[often] / FEW)).astype(np.uint8))
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "cells": pa.array([zlib.compress(cells.tobytes(), 1)], pa.binary())}) if often.any() else pa.table({"part": pa.array([], pa.int32()), "cells": pa.array([], pa.binary())})

    counted = docs.select(F.col("text").cast("string")).mapInArrow(count, "part int, lows binary, more binary, times binary")
    sketch = np.zeros(CELLS, np.uint8)
    for r in counted.groupBy("part").applyInArrow(frequent, "part int, cells binary").toLocalIterator():
        own = np.frombuffer(zlib.decompress(r["cells"]), np.uint8)
        sketch[r["part"] * len(own) : (r["part"] + 1) * len(own)] = own
    return sketch, groups


def sample_counts(hashes: np.ndarray, common: Order | tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How many texts of the sample hold each hash, as far as it is common."""
    known, counts = common
    if not len(hashes) or not len(known):
        return np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[at] == hashes, counts[at], 0)


def frequencies(hashes: np.ndarray, common: Order | tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """What the sketch holds for each hash; 0: rare."""
    if not isinstance(common, Order):
        return np.zeros(len(hashes), np.uint8)
    group, lows = _in_groups(hashes, common.groups)
    return common.sketch[group * (CELLS // common.groups) + _cells(lows, common.groups)]


def prefix(hashes: np.ndarray, common: Order | tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first hashes, rare ones first, of which a similar set's prefix must share one."""
    n = len(hashes)
    return hashes[np.lexsort((hashes, sample_counts(hashes, common), frequencies(hashes, common)))][: n - -(-MANY * n // OF) + 1] if n else hashes


def bitmap(hashes: np.ndarray) -> bytes:
    return np.packbits((np.bincount((hashes % np.uint64(BITMAP)).astype(np.int64), minlength=BITMAP) & 1).astype(np.uint8)).tobytes()


def _texts(docs: DataFrame, common: Order) -> DataFrame:
    """doc_id, row (``row_key``), cid (the text's hash), n (shingles), prefix (hashes), hot (how many of them, at the end,
    are frequent) and bits for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(common)  # CELLS bytes, and at most COMMON hashes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value
        for part in text_slices(batches):
            words = [words_of(t) for t in utf8_of(part)]
            sets = [shingle_hashes(w) for w in words]
            cids = np.array([xxhash.xxh64_intdigest(b" ".join(w)) for w in words], np.uint64).view(np.int64)
            prefixes = [prefix(s, common) for s in sets]
            hot = [int(np.count_nonzero(frequencies(p, common))) for p in prefixes]
            columns = [column_of(part, "doc_id"), column_of(part, "row"), pa.array(cids), pa.array([len(s) for s in sets], pa.int32()), pa.array([p.view(np.int64) for p in prefixes], pa.list_(pa.int64())), pa.array(hot, pa.int32()), pa.array(map(bitmap, sets), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "cid", "n", "prefix", "hot", "bits"])

    named = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), row_key("doc_id", "text").alias("row"))
    return named.mapInArrow(run, "doc_id long, row long, cid long, n int, prefix array<long>, hot int, bits binary")


def _enough(shared: object, both: object) -> object:
    """Whether sets of together ``both`` shingles that share so many are similar, in whole numbers."""
    return (OF + MANY) * shared >= MANY * both


def _places(rows: DataFrame) -> DataFrame:
    """shingle, cid, n, at, c (the shingle's centre) and c_n, for each place of a text's prefix that another text shares.
    The centre is the text with the fewest rare hashes in its prefix: copies of it have changed words, it has not."""
    classes = rows.groupBy("cid").agg(F.first("n").alias("n"), F.first("hot").alias("hot"), F.first("prefix").alias("prefix"))
    places = classes.select("cid", "n", (F.size("prefix") - F.col("hot")).alias("rare"), F.posexplode("prefix").alias("at", "shingle"))
    is_hot, centre = F.col("at") >= F.col("rare"), F.struct("rare", "cid", "n")
    w = Window.partitionBy("shingle")  # rare shingles: FEW texts
    cold = places.where(~is_hot).select("shingle", "cid", "n", "at", "rare").withColumn("c", F.min(centre).over(w)).withColumn("last", F.max("cid").over(w)).withColumn("first", F.min("cid").over(w)).where("first <> last")
    hot = places.where(is_hot).select("shingle", "cid", "n", "at", "rare")
    centres = hot.groupBy("shingle").agg(F.min(centre).alias("c"), F.min("cid").alias("first"), F.max("cid").alias("last")).where("first <> last")
    return cold.unionByName(hot.join(centres, "shingle")).select("shingle", "cid", "n", "at", F.col("c.cid").alias("c"), F.col("c.n").alias("c_n"))


def _thinned(candidates: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b, both) whose bitmaps don't tell that the sets differ too much."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                one, other = (np.frombuffer(b"".join(column_of(batch, c).to_pylist()), "<u8").reshape(batch.num_rows, -1) for c in ("a_bits", "b_bits"))
                both = column_of(batch, "both").to_numpy()
                apart = np.bitwise_count(one ^ other).sum(1, dtype=np.int64)
                # sets that differ in d of their together ``both`` shingles share half of the rest
                near = pa.array((OF + MANY) * (both - apart) >= 2 * MANY * both)
                yield batch.select(["a", "b"]).filter(near)

    of = lambda side: classes.select(F.col("cid").alias(side), F.col("bits").alias(f"{side}_bits"))
    return candidates.join(of("a"), "a").join(of("b"), "b").select("a", "b", "both", "a_bits", "b_bits").mapInArrow(run, "a long, b long")


def measured(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, shared (shingles) and both (the sum of their sets' sizes) of ``pairs`` (a, b: cids; written, each once).

    The texts of all a that are paired with a b come to where b's text is; where they are many, to several places.
    """
    keys = written(classes.select("cid", "row").join(pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct(), "cid", "left_semi"), "copies-asked")
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_TEXTS else keys
    texts = docs.select(F.col("text").cast("string"), row_key("doc_id", "text").alias("row")).join(keys, "row").groupBy("cid").agg(F.first("text").alias("text"))
    spread = pairs.groupBy("b").agg(F.ceil(F.count("*") / SPREAD).cast("int").alias("spread"))
    centres = spread.select(F.col("b").alias("cid"), F.col("b").alias("to"), F.explode(F.sequence(F.lit(0), F.col("spread") - 1)).alias("salt"), F.lit(0).alias("kind"))
    others = pairs.join(spread, "b").select(F.col("a").alias("cid"), F.col("b").alias("to"), F.pmod(F.xxhash64(F.lit(3), "a"), F.col("spread")).cast("int").alias("salt"), F.lit(1).alias("kind"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = np.array([], np.uint64)
        for part in text_slices(batches):
            out = []
            for cid, to, kind, text in zip(*(column_of(part, c).to_pylist() for c in ("cid", "to", "kind")), utf8_of(part)):
                own = shingle_hashes(words_of(text))
                if kind == 0:
                    centre = own
                else:
                    out.append((cid, to, len(np.intersect1d(own, centre, assume_unique=True)), len(own) + len(centre)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 4, ["a", "b", "shared", "both"])

    sent = texts.join(centres.unionByName(others), "cid").select("to", "salt", "kind", "cid", "text")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sent.repartition(parts, "to", "salt").sortWithinPartitions("to", "salt", "kind", "cid").select("cid", "to", "kind", "text").mapInArrow(run, "a long, b long, shared long, both long")


def links(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Links (a, b) between the different texts (by cid) whose shingles have the least similarity or more: not all of
    them, but enough to lead from each text to all that any links would lead to. ``rows`` is written, as of ``_texts``."""
    classes = written(rows.groupBy("cid").agg(F.min("row").alias("row"), F.first("bits").alias("bits")), "copies-classes")
    places = written(_places(rows), "copies-places")
    n, m = F.col("n"), F.col("c_n")
    alike = OF * F.least(n, m) >= MANY * F.greatest(n, m)
    stars = places.where((F.col("cid") != F.col("c")) & alike).select(F.col("cid").alias("a"), F.col("c").alias("b"), (n + m).cast("long").alias("both")).distinct()
    thinned = written(_thinned(stars, classes), "copies-stars")
    star = written(measured(docs, classes, thinned), "copies-measured")
    forget(thinned)
    first = star.where(_enough(F.col("shared"), F.col("both"))).select("a", "b")

    roots = written(connected_components(first), "copies-star-roots")  # small, but looked at twice
    distance = (1 - F.col("shared") / (F.col("both") - F.col("shared"))).alias("d")
    known = star.select(F.col("a").alias("cid"), F.col("b").alias("c"), distance)
    mixed = places.join(roots.select(F.col("node").alias("cid"), "root"), "cid", "left").join(roots.select(F.col("node").alias("c"), F.col("root").alias("c_root")), "c", "left")
    mixed = mixed.join(known, ["cid", "c"], "left").select("shingle", "cid", "n", "at", "c", F.coalesce("root", "cid").alias("root"), F.coalesce("c_root", "c").alias("c_root"), F.when(F.col("cid") == F.col("c"), 0.0).otherwise(F.col("d")).alias("d"))
    mixed = written(mixed, "copies-mixed")
    forget(places, roots)
    p, q = mixed.where("root <> c_root").alias("p"), mixed.where("cid <> c").alias("q")
    n, m = F.col("p.n"), F.col("q.n")
    left = 1 + F.least(n - F.col("p.at") - 1, m - F.col("q.at") - 1)
    once = (F.col("q.root") == F.col("q.c_root")) | (F.col("p.cid") < F.col("q.cid"))
    near = F.abs(F.col("p.d") - F.col("q.d")) <= (OF - MANY) / OF + 1e-9
    meets = (F.col("p.root") != F.col("q.root")) & once & (OF * F.least(n, m) >= MANY * F.greatest(n, m)) & _enough(left, n + m) & F.coalesce(near, F.lit(True))
    met = p.join(q.hint("merge"), "shingle").where(meets).select(F.least("p.cid", "q.cid").alias("a"), F.greatest("p.cid", "q.cid").alias("b"), (n + m).cast("long").alias("both")).distinct()
    pairs = written(_thinned(met, classes), "copies-pairs")
    forget(mixed)
    rest = measured(docs, classes, pairs).where(_enough(F.col("shared"), F.col("both"))).select("a", "b")
    return first.union(rest)


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents of which one stays of each component of near-copies, in the columns of ``docs``: the
    smallest doc_id, null last. Rows that repeat count as copies; null and empty texts are alike. An empty table gives an
    empty result.
    """
    size = docs.count()
    drawn = F.pmod(F.xxhash64(F.lit(7), "doc_id", "text"), F.lit(1 << 30)) < int(min(1.0, SAMPLE_ROWS / max(1, size)) * (1 << 30))
    sample = docs.where(drawn).select(F.lit(0).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.lit(0).alias("label"))
    sample = sample.union(docs.sparkSession.range(1).select(F.lit(0), F.lit(""), F.lit(0)))  # never without rows
    order = Order(*fitted(sample, common_shingles), *frequency_sketch(docs, size))
    rows = written(_texts(docs, order), "copies-texts")
    roots = connected_components(links(docs, rows)).withColumnRenamed("node", "cid")
    owners = rows.groupBy("cid").agg(F.count("*").alias("n")).join(roots, "cid", "left").select("cid", "n", F.coalesce("root", "cid").alias("component"))
    return one_of_each(docs, attached(rows, written(owners, "copies-owners"), "cid", size).select("doc_id", "row", "component"))
