"""Packing token streams into fixed-length training sequences.

Documents fall into randomised groups by a seeded hash of their id. In each group, by itself, the
pieces of the documents are placed first-fit decreasing: a tournament tree over the bins' free
places finds the leftmost bin that still holds a piece in logarithmic time. A document longer than
a sequence is cut into full sequences and one remainder, so only remainders compete for places.

Rows that are alike in id and ids are numbered, and the hash takes that number in, so no group holds all of them.
Only lengths and checksums are shuffled; the ids themselves are made again by ``materialise``.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import column_of, text_slices, texts_of
from marginalia.llm.tokenization import encoder

PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, padded_tokens long"


class BinTree:
    """A tournament tree whose leaves are the free places of bins; inner nodes hold the maximum."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.free = [capacity] * (2 * self.leaves)

    def place(self, need: int) -> int:
        """Puts ``need`` into the leftmost bin with room and returns the bin; -1: none has room."""
        free, leaves = self.free, self.leaves
        if free[1] < need:
            return -1
        node = 1
        while node < leaves:
            node *= 2
            if free[node] < need:
                node += 1
        found = node - leaves
        free[node] -= need
        node >>= 1
        while node:
            best = free[2 * node] if free[2 * node] >= free[2 * node + 1] else free[2 * node + 1]
            if free[node] == best:
                break
            free[node] = best
            node >>= 1
        return found


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each size; sizes are placed from the largest, ties in the given order."""
    tree = BinTree(max(1, len(sizes)), capacity)
    bins = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        bins[i] = tree.place(sizes[i])
    return bins


def padded(tokens: int, length: int) -> int:
    """A sequence is padded to ``length``, except at a power of two."""
    return tokens if tokens & (tokens - 1) == 0 else length


def token_lengths(docs: DataFrame, vocabulary: str, length: int, end_id: int) -> DataFrame:
    """doc_id, doc_tokens (with the end id), the checksums of the document's pieces of ``length`` ids, and nth: how many
    rows of the same id and checksums the same task had before. It doesn't depend on the order of a task's rows."""
    end = np.array([end_id], "<u4").tobytes()
    step = 4 * length

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen = encoder(vocabulary).encode, Counter()
        for part in text_slices(batches, rows=1024):
            streams = [ids + end for ids in encode(texts_of(part))]
            crcs = [[zlib.crc32(s[i : i + step]) for i in range(0, len(s), step)] for s in streams]
            nth = []
            for doc_id, own in zip(column_of(part, "doc_id").to_pylist(), crcs):
                key = hash((doc_id, *own))
                nth.append(seen[key])
                seen[key] += 1
            yield pa.RecordBatch.from_arrays(
                [column_of(part, "doc_id"), pa.array([len(s) // 4 for s in streams], pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(nth, pa.int64())],
                ["doc_id", "doc_tokens", "crcs", "nth"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tokenise, "doc_id long, doc_tokens long, crcs array<long>, nth long")


def pack(docs: DataFrame, vocabulary: str, length: int = 1024, end_id: int = 0, docs_per_group: int = 2048, seed: int = 17) -> DataFrame:
    """Packs all documents into sequences of at most ``length`` tokens.

    One row per piece: doc_id, start and length in the document's ids, ids_crc32 of the piece, doc_tokens
    (the end id counts), sequence_id, offset in the sequence (gapless from 0), sequence_tokens and
    padded_tokens. A null text is an empty text, of the end id alone. Rows that repeat a doc_id are
    packed each for itself; a null doc_id is kept as null. An empty table gives no pieces. Columns
    other than doc_id and text are not looked at.
    """
    groups = max(1, round(docs.count() / docs_per_group))
    lengths = token_lengths(docs, vocabulary, length, end_id)
    keyed = lengths.withColumn("packing_group", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "crcs", "nth"), F.lit(groups)))

    def pack_group(key: tuple, rows: pa.Table) -> pa.Table:
        ids, sums = rows["doc_id"].to_pylist(), rows["crcs"].to_pylist()
        rows = rows.take(sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, sums[i])))
        tokens = rows["doc_tokens"].to_numpy()
        rest = [int(t) % length for t in tokens]
        with_rest = [i for i, r in enumerate(rest) if r]
        bins = first_fit_decreasing([rest[i] for i in with_rest], length)
        fill = [0] * (max(bins, default=-1) + 1)
        base, out = key[0].as_py() << 32, []
        for i, b in sorted(zip(with_rest, bins), key=lambda x: (x[1], -rest[x[0]], x[0])):
            out.append((i, int(tokens[i]) - rest[i], rest[i], b, fill[b]))
            fill[b] += rest[i]
        for i, t in enumerate(tokens):
            for start in range(0, int(t) - rest[i], length):
                out.append((i, start, length, len(fill), 0))
                fill.append(length)
        at = np.array([o[0] for o in out], np.int64)
        crcs, longs = rows["crcs"].to_pylist(), pa.int64()
        columns = [
            rows["doc_id"].combine_chunks().take(pa.array(at)),
            *(pa.array(c, longs) for c in ([o[1] for o in out], [o[2] for o in out], [crcs[o[0]][o[1] // length] for o in out], tokens[at], [base + o[3] for o in out], [o[4] for o in out], [fill[o[3]] for o in out], [padded(fill[o[3]], length) for o in out])),
        ]
        return pa.Table.from_arrays(columns, [c.split()[0] for c in PIECE_SCHEMA.split(", ")])

    return keyed.drop("nth").groupBy("packing_group").applyInArrow(pack_group, PIECE_SCHEMA)


def materialise(docs: DataFrame, pieces: DataFrame, vocabulary: str, length: int = 1024, end_id: int = 0) -> DataFrame:
    """sequence_id and its ids (array<int>, not padded), from ``pack``'s pieces and the documents (unique doc_id)."""
    end = np.array([end_id], "<u4").tobytes()

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        for part in text_slices(batches, rows=1024):
            for doc_id, ids in zip(column_of(part, "doc_id").to_pylist(), encode(texts_of(part))):
                ids = np.frombuffer(ids + end, "<u4").astype("<i4")
                cut = [ids[i : i + length] for i in range(0, len(ids), length)]
                yield pa.RecordBatch.from_arrays([pa.array([doc_id] * len(cut), pa.int64()), pa.array([i * length for i in range(len(cut))], pa.int64()), pa.array(cut, pa.list_(pa.int32()))], ["doc_id", "start", "ids"])

    ids = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tokenise, "doc_id long, start long, ids array<int>")
    joined = pieces.select("doc_id", "start", "sequence_id", "offset").join(ids, ["doc_id", "start"])
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return joined.groupBy("sequence_id").agg(F.flatten(F.transform(ordered, lambda p: p["ids"])).alias("ids"))
