"""Exact top-k inner-product search by a three-phase uniform threshold.

A vector's dimensions are cut into slices, so its score for a query is the sum of one local score from
each slice. Phase 1: each slice lists, for each query, the entries of its best local scores; the whole scores of
those few entries are worked out, and the k-th best of them is a safe cutoff. Phase 2: the cutoff is broadcast; an
entry whose whole score reaches it has a local score of at least its m-th part in one of m slices, so each slice
collects just those, and passes by entries that their length alone keeps below it. Phase 3: of the collected entries, those
that can't reach the cutoff are dropped, and the remaining local scores, of slices that didn't collect them, are resolved
exactly.

Queries go in blocks of bounded size, one after the other, each against all candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import column_of, forget, written

#: Bytes of a block of queries, which is broadcast.
BLOCK_BYTES = 16_000_000
#: Local scores (queries times candidates) that are held at a time; with few queries, at most STEP candidates.
CELLS, STEP = 4_000_000, 2048
LEAST = np.iinfo(np.int64).min


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """vec_id and ints: floor(scale * component). Null ids, and vectors that are null or hold null
    or non-finite components, are left out; an empty vector stays, as one of zeros."""
    usable = F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & usable).select(
        F.col(id_col).cast("long").alias("vec_id"), F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * scale)).alias("ints")
    )


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of integers; a shorter vector is filled up with zeros."""
    values, offsets = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    sizes = np.diff(offsets)
    if (sizes == dims).all():
        return values.reshape(-1, dims)
    out = np.zeros((len(sizes), dims), np.int64)
    for i, (a, n) in enumerate(zip(offsets - offsets[0], sizes)):
        out[i, :n] = values[a : a + n]
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows: in floating point where that is exact."""
    bound = a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    if bound < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _best(of: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's k highest scores, ties to smaller ids."""
    order = np.lexsort((ids, -scores, of))
    of = of[order]
    first = np.searchsorted(of, of)
    return order[np.arange(len(of)) - first < k]


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, slices: int = 2) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest inner products with all rows but those
    of its own id; all, if there are fewer. ``vectors`` holds vec_id and ints, as of ``integer_vectors``;
    ``is_query`` picks the queries. Vectors of different length count as filled up with zeros. Equal scores
    go to the smaller vec_id; rows that repeat a vec_id count each. No queries or no candidates: no rows.
    Scores that a long can't hold are an error.
    """
    spark = vectors.sparkSession
    rows = written(vectors.withColumn("is_query", is_query), "top-k-vectors")
    shape = rows.agg(F.max(F.size("ints")).alias("dims"), F.count_if("is_query").alias("queries")).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not shape["queries"]:
        return spark.createDataFrame([], schema)
    dims = max(1, shape["dims"])
    edges = [dims * i // min(slices, dims) for i in range(min(slices, dims) + 1)]
    blocks = -(-shape["queries"] * dims * 8 // BLOCK_BYTES)
    results = []
    for block in range(blocks):
        asked = rows.where(F.col("is_query") & (F.pmod(F.xxhash64(F.lit(7), "vec_id"), F.lit(blocks)) == block)).select("vec_id", "ints").collect()  # about BLOCK_BYTES
        if not asked:
            continue
        asked.sort(key=lambda r: r["vec_id"])
        matrix = np.zeros((len(asked), dims), np.int64)
        for i, r in enumerate(asked):
            matrix[i, : len(r["ints"])] = r["ints"]
        queries = spark.sparkContext.broadcast((np.array([r["vec_id"] for r in asked]), matrix))
        found, cutoff = _search(rows, queries, edges, k)
        results.append(written(found, "top-k-block").drop("at"))
        queries.destroy()
        cutoff.destroy()
    forget(rows)
    found = results[0]
    for r in results[1:]:
        found = found.unionByName(r)
    return found


def _lengths(rows: np.ndarray) -> np.ndarray:
    """The rows' Euclidean lengths, rounded up a little."""
    return np.sqrt((rows.astype(np.float64) ** 2).sum(1)) * (1 + 1e-9)


def _resolved(of: np.ndarray, at: np.ndarray, queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact inner products of single pairs, some at a time."""
    out = np.empty(len(of), np.int64)
    step = max(1, CELLS // max(1, queries.shape[1]))
    for i in range(0, len(of), step):
        out[i : i + step] = (queries[of[i : i + step]] * vectors[at[i : i + step]]).sum(1)
    return out


def _search(rows: DataFrame, queries, edges: list[int], k: int) -> tuple[DataFrame, object]:
    """A block's result, and the broadcast of its cutoffs."""
    spark, dims, parts = rows.sparkSession, edges[-1], len(edges) - 1
    candidates, cuts = rows.select("vec_id", "ints"), list(zip(edges, edges[1:]))

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        query_ids, matrix = queries.value
        size, most = max(1, min(STEP, CELLS // len(query_ids))), dims * float(np.abs(matrix).max(initial=0))
        for batch in batches:
            for begin in range(0, batch.num_rows, size):
                part = batch.slice(begin, size)
                ints = _matrix(column_of(part, "ints"), dims)
                if most * float(np.abs(ints).max(initial=0)) >= 2**62:
                    raise OverflowError("scores don't fit a long")
                yield column_of(part, "vec_id").to_numpy(), ints

    class Kept:
        """Each query's k best entries so far."""

        def __init__(self) -> None:
            self.of, self.ids, self.totals = (np.empty(0, np.int64) for _ in range(3))

        def add(self, of: np.ndarray, ids: np.ndarray, totals: np.ndarray) -> None:
            of, ids, totals = np.concatenate([self.of, of]), np.concatenate([self.ids, ids]), np.concatenate([self.totals, totals])
            keep = _best(of, ids, totals, k)
            self.of, self.ids, self.totals = of[keep], ids[keep], totals[keep]

    def phase_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (query_ids, matrix), kept = queries.value, Kept()
        for ids, ints in steps(batches):
            listed: list[np.ndarray] = []
            for a, b in cuts:
                local = _products(matrix[:, a:b], ints[:, a:b])
                local[query_ids[:, None] == ids[None, :]] = LEAST
                top = np.argpartition(-local, min(k, len(ids)) - 1, axis=1)[:, :k]
                listed.append(np.arange(len(local))[:, None] * len(ids) + top)
            of, at = np.divmod(np.unique(np.concatenate(listed, axis=None)), len(ids))
            other = query_ids[of] != ids[at]
            of, at = of[other], at[other]
            kept.add(of, ids[at], _resolved(of, at, matrix, ints))
        ends = np.searchsorted(kept.of, np.arange(len(query_ids) + 1))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(kept.totals))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(query_ids))), lists], ["at", "scores"])

    listed = candidates.mapInArrow(phase_one, "at long, scores array<long>").groupBy("at").agg(F.slice(F.sort_array(F.flatten(F.collect_list("scores")), asc=False), 1, k).alias("best"))
    cut = np.full(len(queries.value[0]), LEAST)
    for r in listed.collect():  # one row for each query of the block
        if len(r["best"]) == k:
            cut[r["at"]] = r["best"][-1]
    cutoff = spark.sparkContext.broadcast(cut)

    def phases_two_and_three(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (query_ids, matrix), tau, kept = queries.value, cutoff.value, Kept()
        # whole numbers: a sum reaches the cutoff only if one of its parts reaches the share, rounded up
        share = np.where(tau == LEAST, LEAST, -((-tau) // parts))
        reach = [_lengths(matrix[:, a:b]) for a, b in cuts]
        for ids, ints in steps(batches):
            pairs, known = [], []
            for s, (a, b) in enumerate(cuts):
                far = np.flatnonzero((_lengths(ints[:, a:b])[None, :] * reach[s].max() >= share.min()).ravel())
                asked = np.flatnonzero(reach[s] * _lengths(ints[far, a:b]).max(initial=0) >= share) if len(far) else far
                if not len(far) or not len(asked):
                    continue
                local = _products(matrix[asked, a:b], ints[far, a:b])
                q, c = np.nonzero(local >= share[asked][:, None])
                pairs.append(asked[q] * len(ids) + far[c])
                known.append((pairs[-1], s, local[q, c]))
            if not pairs:
                continue
            collected = np.unique(np.concatenate(pairs))
            of, at = np.divmod(collected, len(ids))
            local, has = np.zeros((parts, len(collected)), np.int64), np.zeros((parts, len(collected)), bool)
            for pair, s, scores in known:
                where = np.searchsorted(collected, pair)
                local[s, where], has[s, where] = scores, True
            # what a slice didn't collect lies below the share
            can = (query_ids[of] != ids[at]) & ((tau[of] == LEAST) | (local.sum(0) + (~has).sum(0) * (share[of] - 1) >= tau[of]))
            of, at, local, has = of[can], at[can], local[:, can], has[:, can]
            for s, (a, b) in enumerate(cuts):
                remaining = np.flatnonzero(~has[s])
                local[s, remaining] = _resolved(of[remaining], at[remaining], matrix[:, a:b], ints[:, a:b])
            total = local.sum(0)
            reached = total >= tau[of]
            kept.add(of[reached], ids[at[reached]], total[reached])
        yield pa.RecordBatch.from_arrays([pa.array(kept.of), pa.array(query_ids[kept.of]), pa.array(kept.ids), pa.array(kept.totals)], ["at", "query_id", "vec_id", "score"])

    found = candidates.mapInArrow(phases_two_and_three, "at long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("at").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("at", "query_id", "rank", "vec_id", "score"), cutoff
