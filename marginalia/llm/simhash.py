"""Near-duplicates by SimHash fingerprints and multi-index hashing.

Fingerprints of 64 bits within ``distance`` = 3 of each other agree up to one bit in one of their two
halves. So a table holds each distinct fingerprint under both halves; a query enumerates the Hamming ball
of radius one around each of its halves (33 values), fetches the table's matches and verifies the whole
distance. A half that very many fingerprints share is split by the bytes of the other half, one of which
must agree. Equal fingerprints count once; their documents follow by membership.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import attached, column_of, forget, holds, text_slices, utf8_of, written
from marginalia.llm.components import connected_components

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Hashes whose bits are counted at a time.
_STEP = 8192


def fingerprint(utf8: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The SimHash of a text as an unsigned number: a bit is set if over half of the shingles' hashes have it."""
    words = utf8.translate(_LOWER).split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, seed)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (stops[:-1]).tolist()
    begins = [0, *starts][: len(words) - shingle + 1]
    hashes = [digest(joined[a:b], seed) for a, b in zip(begins, (stops[shingle - 1 :] - 1).tolist())]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _STEP):
        part = np.array(hashes[at : at + _STEP], "<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long) for every row."""
    return _fingerprints(docs.select(F.col("doc_id").cast("long"), "text"), "long", shingle, seed)


def _fingerprints(docs: DataFrame, id_type: str, shingle: int, seed: int) -> DataFrame:
    """As ``fingerprints``, for ids of any type."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holds("simhash")
        for part in text_slices(batches):
            fps = np.array([fingerprint(t, shingle, seed) for t in utf8_of(part)], np.uint64)
            yield pa.RecordBatch.from_arrays([column_of(part, "doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {id_type}, fp long")


#: A half that more fingerprints share is split further; this bounds a bucket, it loses no pair.
CROWDED = 512


def _half(fp: Column, segment: int) -> Column:
    """A half's 32 bits, with the segment's number above them."""
    return F.shiftrightunsigned(fp, 32 * segment).bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseOR(F.lit(segment << 32))


def _other_bytes(fp: Column, key: Column) -> Column:
    """The four bytes of the half that the key isn't, each with its place."""
    other = F.when(F.shiftright(key, 32) == 0, F.shiftrightunsigned(fp, 32)).otherwise(fp.bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.array(*(F.shiftright(other, 8 * i).bitwiseAND(F.lit(255)) + 256 * i for i in range(4)))


def links(fps: DataFrame, distance: int = 3) -> DataFrame:
    """Pairs a < b of the distinct fingerprints in ``fps`` (column fp) that differ in 1 to 3 bits."""
    if distance > 3:
        raise ValueError("two halves with balls of radius one reach distances up to 3")
    balls = F.array(*(F.lit(0 if i < 0 else 1 << i).cast("long") for i in range(-1, 32)))
    table = fps.select("fp", F.explode(F.array(_half(F.col("fp"), 0), _half(F.col("fp"), 1))).alias("key"))
    crowded = written(table.groupBy("key").count().where(F.col("count") > CROWDED).select("key"), "simhash-crowded")
    probes = table.select("fp", F.explode(F.transform(balls, lambda m: F.col("key").bitwiseXOR(m))).alias("key"))
    a, b = F.col("p.fp"), F.col("t.fp")
    near = (a < b) & (F.bit_count(a.bitwiseXOR(b)) <= distance)
    if not crowded.count():
        return probes.alias("p").join(table.alias("t"), "key").where(near).select(a.alias("a"), b.alias("b")).distinct()
    marked = crowded.withColumn("crowded", F.lit(True))
    split = lambda rows: rows.join(marked, "key", "left").select("fp", "key", F.explode(F.when(F.col("crowded"), _other_bytes(F.col("fp"), F.col("key"))).otherwise(F.array(F.lit(-1).cast("long")))).alias("byte"))
    return split(probes).alias("p").join(split(table).alias("t"), ["key", "byte"]).where(near).select(a.alias("a"), b.alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id that links lead to) per row.

    A null or empty text has fingerprint zero, which links like any other; a text of fewer words than a
    shingle is one shingle. Rows that repeat a doc_id are fingerprinted each. Null ids are kept and never
    name a component that has another id. An empty table gives an empty result. Columns other than doc_id and text are not
    looked at.
    """
    rows = written(fingerprints(docs, shingle, seed), "simhash-fingerprints")
    classes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "simhash-classes")
    roots = written(connected_components(links(classes.select("fp"), distance)), "simhash-roots").withColumnRenamed("node", "fp")
    linked = roots.join(classes, "fp")
    named = roots.join(linked.groupBy("root").agg(F.min("first").alias("component")), "root").select("fp", "component")
    owner = written(classes.join(named, "fp", "left").select("fp", "n", F.coalesce("component", "first").alias("component_id")), "simhash-owners")
    forget(classes)
    return attached(rows, owner, "fp", rows.count()).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def row_key(*names: str) -> Column:
    """A hash of the named columns that tells nulls apart."""
    return F.xxhash64(*names, F.concat(*(F.col(n).isNull().cast("string") for n in names)))


def one_of_each(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of ``docs`` of which one stays of each component in ``rows`` (doc_id, row: their ``row_key`` of
    doc_id and text, component): the smallest doc_id, null last.
    """
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    kept = rows.groupBy("component").agg(least.alias("least")).select(F.col("least.row").alias("row_kept"))
    own = docs.select(F.struct(*(F.col(f"`{n}`") for n in docs.columns)).alias("doc"), row_key("doc_id", "text").alias("row_kept"))
    nth = F.row_number().over(Window.partitionBy("row_kept").orderBy(F.xxhash64("doc")))
    return own.join(kept, "row_kept", "left_semi").withColumn("nth_of_row", nth).where("nth_of_row = 1").select("doc.*")


def deduplicated(docs: DataFrame, shingle: int = 3, distance: int = 3, seed: int = 42) -> DataFrame:
    """The documents of which one stays of each component, in the columns of ``docs``: its smallest doc_id, null last.

    Rows are told apart by doc_id and text, components by a fingerprint: rows that share a doc_id, or
    lack one, each go by their own text's component.
    """
    keyed = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), row_key("doc_id", "text").alias("row")).alias("doc_id"), "text")
    rows = written(_fingerprints(keyed, "struct<doc_id: long, row: long>", shingle, seed).select("doc_id.*", "fp"), "simhash-fingerprints")
    classes = written(rows.groupBy("fp").agg(F.count("*").alias("n")), "simhash-classes")
    roots = connected_components(links(classes.select("fp"), distance)).withColumnRenamed("node", "fp")
    owner = written(classes.join(roots, "fp", "left").select("fp", "n", F.coalesce("root", "fp").alias("component")), "simhash-owners")
    return one_of_each(docs, attached(rows, owner, "fp", rows.count()).select("doc_id", "row", "component"))
