"""A content-addressed store of token-id streams.

A rolling hash over the ids cuts each document's stream where the hash's low bits are zero, so equal
passages give equal chunks wherever they stand. A chunk's address is the BLAKE2b digest of its ids;
each distinct chunk is stored once. A recipe lists a document's chunk addresses in order; recipes are
stored in ascending doc_id. The root of the Merkle tree over a document's addresses goes into its
recipe; the root of the tree over a part's roots goes into the manifest, beside the part's document and token counts;
and the root of the tree over the manifest's rows is the store's.

Layout under the store's folder::

    packs/kind=chunk   digest, width (bytes of an id), body (little-endian ids)
    recipes            part, idx, doc_id, local_start, n_tokens, digests, lengths, root
    manifest           part, base, docs, tokens, part_root
    store              root (of the tree over the manifest's rows)
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.llm.common import column_of, remove_path, text_slices, texts_of
from marginalia.llm.tokenization import encoder

DIGEST = 16
#: A chunk ends where the low bits of the hash are zero, after LEAST ids at the earliest and MOST at the latest.
LEAST, MOST, MASK = 64, 1024, np.uint32(255)
#: Ids that the rolling hash looks back on: 2 ** ROUNDS.
ROUNDS = 4
#: Digests that a task remembers so as not to send a chunk's body twice.
REMEMBERED = 200_000
_CRC_POLY = np.uint32(0xEDB88320)


def _mixed(ids: np.ndarray) -> np.ndarray:
    h = ids.astype(np.uint32) * np.uint32(2654435761)
    h ^= h >> np.uint32(15)
    h *= np.uint32(2246822519)
    return h ^ (h >> np.uint32(13))


def candidates(ids: np.ndarray) -> np.ndarray:
    """Places after which the rolling hash lets a chunk end. Streams may stand one behind the other: a hash looks
    back on fewer ids than ``LEAST``, before which no chunk of a stream ends."""
    h = _mixed(ids)
    for r in range(ROUNDS):  # h[i] over 2**(r+1) ids: the newest id's hash plus the older ones', shifted
        back = 1 << r
        older = np.zeros_like(h)
        older[back:] = h[:-back] << np.uint32(back)
        h = h + older
    return np.flatnonzero((h >> np.uint32(8)) & MASK == 0) + 1


def chunk_ends(places: list[int], n: int) -> list[int]:
    """Where the chunks of a stream of ``n`` ids end, given its candidates; the last is ``n``."""
    ends, begin = [], 0
    for at in places if n > LEAST else ():
        while at - begin > MOST:
            begin += MOST
            ends.append(begin)
        if at - begin >= LEAST and at < n:
            ends.append(at)
            begin = at
    while n - begin > MOST:
        begin += MOST
        ends.append(begin)
    return [*ends, n] if n else []


def cut_points(ids: np.ndarray) -> list[int]:
    """Where the chunks of a stream end; the last is its length."""
    return chunk_ends(candidates(ids).tolist(), len(ids))


def merkle_root(leaves: list[bytes]) -> bytes:
    """Pairs are hashed level by level; an odd node moves up unchanged. No leaves: zero bytes."""
    if not leaves:
        return bytes(DIGEST)
    level = leaves
    while len(level) > 1:
        up = [hashlib.blake2b(level[i] + level[i + 1], digest_size=DIGEST).digest() for i in range(0, len(level) - 1, 2)]
        level = up + ([level[-1]] if len(level) % 2 else [])
    return level[0]


def write_store(docs: DataFrame, path: str, vocabulary: str, end_id: int) -> None:
    """Encodes all texts (null: empty), appends ``end_id`` to each and stores the ids under ``path``.

    Rows that repeat a doc_id get a recipe each; null ids come first. Columns other than doc_id and
    text are not looked at. An empty table gives an empty store.
    """
    spark = docs.sparkSession
    end = np.array([end_id], "<u4").tobytes()

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, sent = encoder(vocabulary).encode, set()
        for part in text_slices(batches, rows=1024):
            rows: list[tuple] = []
            streams = [raw + end for raw in encode(texts_of(part))]
            sizes = np.array([len(x) // 4 for x in streams])
            starts = np.concatenate([[0], np.cumsum(sizes)])
            joined = np.frombuffer(b"".join(streams), "<u4")
            tops = np.maximum.reduceat(joined, starts[:-1]).tolist()
            places = candidates(joined)
            bounds = np.searchsorted(places, starts, "right").tolist()
            for i, doc_id in enumerate(column_of(part, "doc_id").to_pylist()):
                n, width = int(sizes[i]), 2 if tops[i] < 1 << 16 else 4
                body = joined[starts[i] : starts[i + 1]].astype(f"<u{width}").tobytes()
                digests, lengths, begin = [], [], 0
                for stop in chunk_ends((places[bounds[i] : bounds[i + 1]] - starts[i]).tolist(), n):
                    data = body[width * begin : width * stop]
                    digest = hashlib.blake2b(data, digest_size=DIGEST, salt=bytes([width])).digest()
                    digests.append(digest)
                    lengths.append(stop - begin)
                    begin = stop
                    if digest not in sent:
                        if len(sent) < REMEMBERED:
                            sent.add(digest)
                        rows.append(("chunk", int.from_bytes(digest[:8], "little", signed=True), None, None, None, None, None, digest, width, data))
                route = zlib.crc32(str(doc_id).encode())
                rows.append(("doc", route, doc_id, n, b"".join(digests), np.array(lengths, "<u2").tobytes(), merkle_root(digests), None, None, None))
            columns = list(zip(*rows))
            types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.binary()]
            names = ["kind", "route", "doc_id", "n_tokens", "digests", "lengths", "root", "digest", "width", "body"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        chunk, "kind string, route long, doc_id long, n_tokens long, digests binary, lengths binary, root binary, digest binary, width int, body binary"
    )
    # One shuffle carries both: chunks by their address, recipes by their document.
    nth = F.row_number().over(Window.partitionBy("route", "digest").orderBy("kind"))
    unique = rows.repartition("route").withColumn("nth", nth).where((F.col("kind") == "doc") | (F.col("nth") == 1))
    unique.drop("nth", "route").write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/packs")

    staged = spark.read.schema("doc_id long, n_tokens long, digests binary, lengths binary, root binary, digest binary, width int, body binary, kind string").parquet(f"{path}/packs").where("kind = 'doc'")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, idx, start = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            tokens = column_of(batch, "n_tokens").to_numpy()
            before = start + np.concatenate([[0], np.cumsum(tokens)[:-1]]).astype(np.int64) if len(tokens) else np.array([], np.int64)
            own = [pa.array(np.full(len(tokens), part, np.int32)), pa.array(np.arange(idx, idx + len(tokens), dtype=np.int64)), pa.array(before)]
            yield pa.RecordBatch.from_arrays([*own, *batch.columns], ["part", "idx", "local_start", *batch.schema.names])
            idx, start = idx + len(tokens), start + int(tokens.sum())

    (
        staged.select("doc_id", "n_tokens", "digests", "lengths", "root")
        .repartitionByRange(F.col("doc_id"))
        .sortWithinPartitions("doc_id", "root")
        .mapInArrow(number, "part int, idx long, local_start long, doc_id long, n_tokens long, digests binary, lengths binary, root binary")
        .write.option("compression", "zstd")
        .parquet(f"{path}/recipes")
    )
    remove_path(spark, f"{path}/packs/kind=doc")

    parts = _parts(spark, path)
    base, rows_out = 0, []
    for r in sorted(parts.collect(), key=lambda r: r["part"]):  # one row for each file part
        rows_out.append((r["part"], base, r["docs"], r["tokens"], r["part_root"]))
        base += r["tokens"]
    spark.createDataFrame(rows_out, "part int, base long, docs long, tokens long, part_root string").coalesce(1).write.parquet(f"{path}/manifest")
    spark.createDataFrame([(store_root(rows_out),)], "root string").coalesce(1).write.parquet(f"{path}/store")


def store_root(manifest: list[tuple]) -> str:
    """The root of the tree over the manifest's rows (part, base, docs, tokens, part_root), in the parts' order."""
    return merkle_root([hashlib.blake2b(repr(tuple(r)).encode(), digest_size=DIGEST).digest() for r in manifest]).hex()


def _parts(spark: SparkSession, path: str) -> DataFrame:
    """part, docs, tokens and part_root (the root of the tree over the documents' roots), worked out from the recipes."""

    def root(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("idx")
        own = merkle_root(rows["root"].to_pylist())
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "docs": pa.array([rows.num_rows]), "tokens": pa.array([sum(rows["n_tokens"].to_pylist())], pa.int64()), "part_root": pa.array([own.hex()])})

    return read_recipes(spark, path).select("part", "idx", "n_tokens", "root").groupBy("part").applyInArrow(root, "part int, docs long, tokens long, part_root string")


def check_manifest(spark: SparkSession, path: str) -> None:
    """An error if the manifest isn't the store's, or the recipes aren't those of the manifest: a part lost, added or changed, or
    a base that doesn't follow."""
    manifest = spark.read.schema("part int, base long, docs long, tokens long, part_root string").parquet(f"{path}/manifest")
    told = sorted(map(tuple, manifest.collect()))  # one row for each file part
    kept = spark.read.schema("root string").parquet(f"{path}/store").first()
    if kept is None or kept["root"] != store_root(told):
        raise ValueError("the manifest isn't the store's")
    found = {r["part"]: (r["docs"], r["tokens"], r["part_root"]) for r in _parts(spark, path).collect()}
    at = 0
    for part, base, docs, tokens, part_root in told:
        if found.pop(part, None) != (docs, tokens, part_root) or base != at:
            raise ValueError(f"part {part} of the recipes isn't what the manifest says")
        at += tokens
    if found:
        raise ValueError(f"the manifest lacks the recipes' parts {sorted(found)}")


def read_recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("part int, idx long, local_start long, doc_id long, n_tokens long, digests binary, lengths binary, root binary").parquet(f"{path}/recipes")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    packs = spark.read.schema("digest binary, width int, body binary, kind string").parquet(f"{path}/packs")
    return packs.where("kind = 'chunk'").select("digest", "width", "body")


def crc_times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of CRC-32 remainders as polynomials, bits reflected."""
    a, b = np.broadcast_arrays(a, b)
    b, p = b.copy(), np.zeros(a.shape, np.uint32)
    for bit in range(31, -1, -1):
        p ^= b * ((a >> np.uint32(bit)) & np.uint32(1))
        b = (b >> np.uint32(1)) ^ (_CRC_POLY * (b & np.uint32(1)))
    return p


_POWERS: list[np.ndarray] = []


def crc_shift(ids: np.ndarray) -> np.ndarray:
    """x ** (32 * ids) modulo the CRC-32 polynomial: what that many 4-byte ids after it do to a checksum."""
    if not _POWERS:
        unit = np.array([1 << 30], np.uint32)
        for _ in range(5):
            unit = crc_times(unit, unit)  # x**32
        for _ in range(4):
            table = np.full(1024, 1 << 31, np.uint32)
            filled, power = 1, unit
            while filled < 1024:
                table[filled : 2 * filled] = crc_times(table[:filled], power)
                filled, power = 2 * filled, crc_times(power, power)
            _POWERS.append(table)
            unit = power
    out = _POWERS[0][ids & 1023]
    for i in (1, 2, 3):
        digit = (ids >> (10 * i)) & 1023
        if digit.any():
            out = crc_times(out, _POWERS[i][digit])
    return out


def _entries(spark: SparkSession, path: str) -> DataFrame:
    """One row for each chunk of each recipe: its address, and the ids that follow it in the document. A recipe whose
    addresses don't give its Merkle root is an error."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 1024):
                part = batch.slice(begin, 1024)
                lengths = [np.frombuffer(x, "<u2").astype(np.int64) for x in column_of(part, "lengths").to_pylist()]
                recipes = [[x[i : i + DIGEST] for i in range(0, len(x), DIGEST)] for x in column_of(part, "digests").to_pylist()]
                for doc_id, leaves, root in zip(*(column_of(part, c).to_pylist() if c else recipes for c in ("doc_id", "", "root"))):
                    if merkle_root(leaves) != root:
                        raise ValueError(f"the recipe of document {doc_id} is damaged")
                digests = [x for leaves in recipes for x in leaves]
                of = np.repeat(np.arange(part.num_rows), [len(x) for x in lengths])
                own = [column_of(part, c).take(pa.array(of)) for c in ("part", "idx", "doc_id", "local_start", "n_tokens")]
                seq = np.concatenate([np.arange(len(x)) for x in lengths])
                after = np.concatenate([x.sum() - np.cumsum(x) for x in lengths])
                yield pa.RecordBatch.from_arrays([*own, pa.array(seq), pa.array(np.concatenate(lengths)), pa.array(after), pa.array(digests, pa.binary())], ["part", "idx", "doc_id", "local_start", "n_tokens", "seq", "n", "after", "digest"])

    return read_recipes(spark, path).mapInArrow(expand, "part int, idx long, doc_id long, local_start long, n_tokens long, seq long, n long, after long, digest binary")


def verify_store(spark: SparkSession, path: str) -> DataFrame:
    """Checks the recipes against their Merkle roots and the manifest, reads all chunks back, checks them
    against their addresses, and returns per document, in the
    store's terms: doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit
    integers). A missing or damaged chunk, recipe or part is an error. No body is shuffled: a document's checksum
    follows from its chunks' checksums and lengths.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, widths = column_of(batch, "digest").to_pylist(), column_of(batch, "width").to_pylist()
            sums, counts = [], []
            for digest, width, body in zip(digests, widths, column_of(batch, "body").to_pylist()):
                if hashlib.blake2b(body, digest_size=DIGEST, salt=bytes([width])).digest() != digest:
                    raise ValueError(f"chunk {digest.hex()} is damaged")
                sums.append(zlib.crc32(np.frombuffer(body, f"<u{width}").astype("<u4").tobytes()))
                counts.append(len(body) // width)
            yield pa.RecordBatch.from_arrays([column_of(batch, "digest"), pa.array(sums, pa.int64()), pa.array(counts, pa.int64())], ["digest", "crc", "stored"])

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc, stored = column_of(batch, "crc"), column_of(batch, "stored")
            if crc.null_count or not stored.equals(column_of(batch, "n")):
                raise ValueError("a recipe names a chunk that the store lacks")
            moved = crc_times(crc_shift(column_of(batch, "after").to_numpy()), crc.to_numpy().astype(np.uint32))
            yield pa.RecordBatch.from_arrays([*(column_of(batch, c) for c in ("part", "idx", "doc_id", "local_start", "n_tokens", "n")), pa.array(moved.astype(np.int64))], ["part", "idx", "doc_id", "local_start", "n_tokens", "n", "moved"])

    check_manifest(spark, path)
    chunks = read_chunks(spark, path).mapInArrow(check, "digest binary, crc long, stored long")
    joined = _entries(spark, path).join(chunks, "digest", "left").select("part", "idx", "doc_id", "local_start", "n_tokens", "n", "after", "crc", "stored")
    moved = joined.mapInArrow(shift, "part int, idx long, doc_id long, local_start long, n_tokens long, n long, moved long")
    docs = moved.groupBy("part", "idx", "doc_id", "local_start", "n_tokens").agg(F.sum("n").alias("read"), F.expr("bit_xor(moved)").alias("ids_crc32"))
    bases = spark.read.schema("part int, base long").parquet(f"{path}/manifest")
    return docs.join(bases, "part").select(
        "doc_id",
        (F.col("base") + F.col("local_start")).alias("start"),
        F.when(F.col("read") == F.col("n_tokens"), F.col("read")).otherwise(F.raise_error(F.lit("a recipe's chunks don't add up"))).cast("long").alias("n_tokens"),
        "ids_crc32",
    )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and its whole id stream (array<int>), put together from the chunks."""

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            streams = [np.concatenate([np.frombuffer(c["body"], f"<u{c['width']}").astype("<i4") for c in x]) for x in column_of(batch, "chunks").to_pylist()]
            yield pa.RecordBatch.from_arrays([column_of(batch, "doc_id"), pa.array(streams, pa.list_(pa.int32()))], ["doc_id", "ids"])

    joined = _entries(spark, path).join(read_chunks(spark, path), "digest")
    grouped = joined.groupBy("part", "idx", "doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "width", "body"))).alias("chunks"))
    return grouped.select("doc_id", "chunks").mapInArrow(ids, "doc_id long, ids array<int>")
