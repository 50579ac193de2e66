"""Media columns: payloads stored as FLAC streams of 8-bit samples, and read back as PCM blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm import flac, flac_read
from marginalia.llm.common import column_of, text_slices, utf8_of


def payload(utf8: bytes) -> bytes:
    """A text's bytes, filled up with 255 to a positive multiple of a block."""
    fill = -len(utf8) % flac.BLOCK
    return utf8 + b"\xff" * (fill if utf8 else flac.BLOCK)


def _told(utf8: bytes) -> int | None:
    """The length that a stream must tell: UTF-8 never holds 255, but a string column may, and then it looks like the filling."""
    return len(utf8) if utf8.endswith(b"\xff") else None


def _size(stream: bytes, pcm: bytes) -> int:
    told = flac.told_size(stream)
    if told is None:
        return len(pcm.rstrip(b"\xff"))
    if told > len(pcm) or pcm[told:].strip(b"\xff"):
        raise ValueError("the stream tells a size that its bytes don't have")
    return told


def encode_texts(docs: DataFrame) -> DataFrame:
    """doc_id and media: the text's payload as a FLAC stream. A null text is an empty one; null ids and repeated
    rows are kept; an empty table gives an empty one; equal texts give equal streams. Columns other than
    doc_id and text are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            texts = utf8_of(part)
            streams = flac.encode([payload(t) for t in texts], [_told(t) for t in texts])
            yield pa.RecordBatch.from_arrays([column_of(part, "doc_id"), pa.array(streams, pa.binary())], ["doc_id", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, media binary")


def feature(samples: np.ndarray) -> str:
    """Root mean square, share of sign changes and peak of the signed samples."""
    signed = samples.astype(np.int64) - 128
    if not len(signed):
        return "rms=0.000;zcr=0.00000;peak=0"
    changes = int(np.count_nonzero((signed[1:] < 0) != (signed[:-1] < 0)))
    return f"rms={np.sqrt(np.mean(signed * signed)):.3f};zcr={changes / max(1, len(signed) - 1):.5f};peak={int(np.abs(signed).max())}"


Read = tuple[bytes, np.ndarray, np.ndarray]


def _decoded(streams: list[bytes]) -> list[Read]:
    """PCM bytes, block offsets and samples as unsigned 8-bit numbers of each stream: all side by side, and where a stream
    isn't of ``flac``'s own kind, or is damaged, each by itself."""
    try:
        return [(samples.tobytes(), offsets, samples) for samples, offsets in flac.decode(streams)]
    except ValueError:
        return [_foreign(x) for x in streams] if len(streams) == 1 else [r for x in streams for r in _decoded([x])]


def _foreign(stream: bytes) -> Read:
    pcm = flac_read.read_stream(stream)
    shift, flat = pcm.bits - 8, pcm.samples.ravel()
    return pcm.to_bytes(), pcm.offsets, ((flat >> shift if shift >= 0 else flat << -shift) + 128).astype(np.uint8)


def decode_media(media: DataFrame) -> DataFrame:
    """doc_id, media, pcm (the stored bytes), block_offsets (the sample at which each PCM block begins), n_bytes (pcm
    without the filling) and feature, from doc_id and media alone. A null or damaged stream is an error. Streams of
    other encoders are read one by one: pcm then holds the channels by turns, little-endian, unsigned up to 8 bits,
    and the feature is that of the samples, cut to 8 bits. An empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "media"):
            column = column_of(part, "media")
            streams = column.to_pylist()
            read = _decoded(streams)
            pcm = [data for data, _, _ in read]
            yield pa.RecordBatch.from_arrays(
                [
                    column_of(part, "doc_id"),
                    column,
                    pa.array(pcm, pa.binary()),
                    pa.array([offsets for _, offsets, _ in read], pa.list_(pa.int64())),
                    pa.array([_size(s, p) for s, p in zip(streams, pcm)], pa.int64()),
                    pa.array([feature(samples) for _, _, samples in read]),
                ],
                ["doc_id", "media", "pcm", "block_offsets", "n_bytes", "feature"],
            )

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, media binary, pcm binary, block_offsets array<long>, n_bytes long, feature string")


def pcm_blocks(decoded: DataFrame) -> DataFrame:
    """doc_id, sample_offset, block: a row for each PCM block of ``decode_media``'s rows."""
    return decoded.select("doc_id", "pcm", F.explode("block_offsets").alias("sample_offset")).select(
        "doc_id", "sample_offset", F.expr(f"substring(pcm, CAST(sample_offset + 1 AS INT), {flac.BLOCK})").alias("block")
    )
