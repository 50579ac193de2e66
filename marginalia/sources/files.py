"""File sources and the chunk sink."""

from __future__ import annotations

import html
import re
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What may be ingested, by extension and by type, and how large a file may be.
ALLOWED = {
    "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "md": "text/markdown",
    "txt": "text/plain",
    "html": "text/html",
}
MOST_BYTES = 512 * 1024 * 1024


def _html_lines(data: bytes) -> list[tuple[int | None, str]]:
    """Headings as Markdown, other blocks as lines, without tags, scripts and styles."""
    text = re.sub(r"(?is)<(script|style|head)\b.*?</\1\s*>", "", data.decode("utf-8", "replace"))
    text = re.sub(r"(?i)<h([1-6])[^>]*>", lambda m: "\n" + "#" * int(m[1]) + " ", text)
    text = re.sub(r"(?i)</?(p|div|br|li|tr|ul|ol|table|h[1-6])\b[^>]*>", "\n", text)
    lines = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", line)).split()) for line in text.split("\n"))
    return [(None, "\n".join(x for x in lines if x))]


_PARSERS: dict[str, Callable[[bytes], list[tuple[int | None, str]]]] = {
    "txt": lambda data: [(None, data.decode("utf-8", "replace"))],
    "md": lambda data: [(None, data.decode("utf-8", "replace"))],
    "html": _html_lines,
}


def register_parser(extension: str, parse: Callable[[bytes], list[tuple[int | None, str]]]) -> None:
    """``parse`` takes a file's bytes and gives (page or None, text) parts; binary formats need such a plug-in."""
    _PARSERS[extension.lower()] = parse


def read_files(spark: SparkSession, path: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """path, extension, mime_type, length, content of the files with an allowed extension; the content of larger files than
    ``most_bytes`` isn't read."""
    extension = F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1))
    types = F.create_map(*(x for item in ALLOWED.items() for x in map(F.lit, item)))
    files = spark.read.format("binaryFile").load(path).withColumn("extension", extension).where(F.col("extension").isin(*ALLOWED))
    return files.select("path", "extension", F.element_at(types, F.col("extension")).alias("mime_type"), "length", F.when(F.col("length") <= most_bytes, F.col("content")).alias("content"))


def refused_files(files: DataFrame) -> DataFrame:
    """path, reason: the files that ``parse_files`` passes by."""
    reason = F.when(F.col("content").isNull(), "too large").when(~F.col("extension").isin(*_PARSERS), "no parser")
    return files.select("path", reason.alias("reason")).where("reason IS NOT NULL")


def parse_files(files: DataFrame) -> DataFrame:
    """path, ordinal, page, text: the parts of each file that has a parser and isn't too large; ``refused_files`` has the others."""
    parsers = dict(_PARSERS)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(r.path, i, page, text) for r in frame.itertuples() for i, (page, text) in enumerate(parsers[r.extension](bytes(r.content)))]
            yield pd.DataFrame(rows, columns=["path", "ordinal", "page", "text"])

    readable = files.where(F.col("content").isNotNull() & F.col("extension").isin(*parsers))
    return readable.select("path", "extension", "content").mapInPandas(run, "path string, ordinal long, page long, text string")


def write_chunks(chunks: DataFrame, path: str, buckets: int = 64) -> None:
    """Adds chunks to the collection at ``path``, by bucket of document_id; a document written again replaces its
    chunks, all other documents stay. ``buckets`` and the type of document_id must not change between
    writes, and one write runs at a time. The new buckets are written whole beside the old ones before they replace them.
    """
    spark = chunks.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    system = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    staging = f"{path.rstrip('/')}/_staging-{uuid.uuid4().hex[:12]}"
    bucketed = lambda rows: rows.withColumn("bucket", F.pmod(F.xxhash64("document_id"), F.lit(buckets)))
    try:
        chunks.write.parquet(f"{staging}/new")
        new = merged = spark.read.schema(chunks.schema).parquet(f"{staging}/new")
        touched = [r["bucket"] for r in bucketed(new).select("bucket").distinct().collect()]  # at most ``buckets`` rows
        if system.globStatus(hadoop(f"{path}/bucket=*")):
            old = spark.read.option("mergeSchema", "true").parquet(path).where(F.col("bucket").isin(touched)).drop("bucket")
            ids = new.select(F.col("document_id").alias("new_id")).distinct()
            merged = old.join(ids, F.col("document_id").eqNullSafe(F.col("new_id")), "left_anti").unionByName(new, allowMissingColumns=True)
        bucketed(merged).write.parquet(f"{staging}/merged")
        merged = spark.read.schema(bucketed(merged).schema).parquet(f"{staging}/merged")
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    finally:
        system.delete(hadoop(staging), True)
