"""Parts of documents to rows of the index: chunks and the facts of their tables, with where they come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import normalize_text, page_snippets, without_space
from marginalia.operators import splitting, stats, table_facts
from marginalia.operators.ranking import header_path
from marginalia.operators.tables import index_key
from marginalia.sources.scratch import forget, kept

def normalized(parts: DataFrame) -> DataFrame:
    """``parts`` (document_id, ordinal, page, text, ...) without blank ones, their texts normalised."""
    return parts.where(F.coalesce(without_space(F.col("text")), F.lit("")) != "").withColumn("text", normalize_text(F.col("text")))


def page_lookup(parts: DataFrame) -> DataFrame:
    """document_id, page, content: the parts that have a page number and a text, without white space."""
    return parts.select("document_id", F.col("page").try_cast("long").alias("page"), without_space(normalize_text(F.col("text"))).alias("content")).where("page IS NOT NULL AND content <> ''")


def page_ranges(chunks: DataFrame, lookup: DataFrame) -> DataFrame:
    """``chunks`` with page_start and page_end: the pages of the document that hold the beginning, middle or end of the
    chunk; null where none does."""
    found = stats.page_ranges(chunks.select("document_id", "chunk_index", page_snippets(F.col("text")).alias("snippets")), lookup, "document_id", "chunk_index")
    return chunks.join(found, ["document_id", "chunk_index"], "left")


_STEPS = {
    "split": lambda parts: splitting.split(normalized(parts)),
    "deduped": lambda chunks: chunks.withColumn("text", splitting.without_repeats(F.col("text"))),
    "merged": splitting.merged,
    "final": splitting.with_context,
}
STAGES = tuple(_STEPS)


def chunk_stages(parts: DataFrame) -> dict[str, DataFrame]:
    """The chunks of ``parts`` after each step of ``STAGES``; the last is what is stored."""
    chunks, found = parts, {}
    for stage, step in _STEPS.items():
        found[stage] = chunks = step(chunks)
    return found


def stage_statistics(stages: dict[str, DataFrame]) -> DataFrame:
    """Statistics of the chunks' lengths by document and stage."""
    rows = [chunks.select("document_id", F.lit(stage).alias("stage"), "text") for stage, chunks in stages.items()]
    every = rows[0]
    for more in rows[1:]:
        every = every.unionByName(more)
    return stats.chunk_stats(every.withColumn("key", F.struct("document_id", "stage")), "key").select("key.*", "*").drop("key")


def index_rows(chunks: DataFrame, embed_raw: bool = True) -> DataFrame:
    """The index's rows of ``chunks`` (document_id, chunk_index, text, path, and more columns): chunk_id, chunk_role (raw or
    table_fact), parent_chunk_id, fact_index, parent_content and the chunk's columns.

    A chunk gives a raw row and one for each fact of its tables. Without ``embed_raw``, a chunk with facts gives no raw row,
    and its facts hold its text.
    """
    keyed = chunks.withColumn("chunk_id", index_key(F.col("document_id").cast("string"), F.col("chunk_index").cast("string"), F.lit(None).cast("string")))
    facts = table_facts.facts(keyed.select("chunk_id", "text", "path"))
    none = lambda kind: F.lit(None).cast(kind)
    raw = keyed if embed_raw else keyed.join(facts.select("chunk_id").distinct(), "chunk_id", "left_anti")
    raw = raw.select(*keyed.columns, F.lit("raw").alias("chunk_role"), none("string").alias("parent_chunk_id"), none("int").alias("fact_index"), none("string").alias("parent_content"))
    lifted = facts.withColumnRenamed("chunk_id", "parent_chunk_id").join(keyed.withColumnRenamed("chunk_id", "own"), F.col("parent_chunk_id") == F.col("own"))
    columns = [F.col("fact").alias("text") if c == "text" else F.col(c) for c in keyed.columns if c != "chunk_id"]
    key = index_key(F.col("document_id").cast("string"), F.col("chunk_index").cast("string"), F.col("fact_index").cast("string"))
    content = none("string") if embed_raw else F.col("text")
    rows = lifted.select(key.alias("chunk_id"), *columns, F.lit("table_fact").alias("chunk_role"), "parent_chunk_id", "fact_index", content.alias("parent_content"))
    return raw.unionByName(rows)


def parent_of_fact(rows: DataFrame) -> DataFrame:
    """Rows of facts that hold their chunk's text, as the raw rows that the index lacks."""
    own = rows.where("chunk_role = 'table_fact' AND parent_content IS NOT NULL")
    raw = own.withColumns({"chunk_id": F.col("parent_chunk_id"), "text": F.col("parent_content"), "chunk_role": F.lit("raw")})
    return raw.withColumns({"parent_chunk_id": F.lit(None).cast("string"), "fact_index": F.lit(None).cast("int"), "parent_content": F.lit(None).cast("string")}).dropDuplicates(["chunk_id"])


def stored_page(loaded: Column, computed: Column) -> Column:
    """The page that a chunk is shown with: the loader's, else the one that was found."""
    return F.coalesce(loaded, computed)


def ingested(parts: DataFrame, embed_raw: bool = True) -> DataFrame:
    """Rows of the index from ``parts`` (document_id, ordinal, page, text, source): split, cleaned, merged, with context, page
    ranges and facts. Each step's table is kept until the next ones have read it: in a single plan each use of the chunks
    would work out all steps before it again, and their expressions would be put into one another."""
    parts = kept(parts.select("document_id", "ordinal", "page", "text", "source"), "ingest-parts")
    final = parts
    for stage, step in _STEPS.items():
        before, final = final, kept(step(final), f"ingest-{stage}")
        if before is not parts:
            forget(before)
    chunks = page_ranges(final, page_lookup(parts))
    sources = parts.groupBy("document_id").agg(F.max("source").alias("source"))
    path = header_path(*(F.col(h) for h in splitting.HEADERS))
    named = kept(chunks.join(sources, "document_id").withColumn("path", path).withColumn("page", stored_page(F.col("page"), F.col("page_start"))), "ingest-named")
    forget(final, parts)
    return index_rows(named, embed_raw)


def deleted(index: DataFrame, document_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The index without the documents of ``document_ids``, and document_id, deleted: how many rows each of them had."""
    ids = document_ids.select("document_id").distinct()
    counts = ids.join(index.groupBy("document_id").agg(F.count("*").alias("n")), "document_id", "left").select("document_id", F.coalesce("n", F.lit(0)).cast("long").alias("deleted"))
    return index.join(ids, "document_id", "left_anti"), counts


def listed_chunks(index: DataFrame) -> DataFrame:
    """document_id, chunk_index, chunk_id, text of a document's chunks: raw rows, and of chunks that have none the text that a fact
    holds."""
    rows = index.where("chunk_role = 'raw'").unionByName(parent_of_fact(index))
    first = F.min_by(F.struct("chunk_id", "text"), F.struct((F.col("chunk_role") != "raw").alias("no_raw"), "chunk_id"))
    return rows.groupBy("document_id", "chunk_index").agg(first.alias("r")).select("document_id", "chunk_index", "r.*")
