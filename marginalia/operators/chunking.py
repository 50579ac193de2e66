"""Chunks: pages to Markdown, sections, line blocks, overlaps, merging of short neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_SIZE, CHUNK_OVERLAP, MERGE_MIN = 800, 80, 300


def page_markdown(html: Column) -> Column:
    """Headings become ``# `` lines, paragraphs and breaks lines, items ``- `` lines; other tags go."""
    x = F.regexp_replace(html, "(?is)<(script|style|nav|title)[^>]*>.*?</\\1>", "")
    x = F.regexp_replace(x, "(?i)<h1[^>]*>", "\n# ")
    x = F.regexp_replace(x, "(?i)<li[^>]*>", "\n- ")
    x = F.regexp_replace(x, "(?i)<(p|br|/p|/h1|/li|div|/div|footer)[^>]*>", "\n")
    return F.regexp_replace(F.regexp_replace(x, "<[^>]*>", ""), "\n{2,}", "\n")


def line_rows(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """key, pos, line: the lines that aren't blank, trimmed, numbered as in the text."""
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line")).withColumn("line", F.trim("line")).where("line <> ''")


def heading_level(line: Column) -> Column:
    """1 to 6 for a heading line, else null."""
    return F.when(line.rlike("^#{1,6}\\s+"), F.length(F.regexp_extract(line, "^(#{1,6})\\s", 1)))


def sections(lines: DataFrame, key: str) -> DataFrame:
    """Rows of ``line_rows`` with section (running number), h1 and level of the line's last heading."""
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    level = heading_level(F.col("line"))
    return lines.withColumn("level", level).withColumn("section", F.sum(F.when(level.isNotNull(), 1).otherwise(0)).over(w).cast("long")).withColumn("h1", F.last(F.when(level == 1, F.regexp_replace("line", "^#\\s+", "")), ignorenulls=True).over(w))


def is_table_row(line: Column) -> Column:
    return F.startswith(line, F.lit("|")) & F.endswith(line, F.lit("|")) & (F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit(""))) >= 2)


def is_table_separator(line: Column) -> Column:
    cells = F.split(F.regexp_replace(line, "^\\||\\|$", ""), "\\|")
    return F.contains(line, F.lit("|")) & F.contains(line, F.lit("-")) & F.forall(cells, lambda c: F.trim(c).rlike("^:?-{3,}:?$"))


def blocks(lines: DataFrame, key: str) -> DataFrame:
    """key, block, kind (table or text), n_lines, text: runs of lines of one kind."""
    w = Window.partitionBy(key).orderBy("pos")
    kind = F.when(is_table_row(F.col("line")) | is_table_separator(F.col("line")), "table").otherwise("text")
    flagged = lines.withColumn("kind", kind).withColumn("new", (F.col("kind") != F.coalesce(F.lag("kind").over(w), F.lit(""))).cast("long"))
    numbered = flagged.withColumn("block", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda r: r["line"]), "\n")
    return numbered.groupBy(key, "block", "kind").agg(F.count("*").alias("n_lines"), joined.alias("text"))


def overlap_tail(text: Column, limit: int = CHUNK_OVERLAP) -> Column:
    """Whole trailing lines of at most ``limit`` characters together, or the end of a longer last line."""
    stripped = F.regexp_replace(text, "^\\s+|\\s+$", "")
    rows = F.reverse(F.filter(F.transform(F.split(stripped, "\n"), lambda x: F.trim(x)), lambda x: x != ""))
    start = F.struct(F.lit("").alias("kept"), F.lit(False).alias("full"))
    folded = F.aggregate(
        rows,
        start,
        lambda acc, x: F.when(acc["full"], acc)
        .when((acc["kept"] == "") & (F.length(x) > limit), F.struct(F.trim(F.right(x, F.lit(limit))).alias("kept"), F.lit(True).alias("full")))
        .when(F.length(x) + F.length(acc["kept"]) + F.when(acc["kept"] == "", 0).otherwise(1) <= limit, F.struct(F.when(acc["kept"] == "", x).otherwise(F.concat(x, F.lit("\n"), acc["kept"])).alias("kept"), F.lit(False).alias("full")))
        .otherwise(F.struct(acc["kept"].alias("kept"), F.lit(True).alias("full"))),
        lambda acc: acc["kept"],
    )
    return F.when(F.coalesce(is_table_row(F.try_element_at(rows, F.lit(1))) | is_table_separator(F.try_element_at(rows, F.lit(1))), F.lit(False)), "").otherwise(folded)


def merged(chunks: DataFrame, key: str, order: str, least: int = MERGE_MIN, most: int = CHUNK_SIZE) -> DataFrame:
    """Short neighbours joined by a blank line: a buffer is closed when it has ``least`` characters, or when the next
    chunk has another heading (``h1``) or wouldn't fit into ``most``. key, chunk_index, text, merged_chunk_count.

    The fold is one array expression per key, on the JVM; documents run in parallel.
    """
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, F.coalesce("h1", F.lit("")).alias("h1"), "text"))), lambda r: F.struct(r["h1"].alias("h1"), r["text"].alias("text"), F.lit(1).alias("n")))
    kind = "struct<h1:string,text:string,n:int>"
    start = F.struct(F.array().cast(f"array<{kind}>").alias("done"), F.lit(None).cast(kind).alias("held"))

    def step(acc: Column, x: Column) -> Column:
        held = acc["held"]
        fits = held.isNotNull() & (held["h1"] == x["h1"]) & (F.length(held["text"]) < least) & (F.length(held["text"]) + 2 + F.length(x["text"]) <= most)
        joined = F.struct(held["h1"].alias("h1"), F.concat(held["text"], F.lit("\n\n"), x["text"]).alias("text"), (held["n"] + 1).alias("n"))
        done = F.when(held.isNull() | fits, acc["done"]).otherwise(F.array_append(acc["done"], held))
        return F.struct(done.alias("done"), F.when(fits, joined).otherwise(x).alias("held"))

    folded = F.aggregate(parts, start, step, lambda acc: F.when(acc["held"].isNull(), acc["done"]).otherwise(F.array_append(acc["done"], acc["held"])))
    rows = chunks.where("trim(text) <> ''").groupBy(key).agg(folded.alias("chunks"))
    return rows.select(key, F.posexplode("chunks").alias("chunk_index", "c")).select(key, F.col("chunk_index").cast("long"), F.col("c.text").alias("text"), F.col("c.n").cast("long").alias("merged_chunk_count"))
