"""Markdown tables to facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FACT_CHARS, FACTS_PER_CHUNK = 420, 40


def split_cells(line: Column) -> Column:
    """The cells of a table row, without tags and with single spaces."""
    inner = F.regexp_replace(F.trim(line), "^\\||\\|$", "")
    return F.transform(F.split(inner, "\\|"), lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "(?i)<[^>]+>|&nbsp;", " "), "\\s+", " ")))


def is_empty_cell(cell: Column) -> Column:
    return cell.isin("", "-", "–", "—")


def forward_filled(rows: DataFrame, table: str, order: str, columns: list[str]) -> DataFrame:
    """Empty cells of ``columns`` take the last cell above them that isn't."""
    w = Window.partitionBy(table).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({c: F.coalesce(F.last(F.when(~is_empty_cell(F.col(c)), F.col(c)), ignorenulls=True).over(w), F.col(c)) for c in columns})


def column_labels(top: Column, sub: Column) -> Column:
    """Labels of two header rows: a blank top cell continues the one before it; equal parts count once."""
    filled = F.transform(F.sequence(F.lit(1), F.size(top)), lambda i: F.coalesce(F.element_at(F.filter(F.slice(top, F.lit(1), i), lambda c: ~is_empty_cell(c)), -1), F.lit("")))
    return F.transform(F.arrays_zip(filled.alias("a"), sub.alias("b")), lambda p: F.array_join(F.array_distinct(F.filter(F.array(p["a"], p["b"]), lambda x: ~is_empty_cell(x))), " "))


def truncated_fact(fact: Column, limit: int = FACT_CHARS) -> Column:
    flat = F.trim(F.regexp_replace(fact, "\\s+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.rtrim(F.left(flat, F.lit(limit))), F.lit("..."))).otherwise(flat)


def index_key(document_id: Column, chunk_index: Column, fact_index: Column) -> Column:
    return F.when(fact_index.isNull(), F.concat_ws("_", document_id, chunk_index)).otherwise(F.concat_ws("_", document_id, chunk_index, F.lit("fact"), fact_index))


def chunk_number(key: Column) -> Column:
    """The number behind the last underscore, else null."""
    return F.regexp_extract(key, "(?:^|_)([0-9]+)$", 1).try_cast("int")
