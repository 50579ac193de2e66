"""Markdown tables to facts: a sentence for each row, and for each cell of tables of grades.

Lines are dealt by chunk once; blocks, rows and the cells that merged rows leave empty follow from windows within a
chunk, so a table is never looked at outside of its chunk's task.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import lexicon as L
from marginalia.operators.chunking import is_table_row, is_table_separator
from marginalia.operators.tables import FACTS_PER_CHUNK, is_empty_cell, split_cells, truncated_fact

# The wording of facts, which are read again.
ROW_WORDS, ROW_END, NO_SUBJECT, NO_CAPTION, COLUMN, LEGEND = " 행 정보는 ", "이다.", "해당 행", "문서 표", "열 ", "표시"

_CAPTION = r"(?i)^(표|Table)\s*\d"
_NUMBER = r"^[\d.,]+$"


def is_table_line(line: Column) -> Column:
    return is_table_row(line) | is_table_separator(line)


def legends(lines: Column) -> Column:
    """(symbol, description) of lines that tell what a symbol stands for, in their order; the last description counts."""
    symbols = rf"([{L.LEGEND_SYMBOLS}]+)\s*{LEGEND}\s*[:：]?\s*(.+)"
    bare = F.transform(lines, lambda x: F.regexp_replace(F.trim(x), r"^[-*ㆍ·]\s*", ""))
    found = F.transform(bare, lambda x: F.named_struct(F.lit("symbol"), F.regexp_extract(x, symbols, 1), F.lit("description"), F.trim(F.regexp_extract(x, symbols, 2))))
    known = F.filter(found, lambda p: (p["symbol"] != "") & (p["description"] != ""))
    last = lambda s: F.element_at(F.filter(known, lambda p: p["symbol"] == s), -1)["description"]
    return F.transform(F.array_distinct(F.transform(known, lambda p: p["symbol"])), lambda s: F.named_struct(F.lit("symbol"), s, F.lit("description"), last(s)))


def caption(lines: Column, path: Column) -> Column:
    """The last title-like line before the first table line, else the path of headings, else a fixed name."""
    trimmed = F.filter(F.transform(lines, F.trim), lambda x: x != "")
    first = F.array_position(F.transform(trimmed, is_table_line), True)
    before = F.when(first > 0, F.slice(trimmed, F.lit(1), first.cast("int") - 1)).otherwise(trimmed)
    short = lambda x: (F.length(x) <= 80) & ~F.startswith(x, F.lit("- ※")) & ~F.endswith(x, F.lit(">")) & (F.regexp_count(x, F.lit(r"\d{4}\.\d")) < 2)
    title = lambda x: F.when(F.startswith(x, F.lit("######")), F.trim(F.regexp_replace(x, "^#+", ""))).when(x.rlike(_CAPTION), x).when(short(x), F.trim(F.regexp_replace(x, "^[- ]+", "")))
    last = F.try_element_at(F.filter(F.transform(before, title), lambda x: x.isNotNull()), F.lit(-1))
    return F.coalesce(last, F.nullif(path, F.lit("")), F.lit(NO_CAPTION))


def is_subheader(row: Column) -> Column:
    """Two cells or more, none with a digit."""
    filled = F.filter(row, lambda c: ~is_empty_cell(c))
    return (F.size(filled) >= 2) & ~F.exists(filled, lambda c: c.rlike(r"\d"))


def column_labels(headers: Column, sub: Column) -> Column:
    """A label for each column: the header rows' cells, each row's last one to the left where a cell is empty, and the
    sub-header's, each once; a column without any is numbered. ``sub`` may be null."""
    def label(i: Column) -> Column:
        filled = F.transform(headers, lambda row: F.coalesce(F.try_element_at(F.filter(F.slice(row, F.lit(1), i), lambda c: ~is_empty_cell(c)), F.lit(-1)), F.lit("")))
        own = F.filter(F.concat(filled, F.array(F.coalesce(F.try_element_at(sub, i), F.lit("")))), lambda c: ~is_empty_cell(c))
        return F.coalesce(F.nullif(F.array_join(F.array_distinct(own), " "), F.lit("")), F.concat(F.lit(COLUMN), i.cast("string")))

    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(F.get(headers, F.lit(0))))), label)


def _bound(value: Column, make: Callable[[Column], Column]) -> Column:
    """What ``make`` makes of a value that is worked out once, however often it is used (in functions over arrays, too)."""
    return F.transform(F.array(value), lambda x: make(x))[0]


def parsed_tables(chunks: DataFrame, key: str) -> DataFrame:
    """key, block, caption, legends, labels, row_no, cells: the rows that aren't blank of each table of ``chunks`` (key, text,
    path). The first two columns take the value above where a cell is empty. Tables without a separator, or
    without a line above it, have no rows; nulls and empty texts have no tables.
    """
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    # before the lines are dealt out, not for each of them
    named = chunks.select(key, caption(lines, F.coalesce("path", F.lit(""))).alias("caption"), legends(lines).alias("legends"), F.transform(lines, F.trim).alias("lines"))
    chunked = named.select(key, "caption", "legends", F.posexplode("lines").alias("pos", "line"))
    w = Window.partitionBy(key).orderBy("pos")
    kind = chunked.where("line <> ''").withColumn("table", is_table_line(F.col("line")))
    island = kind.withColumn("new", (~F.col("table") | ~F.coalesce(F.lag("table").over(w), F.lit(False))).cast("int")).withColumn("block", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"])
    tables = island.where("table").groupBy(key, "block", "caption", "legends").agg(ordered.alias("lines"))
    cut = F.array_position(F.transform("lines", is_table_separator), True).cast("int")
    name = F.lit
    padded = lambda rows, width: F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), F.greatest(F.lit(0), width - F.size(r)))))
    width = lambda t: F.array_max(F.transform(t["rows"], lambda r, i: F.when(i + 1 != t["cut"], F.size(r)).otherwise(0)))
    parts = lambda t, w: F.named_struct(name("headers"), padded(F.slice(t["rows"], F.lit(1), F.greatest(F.lit(0), t["cut"] - 1)), w), name("body"), padded(F.slice(t["rows"], t["cut"] + 1, F.size(t["rows"])), w))
    parsed = _bound(F.named_struct(name("cut"), cut, name("rows"), F.transform("lines", split_cells)), lambda t: _bound(width(t), lambda w: parts(t, w)))
    sub = lambda p: F.when(is_subheader(F.get(p["body"], F.lit(0))), F.get(p["body"], F.lit(0)))
    labelled = _bound(parsed, lambda p: _bound(sub(p), lambda s: F.named_struct(name("body"), p["body"], name("sub"), s, name("labels"), column_labels(p["headers"], s))))
    tables = tables.withColumn("cut", cut).where("cut > 1 AND size(lines) > cut").select(key, "block", "caption", "legends", labelled.alias("t")).select(key, "block", "caption", "legends", "t.*")
    rows = tables.select(key, "block", "caption", "legends", "labels", "sub", F.posexplode("body").alias("row_no", "cells"))
    rows = rows.where((F.col("row_no") > 0) | F.col("sub").isNull()).where(F.exists("cells", lambda c: ~is_empty_cell(c)))
    above = Window.partitionBy(key, "block").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    for i in (0, 1):
        cell = F.get("cells", F.lit(i))
        rows = rows.withColumn(f"own_{i}", F.coalesce(F.last(F.when(~is_empty_cell(cell), cell), ignorenulls=True).over(above), cell))
    filled = F.concat(F.filter(F.array("own_0", "own_1"), lambda c: c.isNotNull()), F.slice("cells", F.lit(3), F.greatest(F.lit(0), F.size("cells") - 2)))
    return rows.select(key, "block", "caption", "legends", "labels", "row_no", filled.alias("cells"))


def _zipped(labels: Column, cells: Column) -> Column:
    return F.zip_with(labels, cells, lambda k, v: F.named_struct(F.lit("k"), k, F.lit("v"), v))


def _named(labels: Column, cells: Column) -> Column:
    """(k, v) of the cells that aren't empty."""
    return F.filter(_zipped(labels, cells), lambda p: ~is_empty_cell(p["v"]))


def row_subject(labels: Column, cells: Column) -> Column:
    """Of a row's first three cells: the first under a label that names subjects, else the first, that isn't a number."""
    words = F.filter(F.slice(_named(labels, cells), 1, 3), lambda p: ~p["v"].rlike(_NUMBER))
    preferred = F.filter(words, lambda p: p["k"].rlike("|".join(map(re.escape, L.SUBJECT_LABELS))))
    return F.coalesce(F.try_element_at(preferred, F.lit(1))["v"], F.try_element_at(words, F.lit(1))["v"], F.lit(NO_SUBJECT))


def clean_subject(subject: Column) -> Column:
    """Without the symbols that legends explain."""
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(subject, rf"\s*[{L.SUBJECT_SYMBOLS}]\s*", "")), F.lit("")), F.trim(subject))


def _marks(legends: Column, cells: Column) -> Column:
    text = F.array_join(F.filter(cells, lambda c: c != ""), " ")
    return F.filter(legends, lambda x: F.contains(text, x["symbol"]))


def row_fact(caption: Column, legends: Column, labels: Column, cells: Column) -> Column:
    """A row as a sentence of key=value pairs: what its symbols stand for, then its cells; null if there are none."""
    marks = F.transform(_marks(legends, cells), lambda x: F.concat(x["symbol"], F.lit(f" {LEGEND}="), x["description"]))
    own = F.transform(F.filter(_named(labels, cells), lambda p: ~F.startswith(p["k"], F.lit(COLUMN))), lambda p: F.concat(p["k"], F.lit("="), p["v"]))
    pairs = F.concat(marks, own)
    text = F.concat(caption, F.lit(": "), clean_subject(row_subject(labels, cells)), F.lit(ROW_WORDS), F.array_join(pairs, "; "), F.lit(ROW_END))
    return F.when(F.size(pairs) > 0, text)


def _row_info(labels: Column, cells: Column, numbers: bool) -> Column:
    """The first three cells behind a sentence, if there are any."""
    own = F.slice(_named(labels, cells), 1, 3)
    own = own if numbers else F.filter(own, lambda p: ~p["v"].rlike(_NUMBER))
    text = F.array_join(F.transform(own, lambda p: F.concat(p["k"], F.lit("="), p["v"])), ", ")
    return F.when(text != "", F.concat(F.lit(" 행 정보: "), text, F.lit("."))).otherwise("")


def symbol_facts(caption: Column, legends: Column, labels: Column, cells: Column) -> Column:
    """A sentence for each symbol of a row."""
    subject, info = row_subject(labels, cells), _row_info(labels, cells, True)
    return F.transform(_marks(legends, cells), lambda x: F.concat(caption, F.lit(": "), subject, F.lit(" 행에는 "), x["symbol"], F.lit(" 표시가 있으며, "), x["symbol"], F.lit(" 표시는 "), x["description"], F.lit("를 의미한다."), info))


def matrix_facts(caption: Column, labels: Column, cells: Column) -> Column:
    """In a table of grades a sentence for each cell from the third column on."""
    graded = F.exists(labels, lambda k: k.rlike("|".join(map(re.escape, L.GRADES))))
    subject, info = row_subject(labels, cells), _row_info(labels, cells, False)
    rest = F.filter(F.slice(_zipped(labels, cells), F.lit(3), F.greatest(F.lit(0), F.size(cells) - 2)), lambda p: ~is_empty_cell(p["v"]) & ~F.startswith(p["k"], F.lit(COLUMN)))
    facts = F.transform(rest, lambda p: F.concat(caption, F.lit(": "), subject, F.lit("의 "), p["k"], F.lit(" 값은 "), p["v"], F.lit("이다."), info))
    return F.when(graded, facts).otherwise(F.array().cast("array<string>"))


def facts(chunks: DataFrame, key: str = "chunk_id", most: int = FACTS_PER_CHUNK) -> DataFrame:
    """key, fact_index (from 0), fact: the facts of all tables of each chunk (key, text, path), in their order, each once,
    cut at their limit; of a chunk at most ``most``, which is the feature."""
    c = {n: F.col(n) for n in ("caption", "legends", "labels", "cells")}
    own = row_fact(c["caption"], c["legends"], c["labels"], c["cells"])
    spoken = F.when(own.isNotNull(), F.array(own)).otherwise(symbol_facts(c["caption"], c["legends"], c["labels"], c["cells"]))
    rows = parsed_tables(chunks, key).select(key, "block", "row_no", F.posexplode(F.concat(spoken, matrix_facts(c["caption"], c["labels"], c["cells"]))).alias("nth", "fact"))
    rows = rows.withColumn("fact", truncated_fact(F.col("fact"))).where("fact <> ''")
    first = rows.groupBy(key, "fact").agg(F.min(F.struct("block", "row_no", "nth")).alias("place"))
    index = F.row_number().over(Window.partitionBy(key).orderBy("place")) - 1
    return first.select(key, index.alias("fact_index"), "fact").where(F.col("fact_index") < most)


def fact_subject(fact: Column) -> Column:
    """The subject of a row's fact, else empty."""
    return F.trim(F.regexp_extract(fact, rf":\s*(.+?)\s*{ROW_WORDS.strip()}", 1))


def fact_pairs(fact: Column) -> Column:
    """The (k, v) pairs of a row's fact."""
    body = F.regexp_extract(fact, rf"{ROW_WORDS.strip()}\s*(.+?)(?:이다\.?$|$)", 1)
    pair = lambda p: F.named_struct(F.lit("k"), F.trim(F.split_part(p, F.lit("="), F.lit(1))), F.lit("v"), F.regexp_replace(F.trim(F.regexp_replace(p, "^[^=]*=", "")), r"\s*이다\.?$", ""))
    return F.filter(F.transform(F.filter(F.split(body, ";"), lambda p: F.contains(p, F.lit("="))), pair), lambda p: (p["k"] != "") & (p["v"] != ""))
