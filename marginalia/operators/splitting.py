"""Documents to chunks: sections by headings, pieces of long sections, repeated lines, short neighbours, context at borders.

Chunks are rows (document_id, chunk_index, text, h1 to h6, block_type, page); neighbours follow from chunk_index within a
document. All steps are dealt by document_id, so a chain of them shuffles once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import lexicon as L
from marginalia.functions.text import collapse_space, first_line, lines
from marginalia.operators.chunking import CHUNK_OVERLAP, CHUNK_SIZE, MERGE_MIN, is_table_row, is_table_separator, overlap_tail
from marginalia.operators.table_facts import is_table_line

HEADERS = [f"h{i}" for i in range(1, 7)]
#: Lines and characters of a table's notes that are carried over, and lines in which a table counts as near the start.
NOTE_LINES, NOTE_CHARS, NEAR_START, NEAR_START_DOCUMENT = 8, 700, 12, 20

_STRIP = r"(?U)^\s+|\s+$"
_BOUNDARY = r"^[-*ㆍ·]?(제\d+(장|절|조|조의\d+))"
_EMPTY = "array<string>"


def _strip(x: Column) -> Column:
    return F.regexp_replace(x, _STRIP, "")


def sections(pages: DataFrame) -> DataFrame:
    """document_id, ordinal, section, pos, line, page, h1 to h6: the lines that aren't blank of ``pages`` (document_id, ordinal,
    page, text) with the path of headings that is open at each.

    A section begins at a heading, unless a heading stands before it; and, in documents whose parts have pages, with
    each part. A heading closes all of its level and deeper; paths go on over pages. Lines between fences are no
    headings. Nulls are empty texts.
    """
    rows = pages.select("document_id", "ordinal", "page", F.posexplode(lines(F.coalesce("text", F.lit("")))).alias("pos", "line")).withColumn("line", _strip(F.col("line"))).where("line <> ''")
    order = Window.partitionBy("document_id").orderBy("ordinal", "pos")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    fences = F.sum(F.col("line").rlike("^(```|~~~)").cast("int")).over(upto)
    rows = rows.withColumn("nth", F.row_number().over(order)).withColumn("fenced", fences % 2 == 1)
    rows = rows.withColumn("level", F.when(~F.col("fenced") & F.col("line").rlike(r"^#{1,6}(\s|$)"), F.length(F.regexp_extract("line", "^(#+)", 1))))
    paged = F.max(F.col("page").isNotNull()).over(Window.partitionBy("document_id"))
    turns = F.col("level").isNotNull() & F.lag("level").over(order).isNull()
    turns = turns | (paged & (F.col("ordinal") != F.coalesce(F.lag("ordinal").over(order), F.lit(-1))))
    rows = rows.withColumn("section", F.sum(turns.cast("int")).over(upto).cast("long"))
    title = F.trim(F.regexp_replace("line", r"^#+\s*", ""))
    for i, name in enumerate(HEADERS, 1):
        last = F.last(F.when(F.col("level") == i, F.struct("nth", title.alias("title"))), ignorenulls=True).over(upto)
        closed = F.max(F.when(F.col("level") < i, F.col("nth"))).over(upto)
        rows = rows.withColumn(name, F.when(last["nth"] > F.coalesce(closed, F.lit(0)), last["title"]))
    return rows.select("document_id", "ordinal", "section", "pos", "nth", "line", "page", *HEADERS)


def packed(units: Column, joint: str, limit: int, head: Column | None = None) -> Column:
    """Neighbouring units joined up to ``limit`` characters; one that is longer stays whole. ``head`` is put on each piece and
    counts."""
    with_head = lambda x: x if head is None else F.when(head != "", F.concat(head, F.lit("\n"), x)).otherwise(x)
    start = F.named_struct(F.lit("done"), F.array().cast(_EMPTY), F.lit("held"), F.lit(None).cast("string"))

    def step(acc: Column, x: Column) -> Column:
        more = F.concat(acc["held"], F.lit(joint), x)
        full = acc["held"].isNotNull() & (F.length(with_head(more)) > limit)
        return F.named_struct(F.lit("done"), F.when(full, F.array_append(acc["done"], with_head(acc["held"]))).otherwise(acc["done"]), F.lit("held"), F.when(full | acc["held"].isNull(), x).otherwise(more))

    return F.aggregate(units, start, step, lambda acc: F.when(acc["held"].isNull(), acc["done"]).otherwise(F.array_append(acc["done"], with_head(acc["held"]))))


def text_pieces(rows: Column, limit: int = CHUNK_SIZE) -> Column:
    """Lines packed up to ``limit`` characters. A longer line is cut at spaces, a longer word anywhere."""
    cut = lambda w: F.when(F.length(w) <= limit, F.array(w)).otherwise(F.transform(F.sequence(F.lit(0), ((F.length(w) - 1) / limit).cast("int")), lambda i: F.substring(w, i * limit + 1, F.lit(limit))))
    within = lambda x: F.when(F.length(x) <= limit, F.array(x)).otherwise(packed(F.flatten(F.transform(F.filter(F.split(x, " "), lambda w: w != ""), cut)), " ", limit))
    return packed(F.flatten(F.transform(rows, within)), "\n", limit)


def table_pieces(rows: Column, limit: int = CHUNK_SIZE) -> Column:
    """Whole rows packed up to ``limit`` characters, the header row and its separator on each piece; a longer row isn't cut."""
    headed = (F.size(rows) > 2) & F.coalesce(is_table_row(F.get(rows, F.lit(0))) & is_table_separator(F.get(rows, F.lit(1))), F.lit(False))
    head = F.when(headed, F.array_join(F.slice(rows, 1, 2), "\n")).otherwise("")
    body = F.when(headed, F.slice(rows, F.lit(3), F.size(rows))).otherwise(rows)
    whole = F.array_join(rows, "\n")
    return F.when(F.length(whole) <= limit, F.array(whole)).otherwise(packed(body, "\n", limit, head))


def split(pages: DataFrame, limit: int = CHUNK_SIZE) -> DataFrame:
    """Chunks of ``pages``: each section whole if it has ``limit`` characters or fewer, else its tables and the text between
    them in pieces. The path is that of the section's last heading."""
    rows = sections(pages)
    by = ["document_id", "section"]
    whole = Window.partitionBy(*by)
    rows = rows.withColumn("chars", F.sum(F.length("line") + 1).over(whole) - 1).withColumn("table", is_table_line(F.col("line")) & (F.col("chars") > limit))
    before = F.lag("table").over(whole.orderBy("nth"))
    rows = rows.withColumn("block", F.sum(F.coalesce(before != F.col("table"), F.lit(True)).cast("int")).over(whole.orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)))
    last = [F.max_by(c, "nth").alias(c) for c in HEADERS]
    # the path of a section is that of its opening headings, all of which stand before other lines
    blocks = rows.groupBy(*by, "block", "table").agg(F.min("nth").alias("nth"), F.min("page").alias("page"), *last, F.transform(F.array_sort(F.collect_list(F.struct("nth", "line"))), lambda x: x["line"]).alias("lines"), F.first("chars").alias("chars"))
    pieces = F.when(F.col("chars") <= limit, F.array(F.array_join("lines", "\n"))).when(F.col("table"), table_pieces(F.col("lines"), limit)).otherwise(text_pieces(F.col("lines"), limit))
    parts = blocks.select("document_id", "nth", "page", *HEADERS, F.when(F.col("table"), "table").alias("block_type"), F.posexplode(pieces).alias("piece", "text"))
    index = F.row_number().over(Window.partitionBy("document_id").orderBy("nth", "piece")) - 1
    return parts.select("document_id", index.alias("chunk_index"), "text", *HEADERS, "block_type", "page")


def without_repeats(text: Column) -> Column:
    """Without lines that equal the last kept one, white space apart, and without a table's header row and separator
    that equal the last two kept lines. Blank lines stay between; the ends are stripped."""
    own = lines(F.coalesce(text, F.lit("")))
    pairs = F.transform(own, lambda x, i: F.named_struct(F.lit("line"), x, F.lit("next"), F.coalesce(F.get(own, i + 1), F.lit(""))))
    start = F.named_struct(F.lit("kept"), F.array().cast(_EMPTY), F.lit("skip"), F.lit(False))

    def step(acc: Column, x: Column) -> Column:
        flat, n = collapse_space(x["line"]), F.size(acc["kept"])
        same = lambda back, value: F.coalesce(collapse_space(F.get(acc["kept"], n - back)) == value, F.lit(False))
        repeated = (flat != "") & same(1, flat)
        header = is_table_row(_strip(x["line"])) & is_table_separator(_strip(x["next"])) & same(2, flat) & same(1, collapse_space(x["next"]))
        kept = F.when(acc["skip"] | repeated | header, acc["kept"]).otherwise(F.array_append(acc["kept"], x["line"]))
        return F.named_struct(F.lit("kept"), kept, F.lit("skip"), ~acc["skip"] & ~repeated & header)

    return _strip(F.aggregate(pairs, start, step, lambda acc: F.array_join(acc["kept"], "\n")))


def merged(chunks: DataFrame, least: int = MERGE_MIN, most: int = CHUNK_SIZE, slack: int = CHUNK_OVERLAP) -> DataFrame:
    """Short neighbours joined by a blank line, with merged_chunk_count; chunk_index is numbered anew.

    A buffer is closed when it has ``least`` characters; when the next chunk's first three headings differ from those of
    its first; when the kind changes between text and table; or when the next chunk doesn't fit into ``most``.
    Text of fewer than ``least`` characters before a table stays with it, up to ``slack`` more. Joined chunks keep the
    headings and the page that all have. Blank chunks go. ``least`` of 0 joins nothing.
    """
    meta = [*HEADERS, "page"]
    if least <= 0:
        return chunks.withColumn("merged_chunk_count", F.lit(None).cast("long"))
    kind = "struct<sig:array<string>,last:string,meta:array<string>,text:string,n:bigint,table:boolean>"
    one = lambda r: F.named_struct(
        F.lit("sig"), F.transform(F.slice(r["meta"], 1, 3), lambda x: F.coalesce(x, F.lit(""))), F.lit("last"), r["kind"], F.lit("meta"), r["meta"], F.lit("text"), r["text"], F.lit("n"), F.lit(1).cast("long"), F.lit("table"), r["kind"] == "table"
    )
    row = F.struct("chunk_index", F.array(*(F.col(c).cast("string") for c in meta)).alias("meta"), F.coalesce("block_type", F.lit("text")).alias("kind"), "text")
    start = F.named_struct(F.lit("done"), F.array().cast(f"array<{kind}>"), F.lit("held"), F.lit(None).cast(kind))

    def step(acc: Column, x: Column) -> Column:
        held, n = acc["held"], F.length(acc["held"]["text"])
        after = n + 2 + F.length(x["text"])
        prefix = (held["last"] == "text") & (x["last"] == "table") & (n < least) & (after <= most + slack)
        closes = (held["sig"] != x["sig"]) | ((held["last"] != x["last"]) & ~prefix) | (n >= least) | ((after > most) & ~prefix)
        common = F.zip_with(held["meta"], x["meta"], lambda a, b: F.when(a == b, a))
        both = F.named_struct(F.lit("sig"), held["sig"], F.lit("last"), x["last"], F.lit("meta"), common, F.lit("text"), F.concat(held["text"], F.lit("\n\n"), x["text"]), F.lit("n"), held["n"] + 1, F.lit("table"), held["table"] | x["table"])
        done = F.when(held.isNotNull() & closes, F.array_append(acc["done"], held)).otherwise(acc["done"])
        return F.named_struct(F.lit("done"), done, F.lit("held"), F.when(held.isNull() | closes, x).otherwise(both))

    folded = F.aggregate(F.transform(F.array_sort(F.collect_list(row)), one), start, step, lambda acc: F.when(acc["held"].isNull(), acc["done"]).otherwise(F.array_append(acc["done"], acc["held"])))
    rows = chunks.where(_strip(F.col("text")) != "").groupBy("document_id").agg(folded.alias("chunks")).select("document_id", F.posexplode("chunks").alias("chunk_index", "c"))
    return rows.select("document_id", "chunk_index", "c.text", *(F.get("c.meta", F.lit(i)).alias(h) for i, h in enumerate(HEADERS)), F.when(F.col("c.table"), "table").alias("block_type"), F.get("c.meta", F.lit(6)).cast("long").alias("page"), F.col("c.n").alias("merged_chunk_count"))


def is_note(line: Column) -> Column:
    """A line that explains a table: a legend, a remark, a restriction."""
    stripped = _strip(line)
    starts = [F.startswith(stripped, F.lit(p)) for p in L.NOTE_PREFIXES]
    named = stripped.rlike("|".join([*L.NOTE_SYMBOLS])) | F.lower(stripped).rlike("|".join(L.NOTE_WORDS))
    for s in starts:
        named = named | s
    return (stripped != "") & ~is_table_line(stripped) & named


def _own(text: Column) -> Column:
    return F.filter(F.transform(lines(text), _strip), lambda x: x != "")


def table_near_start(rows: Column, most: int = NEAR_START) -> Column:
    """Among the first lines a header row with its separator, or three rows."""
    first = F.slice(rows, 1, most)
    headed = F.exists(F.transform(first, lambda x, i: is_table_row(x) & is_table_separator(F.coalesce(F.get(first, i + 1), F.lit("")))), lambda b: b)
    return headed | (F.size(F.filter(first, is_table_row)) >= 3)


def _notes(rows: Column, stops: Callable[[Column], Column]) -> Column:
    """The first run of notes in ``rows``, as far as it may grow: the limits are looked at after a line is added."""
    start = F.named_struct(F.lit("kept"), F.array().cast(_EMPTY), F.lit("over"), F.lit(False))

    def step(acc: Column, x: Column) -> Column:
        more = F.array_append(acc["kept"], x)
        note, some = is_note(x), F.size(acc["kept"]) > 0
        full = (F.size(more) >= NOTE_LINES) | (F.length(F.array_join(more, "\n")) >= NOTE_CHARS)
        return F.named_struct(F.lit("kept"), F.when(~acc["over"] & note, more).otherwise(acc["kept"]), F.lit("over"), acc["over"] | F.when(note, full).otherwise(some | stops(x)))

    return F.aggregate(rows, start, step, lambda acc: acc["kept"])


def notes_before(previous: Column, current: Column) -> Column:
    """The last notes of the chunk before, for a chunk that begins with a table; else empty."""
    found = F.array_join(F.reverse(_notes(F.reverse(_own(previous)), lambda x: F.lit(False))), "\n")
    return F.when(table_near_start(_own(current)), found).otherwise("")


def notes_at_start(text: Column) -> Column:
    """The first notes of a chunk, if no table stands before them."""
    return F.array_join(_notes(_own(text), is_table_line), "\n")


def open_header(text: Column) -> Column:
    """Header row and separator of the last table of a chunk that has rows, if nothing but the table follows; else empty."""
    rows = F.transform(lines(text), _strip)
    after = lambda i: F.filter(F.slice(rows, i + 3, F.size(rows)), lambda x: x != "")
    opens = lambda x, i: is_table_row(x) & is_table_separator(F.coalesce(F.get(rows, i + 1), F.lit(""))) & F.forall(after(i), is_table_line) & F.exists(after(i), lambda y: is_table_row(y) & ~is_table_separator(y))
    heads = F.transform(rows, lambda x, i: F.when(opens(x, i), F.concat(x, F.lit("\n"), F.get(rows, i + 1))))
    return F.coalesce(F.try_element_at(F.filter(heads, lambda h: h.isNotNull()), F.lit(-1)), F.lit(""))


def header_before(previous: Column, current: Column) -> Column:
    """The open header of the chunk before, for a chunk that goes on with rows and has no header of its own; else empty."""
    rows = _own(current)
    first, second = F.get(rows, F.lit(0)), F.coalesce(F.get(rows, F.lit(1)), F.lit(""))
    goes_on = F.coalesce(is_table_row(first) & ~is_table_separator(first) & ~is_table_separator(second), F.lit(False))
    return F.when(goes_on, open_header(previous)).otherwise("")


def is_boundary(text: Column) -> Column:
    """The chunk begins with a heading or a chapter, section or article of a statute."""
    first = first_line(text)
    squeezed = F.regexp_replace(first, r"(?U)\s+", "")
    return F.startswith(first, F.lit("#")) | F.startswith(squeezed, F.lit("부칙")) | squeezed.rlike(_BOUNDARY)


def with_context(chunks: DataFrame) -> DataFrame:
    """Each chunk with what its border cuts off: behind the text, the notes that follow a run of tables; before it, notes and the
    open header of the chunk before, or else that chunk's last lines, unless a heading or an article begins here. Context
    comes from the chunks as they were. Texts that change lose repeated lines; they may exceed the size of a chunk."""
    w = Window.partitionBy("document_id").orderBy("chunk_index")
    rows = chunks.withColumn("previous", F.lag("text").over(w)).withColumn("table_like", F.coalesce(F.col("block_type") == "table", F.lit(False)) | table_near_start(_own(F.col("text")), NEAR_START_DOCUMENT))
    behind = F.first(F.when(~F.col("table_like"), F.col("text")), ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    rows = rows.withColumn("notes", F.when(F.col("table_like"), F.coalesce(notes_at_start(behind), F.lit(""))).otherwise(""))
    noted = F.when((F.col("notes") != "") & ~F.contains("text", F.col("notes")), F.concat("text", F.lit("\n\n"), F.col("notes"))).otherwise(F.col("text"))
    rows = rows.withColumn("noted", noted)
    previous = F.coalesce("previous", F.lit(""))
    rows = rows.withColumn("above", notes_before(previous, F.col("noted"))).withColumn("header", header_before(previous, F.col("noted"))).withColumn("tail", F.when(is_boundary(F.col("noted")), "").otherwise(F.coalesce(overlap_tail(previous), F.lit(""))))
    tail_lines, head_lines = _own(F.col("tail")), _own(F.col("header"))
    same_head = (F.size(tail_lines) >= 2) & (F.size(head_lines) >= 2) & (F.transform(F.slice(tail_lines, 1, 2), collapse_space) == F.transform(F.slice(head_lines, 1, 2), collapse_space))
    header = F.when(~same_head, F.col("header")).otherwise("")
    plain = F.when((F.col("above") == "") & (F.col("header") == ""), F.col("tail")).otherwise("")
    parts = F.filter(F.array("above", header, plain), lambda x: x != "")
    changed = F.col("previous").isNotNull() & (F.size(parts) > 0) | (F.col("notes") != "")
    own = F.array_join(F.concat(F.when(F.col("previous").isNotNull(), parts).otherwise(F.array().cast(_EMPTY)), F.array("noted")), "\n\n")
    return rows.withColumn("text", F.when(changed, without_repeats(own)).otherwise(F.col("text"))).select(*chunks.columns)
