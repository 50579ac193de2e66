"""Borders of chunks, section paths and pieces, against expected texts."""

from pyspark.sql import functions as F

from marginalia.operators import splitting
from marginalia.operators.splitting import HEADERS

HEAD = "| A | B |\n|---|---|"


def chunked(spark, parts):
    rows = [(1, i, text, kind) for i, (text, kind) in enumerate(parts)]
    return spark.createDataFrame(rows, "document_id long, chunk_index int, text string, block_type string")


def context(spark, *parts):
    return [r["text"] for r in splitting.with_context(chunked(spark, parts)).orderBy("chunk_index").collect()]


def test_context_at_the_borders(spark):
    got = context(spark, ("first line\nsecond line", None), ("plain text", None), ("# Heading\ntext", None), (f"{HEAD}\n| 1 | 2 |", "table"), ("| 3 | 4 |\n| 5 | 6 |", "table"), ("※ 표시 note\nmore", None), ("제3조 article", None))
    assert got == [
        "first line\nsecond line",
        "first line\nsecond line\n\nplain text",  # the last lines of the chunk before
        "# Heading\ntext",  # a heading begins here
        f"# Heading\ntext\n\n{HEAD}\n| 1 | 2 |\n\n※ 표시 note",  # notes behind the run of tables
        f"{HEAD}\n\n| 3 | 4 |\n| 5 | 6 |\n\n※ 표시 note",  # rows without a header go on
        "※ 표시 note\nmore",  # the chunk before ends in a table
        "제3조 article",
    ]


def test_notes_before_a_table_take_the_place_of_last_lines(spark):
    got = context(spark, ("intro\n범례 one\n♣ two\n", None), (f"{HEAD}\n| 1 | 2 |", "table"))
    assert got[1] == f"범례 one\n♣ two\n\n{HEAD}\n| 1 | 2 |"
    many = "\n".join(f"※ n{i}" for i in range(12))
    assert context(spark, (many, None), (f"{HEAD}\n| 1 | 2 |", "table"))[1].startswith("※ n4\n") and len(context(spark, ("x", None))) == 1


def test_open_headers_and_notes(spark):
    texts = [f"{HEAD}\n| 1 | 2 |", f"{HEAD}\n| 1 | 2 |\nprose", HEAD, f"x\n{HEAD}\n\n| 1 | 2 |\n|---|---|", "", None, "※ a\n※ b\nc\n※ d", f"{HEAD}\n※ a", "x\n비고 a"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", splitting.open_header(F.col("t")).alias("h"), splitting.notes_at_start(F.col("t")).alias("n")).orderBy("i").collect()
    assert [r["h"] for r in rows] == [HEAD, "", "", HEAD, "", "", "", "", ""]
    assert [r["n"] or "" for r in rows] == ["", "", "", "", "", "", "※ a\n※ b", "", "비고 a"]


def test_boundaries(spark):
    texts = ["# a", "부 칙", "제 3 조 x", "- 제12장", "제3항", "x\n# a", ""]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(splitting.is_boundary(F.col("t"))).collect()] == [True, True, True, True, False, False, False]


def test_paths_go_on_over_pages_and_fences_hide_headings(spark):
    rows = [(1, 0, 1, "# A\n## B\ntext"), (1, 1, 2, "more\n### C\n```\n# no\n```\nlast"), (1, 2, 3, "# D\nend"), (2, 0, None, "x"), (2, 1, None, "y"), (3, 0, None, None)]
    got = splitting.split(spark.createDataFrame(rows, "document_id long, ordinal int, page long, text string")).orderBy("document_id", "chunk_index").collect()
    assert [(r["document_id"], r["text"], r["h1"], r["h2"], r["h3"], r["page"]) for r in got] == [
        (1, "# A\n## B\ntext", "A", "B", None, 1), (1, "more", "A", "B", None, 2), (1, "### C\n```\n# no\n```\nlast", "A", "B", "C", 2), (1, "# D\nend", "D", None, None, 3), (2, "x\ny", None, None, None, None),
    ]


def test_pieces_keep_rows_and_words(spark):
    table = [*HEAD.split("\n"), *(f"| {i} | {'x' * 300} |" for i in range(4)), f"| big | {'y' * 900} |"]
    words, wide = "word " * 400, "z" * 2000
    frame = spark.createDataFrame([(1, 0, None, "\n".join(["# T", words, wide, *table]))], "document_id long, ordinal int, page long, text string")
    got = [(r["text"], r["block_type"]) for r in splitting.split(frame).orderBy("chunk_index").collect()]
    assert all(len(t) <= 800 for t, k in got if k is None) and "".join("".join(t.split()) for t, k in got if k is None) == "#T" + "word" * 400 + wide
    assert all(t.startswith(HEAD) for t, k in got if k) and [r for t, k in got if k for r in t.split("\n")[2:]] == table[2:]


def test_merging_keeps_a_title_with_its_table_and_shared_headings(spark):
    rows = [(1, i, t, k, h, p) for i, (t, k, h, p) in enumerate([("title", None, "a", 1), ("| t |" * 160, "table", "a", 2), ("t" * 10, None, "a", 2), ("u" * 10, None, "b", 2), (" ", None, "b", 2)])]
    frame = spark.createDataFrame(rows, "document_id long, chunk_index int, text string, block_type string, h1 string, page long")
    for h in HEADERS[1:]:
        frame = frame.withColumn(h, F.lit(None).cast("string"))
    got = [(r["text"][:5], r["block_type"], r["h1"], r["page"], r["merged_chunk_count"]) for r in splitting.merged(frame).orderBy("chunk_index").collect()]
    assert got == [("title", "table", "a", None, 2), ("ttttt", None, "a", 2, 1), ("uuuuu", None, "b", 2, 1)]
    assert splitting.merged(frame, least=0).count() == 5


def test_repeated_lines_and_headers(spark):
    texts = ["a\na \n\na\nb", f"{HEAD}\n{HEAD}\n| 1 | 2 |", f"{HEAD}\n| 1 | 2 |\n{HEAD}", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(splitting.without_repeats(F.col("t"))).collect()]
    assert got == ["a\n\na\nb", f"{HEAD}\n| 1 | 2 |", f"{HEAD}\n| 1 | 2 |\n{HEAD}", ""]
