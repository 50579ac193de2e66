"""Rows that repeat a doc_id or lack one, in the pipeline's stages."""

import collections

from marginalia.llm import mixing, near_copies, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcdef"]
#: doc_id and the text's letter; b stays under id 3, c and d without an id, e and f under one id.
ROWS = [(1, "a"), (None, "a"), (None, "b"), (3, "b"), (None, "c"), (None, "d"), (None, "d"), (7, "e"), (7, "f"), (7, "a"), (7, "f")]


def frame(spark):
    return spark.createDataFrame([(i, WORDS["abcdef".index(t)], "en", "s", 1) for i, t in ROWS], SCHEMA)


def test_one_row_stays_of_each_component(spark):
    for kept in (simhash.deduplicated(frame(spark)), near_copies.deduplicated(frame(spark))):
        got = sorted(((r["doc_id"], r["text"][0]) for r in kept.collect()), key=repr)
        assert got == sorted([(1, "a"), (3, "b"), (None, "c"), (None, "d"), (7, "e"), (7, "f")], key=repr)


def test_mixed_rows_without_and_with_repeated_ids(spark):
    rows = [(None, "p q r"), (None, "x"), (5, "k l m n o"), (5, "y z"), (6, "u v"), (6, "u v")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows] + [(9, "t t t", "en", "t", 1), (None, "s s", "en", None, 1)], SCHEMA)
    taken = collections.Counter()
    for r in mixing.mix(docs).collect():
        taken[r["source"]] += r["taken"]
    got, ids = collections.Counter(), collections.defaultdict(set)
    for r in mixing.mixed_documents(docs).collect():
        got[r["source"]] += len(r["text"].split())
        ids[r["doc_id"]].add(r["text"])
        assert any(t.startswith(r["text"]) and i == r["doc_id"] for i, t in [*rows, (9, "t t t"), (None, "s s")]) and r["n_chars"] == len(r["text"])
    assert got == taken and None in ids
