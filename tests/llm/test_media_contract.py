"""op8_media's exact columns, held against a plain reading of its contract."""

import hashlib
import zlib

import pytest

from marginalia.llm import flac, media, queries

LETTERS = b"a b c d e "
RAW = [None, b"", b"\x00", "\U0010ffff".encode() * 145, *((LETTERS * 120)[:n] for n in (1, 31, 32, 33, 544, 545, 575, 576, 577, 1152, 1153))]
#: A string column holds any bytes, those of the filling too.
RAW += [b"\xff", b"a\xff", b"\xff" * 576, b"\xff" * 577, LETTERS + b"\xff\xff", b"\xffa"]


def expected(doc_id, raw):
    utf8 = raw or b""
    stored = utf8 + b"\xff" * (-len(utf8) % 576 if utf8 else 576)
    return doc_id, len(utf8), len(stored), hashlib.sha256(stored).hexdigest(), zlib.crc32(stored[-32:])


@pytest.mark.parametrize("kind", ["string", "binary"])
def test_media_columns_are_those_of_the_contract(spark, tmp_path, kind):
    rows = list(enumerate([*RAW, *RAW[:6]]))
    rows = [(None if i == 7 else i, raw) for i, raw in rows]
    table = spark.createDataFrame([(i, None if raw is None else bytearray(raw)) for i, raw in rows], "doc_id long, text binary")
    table.selectExpr("doc_id", f"CAST(text AS {kind}) AS text").write.parquet(f"{tmp_path}/documents.parquet")
    read = queries.op8_media(spark, str(tmp_path)).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")
    assert [t for _, t in read.dtypes] == ["bigint", "bigint", "bigint", "string", "bigint"]
    assert sorted(map(tuple, read.collect()), key=repr) == sorted((expected(*r) for r in rows), key=repr)


def test_media_columns_of_given_documents(spark):
    sf = "/root/testdata/sf0.001"
    read = queries.op8_media(spark, sf).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert sorted(map(tuple, read.collect())) == sorted(expected(r["doc_id"], (r["text"] or "").encode()) for r in docs)


def test_a_told_size_must_fit(spark):
    stream = flac.encode([media.payload(b"a\xff")], [2])[0]
    assert flac.told_size(stream) == 2 and flac.told_size(flac.encode([media.payload(b"a")])[0]) is None
    for wrong in (0, 577):
        damaged = stream.replace(b"size" + (2).to_bytes(8, "big"), b"size" + wrong.to_bytes(8, "big"))
        with pytest.raises(Exception, match="tells a size"):
            media.decode_media(spark.createDataFrame([(1, bytearray(damaged))], "doc_id long, media binary")).collect()
