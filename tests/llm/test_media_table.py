"""op8_media stores its payloads and reads the stored table back."""

from pathlib import Path

from marginalia.llm import queries
from marginalia.llm.common import shared_dir


def test_media_are_written_and_read_again(spark):
    sf, folder = "/root/testdata/sf0.001", Path(shared_dir(spark).removeprefix("file://").removeprefix("file:"))
    before = set(folder.glob("media-*"))
    read = queries.op8_media(spark, sf)
    (stored,) = set(folder.glob("media-*")) - before
    rows = spark.read.parquet(f"file://{stored}")
    assert rows.columns == ["doc_id", "media"] and rows.count() == read.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert any(str(stored) in f for f in read.inputFiles())
