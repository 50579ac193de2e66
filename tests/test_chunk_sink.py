"""The chunk sink adds documents and replaces those that come again."""

from pyspark.sql import functions as F

from marginalia.sources import files
from marginalia.streaming import sessions


def stored(spark, path):
    return sorted(((r["document_id"], r["text"]) for r in spark.read.parquet(path).collect()), key=repr)


def test_documents_of_one_bucket_stay(spark, tmp_path):
    path, schema = str(tmp_path / "chunks"), "document_id long, text string"
    write = lambda rows, buckets: files.write_chunks(spark.createDataFrame(rows, schema), path, buckets)
    write([(1, "a"), (1, "b"), (None, "n")], 1)
    write([(2, "c")], 1)
    assert stored(spark, path) == sorted([(1, "a"), (1, "b"), (2, "c"), (None, "n")], key=repr)
    write([(1, "z"), (None, "m")], 1)
    write([], 1)
    assert stored(spark, path) == sorted([(1, "z"), (2, "c"), (None, "m")], key=repr)
    files.write_chunks(spark.read.parquet(path).where("document_id = 2").select("document_id", F.upper("text").alias("text"), F.lit(3).alias("page")), path, 1)
    assert stored(spark, path) == sorted([(1, "z"), (2, "C"), (None, "m")], key=repr)
    assert not [p for p in (tmp_path / "chunks").iterdir() if p.name.startswith("_staging")]


def test_micro_batches_add_up(spark, tmp_path):
    many, path = 100, str(tmp_path / "chunks")
    spark.range(many).select(F.col("id").alias("document_id"), F.lit("t").alias("text")).repartition(3, "document_id").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("document_id long, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sessions.ingest_stream(stream, lambda batch, _: files.write_chunks(batch, path, 8), str(tmp_path / "cp")).awaitTermination(120)
    assert [i for i, _ in sorted(stored(spark, path))] == list(range(many))
