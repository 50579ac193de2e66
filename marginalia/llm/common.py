"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import ctypes
import gc
import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that an operator handles at a time inside one Arrow batch.
SLICE_ROWS = 256
#: Bytes of text in such a slice; a longer text is a slice of its own.
SLICE_BYTES = 8_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``. Where that is unset, a local session gets a
    temporary folder; on a cluster that would lose rows, so there it is an error.
    """
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not (context.master or "").split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="marginalia-")
    context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def remove_path(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` as a table in the shared folder, read again: later plans don't compute it anew."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**options).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch = path
    return table


def forget(*tables: DataFrame) -> None:
    """Deletes tables, as of ``written``, that no later plan reads."""
    for table in tables:
        remove_path(table.sparkSession, table.scratch)


#: A key of more rows than this, and than a ten-thousandth of all, goes by a broadcast: there are at most ten thousand.
HOT_ROWS, HOT_KEYS = 1_000, 10_000


def attached(rows: DataFrame, owners: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` (``total`` of them) beside the columns of ``owners`` (key, n: its rows, ...), which has each key once. Keys of
    very many rows don't go to one task: their owners are broadcast."""
    least = max(HOT_ROWS, total // HOT_KEYS)
    hot, others = F.broadcast(owners.where(F.col("n") > least).drop("n")), owners.where(F.col("n") <= least).drop("n")
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(others, key))


#: What this process keeps between tasks, by owner: how to drop it.
_HELD: dict[str, Callable[[], object]] = {}


def give_back() -> None:
    """Memory that is no longer used goes back to the system; a worker lives on, for tasks of other operators."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def holds(owner: str, drop: Callable[[], object] = lambda: None) -> None:
    """``owner`` is at work in this process, and may keep something between tasks; what others kept goes."""
    others = [x for x in _HELD if x != owner]
    for x in others:
        _HELD.pop(x)()
    if others:
        give_back()
    _HELD[owner] = drop


def doc_remainder(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(column.cast("string").cast("binary")) % F.lit(modulus)


def text_slices(batches: Iterable[pa.RecordBatch], text: str = "text", rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each slice holds few rows and few bytes."""
    for batch in batches:
        at = batch.schema.get_field_index(text)
        sizes = pc.binary_length(batch.column(at)).fill_null(0).to_pylist()
        begin, held = 0, 0
        for i, n in enumerate(sizes):
            if i > begin and (i - begin >= rows or held + n > SLICE_BYTES):
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += n
        if begin < batch.num_rows:
            yield batch.slice(begin)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return ["" if t is None else t for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def utf8_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    column = batch.column(batch.schema.get_field_index(name)).cast(pa.binary())
    return [b"" if t is None else t for t in column.to_pylist()]


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, bound: int, seed: int = 5) -> DataFrame:
    """doc_id, text and label of at most about ``bound`` labelled rows, drawn by a hash of doc_id, of which none
    is held out (crc32 of the id modulo ``modulus`` equal to ``held_out``). One row for each doc_id.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(
        (doc_remainder("doc_id", modulus) != held_out) & F.col("label").isNotNull()
    )
    fraction = min(1.0, bound / max(1, own.count()))
    drawn = own.where(F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 30)) < int(fraction * (1 << 30))).groupBy("doc_id").agg(F.max("label").alias("label"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(drawn), "doc_id")  # about ``bound`` rows
    return rows.groupBy("doc_id").agg(F.max("text").alias("text"), F.max("label").alias("label"))


def fitted(sample: DataFrame, fit: Callable[[list[tuple[str, int]]], object]) -> object:
    """What ``fit`` makes of a bounded sample's texts and labels, worked out in one task; their order doesn't
    depend on partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in zip(*(column_of(batch, c).to_pylist() for c in ("doc_id", "text", "label")))]
        holds("fitting")
        model = pickle.dumps(fit([(text, label) for _, text, label in sorted(rows)]))
        rows.clear()
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], ["model"])

    return pickle.loads(bytes(sample.repartition(1).mapInArrow(run, "model binary").first()["model"]))


def rows_kept(docs: DataFrame, decider: Callable[[], Callable[[list[str]], list[bool]]]) -> DataFrame:
    """The rows of ``docs``, in all its columns, whose texts (null: empty) the decision keeps. ``decider`` is
    called once in each task and gives the decision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decide = decider()
        for part in text_slices(batches):
            yield part.filter(pa.array(decide(texts_of(part)), pa.bool_()))
        del decide
        give_back()

    return docs.mapInArrow(run, docs.schema)
