"""Folders for tables that later plans read: shared by the driver and all executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


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


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read again: plans that use it several times work it out once."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.scratch = path
    return table


def forget(*tables: DataFrame) -> None:
    """Deletes tables, as of ``kept``, that no later plan reads."""
    for table in tables:
        remove_path(table.sparkSession, table.scratch)


def remove_path(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop))


def version(spark: SparkSession, path: str) -> tuple:
    """What tells a table's files apart from an earlier state of it: names, lengths and times."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    status = system.getFileStatus(hadoop)
    found = list(system.listStatus(hadoop)) if status.isDirectory() else [status]
    return tuple(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in found))
