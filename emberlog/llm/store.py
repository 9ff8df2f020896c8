"""Shared scratch space: tables and files that every executor can reach."""

from __future__ import annotations

import atexit
import uuid
from weakref import WeakKeyDictionary

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder and runs on one machine (tests, a laptop).
LOCAL_DEFAULT = "file:///tmp/checkpoints/emberlog"
_made: dict[str, SparkSession] = {}
_tables: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, a local one if the master is local, else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = LOCAL_DEFAULT
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(root)
    return as_uri(root).rstrip("/")


def as_uri(path: str) -> str:
    if path.startswith("file:/") and not path.startswith("file:///"):
        return "file:///" + path[len("file:/") :].lstrip("/")
    return path if "://" in path else "file://" + path


def scratch(spark: SparkSession, name: str) -> str:
    """A new, empty place below the shared folder; removed when the driver exits, or before by :func:`discard`."""
    path = f"{shared_root(spark)}/emberlog-{uuid.uuid4().hex}/{name}"
    if not _made:
        atexit.register(_clear)
    _made[path.rsplit("/", 1)[0]] = spark
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends there, and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _tables[table] = path
    return table


def discard(*tables: DataFrame) -> None:
    """Remove what :func:`written` made, once everything that reads it has itself been written."""
    for table in tables:
        _remove(_tables.pop(table).rsplit("/", 1)[0])


def passed_on(table: DataFrame, reader: DataFrame) -> DataFrame:
    """``reader``, to which :func:`discard` now applies in the place of the table it reads."""
    _tables[reader] = _tables.pop(table)
    return reader


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(as_uri(uri))


def _remove(folder: str) -> None:
    spark = _made.pop(folder)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _clear() -> None:
    for folder in list(_made):
        try:
            _remove(folder)
        except Exception:  # the session may be gone at exit; what is left is scratch
            return
