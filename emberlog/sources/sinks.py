"""Sinks: the entry table, result files, bulk export."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..entry import text
from ..operators.forward import encode_json
from ..operators.render import text_lines


def write_entries(df: DataFrame, path: str, mode: str = "append") -> None:
    """The entry table: Parquet by day and tag, sorted by time, so that searches prune folders and row groups.

    Rebalancing lets Spark split a day or tag that holds most rows.
    """
    dated = df.withColumn("dt", F.to_date("ts")).hint("rebalance", F.col("dt"), F.col("tag"))
    dated.sortWithinPartitions("dt", "tag", "ts").write.mode(mode).partitionBy("dt", "tag").parquet(path)


def stream_entries(df: DataFrame, path: str, checkpoint: str, trigger: str | None = None) -> StreamingQuery:
    """The same from a stream, exactly once by its checkpoint; without a trigger it takes what is there and stops."""
    out = df.withColumn("dt", F.to_date("ts")).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("dt", "tag")
    return (out.trigger(processingTime=trigger) if trigger else out.trigger(availableNow=True)).start()


def stream_to(df: DataFrame, sends: Sequence, checkpoint: str) -> StreamingQuery:
    """Every micro-batch to several senders, kept while they take it."""

    def run(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for send in sends:
                send(batch, number)
        finally:
            batch.unpersist()

    return df.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_results(df: DataFrame, path: str, format: str = "json", mode: str = "errorifexists") -> None:
    """Results as json (one entry a line, for reimport), csv, text, archive (Parquet), lookup (CSV of a table) or ipset."""
    if format == "json":
        df.select(encode_json().alias("value")).write.mode(mode).text(path)
    elif format == "csv":
        from ..functions.net import ipv4_text

        rows = df.select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("Timestamp"), ipv4_text(F.col("src")).alias("Source"), F.col("tag").alias("Tag"), text().alias("Data"))
        rows.write.mode(mode).option("header", "true").option("escape", '"').csv(path)
    elif format == "text":
        text_lines(df).write.mode(mode).text(path)
    elif format == "archive":
        df.write.mode(mode).parquet(path)
    elif format == "lookup":
        df.write.mode(mode).option("header", "true").csv(path)
    elif format == "ipset":
        from ..functions.net import ipv4_number
        from ..operators.filters import ip_bitmaps

        ip_bitmaps(df.select(ipv4_number(F.col("src")).alias("ip")).filter("ip IS NOT NULL")).write.mode(mode).parquet(path)
    else:
        raise ValueError(f"no format {format!r}")


def bulk_export(df: DataFrame, path: str, chunk: str = "hour") -> list[str]:
    """gzip JSON in a folder for each chunk of time; chunks that are there already stay.  The names of the new ones.

    New chunks are written aside and get their names when they are whole: a
    broken run leaves none that the next would take for done.
    """
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    hadoop_path = jvm.org.apache.hadoop.fs.Path
    fs = hadoop_path(path).getFileSystem(conf)

    def chunks(folder: str) -> list[str]:
        if not fs.exists(hadoop_path(folder)):
            return []
        return sorted(name for f in fs.listStatus(hadoop_path(folder)) if (name := f.getPath().getName()).startswith("chunk="))

    rows = df.select(F.date_format(F.date_trunc(chunk, "ts"), "yyyyMMdd'T'HHmmss").alias("chunk"), encode_json().alias("value"))
    if there := [(name.removeprefix("chunk="),) for name in chunks(path)]:  # one name for each unit of time
        rows = rows.join(F.broadcast(spark.createDataFrame(there, "chunk string")), "chunk", "left_anti")
    aside = f"{path}/_new-{uuid.uuid4().hex}"
    rows.write.partitionBy("chunk").option("compression", "gzip").text(aside)
    new = chunks(aside)
    for name in new:
        if not fs.rename(hadoop_path(f"{aside}/{name}"), hadoop_path(f"{path}/{name}")):
            raise OSError(f"{path}/{name} could not be made")
    fs.delete(hadoop_path(aside), True)
    return [name.removeprefix("chunk=") for name in new]


def capture_files(df: DataFrame, packets: int = 10_000) -> DataFrame:
    """Payloads as capture files of at most ``packets`` packets: (number, content), for a client to save; no number occurs twice, and a file never leaves its task's order."""

    def run(batches):
        import pandas as pd
        from pyspark import TaskContext

        from .binary import write_pcap

        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            rows = list(zip(batch["micros"], map(bytes, batch["data"]), strict=True))
            for at in range(0, len(rows), packets):
                yield pd.DataFrame({"number": [number], "content": [write_pcap(rows[at : at + packets])]})
                number += 1

    return df.select(F.unix_micros("ts").alias("micros"), "data").mapInPandas(run, "number long, content binary")
