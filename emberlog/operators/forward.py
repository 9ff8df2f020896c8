"""Forwarders and user code: entries go somewhere besides."""

from __future__ import annotations

import importlib.util
import socket
import ssl
import time
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..entry import ev, ev_upsert, text
from ..functions.net import ipv4_text
from ..functions.regexes import Pattern
from .filters import source_filter, tag_selector


def encode_raw(delimiter: bytes = b"\n") -> Column:
    return F.concat(F.col("data"), F.lit(delimiter))


def encode_json() -> Column:
    """One JSON object a line: time, tag, source, payload in base64, attributes."""
    pairs = F.transform("evs", lambda e: F.struct(e["name"].alias("Name"), e["value"].alias("ValueStr"), F.struct(e["type_id"].cast("int").alias("Type"), F.base64(F.coalesce(e["raw"], e["value"].cast("binary"))).alias("Data")).alias("Value")))
    row = F.struct(_time().alias("TS"), F.col("tag").alias("Tag"), ipv4_text(F.col("src")).alias("SRC"), F.base64("data").alias("Data"), pairs.alias("Enumerated"))
    return F.to_json(row)


def encode_syslog(app: str = "emberlog") -> Column:
    """``<134>1 TIME APP TAG - - - DATA``."""
    return F.concat_ws(" ", F.lit("<134>1"), _time(), F.lit(app), F.col("tag"), F.lit("- - -"), text())


def _time() -> Column:
    nanos = F.lpad((F.date_format("ts", "SSSSSS").cast("bigint") * 1000 + F.coalesce("nsec_rem", F.lit(0))).cast("string"), 9, "0")
    return F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), nanos, F.lit("Z"))


@dataclass(frozen=True)
class Forwarder:
    """What goes to a socket: entries of some tags, that any pattern matches, from any of some networks; the pipeline's output is unchanged.

    ``send`` is an action for a batch or a micro-batch; ``Pipeline.run`` and
    ``Pipeline.stream`` take it where the stage stands.
    """

    target: str
    protocol: str = "tcp"
    format: str = "raw"
    delimiter: str = "\n"
    tags: Sequence[str] = ()
    patterns: Sequence[str] = ()
    sources: Sequence[str] = ()
    non_blocking: bool = False

    def __post_init__(self) -> None:
        if self.protocol not in ("tcp", "udp", "tls", "unix") or self.format not in ("raw", "json", "syslog"):
            raise ValueError("protocol is tcp|udp|tls|unix, format is raw|json|syslog")
        if not self.target:
            raise ValueError("a target is needed")

    @classmethod
    def from_config(cls, c) -> Forwarder:
        return cls(c.one("Target", ""), c.one("Protocol", "tcp"), c.one("Format", "raw"), c.one("Delimiter", "\n"), c.many("Tag"), c.many("Regex"), c.many("Source"), c.flag("Non-Blocking"))

    def __call__(self, df: DataFrame) -> DataFrame:
        return df

    def selected(self, df: DataFrame) -> DataFrame:
        """The entries to send, as lines of bytes."""
        tests = []
        if self.tags:
            tests.append(tag_selector(self.tags))
        if self.patterns:
            tests.append(reduce(lambda a, b: a | b, (Pattern(p).matches(text()) for p in self.patterns)))
        if self.sources:
            tests.append(source_filter(self.sources))
        chosen = df.filter(reduce(lambda a, b: a & b, tests)) if tests else df
        end = self.delimiter.encode()
        line = {"raw": encode_raw(end), "json": F.concat(encode_json().cast("binary"), F.lit(b"\n")), "syslog": F.concat(encode_syslog().cast("binary"), F.lit(b"\n"))}[self.format]
        return chosen.select(line.alias("line"))

    def send(self, df: DataFrame, batch: int | None = None) -> None:
        """One connection for each partition."""
        protocol, target, lossy = self.protocol, self.target, self.non_blocking

        def run(rows: Iterator) -> None:
            rows = iter(rows)
            first = next(rows, None)
            if first is None:
                return
            try:
                with _connect(protocol, target) as s:
                    for row in (first, *rows):
                        s.send(bytes(row.line)) if protocol == "udp" else s.sendall(bytes(row.line))
            except OSError:
                if not lossy:
                    raise

        self.selected(df).foreachPartition(run)


def _connect(protocol: str, target: str) -> socket.socket:
    if protocol == "unix":
        s = socket.socket(socket.AF_UNIX)
        s.connect(target)
        return s
    host, _, port = target.rpartition(":")
    if protocol == "udp":
        s = socket.socket(socket.AF_INET6 if ":" in host else socket.AF_INET, socket.SOCK_DGRAM)
        s.connect((host.strip("[]"), int(port)))
        return s
    s = socket.create_connection((host.strip("[]"), int(port)), timeout=30)
    return ssl.create_default_context().wrap_socket(s, server_hostname=host) if protocol == "tls" else s


@dataclass(frozen=True)
class TableTee:
    """A second store for some tags, by tag name: a table partitioned by day and tag."""

    path: str
    tags: Sequence[str] = ()

    def __call__(self, df: DataFrame) -> DataFrame:
        return df

    def send(self, df: DataFrame, batch: int | None = None) -> None:
        from ..sources.sinks import write_entries

        write_entries(df.filter(tag_selector(self.tags)) if self.tags else df, self.path, mode="append")


@dataclass(frozen=True)
class RingBuffer:
    """The last entries, without attributes, in a bounded folder: batch files, the oldest going beyond ``size`` bytes."""

    path: str
    size: int = 1 << 26

    def __call__(self, df: DataFrame) -> DataFrame:
        return df

    def send(self, df: DataFrame, batch: int | None = None) -> None:
        df.drop("evs").write.mode("append").parquet(self.path)
        self._trim(df.sparkSession)

    def _trim(self, spark) -> None:
        jvm = spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files = sorted((f for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-")), key=lambda f: f.getModificationTime())
        total = sum(f.getLen() for f in files)
        for f in files[:-1]:
            if total <= self.size:
                break
            fs.delete(f.getPath(), False)
            total -= f.getLen()

    def read(self, spark) -> DataFrame:
        """What it holds, oldest first."""
        return spark.read.parquet(f"{self.path}/part-*").orderBy("ts", "nsec_rem")

    def pop(self, spark) -> DataFrame:
        """What it holds, oldest first, taken out of it: the files move aside, and stay there for this reader."""
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path
        fs = path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        aside = f"{self.path}/_taken-{uuid.uuid4().hex}"
        fs.mkdirs(path(aside))
        schema = spark.read.parquet(f"{self.path}/part-*").schema
        for f in fs.listStatus(path(self.path)):
            if (name := f.getPath().getName()).startswith("part-"):
                fs.rename(f.getPath(), path(f"{aside}/{name}"))
        return spark.read.schema(schema).parquet(aside).orderBy("ts", "nsec_rem")


def plugin(process: Callable[[pd.DataFrame], pd.DataFrame], flush: Callable[[], pd.DataFrame] | None = None) -> Callable[[DataFrame], DataFrame]:
    """User code over batches of entries, one to any number out; ``flush`` gives what a task held back."""

    def stage(df: DataFrame) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield process(batch)
            if flush is not None:
                yield flush()

        return df.mapInPandas(run, df.schema)

    return stage


def tolerant_plugin(process: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """As :func:`plugin`; a batch on which the code fails passes unchanged, the error in a column ``_err``."""

    def stage(df: DataFrame) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                try:
                    yield process(batch.copy()).assign(_err=None)
                except Exception as e:
                    yield batch.assign(_err=f"{type(e).__name__}: {e}")

        return df.mapInPandas(run, df.schema.simpleString()[len("struct<") : -1] + ",_err:string")

    return stage


def cached_lookup(resolve: Callable[[list[str]], list[str | None]], key: Column, name: str, most: int = 100_000, seconds: float = 3600.0) -> Callable[[DataFrame], DataFrame]:
    """An attribute ``name`` with what ``resolve`` (many keys a call) gives for each entry's key.

    A task asks once for a key within ``seconds`` and keeps ``most`` answers, the
    latest used; keys without an answer are remembered too.  Entries without key
    or answer stay as they are.
    """

    def stage(df: DataFrame) -> DataFrame:
        @F.pandas_udf("string")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            known: OrderedDict[str, tuple[float, str | None]] = OrderedDict()
            for keys in batches:
                now = time.monotonic()
                fresh = [k for k in keys.dropna().unique() if k not in known or now - known[k][0] > seconds]
                answers = dict(zip(fresh, resolve(fresh), strict=True)) if fresh else {}
                found = {k: answers[k] if k in answers else known[k][1] for k in keys.dropna().unique()}
                for k, v in found.items():
                    known[k] = (now, v) if k in answers else known[k]
                    known.move_to_end(k)
                while len(known) > most:
                    known.popitem(last=False)
                yield keys.map(found, na_action="ignore")

        out = df.withColumn("_answer", run(key.cast("string")))
        return out.withColumn("evs", F.when(F.col("_answer").isNotNull(), ev_upsert(F.col("evs"), ev(name, F.col("_answer")), name)).otherwise(F.col("evs"))).drop("_answer")

    return stage


def load_plugin(path: str, config: dict) -> Callable[[DataFrame], DataFrame]:
    """A Python file with ``process(batch)``, and perhaps ``config(values)`` and ``flush()``."""
    spec = importlib.util.spec_from_file_location("emberlog_user_plugin", path)
    if spec is None or spec.loader is None:
        raise ValueError(f"no plugin at {path}")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    if not hasattr(module, "process"):
        raise ValueError("the plugin has no process()")
    if hasattr(module, "config"):
        module.config(config)
    return plugin(module.process, getattr(module, "flush", None))
