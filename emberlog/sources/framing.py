"""From text to entries: lines, syslog streams, octet counting, JSON streams, delimiters."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..entry import check_tag, entries
from ..functions.jsonpath import json_text, split_quoted
from ..functions.net import to_bytes
from ..functions.timeformats import Grinder
from ..operators.filters import ignore_lines

#: Fixed value: where a syslog message begins in a stream.
SYSLOG_START = r"(?:^|\n)(?=<\d{1,3}>)"


def to_entries(df: DataFrame, value: Column, tag: str | Column, grinder: Grinder | None = None, src: str | None = None, caught: Column | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Texts as entries: time by the grinder, or when it was caught."""
    caught = caught if caught is not None else F.current_timestamp()
    ts = F.coalesce(grinder.extract(value), caught) if grinder is not None else caught
    source = F.lit(to_bytes(src)) if src else None
    return entries(df, ts=ts, data=value, tag=check_tag(tag) if isinstance(tag, str) else tag, src=source, keep=keep)


def clean_line(value: Column, trim: bool = False, quotes: bool = False) -> Column:
    """Without the carriage return at the end, and if asked without blanks or quotes around."""
    value = F.regexp_replace(value, r"\r+$", "")
    value = F.trim(value) if trim else value
    return F.regexp_replace(value, r'^"(.*)"$', "$1") if quotes else value


def read_lines(spark: SparkSession, path: str, tag: str, grinder: Grinder | None = Grinder(), src: str | None = None, prefixes: Sequence[str] = (), globs: Sequence[str] = (), quotes: bool = False, stream: bool = False, glob_filter: str | None = None, keep_name: bool = False) -> DataFrame:
    """Lines of files (plain, gzip or bzip2 by their names); as a stream new files are followed."""
    reader = spark.readStream if stream else spark.read
    if glob_filter:
        reader = reader.option("pathGlobFilter", glob_filter)
    lines = reader.text(path)
    lines = lines.withColumn("_name", F.col("_metadata.file_name")) if keep_name else lines
    found = to_entries(lines, clean_line(F.col("value"), quotes=quotes), tag, grinder, src, keep=["_name"] if keep_name else [])
    if keep_name:
        from ..entry import ev, ev_upsert

        found = found.withColumn("evs", ev_upsert(F.col("evs"), ev("file", F.col("_name")), "file")).drop("_name")
    return found.transform(ignore_lines(prefixes, globs)).filter("octet_length(data) > 0")


def split_stream(value: Column, delimiter: str, trim: bool = True) -> Column:
    """Messages of a byte stream that a pattern parts.

    Groups named ``prefix`` and ``suffix`` stay with the next and the previous
    message: both become look-arounds of one split.
    """
    m = re.fullmatch(r"(?P<s>\(\?P<suffix>.*?\))?(?P<d>.*?)(?P<p>\(\?P<prefix>.*\))?", delimiter, re.DOTALL)
    inner = lambda g, name: g[len(f"(?P<{name}>") : -1]
    pattern = (f"(?<={inner(m['s'], 'suffix')})" if m["s"] else "") + m["d"] + (f"(?={inner(m['p'], 'prefix')})" if m["p"] else "")
    parts = F.split(value, pattern, -1)
    parts = F.transform(parts, lambda p: F.trim(p)) if trim else parts
    return F.filter(parts, lambda p: F.length(p) > 0)


def syslog_stream(value: Column, drop_priority: bool = False) -> Column:
    """Messages of a syslog stream, each from its ``<priority>`` to the next."""
    parts = F.filter(F.transform(F.split(value, SYSLOG_START, -1), lambda p: F.trim(p)), lambda p: F.length(p) > 0)
    return F.transform(parts, lambda p: F.regexp_replace(p, r"^<\d{1,3}>", "")) if drop_priority else parts


def octet_frames(data: bytes, limit: int = 1 << 20) -> list[str]:
    """Messages of an octet-counted stream, ``LENGTH SP MESSAGE``; it ends at the first broken count."""
    out, at = [], 0
    while at < len(data):
        space = data.find(b" ", at, at + 11)
        head = data[at:space].strip() if space > 0 else b""
        if not head.isdigit() or int(head) > limit or space + 1 + int(head) > len(data):
            break
        out.append(data[space + 1 : space + 1 + int(head)].decode("utf-8", "replace"))
        at = space + 1 + int(head)
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def octet_stream(values: pd.Series) -> pd.Series:
    """Messages of octet-counted streams."""
    return values.map(lambda v: octet_frames(bytes(v)) if v is not None else [])


def json_objects(text: str, limit: int = 1 << 20, compact: bool = True) -> list[str]:
    """Objects that follow one another, compacted or as they stand; those beyond the limit are left out, and what is broken ends it."""
    out, at, decoder = [], 0, json.JSONDecoder()
    while True:
        while at < len(text) and text[at] in " \t\r\n,":
            at += 1
        if at >= len(text):
            return out
        try:
            found, end = decoder.raw_decode(text, at)
        except ValueError:
            return out
        if end - at <= limit:
            out.append(json.dumps(found, separators=(",", ":"), ensure_ascii=False) if compact else text[at:end])
        at = end


@F.pandas_udf(T.ArrayType(T.StringType()))
def json_stream(values: pd.Series) -> pd.Series:
    """Objects of JSON streams."""
    return values.map(lambda v: json_objects(v) if v is not None else [])


@F.pandas_udf(T.ArrayType(T.StringType()))
def json_slices(values: pd.Series) -> pd.Series:
    """Objects of JSON streams, as they stand."""
    return values.map(lambda v: json_objects(v, compact=False) if v is not None else [])


def tag_by_field(value: Column, path: str, tags: dict[str, str], default: str) -> Column:
    """The tag that a JSON field's value has, else the default."""
    field = json_text(value, split_quoted(path))
    table = F.create_map(*(F.lit(x) for k, v in tags.items() for x in (k, check_tag(v))))
    return F.coalesce(table[field], F.lit(check_tag(default)))


def exploded(df: DataFrame, messages: Column, tag: str | Column, grinder: Grinder | None = Grinder(), src: str | None = None) -> DataFrame:
    """An entry for each message of an array."""
    return to_entries(df.select(F.explode(messages).alias("_m")), F.col("_m"), tag, grinder, src)


def read_blobs(spark: SparkSession, path: str, tag: str, src: str | None = None) -> DataFrame:
    """A file is an entry: whole sessions."""
    files = spark.read.format("binaryFile").load(path)
    return entries(files, ts=F.col("modificationTime"), data=F.col("content"), tag=check_tag(tag), src=F.lit(to_bytes(src)) if src else None)


def sort_by_time(df: DataFrame) -> DataFrame:
    """Ranges of time, in order within: for files that compress and prune well."""
    return df.repartitionByRange("ts").sortWithinPartitions("ts", "nsec_rem")
