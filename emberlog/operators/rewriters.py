"""Rewriters: payloads, attributes, or several entries for one."""

from __future__ import annotations

import gzip
import os
import socket
import zlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..entry import NO_EVS, check_tag, ev, ev_upsert, text
from ..functions.jsonpath import is_json, json_text, one_value, quoted_slice, raw_items, raw_slice, split_paths, split_quoted
from ..functions.net import ipv4_text
from ..functions.regexes import Pattern
from ..functions.templates import fill


def gunzip(raw: bytes | None) -> bytes | None:
    """The plain bytes of a gzip stream; null if it is broken."""
    try:
        return None if raw is None else gzip.decompress(raw)
    except (OSError, EOFError, zlib.error):
        return None


@F.pandas_udf(T.BinaryType())
def _gunzip(raw: pd.Series) -> pd.Series:
    return raw.map(gunzip)


def is_gzip(data: Column) -> Column:
    return (F.octet_length(data) > 2) & (F.substring(data, 1, 2) == F.unhex(F.lit("1F8B")))


def gunzip_entries(passthrough: bool = False) -> Callable[[DataFrame], DataFrame]:
    """Unpack gzip payloads; broken ones go, and others too unless ``passthrough``.  Only gzip payloads meet Python."""

    def run(df: DataFrame) -> DataFrame:
        packed = is_gzip(F.col("data"))
        out = F.when(packed, _gunzip(F.when(packed, F.col("data"))))
        out = out if not passthrough else F.when(packed, out).otherwise(F.col("data"))
        return df.withColumn("_out", out).filter("_out IS NOT NULL").withColumn("data", F.col("_out")).drop("_out")

    return run


@dataclass(frozen=True)
class JsonExtract:
    """Payload := one value's bytes, or an object of the values found, in the order named.

    ``strict`` needs all keys and needs ``drop_misses``.  With ``drop_misses``
    invalid JSON goes; valid JSON without any of the keys stays as it is unless
    ``strict``.
    """

    extractions: str
    force_object: bool = False
    strict: bool = False
    drop_misses: bool = False

    def __post_init__(self) -> None:
        if not split_paths(self.extractions):
            raise ValueError("no extractions")
        if self.strict and not self.drop_misses:
            raise ValueError("strict needs drop_misses")
        names = [p[-1] for p in split_paths(self.extractions)]
        if len(set(names)) < len(names):
            raise ValueError("names repeat")

    def extract(self, value: str | None) -> str | None:
        """The new payload; null to drop."""
        return None if value is None else self._extract(value, split_paths(self.extractions))

    def _extract(self, value: str, paths: list[list[str]]) -> str | None:
        if self.drop_misses and not is_json(value):
            return None
        found = [(p[-1], s) for p in paths if (s := raw_slice(value, p)) is not None]
        if self.strict and len(found) < len(paths):
            return None
        if not found:
            return value
        if len(paths) == 1 and not self.force_object:
            return found[0][1][0]
        return "{" + ",".join(f'"{name}":{quoted_slice(s)}' for name, s in found) + "}"

    def __call__(self, df: DataFrame) -> DataFrame:
        paths = split_paths(self.extractions)

        @F.pandas_udf("string")
        def run(values: pd.Series) -> pd.Series:
            return values.map(lambda v: self._extract(v, paths), na_action="ignore")

        if len(paths) > 1 or self.force_object:
            out = df.withColumn("_out", run(text()))
        else:
            # whole numbers, and words without escapes, are the same bytes by the JVM's function; the rest meets Python
            found = json_text(text(), paths[0])
            same = F.coalesce(found.rlike(SAME_BYTES) & ~text().contains("\\"), F.lit(False))
            same = same & one_value(text()) if self.drop_misses else same
            out = df.withColumn("_fast", F.when(same, found))
            out = out.withColumn("_out", F.coalesce("_fast", run(F.when(F.col("_fast").isNull(), text())))).drop("_fast")
        return out.filter("_out IS NOT NULL").withColumn("data", F.col("_out").cast("binary")).drop("_out")


#: Values that the JVM's JSON functions give as they stand: whole numbers, and text that is no other number, object, array or null.
SAME_BYTES = r'^(?:-?(?:0|[1-9]\d{0,17})|[A-Za-z_/][^"\\]*)$'
#: Payloads of which an array's items may not come back as they stand: escapes, blanks, fractions, nulls, text that begins like an array.
OTHER_BYTES = r'[\\\s]|\d[.eE]|null|"\['


def json_extract_scalar(path: str) -> Callable[[DataFrame], DataFrame]:
    """Payload := one JSON scalar by the JVM's functions, unchanged where there is none: the fast way when bytes need not stay."""
    keys = split_quoted(path)
    return lambda df: df.withColumn("data", F.coalesce(json_text(text(), keys).cast("binary"), F.col("data")))


@dataclass(frozen=True)
class JsonArraySplit:
    """One entry for each item of the array at ``extraction`` (empty: the payload itself)."""

    extraction: str = ""
    force_object: bool = False
    additional: str = ""
    drop_misses: bool = False

    def __post_init__(self) -> None:
        if not self.extraction and self.additional:
            raise ValueError("additional fields need an extraction")

    def split(self, value: str | None) -> list[str] | None:
        """New payloads; null to keep the entry as it is."""
        return self._split(value, split_quoted(self.extraction) if self.extraction else [], split_paths(self.additional))

    def _split(self, value: str | None, keys: list[str], additional: list[list[str]]) -> list[str] | None:
        if value is None:
            return [] if self.drop_misses else None
        found = raw_slice(value, keys)
        if found is None or found[1] != "array":
            missing = found is None and is_json(value)
            return [] if self.drop_misses or not missing else None
        try:
            items = [i for i in raw_items(found[0]) if i is not None and i[0] != ""]
        except (ValueError, IndexError):
            return []
        extra = [f'"{p[-1]}":{quoted_slice(s)}' for p in additional if (s := raw_slice(value, p)) is not None]
        if not self.force_object and not self.additional:
            return [i[0] for i in items]
        name = keys[-1] if keys else "value"
        return ["{" + ",".join([f'"{name}":{quoted_slice(i)}', *extra]) + "}" for i in items]

    def __call__(self, df: DataFrame) -> DataFrame:
        keys, additional = split_quoted(self.extraction) if self.extraction else [], split_paths(self.additional)
        kept = F.array(F.lit(None).cast("string"))

        @F.pandas_udf("array<string>")
        def run(values: pd.Series, here: pd.Series) -> pd.Series:
            return pd.Series([self._split(v, keys, additional) if own else None for v, own in zip(values, here, strict=True)], dtype=object)

        parts = df
        if not additional and not self.force_object:
            # items of compact JSON are the same bytes by the JVM's functions; the rest meets Python
            found = json_text(text(), keys) if keys else text()
            items = F.filter(F.from_json(found, "array<string>"), lambda i: i != "")
            same = found.startswith("[") & ~text().rlike(OTHER_BYTES) & one_value(text())
            parts = parts.withColumn("_fast", F.when(same, items))
        else:
            parts = parts.withColumn("_fast", F.lit(None).cast("array<string>"))
        slow = F.col("_fast").isNull()
        parts = parts.withColumn("_slow", run(F.when(slow, text()), slow)).withColumn("_parts", F.coalesce("_fast", "_slow", kept)).drop("_fast", "_slow")
        return parts.withColumn("_part", F.explode("_parts")).withColumn("data", F.coalesce(F.col("_part").cast("binary"), F.col("data"))).drop("_parts", "_part")


@dataclass(frozen=True)
class RegexExtract:
    """On a match payload := template over named groups, ``_SRC_``, ``_DATA_`` and ``_TS_``; ``attach`` keeps groups as attributes."""

    pattern: str
    template: str
    attach: Sequence[str] = ()
    drop_misses: bool = False

    def __call__(self, df: DataFrame) -> DataFrame:
        p = Pattern(self.pattern)
        if not p.names:
            raise ValueError("the pattern names no group")
        values = {name: p.group(text(), name) for name in p.names}
        values |= {"_SRC_": ipv4_text(F.col("src")), "_DATA_": text(), "_TS_": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")}
        hit = p.matches(text())
        df = df.filter(hit) if self.drop_misses else df
        evs = F.col("evs")
        for name in self.attach:
            value = p.group(text(), name)
            evs = F.when(hit & (value != ""), ev_upsert(evs, ev(name, value), name)).otherwise(evs)
        new = F.when(hit, fill(self.template, values).cast("binary")).otherwise(F.col("data"))
        return df.withColumns({"data": new, "evs": evs})


def regex_replace(pattern: str, replacement: str, case_sensitive: bool = False) -> Callable[[DataFrame], DataFrame]:
    """Payload := every match replaced, ignoring case unless told; attributes are lost."""
    new = Pattern(pattern, ignore_case=not case_sensitive).replace_all(text(), replacement)
    return lambda df: df.withColumns({"data": new.cast("binary"), "evs": F.expr(NO_EVS)})


@dataclass(frozen=True)
class Attach:
    """The same attributes for every entry; ``$NOW``, ``$HOSTNAME`` and environment variables are filled in, ``$UUID`` is refused."""

    values: Sequence[tuple[str, str]]
    now: Column | None = None

    def __post_init__(self) -> None:
        names = [n for n, _ in self.values]
        if not names or len(set(names)) < len(names) or any(not n or not v for n, v in self.values):
            raise ValueError("names and values must be there, and names differ")
        if any(v == "$UUID" for _, v in self.values):
            raise ValueError("$UUID is not supported here")

    def __call__(self, df: DataFrame) -> DataFrame:
        evs = F.col("evs")
        for name, value in self.values:
            if value == "$NOW":
                one = ev(name, self.now if self.now is not None else F.current_timestamp(), "timestamp")
            elif value == "$HOSTNAME":
                one = ev(name, F.lit(socket.gethostname()))
            elif value.startswith("$"):
                one = ev(name, F.lit(os.environ.get(value[1:], "")))
            else:
                one = ev(name, F.lit(value))
            evs = ev_upsert(evs, one, name)
        return df.withColumn("evs", evs)


def table_to_entries(df: DataFrame, tag: str, ts: str = "ts") -> DataFrame:
    """Rows of a table as entries: every other column is an attribute of bytes."""
    from ..entry import entries

    names = [c for c in df.columns if c != ts]
    evs = F.array(*(ev(c, F.col(c), "bytes") for c in names))
    return entries(df, ts=F.col(ts), data=F.concat_ws(",", *(F.col(c).cast("string") for c in names)), tag=check_tag(tag), evs=evs)
