"""Operators that set an entry's time from its payload."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..entry import text
from ..functions.jsonpath import json_text, split_quoted
from ..functions.regexes import Pattern
from ..functions.timeformats import Grinder


def _set(df: DataFrame, ts) -> DataFrame:
    df = df.withColumn("_ts", ts)
    return df.withColumns({"ts": F.coalesce("_ts", "ts"), "nsec_rem": F.when(F.col("_ts").isNull(), F.col("nsec_rem")).otherwise(0)}).drop("_ts")


def time_extract(grinder: Grinder = Grinder()) -> Callable[[DataFrame], DataFrame]:
    """Time := what the grinder finds in the payload, if anything."""
    return lambda df: _set(df, grinder.extract(text()))


def json_time(path: str, grinder: Grinder = Grinder()) -> Callable[[DataFrame], DataFrame]:
    """Time := what the grinder reads from a JSON value; left as it is otherwise."""
    return lambda df: _set(df, grinder.extract(json_text(text(), split_quoted(path))))


def regex_time(pattern: str, group: str, grinder: Grinder = Grinder()) -> Callable[[DataFrame], DataFrame]:
    """Time := what the grinder reads from a named group; entries that don't match pass."""
    value = Pattern(pattern).group(text(), group)
    return lambda df: _set(df, grinder.extract(value))


def time_window(grinder: Grinder, clamp: bool = False) -> Callable[[DataFrame], DataFrame]:
    """Drop entries outside the grinder's window, or set them to now."""
    if clamp:
        return lambda df: df.withColumn("ts", grinder.clamp(F.col("ts")))
    return lambda df: df.filter(grinder._valid(F.col("ts")).isNotNull())
