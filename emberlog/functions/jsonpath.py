"""JSON by path: built-in expressions, and slices of the bytes as they stand."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def split_quoted(text: str, by: str = ".") -> list[str]:
    """Parts of ``text`` between separators; double quotes protect them, a backslash protects the next character."""
    parts, now, quoted, at = [], [], False, 0
    while at < len(text):
        c = text[at]
        if c == "\\" and at + 1 < len(text):
            now.append(text[at + 1])
            at += 1
        elif c == '"':
            quoted = not quoted
        elif c == by and not quoted:
            parts.append("".join(now))
            now = []
        else:
            now.append(c)
        at += 1
    if quoted:
        raise ValueError(f"quote without end in {text!r}")
    return [*parts, "".join(now)]


def split_paths(text: str) -> list[list[str]]:
    """Comma-separated paths, each as its keys."""
    fields, now, quoted = [], [], False
    for k, c in enumerate(text):
        quoted ^= c == '"' and (k == 0 or text[k - 1] != "\\")
        if c == "," and not quoted:
            fields.append("".join(now))
            now = []
        else:
            now.append(c)
    return [split_quoted(f.strip()) for f in [*fields, "".join(now)] if f.strip()]


def spark_path(keys: list[str]) -> str:
    return "$" + "".join("['" + k.replace("'", "\\'") + "']" for k in keys)


def json_text(value: Column, keys: list[str]) -> Column:
    """The value by the JVM's JSON functions: scalars as text, others re-written as compact JSON."""
    return F.get_json_object(value, spark_path(keys))


_END = "emberlog-end"


def one_value(value: Column) -> Column:
    """Whether text is one JSON value and nothing more, by the JVM: put into an array, it has just one item before the mark that follows."""
    marked = F.concat(F.lit("["), value, F.lit(f',"{_END}"]'))
    return F.coalesce((F.get_json_object(marked, "$[1]") == _END) & ~value.contains(_END), F.lit(False))


_decoder = json.JSONDecoder()
_space = re.compile(r"[ \t\r\n]*")


def raw_slice(text: str, keys: list[str]) -> tuple[str, str] | None:
    """(slice, kind) of the value at the path, kind being string, number, literal, object or array.

    A string is given without its quotes and with its escapes as they stand.
    None if the path leads nowhere or the JSON on the way is broken.
    """
    try:
        at = _space.match(text, 0).end()
        for key in keys:
            at = _member(text, at, key)
            if at is None:
                return None
        _, end = _decoder.raw_decode(text, at)
    except (ValueError, IndexError, RecursionError):
        return None
    c = text[at]
    if c == '"':
        return text[at + 1 : end - 1], "string"
    return text[at:end], "object" if c == "{" else "array" if c == "[" else "number" if c in "-0123456789" else "literal"


def _member(text: str, at: int, key: str) -> int | None:
    """Where the value of ``key`` begins in the object at ``at``."""
    if text[at] != "{":
        return None
    at = _space.match(text, at + 1).end()
    while text[at] != "}":
        name, at = json.decoder.scanstring(text, at + 1, True)
        at = _space.match(text, at).end()
        if text[at] != ":":
            raise ValueError("no colon")
        at = _space.match(text, at + 1).end()
        if name == key:
            return at
        _, at = _decoder.raw_decode(text, at)
        at = _space.match(text, at).end()
        if text[at] == ",":
            at = _space.match(text, at + 1).end()
    return None


def raw_items(text: str) -> list[tuple[str, str]]:
    """(slice, kind) of each item of an array's text."""
    out, at = [], _space.match(text, 0).end()
    if text[at] != "[":
        raise ValueError("not an array")
    at = _space.match(text, at + 1).end()
    while text[at] != "]":
        _, end = _decoder.raw_decode(text, at)
        found = raw_slice(text[at:end], [])
        out.append(found)
        at = _space.match(text, end).end()
        if text[at] == ",":
            at = _space.match(text, at + 1).end()
        elif text[at] != "]":
            raise ValueError("no comma")
    return out


def quoted_slice(found: tuple[str, str]) -> str:
    return f'"{found[0]}"' if found[1] == "string" else found[0]


def is_json(text: str) -> bool:
    try:
        json.loads(text)
    except (ValueError, RecursionError):
        return False
    return True


def raw_values(value: Column, paths: list[list[str]]) -> Column:
    """An array of structs (text, kind), null where a path leads nowhere, from one pass over Arrow batches."""

    @F.pandas_udf("array<struct<text: string, kind: string>>")
    def take(values: pd.Series) -> pd.Series:
        return values.map(lambda t: None if t is None else [None if (s := raw_slice(t, p)) is None else {"text": s[0], "kind": s[1]} for p in paths])

    return take(value)
