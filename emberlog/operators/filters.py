"""Filters: rows go or stay, nothing else changes."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..entry import ev_get, text
from ..functions.jsonpath import json_text, raw_values, split_quoted
from ..functions.net import in_network, ipv4_number
from ..functions.regexes import Pattern, glob_to_regex, is_glob

Transform = Callable[[DataFrame], DataFrame]
#: Values of a membership test that go into the plan; more become a table and a join.
INLINE_VALUES = 1000


def drop(df: DataFrame) -> DataFrame:
    """Nothing passes."""
    return df.filter(F.lit(False))


def regex_drop(pattern: str, invert: bool = False, ignore_case: bool = False) -> Transform:
    """Drop entries that match, or with ``invert`` those that don't."""
    hit = Pattern(pattern, ignore_case).matches(text())
    return lambda df: df.filter(hit if invert else ~hit)


def tag_selector(tags: str | Sequence[str], column: str = "tag") -> Column:
    """A comma-separated list of tags, of which some may be globs."""
    names = [t.strip() for t in (tags.split(",") if isinstance(tags, str) else tags) if t.strip()]
    if not names:
        raise ValueError("no tags")
    plain, globs = [t for t in names if not any(c in "?*[]{}!" for c in t)], [t for t in names if any(c in "?*[]{}!" for c in t)]
    tests = [F.col(column).isin(plain)] if plain else []
    return reduce(lambda a, b: a | b, tests + [F.col(column).rlike(glob_to_regex(g)) for g in globs])


def time_range(start: str | Column, end: str | Column, column: str = "ts") -> Column:
    """start <= ts < end, on the bare column so that scans use it."""
    start, end = (F.lit(x).cast("timestamp") if isinstance(x, str) else x for x in (start, end))
    return (F.col(column) >= start) & (F.col(column) < end)


@dataclass(frozen=True)
class FieldFilter:
    """A structured filter: compare a JSON field, an attribute (``path`` None) or a captured group with a value."""

    op: str
    value: str
    path: str | None = None
    name: str | None = None
    pattern: str | None = None

    def column(self) -> Column:
        if self.pattern:
            left = Pattern(self.pattern).group(text(), self.name or 0)
        elif self.path:
            left = json_text(text(), split_quoted(self.path))
        elif self.name:
            left = ev_get(self.name)
        else:
            left = text()
        if self.op in ("~", "!~"):
            hit = Pattern(self.value).matches(left)
            return hit if self.op == "~" else ~hit
        as_number = left.try_cast("double")
        try:
            right = float(self.value)
            a, b = as_number, F.lit(right)
        except ValueError:
            a, b = left, F.lit(self.value)
        tests = {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}
        if self.op not in tests:
            raise ValueError(f"no operator {self.op!r}")
        return F.coalesce(tests[self.op], F.lit(self.op == "!="))


def field_filters(filters: Sequence[FieldFilter]) -> Transform:
    return lambda df: reduce(lambda d, f: d.filter(f.column()), filters, df)


@dataclass(frozen=True)
class JsonFilter:
    """Membership of JSON values in sets: ``fields`` maps paths to values.

    All (``and``) or any (``or``) of the fields must be in their sets to match;
    matches pass or are dropped.  A missing value is no match; no fields pass all.
    ``raw`` compares slices as they stand instead of the JVM's text.
    """

    fields: dict[str, Sequence[str]] = field(default_factory=dict)
    logic: str = "and"
    action: str = "pass"
    raw: bool = False

    def __post_init__(self) -> None:
        if self.logic not in ("and", "or") or self.action not in ("pass", "drop"):
            raise ValueError("logic is and|or, action is pass|drop")

    def __call__(self, df: DataFrame) -> DataFrame:
        if not self.fields:
            return df
        tests, used = [], []
        if self.raw:
            df = df.withColumn("_raw", raw_values(text(), [split_quoted(p) for p in self.fields]))
            used.append("_raw")
        for k, (path, values) in enumerate(self.fields.items()):
            value = F.get("_raw", F.lit(k))["text"] if self.raw else json_text(text(), split_quoted(path))
            values = list(dict.fromkeys(values))
            if len(values) <= INLINE_VALUES:
                tests.append(F.coalesce(value.isin(values), F.lit(False)))
            else:  # the set is a table: Spark broadcasts it or not by its size
                table = df.sparkSession.createDataFrame([(v,) for v in values], "v string").select(F.col("v").alias(f"_v{k}"))
                df = df.withColumn(f"_k{k}", value).join(table, F.col(f"_k{k}") == F.col(f"_v{k}"), "left")
                tests.append(F.col(f"_v{k}").isNotNull())
                used += [f"_k{k}", f"_v{k}"]
        match = reduce((lambda a, b: a & b) if self.logic == "and" else (lambda a, b: a | b), tests)
        return df.filter(match if self.action == "pass" else ~match).drop(*used)


def read_set(path: str) -> list[str]:
    """Lines of a set's file."""
    with open(path, encoding="utf-8") as f:
        return [line.rstrip("\r\n") for line in f if line.strip()]


def source_filter(networks: Sequence[str]) -> Column:
    """Whether the source lies in any of the networks."""
    return reduce(lambda a, b: a | b, (in_network(F.col("src"), n) for n in networks))


def ignore_lines(prefixes: Sequence[str] = (), globs: Sequence[str] = ()) -> Transform:
    """Drop lines with a prefix, or that a glob describes."""
    tests = [F.startswith(text(), F.lit(p)) for p in prefixes] + [text().rlike(glob_to_regex(g)) for g in globs]
    return lambda df: df.filter(~reduce(lambda a, b: a | b, tests)) if tests else df


def geofence(lat: Column, lon: Column, south: float, west: float, north: float, east: float) -> Column:
    """Whether a point lies inside; a fence of zeros is none, and west > east crosses the antimeridian."""
    if not (-90 <= south <= north <= 90 and -180 <= west <= 180 and -180 <= east <= 180):
        raise ValueError("fence out of bounds")
    if south == west == north == east == 0:
        return F.lit(True)
    along = lon.between(west, east) if west <= east else (lon >= west) | (lon <= east)
    return lat.between(south, north) & along


def ip_set(df: DataFrame, members: DataFrame, src: Column | None = None, exists: bool = True) -> DataFrame:
    """Entries whose IPv4 source is (not) among ``members`` (column ``ip``, a number); 255.255.0.0/16 is never a member."""
    key = src if src is not None else ipv4_number(F.col("src"))
    known = members.filter(F.shiftright("ip", 16) != 0xFFFF).select(F.col("ip").cast("long").alias("_ip")).distinct()
    return df.withColumn("_k", key).join(known, F.col("_k") == F.col("_ip"), "left_semi" if exists else "left_anti").drop("_k")


def ip_bitmaps(members: DataFrame) -> DataFrame:
    """A set as bitmaps: one per 32768 addresses, (bucket, bits)."""
    return members.select(F.col("ip").cast("long").alias("ip")).groupBy(F.bitmap_bucket_number("ip").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("ip")).alias("bits"))


@dataclass(frozen=True)
class Access:
    """Who sees which tags: a user's own grants or any group's, exact names or globs; administrators see all."""

    admin: bool = False
    grants: Sequence[str] = ()
    group_grants: Sequence[Sequence[str]] = ()

    def all_grants(self) -> list[str]:
        return list(dict.fromkeys([*self.grants, *(g for own in self.group_grants for g in own)]))

    def column(self, column: str = "tag") -> Column:
        if self.admin:
            return F.lit(True)
        grants = self.all_grants()
        return tag_selector(grants, column) if grants else F.lit(False)

    def allows(self, tag: str) -> bool:
        import re

        return self.admin or any(re.match(glob_to_regex(g), tag) if is_glob(g) else g == tag for g in self.all_grants())

    def overlaps(self, tags: Sequence[str]) -> list[str]:
        """Of ``tags``, those allowed, in their order."""
        return [t for t in tags if self.allows(t)]


def entry_range(df: DataFrame, first: int, last: int, keys: Sequence[Column | str]) -> DataFrame:
    """Rows first (included) to last (excluded) in the order of ``keys``: offset and limit, no global window."""
    if not 0 <= first <= last:
        raise ValueError("bad range")
    return df.orderBy(*keys).offset(first).limit(last - first)


def preview(df: DataFrame, n: int = 1000) -> DataFrame:
    """Any ``n`` entries."""
    return df.limit(n)
