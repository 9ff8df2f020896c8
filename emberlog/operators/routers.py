"""Routers: entries get another tag, or go."""

from __future__ import annotations

import csv
import io
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..entry import check_tag, remap_tag, text
from ..functions.jsonpath import json_text, raw_values, split_quoted
from ..functions.net import cidr, in_network
from ..functions.regexes import Pattern
from ..functions.templates import fill, template_names

#: Routes that go into the plan as one map; more are a join.
INLINE_ROUTES = 500
_DROP = ""


def parse_route(route: str) -> tuple[str, str]:
    """(value, tag): the tag is what follows the last colon; an empty one drops."""
    value, colon, tag = route.rpartition(":")
    if not colon or not value:
        raise ValueError(f"route {route!r} is not value:tag")
    return value, check_tag(tag) if tag.strip() else _DROP


def _routed(df: DataFrame, value: Column, routes: dict[str, str], drop_misses: bool, missing: Column | None = None) -> DataFrame:
    """Retag by value.  ``missing`` marks entries without a value; what has no route is dropped iff ``drop_misses``."""
    if len(routes) <= INLINE_ROUTES:
        to = F.create_map(*(F.lit(x) for kv in routes.items() for x in kv))[value] if routes else F.lit(None).cast("string")
        df = df.withColumn("_to", to)
    else:
        table = df.sparkSession.createDataFrame(list(routes.items()), "_value string, _to string")
        df = df.withColumn("_key", value).join(table, F.col("_key") == F.col("_value"), "left").drop("_key", "_value")
    keep = F.col("_to") != _DROP
    keep = F.coalesce(keep, F.lit(not drop_misses))
    return df.filter(keep).withColumn("tag", F.coalesce("_to", "tag")).drop("_to")


@dataclass(frozen=True)
class JsonRouter:
    """By the JSON value at ``key``; a value has one route only."""

    key: str
    routes: Sequence[str]
    drop_misses: bool = False
    raw: bool = False

    def table(self) -> dict[str, str]:
        pairs = [parse_route(r) for r in self.routes]
        if not pairs or len({v for v, _ in pairs}) < len(pairs):
            raise ValueError("routes are missing or repeat a value")
        return dict(pairs)

    def __call__(self, df: DataFrame) -> DataFrame:
        keys = split_quoted(self.key)
        value = F.get(raw_values(text(), [keys]), F.lit(0))["text"] if self.raw else json_text(text(), keys)
        return _routed(df, value, self.table(), self.drop_misses)


@dataclass(frozen=True)
class RegexRouter:
    """By a named group; of routes for one value the last counts, and a tag counts before a drop."""

    pattern: str
    group: str
    routes: Sequence[str]
    drop_misses: bool = False

    def __call__(self, df: DataFrame) -> DataFrame:
        table: dict[str, str] = {}
        for value, tag in map(parse_route, self.routes):
            if tag != _DROP or not table.get(value):
                table[value] = tag
        return _routed(df, Pattern(self.pattern).group(text(), self.group), table, self.drop_misses)


def csv_field(value: Column, index: int) -> Column:
    """Field ``index`` of the first record, leading blanks trimmed; null where the quoting is broken or the record is short.

    Records without quotes are split by the JVM; the others go to an Arrow UDF.
    """

    @F.pandas_udf("string")
    def quoted(values: pd.Series) -> pd.Series:
        return values.map(lambda t: strict_csv_field(t, index))

    plain = F.split(F.regexp_extract(value, r"^[\r\n]*([^\r\n]*)", 1), ",", -1)
    return F.when(F.contains(value, F.lit('"')), quoted(F.when(F.contains(value, F.lit('"')), value))).otherwise(F.ltrim(F.get(plain, F.lit(index))))


def strict_csv_field(line: str | None, index: int) -> str | None:
    if line is None:
        return None
    first = line.lstrip("\r\n")
    at, quoted = 0, False
    while at < len(first):  # a quote may only open a field or close it
        c = first[at]
        if quoted:
            if c == '"':
                if first[at + 1 : at + 2] == '"':
                    at += 1
                elif first[at + 1 : at + 2] not in ("", ",", "\n", "\r"):
                    return None
                else:
                    quoted = False
        elif c in "\r\n":
            break
        elif c == '"':
            if first[:at].rstrip(" \t")[-1:] not in ("", ","):
                return None
            quoted = True
        at += 1
    if quoted:
        return None
    try:
        record = next(csv.reader(io.StringIO(first[:at], newline=""), skipinitialspace=True, strict=True), [])
    except csv.Error:
        return None
    return record[index] if index < len(record) else None


@dataclass(frozen=True)
class CsvRouter:
    """By a field of the first CSV record."""

    column: int
    routes: Sequence[str]
    drop_misses: bool = False

    def __call__(self, df: DataFrame) -> DataFrame:
        return _routed(df, csv_field(text(), self.column), dict(map(parse_route, self.routes)), self.drop_misses)


@dataclass(frozen=True)
class SourceRouter:
    """By the source's address: of the networks that hold it, the most specific counts.

    Up to ``INLINE_ROUTES`` networks are comparisons in the plan, most specific
    first; more are a range join on the address.
    """

    routes: Sequence[str]
    drop_misses: bool = False

    def table(self) -> list[tuple[bytes, bytes, int, str]]:
        found: dict[tuple[bytes, bytes, int], str] = {}
        for network, tag in map(parse_route, self.routes):
            found[cidr(network.strip("[]"))] = tag
        if not found:
            raise ValueError("no routes")
        return sorted(((*k, t) for k, t in found.items()), key=lambda r: (-r[2], r[0]))

    def __call__(self, df: DataFrame) -> DataFrame:
        table = self.table()
        if len(table) <= INLINE_ROUTES:
            to = F.coalesce(*(F.when((F.col("src") >= F.lit(a)) & (F.col("src") <= F.lit(b)), F.lit(tag)) for a, b, _, tag in table))
            df = df.withColumn("_to", to)
        else:  # an address meets each prefix length in use once: an equi-join on (length, network), no range join
            networks = df.sparkSession.createDataFrame([(n, bytes(a), tag) for a, _, n, tag in table], "_n int, _net binary, _to string")
            lengths = sorted({n for _, _, n, _ in table}, reverse=True)
            sources = df.select("src").filter("src IS NOT NULL").distinct()
            probes = sources.select("src", F.explode(F.array(*(F.struct(F.lit(n).alias("n"), _masked(F.col("src"), n).alias("net")) for n in lengths))).alias("p"))
            best = probes.join(networks, (F.col("p.n") == F.col("_n")) & (F.col("p.net") == F.col("_net"))).groupBy(F.col("src").alias("_src")).agg(F.max_by("_to", "_n").alias("_to"))
            df = df.join(best, df["src"] == best["_src"], "left").drop("_src")
        keep = F.coalesce(F.col("_to") != _DROP, F.lit(not self.drop_misses))
        return df.filter(keep).withColumn("tag", F.coalesce("_to", "tag")).drop("_to")


def _masked(src: Column, length: int) -> Column:
    """The first ``length`` of 128 bits, others zero."""
    whole, bits = divmod(length, 8)
    parts = [F.substring(src, 1, whole)] if whole else []
    if bits:
        byte = F.conv(F.hex(F.substring(src, whole + 1, 1)), 16, 10).cast("int").bitwiseAND(0xFF << (8 - bits) & 0xFF)
        parts.append(F.unhex(F.lpad(F.hex(byte.cast("long")), 2, "0")))
    rest = 16 - whole - bool(bits)
    return F.concat(*parts, F.lit(bytes(rest))) if rest else F.concat(*parts)


@dataclass(frozen=True)
class TagRouter:
    """``from:to[:network]``: from one tag to another, for some sources; the last rule for a tag counts, nothing is dropped."""

    rules: Sequence[str]

    def __call__(self, df: DataFrame) -> DataFrame:
        table: dict[str, Column] = {}
        for rule in self.rules:
            parts = rule.split(":")
            if len(parts) not in (2, 3):
                raise ValueError(f"rule {rule!r} is not from:to[:network]")
            source, to = check_tag(parts[0]), F.lit(check_tag(parts[1]))
            table[source] = F.when(in_network(F.col("src"), parts[2]), to) if len(parts) == 3 else to
        if not table:
            raise ValueError("no rules")
        return df.withColumn("tag", F.coalesce(*(F.when(F.col("tag") == source, to) for source, to in table.items()), F.col("tag")))


#: Parts of the two syslog forms, by name.
_RFC5424 = Pattern(r"^\s*<(?P<Priority>\d{1,3})>(?P<Version>\d{1,2}) (?P<Timestamp>\S+) (?P<Hostname>\S+) (?P<Appname>\S+) (?P<ProcID>\S+) (?P<MsgID>\S+) (?P<StructuredData>-|(?:\[(?:[^\]\\]|\\.)*\])+)(?: (?P<Message>(?s:.*)))?$")
_RFC3164 = Pattern(r"^\s*<(?P<Priority>\d{1,3})>(?P<Timestamp>[A-Z][a-z]{2}\s+\d{1,2} \d\d:\d\d:\d\d) (?P<Hostname>\S+) (?P<Appname>[^:\[\s]+)(?:\[(?P<ProcID>[^\]]*)\])?:?\s?(?P<Message>(?s:.*))$")
SYSLOG_PARTS = ("Priority", "Facility", "Severity", "Version", "Timestamp", "Hostname", "Appname", "ProcID", "MsgID", "StructuredData", "Message")


def syslog_parts(value: Column) -> dict[str, Column]:
    """Each part of a syslog message; empty for a dash, null if the value is no syslog."""
    new, old = _RFC5424.matches(value), _RFC3164.matches(value)
    out = {}
    for name in SYSLOG_PARTS:
        if name in ("Facility", "Severity"):
            continue
        a = _RFC5424.group(value, name)
        b = _RFC3164.group(value, name) if name in _RFC3164.names else F.lit("")
        found = F.when(new, a).when(old, b)
        out[name] = F.when(found == "-", "").otherwise(found)
    number = out["Priority"].cast("int")
    out["Facility"], out["Severity"] = F.shiftright(number, 3).cast("string"), number.bitwiseAND(7).cast("string")
    return out


_MARK = "\x01"


def with_syslog_parts(df: DataFrame, value: Column, name: str = "_s") -> DataFrame:
    """``df`` with a struct of the parts (see :func:`syslog_parts`), each message matched once a form.

    A match is replaced by its groups between marks, and split there; values that
    hold the mark themselves go by single groups.
    """

    def marked(p: Pattern) -> Column:
        return F.regexp_replace(value, p.java, "".join(f"{_MARK}${p.names[n]}" for n in SYSLOG_PARTS if n in p.names))

    plain = ~F.coalesce(value.contains(_MARK), F.lit(False))
    df = df.withColumn("_new", F.when(plain, marked(_RFC5424)))
    df = df.withColumn("_old", F.when(plain & ~F.startswith("_new", F.lit(_MARK)), marked(_RFC3164)))
    slow = syslog_parts(value)

    def struct_of(column: str, p: Pattern) -> Column:
        names = [n for n in SYSLOG_PARTS if n in p.names]
        parts = F.split(F.col(column), _MARK, len(names) + 1)
        got = {n: F.get(parts, F.lit(k)) for k, n in enumerate(names, 1)}
        # a line end after a message without text is none of its parts
        got["Message"] = F.when(got["Message"] == "\n", slow["Message"]).otherwise(got["Message"])
        got = {n: F.when(c == "-", "").otherwise(c) for n, c in got.items()} | {n: F.lit("") for n in ("Version", "MsgID", "StructuredData") if n not in got}
        number = got["Priority"].cast("int")
        got |= {"Facility": F.shiftright(number, 3).cast("string"), "Severity": number.bitwiseAND(7).cast("string")}
        return F.struct(*(got[n].alias(n) for n in SYSLOG_PARTS))

    by_group = F.struct(*(slow[n].alias(n) for n in SYSLOG_PARTS))
    found = F.when(F.startswith("_new", F.lit(_MARK)), struct_of("_new", _RFC5424)).when(F.startswith("_old", F.lit(_MARK)), struct_of("_old", _RFC3164)).when(~plain & slow["Priority"].isNotNull(), by_group)
    return df.withColumn(name, found).drop("_new", "_old")


@dataclass(frozen=True)
class SyslogRouter:
    """The tag is a template over the message's parts, forbidden characters replaced."""

    template: str
    drop_misses: bool = False

    def __post_init__(self) -> None:
        if not template_names(self.template) or set(template_names(self.template)) - set(SYSLOG_PARTS):
            raise ValueError("the template names no part, or an unknown one")

    def __call__(self, df: DataFrame) -> DataFrame:
        df = with_syslog_parts(df, text())
        df = df.withColumn("_tag", F.when(F.col("_s").isNotNull(), F.nullif(remap_tag(fill(self.template, {n: F.col(f"_s.{n}") for n in SYSLOG_PARTS})), F.lit(""))))
        df = df.filter("_tag IS NOT NULL") if self.drop_misses else df
        return df.withColumn("tag", F.coalesce("_tag", "tag")).drop("_s", "_tag")
