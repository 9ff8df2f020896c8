"""Timestamps in text: formats, search, and custom layouts."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

_MONTH = "[JFMASOND][anebriyunlgpctov]+"
#: Fixed values: (name, pattern, parse pattern) in the order they are tried.
FORMATS = (
    ("AnsiC", _MONTH + r"\s+\d{1,2}\s+\d\d:\d\d:\d\d\s+\d{4}", "MMM d HH:mm:ss yyyy"),
    ("Unix", _MONTH + r"\s+\d{1,2}\s+\d\d:\d\d:\d\d\s+[A-Z]{3}\s+\d{4}", "MMM d HH:mm:ss zzz yyyy"),
    ("Ruby", _MONTH + r"\s+\d{1,2}\s+\d\d:\d\d:\d\d\s+[\-|\+]\d{4}\s+\d{4}", "MMM d HH:mm:ss xx yyyy"),
    ("RFC822", r"\d{2}\s" + _MONTH + r"\s+\d{2}\s\d\d:\d\d\s[A-Z]{3}", "dd MMM yy HH:mm zzz"),
    ("RFC822Z", r"\d{2}\s" + _MONTH + r"\s+\d{2}\s\d\d:\d\d\s[\-|\+]\d{4}", "dd MMM yy HH:mm xx"),
    ("RFC850", r"\d{2}\-" + _MONTH + r"\-\d{2}\s\d\d:\d\d:\d\d\s[A-Z]{3}", "dd-MMM-yy HH:mm:ss zzz"),
    ("RFC1123", r"\d{2} " + _MONTH + r" \d{4}\s\d\d:\d\d:\d\d\s[A-Z]{3}", "dd MMM yyyy HH:mm:ss zzz"),
    ("RFC1123Z", r"\d{2} " + _MONTH + r" \d{4}\s\d\d:\d\d:\d\d\s[\-|\+]\d{4}", "dd MMM yyyy HH:mm:ss xx"),
    ("RFC3339", r"\d{4}-\d{2}-\d{2}T\d\d:\d\d:\d\d[Z\-+]", "yyyy-MM-dd'T'HH:mm:ssXXX"),
    ("RFC3339Nano", r"\d{4}-\d{2}-\d{2}T\d\d:\d\d:\d\d.\d+[Z\-+]", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSSSSXXX"),
    ("Apache", r"\d{1,2}/" + _MONTH + r"/\d{4}:\d\d:\d\d:\d\d\s[\-|\+]\d{4}", "d/MMM/yyyy:HH:mm:ss xx"),
    ("ApacheNoTz", r"\d{1,2}/" + _MONTH + r"/\d{4}:\d\d:\d\d:\d\d", "d/MMM/yyyy:HH:mm:ss"),
    ("Syslog", _MONTH + r"\s+\d+\s+\d\d:\d\d:\d\d", "MMM d HH:mm:ss"),
    ("SyslogFile", r"\d{4}-\d{2}-\d{2}T\d\d:\d\d:\d+\.?\d*[-+]\d\d:\d\d", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS]XXX"),
    ("SyslogFileTZ", r"\d{4}-\d{2}-\d{2}T\d\d:\d\d:\d+\.?\d*[-+]\d\d\d\d", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS]xx"),
    ("DPKG", r"\d\d\d\d-\d\d-\d\d\s\d\d:\d\d:\d\d", "yyyy-MM-dd HH:mm:ss"),
    ("NGINX", r"\d{4}\/\d{2}\/\d{2}\s+\d{2}:\d{2}:\d{2}", "yyyy/MM/dd HH:mm:ss"),
    ("UnixMilli", r"\A\s*(\d{9,10}\.\d+)(?:\D|$)", "seconds.fraction"),
    ("ZonelessRFC3339", r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.*\d*", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS]"),
    ("SyslogVariant", _MONTH + r"\s+\d{2}\s+\d\d\d\d\s+\d\d:\d\d:\d\d", "MMM d yyyy HH:mm:ss"),
    ("UnpaddedDateTime", r"\d\d\d\d-\d+-\d+\s+\d+:\d\d:\d\d", "yyyy-M-d HH:mm:ss"),
    ("UnpaddedMilliDateTime", r"\d\d\d\d-\d+-\d+\s+\d+:\d\d:\d\d\.\d{1,9}", "yyyy-M-d HH:mm:ss.SSSSSSSSS"),
    ("UK", r"\d\d/\d\d/\d\d\d\d\s\d\d\:\d\d\:\d\d,\d{1,5}", "dd/MM/yyyy HH:mm:ss,SSSSS"),
    ("MonthDayYear", r"\d{1,2}\-\d{1,2}\-\d{4}\s+\d{1,2}\:\d{2}\:\d{2}(\.\d{1,6})?", "M-d-yyyy H:mm:ss[.SSSSSSSSS]"),
    ("Bind", r"\d{2}\-(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)\-\d{4} \d{2}:\d{2}:\d{2}\.\d{1,3}", "dd-MMM-yyyy HH:mm:ss.SSS"),
    ("LDAP", r"\A\s*(\d{18})(?:\D|$)", "100ns since 1601"),
    ("UnixSeconds", r"\A\s*(\d{9,10})(?:\D|$)", "seconds"),
    ("UnixMs", r"\A\s*(\d{12,13})(?:\D|$)", "milliseconds"),
    ("UnixNano", r"\A\s*(\d{18,19})(?:\D|$)", "nanoseconds"),
    ("DirectAdmin", r"\d{4}:\d{2}:\d{2}-\d{2}:\d{2}:\d{2}", "yyyy:MM:dd-HH:mm:ss"),
    ("TimePicker", r"\d{2}/\d{2}/\d{4} \d{1,2}:\d{2}:\d{2} (AM|PM)", "MM/dd/yyyy h:mm:ss a"),
)
NAMES = tuple(f[0] for f in FORMATS)
#: What must not follow a match of these formats.
_NOT_AFTER = {"ApacheNoTz": r"(?!\s?[-+]\d{4})", "ZonelessRFC3339": r"(?!Z|[+\-])"}
_HAS_ZONE = re.compile(r"XXX|xx|zzz")
_NUMERIC = {"seconds.fraction", "100ns since 1601", "seconds", "milliseconds", "nanoseconds"}


@dataclass(frozen=True)
class TimeFormat:
    """One way to find and read a timestamp."""

    name: str
    pattern: str
    layout: str
    date_missing: bool = False

    def located(self, value: Column) -> Column:
        """The text of the first match; null if there is none."""
        if self.layout in _NUMERIC:
            return F.when(value.rlike(self.pattern), F.regexp_extract(value, self.pattern, 1))
        return F.regexp_substr(value, F.lit(self.pattern + _NOT_AFTER.get(self.name, "")))

    def read(self, found: Column, zone: str, now: Column) -> Column:
        """A timestamp from the text; null if it is none."""
        if self.layout == "seconds.fraction":
            whole, part = F.split_part(found, F.lit("."), F.lit(1)), F.rpad(F.substring(F.split_part(found, F.lit("."), F.lit(2)), 1, 6), 6, "0")
            return F.timestamp_micros(whole.cast("long") * 1_000_000 + part.cast("long"))
        if self.layout in _NUMERIC:
            n = found.cast("decimal(20,0)")
            micros = {"seconds": n * 1_000_000, "milliseconds": n * 1000, "nanoseconds": n / 1000, "100ns since 1601": n / 10 - F.lit(11644473600000000)}[self.layout]
            return F.timestamp_micros(F.floor(micros).cast("long"))
        text = F.regexp_replace(F.trim(found), r"\s+", " ")
        layout = self.layout
        if self.name == "Syslog":  # no year: this one, unless that lies over 25 hours ahead
            year = F.year(now)
            this, last = (F.try_to_timestamp(F.concat(y.cast("string"), F.lit(" "), text), F.lit("yyyy MMM d HH:mm:ss")) for y in (year, year - 1))
            this, last = _in_zone(this, zone), _in_zone(last, zone)
            return F.when(this > now + F.expr("INTERVAL 25 HOURS"), last).otherwise(F.coalesce(this, last))
        if "zzz" in layout:  # abbreviations other than UTC and GMT have no offset
            text, layout = F.regexp_replace(text, r"\b(?!AM|PM)[A-Z]{3}\b", "UTC"), layout.replace("zzz", "z")
        if self.date_missing:
            text, layout = F.concat(F.date_format(now, "yyyy-MM-dd "), text), "yyyy-MM-dd " + layout
        read = F.try_to_timestamp(text, F.lit(layout))
        return read if _HAS_ZONE.search(self.layout) or "z" in layout else _in_zone(read, "UTC" if self.name == "UK" else zone)


def _in_zone(read: Column, zone: str) -> Column:
    """A time read in the session's zone (UTC) as one of ``zone``."""
    return read if zone == "UTC" else F.to_utc_timestamp(read, zone)


def _needed(f: TimeFormat) -> str | None:
    """A cheap pattern that any text of a built-in format has; None for others."""
    if f.name not in NAMES:
        return None
    if "[JFMASOND]" in f.pattern or "(Jan|" in f.pattern:
        return r"[JFMASOND][a-z]"
    if f.layout in _NUMERIC:
        return r"\A\s*\d{9}"
    return r"\dT\d" if r"T\d" in f.pattern else r"\d:\d"


BUILT_IN = {name: TimeFormat(name, pattern, layout) for name, pattern, layout in FORMATS}
#: Reference layout elements and what they are on the JVM, longest first.
_LAYOUT = (
    ("January", "MMMM"), ("Jan", "MMM"), ("Monday", "EEEE"), ("Mon", "EEE"), ("2006", "yyyy"), ("-07:00", "xxx"), ("Z07:00", "XXX"), ("-0700", "xx"), ("Z0700", "XX"), ("MST", "z"),
    ("01", "MM"), ("02", "dd"), ("_2", "d"), ("03", "hh"), ("04", "mm"), ("05", "ss"), ("06", "yy"), ("15", "HH"), ("PM", "a"), ("1", "M"), ("2", "d"), ("3", "h"), ("4", "m"), ("5", "s"),
)


def spark_layout(layout: str) -> str:
    """A layout written as the time 2006-01-02 15:04:05 -0700 would be, as a pattern for the JVM."""
    out, at = [], 0
    while at < len(layout):
        if fraction := re.match(r"[.,](9+|0+)(?!\d)", layout[at:]):
            mark, digits = layout[at], "S" * len(fraction[1])
            out.append(f"[{mark}{digits}]" if fraction[1][0] == "9" else mark + digits)
            at += fraction.end()
            continue
        for element, pattern in _LAYOUT:
            if layout.startswith(element, at):
                out.append(pattern)
                at += len(element)
                break
        else:
            c = layout[at]
            out.append("''" if c == "'" else f"'{c}'" if c.isalpha() else c)
            at += 1
    return re.sub(r"(?<=\w)''(?=\w)", "", "".join(out))  # quoted letters side by side are one quotation


def custom_format(name: str, pattern: str, layout: str) -> TimeFormat:
    """A format of one's own; without a date in the layout, the date is today's in UTC."""
    if not name or not pattern or not layout:
        raise ValueError("name, pattern and layout are needed")
    re.compile(pattern)
    dated = any(e in layout for e in ("2006", "06", "Jan", "01", "02", "_2"))
    if not any(e in layout for e in ("15", "03", "3", "04", "05")) and not dated:
        raise ValueError("the layout has neither date nor time")
    return TimeFormat(name, pattern, spark_layout(layout), date_missing=not dated)


@dataclass(frozen=True)
class PreExtraction:
    """A pattern with one named group, in which a known format is then looked for."""

    name: str
    pattern: str
    format: str


@dataclass(frozen=True)
class Grinder:
    """Finds a timestamp by the first format, in order, that reads one.

    A pure function of the text: which format read the text before plays no part.
    ``past`` and ``future`` (seconds from ``now``) reject what lies outside.
    """

    override: str | None = None
    zone: str = "UTC"
    custom: Sequence[TimeFormat] = ()
    pre: Sequence[PreExtraction] = ()
    now: Column | None = None
    past: int | None = None
    future: int | None = None
    leftmost: bool = False
    only: Sequence[str] = field(default_factory=tuple)

    def __post_init__(self) -> None:
        names = [f.name.lower() for f in self.custom] + [p.name.lower() for p in self.pre]
        if len(set(names)) < len(names) or set(names) & {n.lower() for n in NAMES}:
            raise ValueError("a format of that name exists")
        if self.override and self.override.lower() not in {n.lower() for n in NAMES} | set(names):
            raise ValueError(f"no format {self.override!r}")

    def formats(self) -> list[TimeFormat]:
        ordered = [*self.custom, *BUILT_IN.values()]
        if self.only:
            ordered = [f for f in ordered if f.name in self.only]
        if self.override:
            ordered.sort(key=lambda f: f.name.lower() != self.override.lower())
        return ordered

    def _now(self) -> Column:
        return self.now if self.now is not None else F.current_timestamp()

    def _valid(self, ts: Column) -> Column:
        test = F.lit(True)
        if self.past is not None:
            test &= ts >= self._now() - F.make_dt_interval(secs=F.lit(self.past))
        if self.future is not None:
            test &= ts <= self._now() + F.make_dt_interval(secs=F.lit(self.future))
        return F.when(test, ts) if self.past is not None or self.future is not None else ts

    def _reader(self, f: TimeFormat):
        return lambda text: self._valid(f.read(text, self.zone, self._now()))

    def extract(self, value: Column) -> Column:
        """The timestamp in ``value``; null if there is none."""
        from .regexes import Pattern

        found = []
        for p in self.pre:
            pattern = Pattern(p.pattern)
            if len(pattern.names) != 1:
                raise ValueError("exactly one named group is needed")
            f = BUILT_IN[p.format]
            found.append(self._valid(f.read(f.located(pattern.group(value, 1)), self.zone, self._now())))
        if self.leftmost:
            hits = [F.struct(F.nullif(F.regexp_instr(value, F.lit(f.pattern)), F.lit(0)).alias("at"), F.lit(k).alias("k"), self._valid(f.read(f.located(value), self.zone, self._now())).alias("ts")) for k, f in enumerate(self.formats())]
            kept = F.filter(F.array(*hits), lambda h: h["at"].isNotNull() & h["ts"].isNotNull())
            return F.coalesce(*found, F.get(F.array_sort(kept), F.lit(0))["ts"])
        # formats in order; those side by side that need the same thing are passed over together where it is missing
        for needed, some in groupby(self.formats(), key=_needed):
            one = F.coalesce(*(self._read_one(f, value) for f in some))
            found.append(one if needed is None else F.when(value.rlike(needed), one))
        return F.coalesce(*found)

    def _read_one(self, f: TimeFormat, value: Column) -> Column:
        ts = self._valid(f.read(f.located(value), self.zone, self._now()))
        if self.past is None and self.future is None:
            return ts
        # one outside the window: look further right
        rest = F.regexp_extract_all(value, F.lit(f.pattern), F.lit(1 if f.layout in _NUMERIC else 0))
        return F.coalesce(ts, F.get(F.filter(F.transform(rest, self._reader(f)), lambda t: t.isNotNull()), F.lit(0)))

    def match(self, value: Column) -> Column:
        """(start, end) of the first format's match, from 0; null if none matches.  Nothing is read."""
        spans = [F.when(f.located(value).isNotNull(), F.struct((F.instr(value, f.located(value)) - 1).alias("start"), (F.instr(value, f.located(value)) - 1 + F.length(f.located(value))).alias("end"))) for f in self.formats()]
        return F.coalesce(*spans)

    def clamp(self, ts: Column) -> Column:
        """``ts``, or now where it lies outside the window."""
        return F.coalesce(self._valid(ts), self._now())
