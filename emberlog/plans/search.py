"""Searches: tags, a range of time, filters, stages and a renderer as one lazy plan; definitions that name extractions."""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..entry import check_tag, text
from ..functions.jsonpath import json_text, split_quoted
from ..functions.regexes import Pattern
from ..operators.aggregates import facet_by, facet_numeric, facet_values, overview
from ..operators.filters import Access, FieldFilter, entry_range, field_filters, preview, tag_selector, time_range

MODULES = ("json", "regex", "csv", "fields", "kv")


@dataclass(frozen=True)
class Extraction:
    """How to read fields out of a tag's payloads."""

    name: str
    module: str
    params: str
    tags: Sequence[str]
    args: str = ""
    desc: str = ""

    def __post_init__(self) -> None:
        if self.module not in MODULES:
            raise ValueError(f"no module {self.module!r}")
        if not self.tags or len(set(self.tags)) < len(self.tags):
            raise ValueError("tags are missing or repeat")
        for t in self.tags:
            check_tag(t)

    def apply(self, df: DataFrame) -> DataFrame:
        """Entries of the tags, with a column for each field."""
        rows = df.filter(F.col("tag").isin(*self.tags))
        value = text()
        if self.module == "regex":
            p = Pattern(self.params)
            return rows.withColumns({n: p.group(value, n) for n in p.names})
        names = [n.strip() for n in self.params.split(",") if n.strip()]
        if self.module == "json":
            return rows.withColumns({split_quoted(n)[-1]: json_text(value, split_quoted(n)) for n in names})
        if self.module == "csv":
            parsed = F.from_csv(value, ", ".join(f"`{n}` string" for n in names), {"ignoreLeadingWhiteSpace": "true"})
            return rows.withColumn("_c", parsed).withColumns({n: F.col(f"_c.`{n}`") for n in names}).drop("_c")
        if self.module == "fields":
            mark = re.search(r'-d\s+"([^"]+)"', self.args)
            parts = F.split(value, re.escape(mark[1]) if mark else r"\s+", -1)
            return rows.withColumns({n: F.get(parts, F.lit(k)) for k, n in enumerate(names)})
        return rows.withColumns({n: F.regexp_extract(value, rf'(?:^|\s){re.escape(n)}=("[^"]*"|\S*)', 1) for n in names})

    def toml(self) -> str:
        """As a block of a definitions file."""
        q = lambda s: '"' + re.sub(r"[\r\n]+", " ", s).replace("\\", "\\\\").replace('"', '\\"') + '"'
        lines = ["[[extraction]]", f"\tname={q(self.name)}", f"\tdesc={q(self.desc)}", f"\tmodule={q(self.module)}", f"\tparams={q(self.params)}", f"\targs={q(self.args)}"]
        tags = f"\ttag={q(self.tags[0])}" if len(self.tags) == 1 else "\ttags=[" + ", ".join(map(q, self.tags)) + "]"
        return "\n".join([*lines, tags]) + "\n"


@dataclass
class Search:
    """A search in the making; ``frame`` is its result before rendering."""

    frame: DataFrame
    query: dict
    id: str = field(default_factory=lambda: uuid.uuid4().hex)
    started: float = field(default_factory=time.time)
    saved: bool = False

    def count(self) -> int:
        return self.frame.count()

    def entries(self, first: int = 0, last: int = 100, descending: bool = True) -> DataFrame:
        from ..entry import order

        return entry_range(self.frame, first, last, order(descending))

    def entries_between(self, start: str, end: str) -> DataFrame:
        return self.frame.filter(time_range(start, end))

    def overview(self, width: str = "1 hour") -> DataFrame:
        return overview(self.frame, width)

    def facets(self, numeric: Sequence[str] = (), textual: Sequence[str] = (), top: int = 10) -> dict[str, DataFrame]:
        from ..entry import ev_get

        found = {n: facet_numeric(self.frame, n) for n in numeric} | {n: facet_values(self.frame, ev_get(n), top) for n in textual}
        return found | {"tag": facet_by(self.frame, "tag"), "src": facet_by(self.frame, "src")}

    def download(self, path: str, format: str = "json") -> None:
        from ..sources.sinks import write_results

        write_results(self.frame, path, format)


class Engine:
    """Searches over one entry table, for one user; keeps what was searched."""

    def __init__(self, table: DataFrame, access: Access = Access(admin=True)):
        self.table, self.access = table, access
        self.log: list[Search] = []
        self.macros: dict[str, str] = {}
        self.resources: dict[str, DataFrame] = {}
        self.library: dict[str, dict] = {}

    def scan(self, tags: str | Sequence[str], start: str, end: str, partitioned_by_day: bool = False) -> DataFrame:
        """What the user may see of the tags, in start <= ts < end; a table partitioned by ``dt`` is pruned to its days."""
        df = self.table.filter(tag_selector(tags) & time_range(start, end) & self.access.column())
        if partitioned_by_day:
            day = lambda t: F.to_date(F.lit(t).cast("timestamp"))
            df = df.filter(F.col("dt").between(day(start), day(end)))
        return df

    def search(self, tags: str | Sequence[str], start: str, end: str, filters: Sequence[FieldFilter] = (), stages: Sequence[Callable[[DataFrame], DataFrame]] = (), renderer: Callable[[DataFrame], DataFrame] | None = None, preview_only: bool = False) -> Search:
        df = field_filters(filters)(self.scan(tags, start, end, "dt" in self.table.columns))
        df = preview(df) if preview_only else df
        for stage in stages:
            df = df.transform(stage)
        found = Search(df if renderer is None else renderer(df), {"tags": tags, "start": start, "end": end, "filters": list(filters)})
        self.log.append(found)
        return found

    def history(self, refine: str = "") -> list[Search]:
        """Searches by their start, those whose query holds ``refine``."""
        return sorted((s for s in self.log if refine in str(s.query)), key=lambda s: s.started)

    def set_macro(self, name: str, value: str) -> None:
        if not re.fullmatch(r"[A-Z0-9_\-]+", name):
            raise ValueError("macro names are upper case")
        self.macros[name] = value

    def expand(self, query: str, depth: int = 10) -> str:
        """``query`` with ``$NAME`` macros filled in, also within macros."""
        for _ in range(depth):
            new = re.sub(r"\$([A-Z0-9_\-]+)", lambda m: self.macros.get(m[1], m[0]), query)
            if new == query:
                return query
            query = new
        raise ValueError("macros nest too deeply")


@dataclass(frozen=True)
class Schedule:
    """A search, script or flow by cron; running it is left to a scheduler."""

    name: str
    cron: str
    query: str
    duration_s: int
    timezone: str = "UTC"
    kind: str = "search"
    backfill: bool = False
    since_last: bool = False
    offset_s: int = 0

    def __post_init__(self) -> None:
        if len(self.cron.split()) not in (5, 6) or self.kind not in ("search", "script", "flow"):
            raise ValueError("bad schedule")
        if self.duration_s >= 0 and not self.since_last:
            raise ValueError("the duration reaches back: it is negative")

    def range(self, now: int, last: int | None = None) -> tuple[int, int]:
        """Seconds (start, end) of a run."""
        end = now + self.offset_s
        return (last if self.since_last and last is not None else end + self.duration_s), end


@dataclass(frozen=True)
class Alert:
    """Results of schedules that count as events, and what takes them."""

    name: str
    dispatchers: Sequence[str]
    consumers: Sequence[str] = ()
    schema: Sequence[tuple[str, str]] = ()
    max_events: int = 16

    def validate(self, row: dict) -> list[str]:
        """What a row lacks."""
        kinds = {"string": str, "number": (int, float), "bool": bool}
        return [f"{n}: missing" if n not in row else f"{n}: no {k}" for n, k in self.schema if n not in row or not isinstance(row[n], kinds[k])]
