"""The registry of preprocessors, and ordered pipelines of them."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.timeformats import Grinder
from ..operators import filters, forward, rewriters, routers, timestamps, vendor
from .config import Section

Stage = Callable[[DataFrame], DataFrame]


class ConfigError(ValueError):
    """A preprocessor that is unknown or badly configured, by name."""


def _needed(c: Section, key: str) -> str:
    value = c.one(key)
    if not value:
        raise ValueError(f"{key} is missing")
    return value


def _grinder(c: Section) -> Grinder:
    if c.one("Timezone-Override") and c.flag("Assume-Local-Timezone"):
        raise ValueError("Timezone-Override and Assume-Local-Timezone exclude each other")
    return Grinder(override=c.one("Timestamp-Override") or c.one("TS-Format-Override"), zone=c.one("Timezone-Override", "UTC"))


def _misses(c: Section) -> bool:
    legacy = c.one("Passthrough-Misses")
    return c.flag("Drop-Misses") or (legacy is not None and not c.flag("Passthrough-Misses"))


def _sets(c: Section) -> dict[str, list[str]]:
    pairs = [f.rpartition(",") for f in c.many("Field-Filter")]
    return {path.strip(): filters.read_set(file.strip()) for path, _, file in pairs}


def _source_routes(c: Section) -> list[str]:
    return c.many("Route") + [line for file in c.many("Route-File") for line in filters.read_set(file)]


#: type -> stage from its configuration.
REGISTRY: dict[str, Callable[[Section], Stage]] = {
    "drop": lambda c: filters.drop,
    "gzip": lambda c: rewriters.gunzip_entries(c.flag("Passthrough-Non-Gzip")),
    "jsonextract": lambda c: rewriters.JsonExtract(_needed(c, "Extractions"), c.flag("Force-JSON-Object"), c.flag("Strict-Extraction"), _misses(c)),
    "jsonarraysplit": lambda c: rewriters.JsonArraySplit(c.one("Extraction", ""), c.flag("Force-JSON-Object"), c.one("Additional-Fields", ""), _misses(c)),
    "jsonfilter": lambda c: filters.JsonFilter(_sets(c), c.one("Match-Logic", "and"), c.one("Match-Action", "pass"), raw=True),
    "jsonrouter": lambda c: routers.JsonRouter(_needed(c, "Route-Key"), c.many("Route"), c.flag("Drop-Misses")),
    "jsontimeextract": lambda c: timestamps.json_time(_needed(c, "Path"), _grinder(c)),
    "regextimestamp": lambda c: timestamps.regex_time(_needed(c, "Regex"), _needed(c, "TS-Match-Name"), _grinder(c)),
    "regexextract": lambda c: rewriters.RegexExtract(_needed(c, "Regex"), _needed(c, "Template"), c.many("Attach"), _misses(c)),
    "regexrouter": lambda c: routers.RegexRouter(_needed(c, "Regex"), _needed(c, "Route-Extraction"), c.many("Route"), c.flag("Drop-Misses")),
    "regexreplace": lambda c: rewriters.regex_replace(_needed(c, "Regex"), c.one("Replacement", ""), c.flag("Case-Sensitive")),
    "regexdrop": lambda c: filters.regex_drop(_needed(c, "Regex"), c.flag("Invert")),
    "csvrouter": lambda c: routers.CsvRouter(c.number("Route-Extraction", 0), c.many("Route"), c.flag("Drop-Misses")),
    "srcrouter": lambda c: routers.SourceRouter(_source_routes(c), c.flag("Drop-Misses")),
    "syslogrouter": lambda c: routers.SyslogRouter(_needed(c, "Template"), c.flag("Drop-Misses")),
    "tagrouter": lambda c: routers.TagRouter(c.many("Route")),
    "attach": lambda c: rewriters.Attach([(k, v[-1]) for k, v in c.items() if k != "type"]),
    "vpc": lambda c: vendor.flow_log_split(c.flag("Extract-JSON")),
    "corelight": lambda c: vendor.MonitorTsv(c.one("Prefix", "zeek"), c.many("Custom-Format")),
    "cisco_ise": lambda c: _identity(c),
    "forwarder": lambda c: forward.Forwarder.from_config(c),
    "clusterforwarder": lambda c: forward.TableTee(_needed(c, "Target"), [t for x in c.many("Tag") for t in x.split(",")]),
    "plugin": lambda c: forward.load_plugin(_needed(c, "Plugin-Path"), dict(c)),
    "persistent-buffer": lambda c: forward.RingBuffer(_needed(c, "Filename"), c.number("BufferSize", 1 << 26)),
}


def _identity(c: Section) -> Stage:
    form = vendor.IdentityFormat(c.one("Output-Format", "raw"), c.many("Attribute-Drop-Filter"), c.flag("Attribute-Strip-Header"), c.flag("Passthrough-Misses", True))
    if not c.flag("Enable-Multipart-Reassembly"):
        return form
    return lambda df: form(vendor.reassemble(df))


def register(kind: str, make: Callable[[Section], Stage]) -> None:
    """Add a preprocessor type of one's own."""
    REGISTRY[kind.strip().lower()] = make


def stage(kind: str, config: Section) -> Stage:
    make = REGISTRY.get(kind.strip().lower())
    if make is None:
        raise ConfigError(f"unknown preprocessor type {kind!r}")
    return make(config)


class Pipeline:
    """Stages in order; an empty pipeline passes everything.

    With ``tolerant`` names, a stage whose plan cannot be made is left out and
    named in ``faults``, the entries passing as they were before it.  Calling a
    pipeline makes a plan; ``run`` and ``stream`` also send to its tees.
    """

    def __init__(self, stages: Sequence[tuple[str, Stage]], tolerant: Iterable[str] = ()):
        self.stages, self.tolerant = list(stages), set(tolerant)
        self.faults: dict[str, str] = {}

    @classmethod
    def from_config(cls, parsed: dict[tuple[str, str], Section], names: Sequence[str]) -> Pipeline:
        found = []
        for name in names:
            section = parsed.get(("preprocessor", name))
            if section is None:
                raise ConfigError(f"no preprocessor named {name!r}")
            try:
                found.append((name, stage(_needed(section, "Type"), section)))
            except ConfigError as e:
                raise ConfigError(f"{name}: {e}") from e
            except ValueError as e:
                raise ConfigError(f"preprocessor {name!r}: {e}") from e
        return cls(found)

    def __call__(self, df: DataFrame) -> DataFrame:
        return reduce(self._apply, self.stages, df)

    def run(self, df: DataFrame, batch: int | None = None) -> DataFrame:
        """The output for a batch, with every tee (a stage that has ``send``) given the entries as they are where it stands."""
        for name, one in self.stages:
            if hasattr(one, "send"):
                try:
                    one.send(df, batch)
                except Exception as e:
                    if name not in self.tolerant:
                        raise
                    self.faults[name] = str(e)
            df = self._apply(df, (name, one))
        return df

    def stream(self, df: DataFrame, sinks: Sequence[Callable[[DataFrame, int], None]], checkpoint: str, trigger: str | None = None) -> StreamingQuery:
        """Every micro-batch through the pipeline, its tees and then the sinks; without a trigger it takes what is there and stops."""

        def each(entries: DataFrame, number: int) -> None:
            entries.persist()
            try:
                out = self.run(entries, number)
                for sink in sinks:
                    sink(out, number)
            finally:
                entries.unpersist()

        writer = df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)).start()

    def _apply(self, df: DataFrame, named: tuple[str, Stage]) -> DataFrame:
        name, run = named
        if name not in self.tolerant:
            return df.transform(run)
        try:
            return df.transform(run)
        except Exception as e:  # a plugin's own code
            self.faults[name] = str(e)
            return df


def only_tags(run: Stage, tags: Sequence[str]) -> Stage:
    """``run`` for entries of some tags; the others pass."""

    def both(df: DataFrame) -> DataFrame:
        hit = F.coalesce(filters.tag_selector(tags), F.lit(False))
        return run(df.filter(hit)).unionByName(df.filter(~hit))

    return both
