"""Python data sources: files that grow, and services that are asked page by page.

Both keep where they are in the stream's checkpoint, so a restarted query goes
on without a gap.  Register with ``spark.dataSource.register``.
"""

from __future__ import annotations

import importlib
import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition, SimpleDataSourceStreamReader

LINES = "path string, position long, value string"
ITEMS = "value string"


class _Span(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class _FollowReader(DataSourceStreamReader):
    """Offsets are how far each file is read, by device and inode, so a renamed file goes on where it was."""

    def __init__(self, options: dict):
        self.folder, self.suffix = options["path"], options.get("suffix", "")
        self.from_end = options.get("startingOffset", "start") == "end"

    def _files(self) -> dict[str, tuple[str, int]]:
        found = {}
        for name in sorted(os.listdir(self.folder)):
            path = os.path.join(self.folder, name)
            if name.endswith(self.suffix) and os.path.isfile(path):
                s = os.stat(path)
                found[f"{s.st_dev}:{s.st_ino}"] = (path, s.st_size)
        return found

    def initialOffset(self) -> dict:
        return {"at": json.dumps({k: size if self.from_end else 0 for k, (_, size) in self._files().items()})}

    def latestOffset(self) -> dict:
        """To the end of each file's last whole line."""
        return {"at": json.dumps({k: self._line_end(path, size) for k, (path, size) in self._files().items()})}

    @staticmethod
    def _line_end(path: str, size: int) -> int:
        with open(path, "rb") as f:
            end = size
            while end > 0:
                start = max(0, end - 65536)
                f.seek(start)
                at = f.read(end - start).rfind(b"\n")
                if at >= 0:
                    return start + at + 1
                end = start
        return 0

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        before, after = json.loads(start["at"]), json.loads(end["at"])
        paths = {k: p for k, (p, _) in self._files().items()}
        spans = []
        for k, to in after.items():
            at = before.get(k, 0)
            at = 0 if to < at else at  # cut short: it begins anew
            if to > at and k in paths:
                spans.append(_Span(paths[k], at, to))
        return spans

    def read(self, partition: _Span) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            f.seek(partition.start)
            at = partition.start
            while at < partition.end and (line := f.readline()):
                yield partition.path, at, line.rstrip(b"\r\n").decode("utf-8", "replace")
                at += len(line)


class FollowSource(DataSource):
    """``follow``: lines as they are appended to the files of a folder that all workers see."""

    @classmethod
    def name(cls) -> str:
        return "follow"

    def schema(self) -> str:
        return LINES

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _FollowReader(self.options)


class _PagedReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        module, _, name = options["fetch"].partition(":")
        self.fetch = getattr(importlib.import_module(module), name)
        self.start, self.pages = options.get("start", ""), int(options.get("maxPages", "100"))

    def initialOffset(self) -> dict:
        return {"mark": self.start}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        mark, rows = start["mark"], []
        for _ in range(self.pages):
            items, then = self.fetch(mark)
            rows += [(json.dumps(i, separators=(",", ":"), ensure_ascii=False),) for i in items]
            if then == mark or not items:
                mark = then
                break
            mark = then
        return iter(rows), {"mark": mark}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        mark = start["mark"]
        while mark != end["mark"]:
            items, then = self.fetch(mark)
            for i in items:
                yield (json.dumps(i, separators=(",", ":"), ensure_ascii=False),)
            if then == mark:
                return
            mark = then


class PagedSource(DataSource):
    """``paged``: items of a service.  Option ``fetch`` names ``module:function``, which takes a high-water mark and gives (items, next mark)."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return ITEMS

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _PagedReader(self.options)


def follow(spark: SparkSession, folder: str, suffix: str = "", from_end: bool = False) -> DataFrame:
    """The stream of lines appended to a folder's files."""
    spark.dataSource.register(FollowSource)
    return spark.readStream.format("follow").options(path=folder, suffix=suffix, startingOffset="end" if from_end else "start").load()


def paged(spark: SparkSession, fetch: str, start: str = "") -> DataFrame:
    """The stream of a service's items."""
    spark.dataSource.register(PagedSource)
    return spark.readStream.format("paged").options(fetch=fetch, start=start).load()


def listen(spark: SparkSession, host: str, port: int) -> DataFrame:
    """Lines from a TCP socket, for trials: Spark's socket source does not replay what a lost driver had read."""
    return spark.readStream.format("socket").options(host=host, port=str(port)).load()
