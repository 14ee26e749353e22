"""Recorded answers of providers as a Spark data source: `spark.read.format("recorded_answers").load(folder)`.

A folder holds `provider=<name>/<file>.json`, one JSON object a line with key, payload and fetched_at
(seconds). One file is one partition. Filters on provider leave whole files out before any is read; one
on fetched_at (the time to live of a cache) leaves out lines, and files whose name says that they are
older (`until=<seconds>` in it). Filters that the source has taken are not evaluated again.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull
from pyspark.sql.types import StructType

NAME = "recorded_answers"
SCHEMA = "provider string, key string, payload string, fetched_at long"


@dataclass
class File(InputPartition):
    path: str
    provider: str

    def __init__(self, path: str, provider: str) -> None:
        super().__init__((path, provider))
        self.path, self.provider = path, provider


@dataclass
class Reader(DataSourceReader):
    folder: str
    providers: set[str] | None = None
    since: int | None = None
    after: list[int] = field(default_factory=list)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes filters on provider and lower bounds of fetched_at; gives back the others."""
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("provider",) and isinstance(f, EqualTo | In):
                named = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.providers = named if self.providers is None else self.providers & named
            elif column == ("fetched_at",) and isinstance(f, GreaterThan | GreaterThanOrEqual):
                least = f.value + isinstance(f, GreaterThan)
                self.since = least if self.since is None else max(self.since, least)
            elif not (column == ("provider",) and isinstance(f, IsNotNull)):  # every answer has a provider
                yield f

    def _system(self) -> tuple[pyarrow.fs.FileSystem, str]:
        return pyarrow.fs.FileSystem.from_uri(self.folder) if "://" in self.folder or self.folder.startswith("file:") else (pyarrow.fs.LocalFileSystem(), self.folder)

    def partitions(self) -> list[File]:
        system, root = self._system()
        found = []
        for x in system.get_file_info(pyarrow.fs.FileSelector(root, recursive=True)):
            named, until = re.search(r"/provider=([^/]+)/[^/]+\.json$", x.path), re.search(r"until=(\d+)[^/]*\.json$", x.path)
            old = until and self.since is not None and int(until[1]) < self.since
            if named and x.is_file and not old and (self.providers is None or named[1] in self.providers):
                found.append(File(x.path, named[1]))
        return sorted(found, key=lambda f: f.path) or [File("", "")]

    def read(self, partition: File) -> Iterator[tuple]:
        if not partition.path:
            return
        system, _ = self._system()
        with system.open_input_stream(partition.path) as stream:
            rest = b""
            while chunk := stream.read(1 << 20):
                *lines, rest = (rest + chunk).split(b"\n")
                yield from self._rows(lines, partition.provider)
            yield from self._rows([rest], partition.provider)

    def _rows(self, lines: list[bytes], provider: str) -> Iterator[tuple]:
        for line in lines:
            try:
                row = json.loads(line) if line.strip() else None
            except ValueError:
                row = None
            if isinstance(row, dict):
                at = row.get("fetched_at")
                if self.since is None or (isinstance(at, int) and at >= self.since):
                    yield provider, row.get("key"), row.get("payload"), at


class RecordedAnswers(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"])


def register_sources(spark: SparkSession) -> None:
    """Makes the source known to the session and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RecordedAnswers)
