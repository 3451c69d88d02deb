"""A source of pages as a Spark data source: a cursor that moves on, pages that tasks fetch.

A connector knows how many documents there are now (``total``) and fetches ``size`` of them from a
cursor (``page``). It is named by ``connector``, as ``module:factory``; the factory gets all options.
The data source reads it as a table (all pages now) or as a stream: the offset is the cursor, a batch
goes from the last cursor to the present total, and each page of it is a partition that a task
fetches, again if the task is lost. Fetching the same page twice has to give the same documents.

    spark.dataSource.register(PagedSource)
    spark.readStream.format("paged").option("connector", "my.module:connect").option("page_size", 100).load()
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from importlib import import_module
from typing import Protocol

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition


class Connector(Protocol):
    def total(self) -> int: ...

    def page(self, cursor: int, size: int) -> list[str]: ...


def connect(options: dict[str, str]) -> Connector:
    module, _, factory = options["connector"].partition(":")
    return getattr(import_module(module), factory)(options)


@dataclass
class Page(InputPartition):
    cursor: int
    size: int


def pages(start: int, end: int, size: int) -> list[Page]:
    return [Page(c, min(size, end - c)) for c in range(start, end, size)]


class Pages:
    """What batch and stream readers share."""

    def __init__(self, options: dict[str, str]):
        self.options = options
        self.size = int(options.get("page_size", "100"))
        if self.size < 1:
            raise ValueError("page_size must be 1 at least")

    def read(self, partition: Page) -> Iterator[tuple[int, str]]:
        docs = connect(self.options).page(partition.cursor, partition.size)
        if len(docs) != partition.size:
            raise OSError(f"the page at {partition.cursor} has {len(docs)} documents instead of {partition.size}")
        for i, doc in enumerate(docs):
            yield partition.cursor + i, doc


class PageReader(Pages, DataSourceReader):
    def partitions(self) -> list[Page]:
        return pages(0, connect(self.options).total(), self.size)


class PageStream(Pages, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"cursor": int(self.options.get("cursor", "0"))}

    def latestOffset(self) -> dict:
        return {"cursor": connect(self.options).total()}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return pages(start["cursor"], end["cursor"], self.size)

    def commit(self, end: dict) -> None:
        """Nothing to do: a connector keeps no state of its readers."""


class PagedSource(DataSource):
    """Rows of cursor (the place of the document) and payload (its JSON)."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "cursor long, payload string"

    def reader(self, schema) -> DataSourceReader:
        return PageReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PageStream(dict(self.options))


class LinesConnector:
    """Documents of a JSON-lines file, for tests and small packs: a file that grows at its end."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]

    def _lines(self) -> list[str]:
        with open(self.path, encoding="utf-8") as f:
            return [line.rstrip("\n") for line in f if line.strip()]

    def total(self) -> int:
        return len(self._lines())

    def page(self, cursor: int, size: int) -> list[str]:
        found = self._lines()[cursor : cursor + size]
        for line in found:
            json.loads(line)
        return found
