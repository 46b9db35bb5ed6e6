"""Crawled papers as a Spark data source: pages of sequential ids, fetched by a function of your own.

    spark.dataSource.register(CrawlSource)
    spark.read.format("crawl").options(fetch="my.module:page", month="2403", first=1, last=5000).load()

`fetch` names a function from an id (yyMM.nnnnn) to the HTML of its page, or None where there is none; it is imported on the
executors. Ids are dealt into ranges of `ids_a_task`, so a lost task fetches its own range again and no other.
"""

from __future__ import annotations

from collections.abc import Iterator
from importlib import import_module

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .files import PAGE_FIELDS, page_fields


class Ids(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class CrawlReader(DataSourceReader):
    def __init__(self, options: dict):
        self.fetch, self.month = options["fetch"], options["month"]
        self.first, self.last = int(options.get("first", 1)), int(options["last"])
        self.step = int(options.get("ids_a_task", 1000))
        if self.first < 1 or self.step < 1:
            raise ValueError("first and ids_a_task must be at least 1")

    def partitions(self) -> list[InputPartition]:
        return [Ids(i, min(i + self.step - 1, self.last)) for i in range(self.first, self.last + 1, self.step)]

    def read(self, partition: Ids) -> Iterator[tuple]:
        module, _, name = self.fetch.partition(":")
        fetch = getattr(import_module(module), name)
        for i in range(partition.first, partition.last + 1):
            paper = f"{self.month}.{i:05d}"
            if (html := fetch(paper)) is not None:
                yield (paper, *page_fields(html, tuple(PAGE_FIELDS)))


class CrawlSource(DataSource):
    """(id, date, title, authors, abstract, subject) of the pages that there are."""

    @classmethod
    def name(cls) -> str:
        return "crawl"

    def schema(self) -> str:
        return "id string, " + ", ".join(f"{name} string" for name, _ in PAGE_FIELDS.values())

    def reader(self, schema: StructType) -> DataSourceReader:
        for needed in ("fetch", "month", "last"):
            if needed not in self.options:
                raise ValueError(f"option {needed} is missing")
        return CrawlReader(dict(self.options))
