"""A data source for services that hand out records in numbered pages.

Every partition covers a range of offsets, so tasks read different pages at the
same time. What talks to the service is yours: two functions that executors can
import, named as ``module:function``.

    spark.dataSource.register(PagedSource)
    raw = (
        spark.read.format("paged")
        .option("fetch", "wiki_client:fetch")      # (start, limit, params) -> list of records
        .option("count", "wiki_client:count")      # (params) -> number of records
        .option("param.space", "IT")
        .load()
    )
    pages = parse_pages(raw, "json")
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from importlib import import_module

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Records per request that the usual services allow.
PAGE_SIZE = 50
PAGES_PER_TASK = 20
_PARAM = "param."


def _load(name: str):
    module, _, function = name.partition(":")
    return getattr(import_module(module), function)


@dataclass
class OffsetRange(InputPartition):
    start: int
    stop: int


class PagedSource(DataSource):
    """Records of a paged service as JSON text with their offset."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "record_offset bigint, json string"

    def reader(self, schema) -> _PagedReader:
        return _PagedReader(dict(self.options))


class _PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        lowered = {key.lower(): value for key, value in options.items()}
        self.fetch, self.count = lowered["fetch"], lowered["count"]
        self.page = int(lowered.get("page_size", PAGE_SIZE))
        self.per_task = self.page * int(lowered.get("pages_per_task", PAGES_PER_TASK))
        self.params = {k[len(_PARAM) :]: v for k, v in lowered.items() if k.startswith(_PARAM)}

    def partitions(self) -> list[OffsetRange]:
        total = int(_load(self.count)(self.params))
        return [OffsetRange(at, min(at + self.per_task, total)) for at in range(0, total, self.per_task)]

    def read(self, partition: OffsetRange | None) -> Iterator[tuple[int, str]]:
        """Failed requests fail the task; Spark runs it again."""
        if partition is None:  # nothing to read
            return
        fetch = _load(self.fetch)
        for start in range(partition.start, partition.stop, self.page):
            limit = min(self.page, partition.stop - start)
            for place, record in enumerate(fetch(start, limit, self.params)):
                yield start + place, json.dumps(record, ensure_ascii=False)
