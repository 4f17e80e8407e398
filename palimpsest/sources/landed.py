"""A data source over landed pages of a feed, as a table and as a stream with offsets of its own.

A walk over a feed is landed as numbered files, ``page-<number>.json``, one answer of the feed each:
``{"nextPageToken": ..., "<records>": [...]}``.  A file stands at its place whole or not at all
(written beside and renamed).  The stream's offset is the number of the last page taken.  Pages are
offered in order, and only up to the first number that is missing: a page that lands late is not
passed over.  A page is one partition; its records are read in the task.

A restarted query goes on after the last page of its checkpoint.  A page that is no JSON object fails the
read, with its name.  Records are JSON text, so nothing of them is lost.

Options: ``path`` (any file system that Arrow reads), ``records`` (the name of the list, default
``studies``), ``first`` (number of the first page, default 1).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "page long, nth long, next_token string, record string"
_NAME = re.compile(r"page-(\d+)\.json")


class Page(InputPartition):
    def __init__(self, number: int, name: str):
        super().__init__(number)
        self.number, self.name = number, name


class _Pages:
    """The landed files of one folder."""

    def __init__(self, options: dict):
        self.path, self.records = options["path"].rstrip("/"), options.get("records", "studies")
        self.first = int(options.get("first", 1))

    def _system(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if re.match(r"^[a-z0-9+.-]+:", self.path) else (fs.LocalFileSystem(), self.path)

    def numbered(self) -> dict[int, str]:
        from pyarrow import fs

        system, path = self._system()
        found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
        return {int(m[1]): f.base_name for f in found if f.is_file and (m := _NAME.fullmatch(f.base_name))}

    def contiguous(self, after: int) -> int:
        """The last number up to which no page is missing, after ``after``."""
        known, last = self.numbered(), after
        while last + 1 in known:
            last += 1
        return last

    def read(self, page: Page) -> Iterator[tuple]:
        system, path = self._system()
        with system.open_input_stream(f"{path}/{page.name}") as stream:
            text = stream.read().decode()
        try:
            answer = json.loads(text)
            items = answer.get(self.records) or []
        except (ValueError, AttributeError) as problem:
            raise ValueError(f"{page.name} is no page: {problem}") from None
        for nth, item in enumerate(items):
            yield page.number, nth, answer.get("nextPageToken"), json.dumps(item, ensure_ascii=False)


class _TableReader(DataSourceReader):
    def __init__(self, options: dict):
        self.pages = _Pages(options)

    def partitions(self) -> list[Page]:
        known = self.pages.numbered()
        last = self.pages.contiguous(self.pages.first - 1)
        return [Page(n, known[n]) for n in range(self.pages.first, last + 1)] or [Page(-1, "")]

    def read(self, partition: Page) -> Iterator[tuple]:
        return self.pages.read(partition) if partition.name else iter(())


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.pages = _Pages(options)
        self.offered = self.pages.first - 1

    def initialOffset(self) -> dict:
        return {"page": self.pages.first - 1}

    def latestOffset(self) -> dict:
        self.offered = self.pages.contiguous(self.offered)
        return {"page": self.offered}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        self.offered = max(self.offered, end["page"])
        known = self.pages.numbered()
        return [Page(n, known[n]) for n in range(start["page"] + 1, end["page"] + 1)]

    def read(self, partition: Page) -> Iterator[tuple]:
        return self.pages.read(partition)

    def commit(self, end: dict) -> None:
        """Pages stay where they are."""


class LandedPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landed_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _TableReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(dict(self.options))


def read_pages(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """``(page, nth, next_token, record)`` of the landed pages up to the first gap."""
    spark.dataSource.register(LandedPages)
    return spark.read.format("landed_pages").options(path=path, **options).load()


def stream_pages(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The same as a stream."""
    spark.dataSource.register(LandedPages)
    return spark.readStream.format("landed_pages").options(path=path, **options).load()
