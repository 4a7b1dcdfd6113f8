"""Services that give rows page by page, as a Spark data source: batch and stream, with back-off, filters and offsets.

A client has ``pages() -> list`` of cursors (anything JSON can hold, in order; cheap to
list) and ``page(cursor)``, an iterable of rows.  Cursors are dealt over partitions, and
only executors fetch pages.  A page that fails is asked for again after growing delays; a
page is handed on whole, so rows don't repeat.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterable, Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThanOrEqual, InputPartition

from shutterlake.sources.files import retry_delays


class GaveUp(RuntimeError):
    """A page that couldn't be had after all attempts."""


def fetched(client, cursor, *, attempts: int = 3, base: float = 2.0, wait: Callable[[float], None] = time.sleep) -> list:
    """The rows of one page. After each failure but the last it waits: base, twice base, ..."""
    for k in range(attempts):
        try:
            return list(client.page(cursor))
        except Exception as e:
            if k + 1 == attempts:
                raise GaveUp(f"page {cursor!r}: {attempts} attempts failed, the last by {type(e).__name__}: {e}") from e
            wait(retry_delays(k, base, attempts))


class Pages(InputPartition):
    def __init__(self, cursors: list):
        super().__init__(cursors)
        self.cursors = cursors


def paged_source(name: str, schema: str, connect: Callable[[dict], object], *, pushable: Iterable[tuple[str, str]] = (), attempts: int = 3, base: float = 2.0) -> type[DataSource]:
    """A data source to register: ``spark.dataSource.register(paged_source(...))``, then ``spark.read.format(name)``.

    ``connect(where)`` makes a client on the driver or an executor; ``where`` maps
    (column, '=' or '>=') of ``pushable`` to values that the query's filters gave; it needs
    ``spark.sql.python.filterPushdown.enabled``.
    Options: ``take`` (a partition ends after so many rows), ``pages_per_partition``.
    As a stream, an offset is how many pages have been read; a restart goes on from there.
    """
    pushable = set(pushable)

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.take, self.per = int(options.get("take", 0)), max(1, int(options.get("pages_per_partition", 1)))
            self.where: dict = {}

        def partitions(self) -> Sequence[InputPartition]:
            cursors = connect(self.where).pages()
            return [Pages(cursors[k : k + self.per]) for k in range(0, len(cursors), self.per)] or [Pages([])]

        def read(self, partition: Pages) -> Iterator:
            client, given = connect(self.where), 0
            for cursor in partition.cursors:
                for row in fetched(client, cursor, attempts=attempts, base=base):
                    yield row
                    given += 1
                    if given == self.take:
                        return

    # Spark asks for a setting where a reader takes filters, so only one that can use them does.
    class FilteredReader(Reader):
        def pushFilters(self, filters):
            for f in filters:
                test = {EqualTo: "=", GreaterThanOrEqual: ">="}.get(type(f))
                if test and len(f.attribute) == 1 and (f.attribute[0], test) in pushable and (f.attribute[0], test) not in self.where:
                    self.where[f.attribute[0], test] = f.value
                else:
                    yield f

    class StreamReader(DataSourceStreamReader):
        def initialOffset(self) -> dict:
            return {"pages": 0}

        def latestOffset(self) -> dict:
            return {"pages": len(connect({}).pages())}

        def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
            return [Pages([c]) for c in connect({}).pages()[start["pages"] : end["pages"]]]

        def read(self, partition: Pages) -> Iterator:
            client = connect({})
            for cursor in partition.cursors:
                yield from fetched(client, cursor, attempts=attempts, base=base)

        def commit(self, end: dict) -> None:
            pass

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> DataSourceReader:
            return (FilteredReader if pushable else Reader)(self.options)

        def streamReader(self, schema) -> DataSourceStreamReader:
            return StreamReader()

    return Source


def take(rows: DataFrame, n: int, *, order: str, needed: Sequence[str]) -> DataFrame:
    """The first ``n`` rows by ``order`` that have all columns ``needed``; others are passed over, not counted."""
    whole = rows
    for c in needed:
        whole = whole.where(F.col(c).isNotNull())
    return whole.orderBy(order).limit(n)


class JsonPages:
    """A JSON service: ``page`` and ``per_page`` in the query, ``total`` items, a list under ``items``; items become rows by ``fields``."""

    def __init__(self, url: str, fields: Sequence[str], *, params: dict | None = None, per_page: int = 100, most: int | None = None, items: str = "items", total: str = "total", timeout: float = 30.0):
        self.url, self.fields, self.params, self.per_page, self.most, self.items, self.total, self.timeout = url, list(fields), dict(params or {}), per_page, most, items, total, timeout

    def _get(self, page: int, per_page: int) -> dict:
        query = urllib.parse.urlencode({**self.params, "page": page, "per_page": per_page})
        with urllib.request.urlopen(f"{self.url}?{query}", timeout=self.timeout) as f:
            return json.load(f)

    def pages(self) -> list[int]:
        counted = fetched(_Once(lambda: [self._get(1, 1)[self.total]]), None, base=0.5)[0]
        n = counted if self.most is None else min(counted, self.most)
        return list(range(1, -(-n // self.per_page) + 1))

    def page(self, cursor: int) -> Iterator[tuple]:
        found = self._get(cursor, self.per_page)[self.items]
        if self.most is not None:
            found = found[: max(0, self.most - (cursor - 1) * self.per_page)]
        for item in found:
            yield tuple(item.get(f) for f in self.fields)


class _Once:
    def __init__(self, get):
        self.get = get

    def page(self, _):
        return self.get()
