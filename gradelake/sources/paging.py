"""A paged listing as a stream: offsets are pages, so a restart goes on where the last written batch ended.

``fetch(page, size)`` gives ``(rows, total)`` of a page, counted from 1, and raises :class:`Refused` or any other error.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery

#: Rows of a page, attempts, and seconds by which the wait grows when refused for haste and otherwise.
SIZE, ATTEMPTS, HASTE, OTHER = 250, 4, 5, 2


class Refused(Exception):
    """An answer of another status than success."""

    def __init__(self, status: int):
        super().__init__(f"status {status}")
        self.status = status


def fetched(fetch: Callable, page: int, size: int, wait: Callable[[float], None] = time.sleep) -> tuple[list[tuple], int]:
    """A page, asked for up to four times; a listing that wants less haste (429) is given more time."""
    for attempt in range(1, ATTEMPTS + 1):
        try:
            return fetch(page, size)
        except Exception as error:
            if attempt == ATTEMPTS:
                raise
            wait(attempt * (HASTE if getattr(error, "status", None) == 429 else OTHER))
    raise AssertionError


class _Pages(SimpleDataSourceStreamReader):
    """Offset ``next``: the page to be read; ``total``: what the latest page said; ``done``: whether there is none left."""

    def __init__(self, fetch: Callable, size: int, most: int, wait: Callable):
        self.fetch, self.size, self.most, self.wait = fetch, size, most, wait

    def initialOffset(self) -> dict:
        return {"next": 1, "total": -1, "done": False}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        page, total = start["next"], start["total"]
        if start["done"] or page > self.most or 0 <= total <= (page - 1) * self.size:
            return iter([]), start
        rows, total = fetched(self.fetch, page, self.size, self.wait)
        done = not rows or total <= page * self.size or page >= self.most
        return iter(rows), {"next": page + 1, "total": total, "done": done}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """Pages of a batch that was planned but not written when the stream stopped."""
        for page in range(start["next"], end["next"]):
            yield from fetched(self.fetch, page, self.size, self.wait)[0]

    def commit(self, end: dict) -> None:
        pass


def listing(spark: SparkSession, fetch: Callable, ddl: str, size: int = SIZE, most: int = 1 << 30, wait: Callable = time.sleep) -> DataFrame:
    """The listing as a stream, a page per batch; it stops at the total that the listing tells, at an empty page, or after ``most`` pages."""

    class Listing(DataSource):
        @classmethod
        def name(cls) -> str:
            return "listing"

        def schema(self) -> str:
            return ddl

        def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
            return _Pages(fetch, size, most, wait)

    spark.dataSource.register(Listing)
    return spark.readStream.format("listing").load()


def saved(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the stream as JSON lines, page by page; ``processAllAvailable`` returns when the listing ends."""
    return rows.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).start()


def described(spark: SparkSession, path: str, source: str, seconds: float, schema: str) -> DataFrame:
    """The record that goes beside a listing's file: when and from where it was built, its rows and fields, and how long it took."""
    rows = spark.read.schema(schema).json(path)
    return rows.agg(F.count("*").alias("count")).select(F.current_timestamp().alias("built_at"), "count", F.lit(source).alias("source"), F.array(*map(F.lit, rows.columns)).alias("fields"), F.lit(int(seconds * 1000)).alias("took_ms"))
