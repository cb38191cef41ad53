"""Listings, lookups and downloads of a paged web service. The client is given by name, so nothing here needs a network.

A client is a function without arguments that makes an object with ``page(category, kind, token)``, which returns
(titles, next token or None) for ``kind`` "file" or "subcat", ``info(titles)``, which returns {title: {field: value}},
and ``content(url)``, which returns bytes. Any of them raises :class:`Busy` when the service asks to wait.
"""

from __future__ import annotations

import importlib
import json
import time
import zlib
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

#: Titles of one lookup, and subcategories that are listed when a category's own files are too few.
BATCH, SUBCATEGORIES = 50, 20
INFO = ("mime", "width", "height", "url", "thumb_url", "page_url", "description", "artist", "licence", "licence_url")
INFO_SCHEMA = "title string, mime string, width int, height int, url string, thumb_url string, page_url string, description string, artist string, licence string, licence_url string"


class Busy(Exception):
    """The service asks to come back later."""


def client_of(name: str) -> Any:
    """The client that ``module:function`` makes."""
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)()


def retried(call: Callable[[], Any], tries: int = 8, longest: float | None = 60, network: bool = True, sleep: Callable[[float], None] = time.sleep) -> Any:
    """What ``call`` returns, asked again after 1, 2, 4 and more seconds (``longest`` at most) while the service is
    busy and, with ``network``, after errors of the network. Other errors are raised; so is the end of ``tries``."""
    for attempt in range(tries):
        try:
            return call()
        except (Busy, OSError) as e:
            if isinstance(e, OSError) and not network:
                raise
            sleep(2**attempt if longest is None else min(2**attempt, longest))
    raise RuntimeError(f"no answer after {tries} tries")


class _Category(InputPartition):
    def __init__(self, name: str):
        super().__init__(name)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.client, self.most = options["client"], int(options["most"])
        self.names = json.loads(options["categories"])

    def partitions(self) -> list[InputPartition]:
        return [_Category(n) for n in self.names]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        client, name, seen = client_of(self.client), partition.value, {}

        def listed(category: str) -> Iterator[str]:
            token, first = None, True
            while first or token:
                titles, token = retried(lambda: client.page(category, "file", token))
                first = False
                yield from titles

        def take(category: str, level: int) -> None:
            for title in listed(category):
                if len(seen) >= self.most:
                    return
                seen.setdefault(title, level)

        take(name, 0)
        if len(seen) < self.most:
            for sub in retried(lambda: client.page(name, "subcat", None))[0][:SUBCATEGORIES]:
                if len(seen) >= self.most:
                    break
                take(sub.removeprefix("Category:"), 1)
        for pos, (title, level) in enumerate(seen.items()):
            yield name, title, level, pos


class CategorySource(DataSource):
    """Titles of categories, a partition a category: its own files, then those of its subcategories until ``most``."""

    @classmethod
    def name(cls) -> str:
        return "category_listing"

    def schema(self) -> str:
        return "category string, title string, level int, pos int"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_categories(spark: SparkSession, client: str, categories: list[str], most: int) -> DataFrame:
    """(category, title, level, pos) of each category, each title once, at most ``most`` in a category."""
    spark.dataSource.register(CategorySource)
    return spark.read.format(CategorySource.name()).options(client=client, categories=json.dumps(categories), most=str(most)).load()


class _Pages(SimpleDataSourceStreamReader):
    """A page of a category's titles at a time. An offset says where the listing stands: the category, the listings that are left of it, the page,
    and by hashes the titles that were given of this category, ``most`` at most; so a listing goes on where it stopped, and gives the same again
    if it is asked to."""

    def __init__(self, options: dict[str, str]):
        self.client, self.most, self.names = options["client"], int(options["most"]), json.loads(options["categories"])

    def initialOffset(self) -> dict:
        return {"category": 0, "left": None, "level": 0, "token": None, "seen": []}

    def _next_category(self, at: dict) -> dict:
        return {"category": at["category"] + 1, "left": None, "level": 0, "token": None, "seen": []}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if start["category"] >= len(self.names):
            return iter([]), start
        client, name, seen = client_of(self.client), self.names[start["category"]], list(start["seen"])
        listing = start["left"][0] if start["left"] else name
        titles, token = retried(lambda: client.page(listing, "file", start["token"]))
        rows = []
        for title in titles:
            mark = zlib.crc32(title.encode()) << 32 | zlib.crc32(title[::-1].encode())
            if mark not in seen and len(seen) < self.most:
                rows.append((name, title, start["level"], len(seen)))
                seen.append(mark)
        if len(seen) >= self.most:
            return iter(rows), self._next_category(start)
        if token:
            return iter(rows), {**start, "token": token, "seen": seen}
        left = start["left"][1:] if start["left"] else None
        if left is None:  # the category's own files have come to an end
            subs = retried(lambda: client.page(name, "subcat", None))[0][:SUBCATEGORIES]
            left = [sub.removeprefix("Category:") for sub in subs]
        if not left:
            return iter(rows), self._next_category(start)
        return iter(rows), {**start, "left": left, "level": 1, "token": None, "seen": seen}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        while start != end:
            rows, start = self.read(start)
            yield from rows

    def commit(self, end: dict) -> None:
        pass


class CategoryStream(DataSource):
    """As :class:`CategorySource`, a page a batch, from where an earlier run stopped."""

    @classmethod
    def name(cls) -> str:
        return "category_stream"

    def schema(self) -> str:
        return "category string, title string, level int, pos int"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Pages(self.options)


def stream_categories(spark: SparkSession, client: str, categories: list[str], most: int) -> DataFrame:
    """The rows of :func:`read_categories` as a stream. A listing is one reader's work, as each page names the next."""
    spark.dataSource.register(CategoryStream)
    return spark.readStream.format(CategoryStream.name()).options(client=client, categories=json.dumps(categories), most=str(most)).load()


def _cause(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"[:200]


def outcomes(titles: DataFrame, client: str, batch: int = BATCH) -> DataFrame:
    """A row for each ``title``: what the service says of it, ``batch`` titles a call, or why there is nothing in ``failure``: ``unknown`` for
    titles that it doesn't know, the error for those of a call that failed. Null titles have no row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = client_of(client)
        for frame in frames:
            for lo in range(0, len(frame), batch):
                asked = frame["title"].iloc[lo : lo + batch].tolist()
                try:
                    got, failed = retried(lambda asked=asked: made.info(asked)), "unknown"
                except Exception as e:  # noqa: BLE001 - the other calls' rows are worth having, and the cause is kept
                    got, failed = {}, _cause(e)
                rows = [(t, *(got[t].get(f) for f in INFO), None) if t in got else (t, *[None] * len(INFO), failed) for t in asked]
                yield pd.DataFrame(rows, columns=["title", *INFO, "failure"]).astype({"width": "Int32", "height": "Int32"})

    return titles.select("title").where("title is not null").mapInPandas(run, INFO_SCHEMA + ", failure string")


def look_up(titles: DataFrame, client: str, batch: int = BATCH) -> DataFrame:
    """The :func:`outcomes` that are no failures."""
    return outcomes(titles, client, batch).where("failure is null").drop("failure")


def fetched(found: DataFrame, client: str) -> DataFrame:
    """``found`` (title, url, thumb_url) as (title, content, failure): the thumbnail if there is one, or why none came."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = client_of(client)
        for frame in frames:
            for title, url in zip(frame["title"], frame["at"]):
                content, failed = None, None
                if url is None:
                    failed = "no url"
                else:
                    try:
                        content = retried(lambda url=url: made.content(url), tries=5, longest=None, network=False)
                    except Exception as e:  # noqa: BLE001 - as above
                        failed = _cause(e)
                yield pd.DataFrame({"title": [title], "content": [content], "failure": [failed]})

    return found.selectExpr("title", "coalesce(nullif(thumb_url, ''), url) as at").mapInPandas(run, "title string, content binary, failure string")


def downloaded(found: DataFrame, client: str) -> DataFrame:
    """What :func:`fetched` could fetch."""
    return fetched(found, client).where("failure is null").drop("failure")


def failures(outcome: DataFrame) -> DataFrame:
    """(failure, n): how many rows failed, by cause."""
    return outcome.where("failure is not null").groupBy("failure").agg(F.count(F.lit(1)).alias("n"))
