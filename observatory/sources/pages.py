"""Landed pages of an API as a data source, in batches and as a stream.

``spark.read.format("landed_pages")`` reads a folder in which each request's pages lie
as ``<chain>/<page>.json``: the chain is a listing that was asked for (a search, the
contributors of a repository), pages are numbered from 1, and each file is an object
{"url", "status", "link", "body"}. A chain is followed as its pages tell: to the one
that the header names as next, and no further than a page that is short, empty, has
status 204 or names none. Chains are the partitions; a limit is pushed down, so pages
behind it aren't opened.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator, Sequence
from urllib.parse import urlsplit

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "chain string, page int, position int, item string"
NAME = "landed_pages"


class IncompletePage(ValueError):
    """A page that says that it isn't whole, is of no list, or leads elsewhere."""


class _Chain(InputPartition):
    def __init__(self, folder: str, chain: str) -> None:
        self.folder, self.chain = folder, chain


def _next(link: str | None) -> str | None:
    found = re.search(r'<([^>]*)>\s*;[^,]*rel="?next"?', (link or "").replace("\n", " "))
    return found[1] if found else None


def follow(folder: str, chain: str, per_page: int, most: int | None, items_key: str | None) -> Iterator[tuple[str, int, int, str]]:
    """(chain, page, position, item) of one chain, positions counted over its pages."""
    page, position, first = 1, 0, None
    while most is None or position < most:
        path = os.path.join(folder, chain, f"{page}.json")
        if not os.path.exists(path):
            raise IncompletePage(f"{chain}: page {page} is named but isn't there")
        with open(path, encoding="utf-8") as f:
            landed = json.load(f)
        if landed.get("status") == 204:
            return
        body = landed.get("body")
        items = body.get(items_key) if items_key and isinstance(body, dict) else body
        if not isinstance(items, list):
            raise IncompletePage(f"{chain}: page {page} has no list" + (f" under {items_key!r}" if items_key else ""))
        if isinstance(body, dict) and body.get("incomplete_results"):
            raise IncompletePage(f"{chain}: page {page} has incomplete results")
        for item in items:
            if most is not None and position >= most:
                return
            yield chain, page, position, json.dumps(item)
            position += 1
        following = _next(landed.get("link"))
        if following is None or len(items) < per_page or not items:
            return
        first = first or landed.get("url") or following
        if urlsplit(following).path != urlsplit(first).path:
            raise IncompletePage(f"{chain}: page {page} leads to another endpoint")
        page += 1


def _options(options: dict) -> tuple[str, int, int | None, str | None]:
    folder, per_page, most = options.get("path"), int(options.get("per_page", 100)), options.get("max_items")
    if not folder:
        raise ValueError("landed_pages needs a path")
    if not 1 <= per_page <= 100 or (most is not None and int(most) < 0):
        raise ValueError("per_page is 1 to 100, max_items not negative")
    return folder.removeprefix("file://"), per_page, None if most is None else int(most), options.get("items_key")


def _chains(folder: str) -> list[str]:
    return sorted(e.name for e in os.scandir(folder) if e.is_dir()) if os.path.isdir(folder) else []


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder, self.per_page, self.most, self.items_key = _options(options)

    def partitions(self) -> Sequence[InputPartition]:
        return [_Chain(self.folder, c) for c in _chains(self.folder)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        # a folder without chains is read as one partition of nothing
        return follow(partition.folder, partition.chain, self.per_page, self.most, self.items_key) if isinstance(partition, _Chain) else iter(())


class _StreamReader(DataSourceStreamReader):
    """Offsets are chains by name: a chain counts once it is named by a later one or ``<chain>.done`` lies beside it."""

    def __init__(self, options: dict) -> None:
        self.folder, self.per_page, self.most, self.items_key = _options(options)

    def initialOffset(self) -> dict:
        return {"chain": ""}

    def latestOffset(self) -> dict:
        done = [c for c in _chains(self.folder) if os.path.exists(os.path.join(self.folder, c + ".done"))]
        return {"chain": max(done, default="")}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return [_Chain(self.folder, c) for c in _chains(self.folder) if start["chain"] < c <= end["chain"]]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        # a folder without chains is read as one partition of nothing
        return follow(partition.folder, partition.chain, self.per_page, self.most, self.items_key) if isinstance(partition, _Chain) else iter(())

    def commit(self, end: dict) -> None:
        pass


class LandedPages(DataSource):
    """Options: path, per_page (100), max_items of each chain (all), items_key of pages that are objects (none).

    Rows are (chain, page, position, item as JSON); parse them with ``sources.landing``.
    As a stream chains come in the order of their names, each once, when it is done.
    The folder has to be one that all executors see.
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LandedPages)
