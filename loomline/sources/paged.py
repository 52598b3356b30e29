"""Paged listings as a Spark data source: pages that name the page after them, by a cursor in the body or by a Link header.

A listing is a folder of pages, `path` a folder of listings. Each listing is one partition, whose task follows its
pages; listings are read side by side. Read as a stream, an offset is the number of pages of each listing that
are known, so a run goes on after the pages of the last one, and a page that isn't there yet is waited for.

Options: `path`; `style`, cursor (the default) or link; `start`, the first page's name; `items` and `cursor`, where a body has
its entries and the next page's name (a.b); `max_pages` of a listing, 10 for links, else no bound. Under `link` a page is
{"headers": {"Link": ...}, "body": a list, an object with items, or one item}.

Cases: a page that is missing or no JSON ends its listing with a row that has an error and no item, after the rows of the pages
before it; so does a page named a second time; a page without entries has no rows; a folder as page is its files in order of their names.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "listing string, page string, number int, ord int, item string, error string"
NAME = "paged_listing"
LINKED_PAGES = 10


def dig(body: Any, path: str) -> Any:
    """The value at a path a.b of nested objects; None on a miss."""
    for part in path.split("."):
        body = body.get(part) if isinstance(body, dict) else None
    return body


def next_link(header: str) -> str | None:
    """The last part of the address that a Link header calls next."""
    for target, rest in re.findall(r"<([^>]*)>([^<]*)", header or ""):
        if re.search(r'\brel\s*=\s*"?next\b', rest):
            return target.rstrip("/").rpartition("/")[2]
    return None


class Listings:
    """How pages are found and read; goes to the tasks."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.link = options["path"].rstrip("/"), options.get("style", "cursor") == "link"
        self.start, self.items, self.cursor = options.get("start", "page=0"), options.get("items", "items"), options.get("cursor", "continue")
        self.most = int(options.get("max_pages", LINKED_PAGES if self.link else 0))

    def _fs(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def names(self) -> list[str]:
        from pyarrow import fs

        store, root = self._fs()
        found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return sorted(f.base_name for f in found if f.type == fs.FileType.Directory and f.base_name[0] not in "._")

    def load(self, listing: str, page: str) -> tuple[list | None, str | None, str | None]:
        """Entries, the next page and an error; no entries if there is an error."""
        from pyarrow import fs

        store, root = self._fs()
        at = f"{root}/{listing}/{page}"
        info = store.get_file_info(at)
        if info.type == fs.FileType.NotFound:
            return None, None, "missing page"
        files = [at] if info.type == fs.FileType.File else sorted(f.path for f in store.get_file_info(fs.FileSelector(at)) if f.base_name[0] not in "._")
        text = b""
        for f in files:
            with store.open_input_stream(f) as s:
                text += s.read()
        try:
            body = json.loads(text)
        except ValueError:
            return None, None, "malformed page"
        if not self.link:
            found, then = dig(body, self.items), dig(body, self.cursor)
            return found if isinstance(found, list) else [], str(then) if then not in (None, "") else None, None
        then, body = next_link(dig(body, "headers.Link") or ""), dig(body, "body")
        return body["items"] if isinstance(body, dict) and isinstance(body.get("items"), list) else body if isinstance(body, list) else [body], then, None

    def follow(self, listing: str) -> Iterator[tuple[str, int, list | None, str | None]]:
        """(page, number, entries, error) from the first page on."""
        page, number, seen = self.start, 0, set()
        while page and (not self.most or number < self.most):
            if page in seen:
                yield page, number, None, "repeated page"
                return
            seen.add(page)
            found, then, error = self.load(listing, page)
            yield page, number, found, error
            page, number = then, number + 1


def rows_of(listing: str, page: str, number: int, found: list | None, error: str | None) -> Iterator[tuple]:
    if error:
        yield listing, page, number, None, None, error
    for i, item in enumerate(found or ()):
        yield listing, page, number, i, json.dumps(item, ensure_ascii=False), None


class _Listing(InputPartition):
    def __init__(self, name: str, pages: list[tuple[str, int]] | None = None) -> None:
        self.name, self.pages = name, pages


class _Reader(DataSourceReader):
    def __init__(self, listings: Listings) -> None:
        self.listings = listings

    def partitions(self) -> list[InputPartition]:
        return [_Listing(n) for n in self.listings.names()]

    def read(self, partition: _Listing) -> Iterator[tuple]:
        if isinstance(partition, _Listing):  # with no listings Spark reads one empty partition
            for page in self.listings.follow(partition.name):
                yield from rows_of(partition.name, *page)


class _Stream(DataSourceStreamReader):
    def __init__(self, listings: Listings) -> None:
        self.listings, self.known = listings, {}

    def initialOffset(self) -> dict:
        return {}

    def _pages(self, listing: str) -> list[str]:
        """Names of the pages that are there; a page that is missing or broken may still come right."""
        found = []
        for page, _, _, error in self.listings.follow(listing):
            if error:
                break
            found.append(page)
        self.known[listing] = found
        return found

    def latestOffset(self) -> dict:
        return {n: len(self._pages(n)) for n in self.listings.names()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for n, upto in sorted(end.items()):
            if upto > start.get(n, 0):
                pages = self.known.get(n, [])
                pages = pages if len(pages) >= upto else self._pages(n)  # a restarted run knows the offsets only
                out.append(_Listing(n, [(pages[i], i) for i in range(start.get(n, 0), upto)]))
        return out

    def read(self, partition: _Listing) -> Iterator[tuple]:
        for page, number in partition.pages:
            found, _, error = self.listings.load(partition.name, page)
            yield from rows_of(partition.name, page, number, found, error)

    def commit(self, end: dict) -> None:
        """Nothing to forget: pages stay where they are."""


class PagedListing(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(Listings(dict(self.options)))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(Listings(dict(self.options)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedListing)


def read_listings(spark: SparkSession, path: str, **options):
    """(listing, page, number, ord, item, error): the entries, as JSON, of all listings below path."""
    register(spark)
    return spark.read.format(NAME).options(path=path, **options).load()
