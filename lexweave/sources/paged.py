"""A data source of paged listings, as batches and as a stream.

    spark.dataSource.register(PagedSource)
    spark.read.format("paged").options(path=..., terms="DSGVO,GDPR").load()

A listing answers for a term and a page, from 1, with {"count": n, "results": [...]}. ``path`` is an
http(s) address, asked with q, page, page_size and ordering, or a folder of answers for work without a
network: <path>/term=<term>/page=<n>/ with one file, as Spark writes text by these two columns. Pages are
read by many tasks, each with a range of them.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, urlencode
from urllib.request import urlopen

import pyarrow.fs as fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Fixed value: how results are ordered in a batch, newest first.
NEWEST = "-updated_date"
#: A stream reads the oldest first, so that pages only grow at the end.
OLDEST = "updated_date"
ATTEMPTS, WAIT_SECONDS, TIMEOUT_SECONDS = 3, 1.0, 30


@dataclass
class Pages(InputPartition):
    """Pages first to last of a term, and of their items, counted from 0 over all pages, those from begin up to end."""

    term: str
    first: int
    last: int
    begin: int = 0
    end: int | None = None


def answer(path: str, term: str, page: int, size: int, ordering: str) -> dict:
    """A page of a listing; one that isn't there is empty. Other errors are tried again, then raised."""
    for attempt in range(ATTEMPTS):
        try:
            if path.startswith(("http://", "https://")):
                with urlopen(f"{path}?{urlencode({'q': term, 'page': page, 'page_size': size, 'ordering': ordering})}", timeout=TIMEOUT_SECONDS) as got:  # noqa: S310
                    return json.load(got)
            system, root = (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)
            found = system.get_file_info(fs.FileSelector(f"{root}/term={quote(term)}/page={page}", allow_not_found=True))
            file = next((f.path for f in found if f.is_file and not f.base_name.startswith((".", "_"))), None)
            if file is None:
                return {"results": []}
            with system.open_input_stream(file) as stream:
                return json.loads(stream.read())
        except OSError as e:
            if getattr(e, "code", None) == 404:
                return {"results": []}
            if attempt + 1 == ATTEMPTS:
                raise
            time.sleep(WAIT_SECONDS)
    raise AssertionError


class _Listing:
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.terms = [t.strip() for t in options["terms"].split(",") if t.strip()]
        self.size, self.step = int(options.get("page_size", 100)), int(options.get("pages_per_task", 10))
        self.most, self.after = int(options.get("max_pages", 0)), options.get("updated_after")
        if min(self.size, self.step) < 1 or self.most < 0 or not self.terms:
            raise ValueError("page_size and pages_per_task must be 1 or more, max_pages 0 or more, and terms must name one")

    def count(self, term: str, ordering: str) -> int:
        return int(answer(self.path, term, 1, self.size, ordering).get("count") or 0)

    def rows(self, part: Pages, ordering: str) -> Iterator[tuple]:
        for page in range(part.first, part.last + 1):
            results = answer(self.path, part.term, page, self.size, ordering)["results"]
            fresh = 0
            for k, item in enumerate(results):
                at = (page - 1) * self.size + k
                updated = item.get("updated_date")
                if self.after and (updated or "") <= self.after:
                    continue
                fresh += 1
                if at >= part.begin and (part.end is None or at < part.end):
                    yield part.term, page, at, None if item.get("id") is None else str(item["id"]), updated, json.dumps(item, ensure_ascii=False)
            if not results or (ordering == NEWEST and self.after and not fresh):  # what follows is older
                return


class _Reader(_Listing, DataSourceReader):
    def partitions(self) -> list[Pages]:
        parts = []
        for term in self.terms:
            pages = -(-self.count(term, NEWEST) // self.size)
            pages = min(pages, self.most) if self.most else pages
            parts += [Pages(term, p, min(p + self.step - 1, pages)) for p in range(1, pages + 1, self.step)]
        return parts

    def read(self, partition: Pages) -> Iterator[tuple]:
        return self.rows(partition, NEWEST)


class _StreamReader(_Listing, DataSourceStreamReader):
    """An offset has how many items of each term were read; a checkpoint resumes there, also within a page."""

    def initialOffset(self) -> dict:
        return dict.fromkeys(self.terms, 0)

    def latestOffset(self) -> dict:
        counts = {term: self.count(term, OLDEST) for term in self.terms}
        return {term: min(n, self.most * self.size) if self.most else n for term, n in counts.items()}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        parts = []
        for term, stop in end.items():
            begin = start.get(term, 0)
            first, last = begin // self.size + 1, -(-stop // self.size)
            if stop > begin:
                parts += [Pages(term, p, min(p + self.step - 1, last), begin, stop) for p in range(first, last + 1, self.step)]
        return parts

    def read(self, partition: Pages) -> Iterator[tuple]:
        return self.rows(partition, OLDEST)

    def commit(self, end: dict) -> None:
        pass


class PagedSource(DataSource):
    """Options: path, terms (comma-separated), page_size, pages_per_task, max_pages (0: all), updated_after (ISO time; older items are left out)."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "term string, page int, place bigint, id string, updated string, document string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)
