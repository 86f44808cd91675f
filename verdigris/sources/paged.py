"""A data source of paged searches: one partition a page, offsets that a stream commits, failed pages as rows.

``spark.dataSource.register(PagedSource)`` makes the format ``paged`` known.
Pages are recorded responses, one folder ``page=<n>`` or file ``page-<n>.json``
each, in any store that pyarrow reads.  A batch read takes all pages at once; a
stream takes some in each batch, and its checkpoint knows the next one, so a
run that was killed goes on where it was.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "page long, pos int, total long, row string, error string, attempts int"
# Where a response may hold its rows and its total.
ROWS, TOTALS = ("data", "items", "lawcases", "results"), ("total", "count", "totalCount")
_NAME = re.compile(r"page[=-](\d+)(?:\.json)?$")


@dataclass
class Page(InputPartition):
    number: int
    path: str

    def __init__(self, number: int, path: str) -> None:
        self.number, self.path = number, path


def store(path: str):
    """The file system of an address, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]*:", path) else (fs.LocalFileSystem(), path)


def pages(path: str) -> dict[int, str]:
    """The pages that are there, by number: a listing, no content."""
    from pyarrow import fs

    files, base = store(path)
    found = files.get_file_info(fs.FileSelector(base, allow_not_found=True))
    return {int(m[1]): x.path for x in found if (m := _NAME.search(x.path))}


def fetch(root: str, path: str) -> str:
    """The text of a page: the file, or the files of its folder in order."""
    from pyarrow import fs

    files, _ = store(root)
    if files.get_file_info(path).type == fs.FileType.Directory:
        parts = sorted(x.path for x in files.get_file_info(fs.FileSelector(path)) if x.is_file and not x.base_name.startswith(("_", ".")))
    else:
        parts = [path]
    out = []
    for p in parts:
        with files.open_input_stream(p) as f:
            out.append(f.read().decode("utf-8"))
    return "".join(out)


def rows_of(body: str) -> tuple[int | None, list]:
    """Total and rows of a response, under whichever name they are; ValueError for one that has none."""
    value = json.loads(body)
    if not isinstance(value, dict):
        raise ValueError("malformed")
    rows = next((value[k] for k in ROWS if isinstance(value.get(k), list)), None)
    if rows is None:
        raise ValueError("no_rows")
    return next((value[k] for k in TOTALS if isinstance(value.get(k), int)), None), rows


def _read(root: str, part: Page, attempts: int, wait: float) -> Iterator[tuple]:
    """The rows of a page, or one row that says why it failed; a fetch that fails is tried again, a bad response isn't."""
    for n in range(1, attempts + 1):
        try:
            body = fetch(root, part.path)
            break
        except (OSError, UnicodeDecodeError) as e:
            if n == attempts:
                yield part.number, None, None, None, "malformed" if isinstance(e, UnicodeDecodeError) else "network", n
                return
            time.sleep(wait * 2 ** (n - 1))
    try:
        total, rows = rows_of(body)
    except ValueError as e:
        yield part.number, None, None, None, "no_rows" if str(e) == "no_rows" else "malformed", n
        return
    for i, row in enumerate(rows):
        yield part.number, i, total, json.dumps(row, ensure_ascii=False, sort_keys=True), None, n


class _Settings:
    def __init__(self, options) -> None:
        self.path = options["path"]
        self.attempts = int(options.get("attempts", "3"))
        self.wait = float(options.get("wait", "0.8"))
        self.batch = int(options.get("pagesPerBatch", "5"))


class PagedReader(_Settings, DataSourceReader):
    def partitions(self) -> list[Page]:
        return [Page(n, p) for n, p in sorted(pages(self.path).items())]

    def read(self, partition: Page | None) -> Iterator[tuple]:
        if partition is not None and isinstance(partition, Page):
            yield from _read(self.path, partition, self.attempts, self.wait)


class PagedStreamReader(_Settings, DataSourceStreamReader):
    """Pages in order, without a gap: a page that isn't there yet is waited for, those after it come later."""

    def __init__(self, options) -> None:
        super().__init__(options)
        self.next = 0

    def initialOffset(self) -> dict:
        return {"page": 0}

    def latestOffset(self) -> dict:
        there = pages(self.path)
        end = self.next
        while end < self.next + self.batch and end in there:
            end += 1
        self.next = end
        return {"page": end}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        self.next = max(self.next, end["page"])  # after a restart Spark plans the batch that it was in
        there = pages(self.path)
        return [Page(n, there.get(n, f"{store(self.path)[1]}/page={n}")) for n in range(start["page"], end["page"])]

    def read(self, partition: Page) -> Iterator[tuple]:
        yield from _read(self.path, partition, self.attempts, self.wait)

    def commit(self, end: dict) -> None:
        self.next = max(self.next, end["page"])


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)

    def streamReader(self, schema) -> PagedStreamReader:
        return PagedStreamReader(self.options)
