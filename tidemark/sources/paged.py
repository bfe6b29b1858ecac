"""A paged listing as a Spark source, and snapshots that readers see only as a whole.

PagedSource reads a folder of page files ("page-000000.json", a JSON array each) as a client reads a listing by offset and
limit: page after page in order, up to the first one with fewer rows than the limit. SnapshotSink writes a run's
rows as JSON lines beside each other and publishes the run by replacing one small file at the very end.
Both go through pyarrow's file systems, so the folder may be a path or an address that these know.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

#: Rows of a full page, and pages of a partition.
LIMIT, PAGES = 1_000, 8
#: Filters that a page's rows can be held against before they leave the reader.
COMPARE = {
    EqualTo: lambda x, v: x == v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v, LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v, In: lambda x, v: x in v,
}


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def page_name(k: int) -> str:
    return f"page-{k:06d}.json"


@dataclass
class PageRange(InputPartition):
    first: int
    last: int
    end: int


class PagedReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.schema, self.path, self.limit, self.pages = schema, options["path"], int(options.get("limit", LIMIT)), int(options.get("pages", PAGES))
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of a column with a value are made while reading; the others are left to Spark."""
        for f in filters:
            if type(f) in COMPARE and len(f.attribute) == 1:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[PageRange]:
        """Ranges of pages up to the first short one, found by halving: a few pages are looked at, whatever their number."""
        store, path = _opened(self.path)
        names = {x.base_name for x in store.get_file_info(fs.FileSelector(path))}
        n = next(k for k in range(len(names) + 1) if page_name(k) not in names)
        low, high = 0, n
        while low < high:
            middle = (low + high) // 2
            low, high = (middle + 1, high) if len(self._page(store, path, middle)) == self.limit else (low, middle)
        end = min(n, low + 1)
        return [PageRange(k, min(end, k + self.pages), end) for k in range(0, end, self.pages)]

    def _page(self, store: fs.FileSystem, path: str, k: int) -> list[dict]:
        with store.open_input_stream(f"{path}/{page_name(k)}") as f:
            rows = json.loads(f.read())
        if not isinstance(rows, list):
            raise ValueError(f"{page_name(k)} is not a list")
        if len(rows) > self.limit:
            raise ValueError(f"{page_name(k)} has more than {self.limit} rows")
        return rows

    def read(self, partition: PageRange | None) -> Iterator[tuple]:
        if partition is None:  # an empty folder
            return
        store, path = _opened(self.path)
        keep = [(f.attribute[0], COMPARE[type(f)], f.value) for f in self.filters]
        for k in range(partition.first, partition.last):
            rows = self._page(store, path, k)
            if len(rows) < self.limit and k + 1 < partition.end:
                raise ValueError(f"{page_name(k)} is short, but not the last page")
            for row in rows:
                if all(row.get(c) is not None and op(row[c], v) for c, op, v in keep):
                    yield tuple(row.get(c) for c in self.schema.names)


class PagedSource(DataSource):
    """options: path, limit (rows of a full page), pages (of a partition). The schema must be given; a row's missing keys are null."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(schema, self.options)


def read_pages(spark: SparkSession, path: str, schema: str, *, limit: int = LIMIT, pages: int = PAGES) -> DataFrame:
    """The rows of a listing. It ends with its first short page; what lies behind that isn't read, and a short page in between fails."""
    spark.dataSource.register(PagedSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("paged").schema(schema).options(path=path, limit=limit, pages=pages).load()


@dataclass
class Part(WriterCommitMessage):
    name: str
    rows: int


class SnapshotWriter(DataSourceWriter):
    def __init__(self, schema: StructType, options: dict, overwrite: bool) -> None:
        self.names, self.path, self.run, self.complete = schema.names, options["path"], uuid.uuid4().hex, options.get("complete")

    def write(self, iterator: Iterator) -> Part:
        store, path = _opened(self.path)
        name, n = f"{self.run}/{uuid.uuid4().hex}.jsonl", 0  # a retried task writes another file; only the one that is told of is published
        store.create_dir(f"{path}/{self.run}", recursive=True)
        with store.open_output_stream(f"{path}/{name}") as f:
            for row in iterator:
                f.write((json.dumps(dict(zip(self.names, row, strict=True)), ensure_ascii=False, sort_keys=True, default=str) + "\n").encode())
                n += 1
        return Part(name, n)

    def commit(self, messages: list[Part | None]) -> None:
        """All tasks are done: check the number of rows, then let readers see the run."""
        parts = [m for m in messages if m is not None]
        rows = sum(p.rows for p in parts)
        if self.complete is not None and rows != int(self.complete):
            self.abort(messages)
            raise ValueError(f"{rows} rows instead of {self.complete}: the run is not published")
        store, path = _opened(self.path)
        told = {"run": self.run, "status": "complete", "rows": rows, "files": sorted(p.name for p in parts)}
        with store.open_output_stream(f"{path}/{self.run}/manifest.json") as f:
            f.write(json.dumps(told, sort_keys=True).encode())
        with store.open_output_stream(f"{path}/current.{self.run}") as f:
            f.write(self.run.encode())
        store.move(f"{path}/current.{self.run}", f"{path}/current")

    def abort(self, messages: list[Part | None]) -> None:
        """A task has failed: mark the run as failed and leave readers on the last complete one."""
        store, path = _opened(self.path)
        store.create_dir(f"{path}/{self.run}", recursive=True)
        with store.open_output_stream(f"{path}/{self.run}/failed.json") as f:
            f.write(json.dumps({"run": self.run, "status": "failed"}).encode())


class SnapshotSink(DataSource):
    """options: path, complete (the number of rows that a run must have; else any)."""

    @classmethod
    def name(cls) -> str:
        return "snapshot"

    def writer(self, schema: StructType, overwrite: bool) -> SnapshotWriter:
        return SnapshotWriter(schema, self.options, overwrite)


def write_snapshot(rows: DataFrame, path: str, *, complete: int | None = None) -> None:
    rows.sparkSession.dataSource.register(SnapshotSink)
    out = rows.write.format("snapshot").mode("append").option("path", path)
    (out if complete is None else out.option("complete", complete)).save()


def current_run(path: str) -> dict | None:
    """The manifest of the last complete run; none if there is none."""
    store, at = _opened(path)
    if store.get_file_info(f"{at}/current").type == fs.FileType.NotFound:
        return None
    with store.open_input_stream(f"{at}/current") as f:
        run = f.read().decode()
    with store.open_input_stream(f"{at}/{run}/manifest.json") as f:
        return json.loads(f.read())


def read_snapshot(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of the last complete run, by its manifest; none before the first."""
    told = current_run(path)
    if told is None or not told["rows"]:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json([f"{path}/{name}" for name in told["files"]])
