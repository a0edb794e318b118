"""The crawl as a data source: spark.read and spark.readStream of raw documents.

    register(spark)
    spark.read.format("raw_pages").options(titles=folder, client="my_module:connect").load()
    spark.readStream.format("raw_pages").options(titles=folder, title="url", text="html").load()

``titles`` is a Parquet file or folder, ``title`` its column of titles.  A partition is a row
group of it, known by its first and last title, so a plan holds ranges of titles and never the titles
themselves.  What a title's text is a client says - ``module:factory``, made
anew in each task and after each failure, waits growing linearly - or, for pages that are stored
already, the column ``text``.  Pages without text are left out.  A stream's offset is the number of row
groups taken, in order of their files' age: where a checkpoint stands, a crawl goes on.
"""

from __future__ import annotations

import hashlib
import importlib
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from corploom.shipping import ship

SCHEMA = "id string, title string, text string, source string, retrieved_at string, bytes long"
BATCH = 500  # titles that are fetched between two batches of rows


@dataclass
class TitleRange(InputPartition):
    """A row group of a file, and the titles that it lies between where the file tells."""

    path: str
    group: int
    first: str | None = None
    last: str | None = None


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return fs.LocalFileSystem(), path


def title_ranges(path: str, title: str) -> list[TitleRange]:
    """The row groups of all files under path, the oldest file first; only footers are read."""
    system, root = _open(path)
    info = system.get_file_info(root)
    files = [info] if info.is_file else [f for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file and not f.base_name.startswith(("_", "."))]
    out = []
    for f in sorted(files, key=lambda f: (f.mtime_ns or 0, f.path)):
        with system.open_input_file(f.path) as handle:
            meta = pq.ParquetFile(handle).metadata
        at = meta.schema.to_arrow_schema().names.index(title)
        for g in range(meta.num_row_groups):
            told = meta.row_group(g).column(at).statistics
            ends = (told.min, told.max) if told is not None and told.has_min_max else (None, None)
            out.append(TitleRange(f.path, g, *ends))
    return out


def _client(options: dict[str, str]) -> Callable[[], Callable[[str], str]]:
    module, _, factory = options["client"].partition(":")
    return getattr(importlib.import_module(module), factory)


def patiently(connect: Callable[[], Callable[[str], str]], attempts: int, backoff: float) -> Callable[[str], str]:
    """A session that is made anew after a failure; '' when all attempts fail."""
    held = [connect()]

    def get(title: str) -> str:
        for n in range(1, attempts + 1):
            try:
                return held[0](title) or ""
            except Exception:  # noqa: BLE001  any failure of the client is retried
                if n < attempts:
                    time.sleep(backoff * n)
                    held[0] = connect()
        return ""

    return get


class _Reading:
    """What batch and stream readers share."""

    def __init__(self, options: dict[str, str]) -> None:
        self.options = dict(options)
        self.path, self.title = self.options.get("titles") or self.options["path"], self.options.get("title", "title")

    def rows(self, part: TitleRange) -> Iterator[pa.RecordBatch]:
        system, _ = _open(self.path)
        stored = self.options.get("text")
        get = None if stored else patiently(_client(self.options), int(self.options.get("attempts", 3)), float(self.options.get("backoff", 1.0)))
        with system.open_input_file(part.path) as handle:
            file = pq.ParquetFile(handle)
            for batch in file.iter_batches(BATCH, row_groups=[part.group], columns=[self.title, *([stored] if stored else [])]):
                titles = batch.column(0).to_pylist()
                texts = batch.column(1).to_pylist() if stored else [get(t) if t is not None else "" for t in titles]
                own = [(t, x) for t, x in zip(titles, texts, strict=True) if t is not None and x]
                stamp, source = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), self.options.get("source", "raw_pages")
                yield pa.RecordBatch.from_pydict({
                    "id": [hashlib.sha1(t.encode()).hexdigest() for t, _ in own], "title": [t for t, _ in own], "text": [x for _, x in own],  # noqa: S324
                    "source": [source] * len(own), "retrieved_at": [stamp] * len(own), "bytes": pa.array([len(x.encode()) for _, x in own], pa.int64()),
                })


class PageReader(_Reading, DataSourceReader):
    def partitions(self) -> list[TitleRange]:
        return title_ranges(self.path, self.title)

    def read(self, partition: TitleRange | None) -> Iterator[pa.RecordBatch]:
        yield from self.rows(partition) if partition is not None else ()


class PageStream(_Reading, DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        super().__init__(options)
        self.most, self.taken = int(self.options.get("groups_per_batch", 0)), None

    def initialOffset(self) -> dict:  # noqa: N802
        return {"groups": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        there = len(title_ranges(self.path, self.title))
        self.taken = there if not self.most else min(there, (self.taken or 0) + self.most)
        return {"groups": self.taken}

    def partitions(self, start: dict, end: dict) -> list[TitleRange]:
        self.taken = max(self.taken or 0, end["groups"])
        return title_ranges(self.path, self.title)[start["groups"] : end["groups"]]

    def read(self, partition: TitleRange) -> Iterator[pa.RecordBatch]:
        yield from self.rows(partition)


class RawPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raw_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> PageReader:
        return PageReader(self.options)

    def streamReader(self, schema: StructType) -> PageStream:  # noqa: N802
        return PageStream(self.options)


def register(spark: SparkSession) -> None:
    """Make raw_pages known to the session."""
    ship(spark)
    spark.dataSource.register(RawPages)
