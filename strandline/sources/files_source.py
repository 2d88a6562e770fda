"""``spark.read.format("strandline_files")``: a directory of text files as a Spark data source, batch and stream.

Options: ``path`` (below which all supported files are read), ``since`` (epoch microseconds; only files that
changed later) and ``partitionBytes`` (files are dealt to partitions of about that size, in the order of their paths).

The stream's offset is the latest modification that was seen; a micro-batch is what changed after one offset and up to the
next, so a changed file is read again and a restart goes on where the last committed batch ended."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .connectors import CONTENT_TYPES

NAME = "strandline_files"
SCHEMA = "path string, content string, content_type string, modified timestamp"
PARTITION_BYTES = 32 << 20
BATCH_BYTES = 8 << 20
_ARROW = pa.schema([("path", pa.string()), ("content", pa.string()), ("content_type", pa.string()), ("modified", pa.timestamp("us", "UTC"))])


def type_of(path: str) -> str:
    """The content type of a path's extension, ignoring case; '' if it isn't supported."""
    name = path.rpartition("/")[2]
    return CONTENT_TYPES.get(name.rpartition(".")[2].lower(), "") if "." in name else ""


def _file_system(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri) if ":" in uri else (pyarrow.fs.LocalFileSystem(), uri)


@dataclass
class Found:
    """A file as the driver lists it: its path, size and modification in microseconds."""

    path: str
    size: int
    modified: int


def listing(uri: str, after: int | None = None, upto: int | None = None) -> list[Found]:
    """Supported files by path, changed after ``after`` (strictly) and up to ``upto``."""
    fs, root = _file_system(uri)
    infos = fs.get_file_info(pyarrow.fs.FileSelector(root, recursive=True, allow_not_found=True))
    found = [Found(i.path, i.size or 0, (i.mtime_ns or 0) // 1000) for i in infos if i.type == pyarrow.fs.FileType.File and type_of(i.path)]
    return sorted((f for f in found if (after is None or f.modified > after) and (upto is None or f.modified <= upto)), key=lambda f: f.path)


class Files(InputPartition):
    def __init__(self, files: list[Found]):
        super().__init__([f.path for f in files])
        self.files = files


def dealt(files: list[Found], partition_bytes: int) -> list[Files]:
    out: list[list[Found]] = []
    size = partition_bytes
    for f in files:
        if size + f.size > partition_bytes:
            out.append([])
            size = 0
        out[-1].append(f)
        size += f.size
    return [Files(x) for x in out]


class _Reading:
    def __init__(self, options: dict):
        self.uri = options["path"]
        self.partition_bytes = int(options.get("partitionBytes", PARTITION_BYTES))
        since = options.get("since")
        self.since = int(since) if since not in (None, "") else None

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = _file_system(self.uri)
        rows: list[dict] = []
        size = 0
        for f in partition.files:
            with fs.open_input_stream(f.path) as stream:
                content = stream.read().decode("utf-8", "replace")
            rows.append({"path": f.path, "content": content, "content_type": type_of(f.path), "modified": f.modified})
            size += len(content)
            if size >= BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, _ARROW)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)


class FilesReader(_Reading, DataSourceReader):
    def partitions(self) -> list[Files]:
        return dealt(listing(self.uri, self.since), self.partition_bytes) or [Files([])]


class FilesStream(_Reading, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"mark": -1 if self.since is None else self.since}

    def latestOffset(self) -> dict:
        return {"mark": max([f.modified for f in listing(self.uri)], default=self.initialOffset()["mark"])}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return dealt(listing(self.uri, start["mark"], end["mark"]), self.partition_bytes)


class FilesDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FilesReader:
        return FilesReader(self.options)

    def streamReader(self, schema) -> FilesStream:
        return FilesStream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FilesDataSource)
