"""Files that are opened by ranges, through whatever file system their path names.

An event log of any size is read as ranges of chunks: a data source whose partitions are byte ranges, largest first.
A task holds a few chunks at a time, so neither a log's nor a range's length decides its memory."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from datetime import UTC

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from vestige.sources.evtx import CHUNK, HEAD

#: Bytes of a range, and chunks of one batch.
RANGE, BATCH = 16 << 20, 16
_SCHEMA = "path string, at long, chunk binary, note string"


def where(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def digested(paths: DataFrame) -> DataFrame:
    """paths with size_bytes, modified_at, sha256 and problem of each file; a file is read block by block."""
    names = paths.columns

    def digest(path: str) -> tuple:
        try:
            system, at = where(path)
            about = system.get_file_info(at)
            sums, size = hashlib.sha256(), 0
            with system.open_input_stream(at) as f:
                while block := f.read(4 << 20):
                    sums.update(block)
                    size += len(block)
            changed = about.mtime.astimezone(UTC).replace(tzinfo=None) if about.mtime else None
            return size, changed, sums.hexdigest(), None
        except OSError as e:
            return None, None, None, f"unreadable: {e}"

    def each(batches):
        for b in batches:
            b[["size_bytes", "modified_at", "sha256", "problem"]] = pd.DataFrame([digest(p) for p in b["path"]], index=b.index, columns=["size_bytes", "modified_at", "sha256", "problem"]).astype(object)
            yield b[[*names, "size_bytes", "modified_at", "sha256", "problem"]]

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in paths.schema)
    return paths.mapInPandas(each, f"{fields}, size_bytes long, modified_at timestamp_ntz, sha256 string, problem string")


class _Range(InputPartition):
    def __init__(self, path: str, begin: int, end: int, problem: str | None = None):
        self.path, self.begin, self.end, self.problem = path, begin, end, problem


def ranges(path: str, size: int) -> list[_Range]:
    """The ranges of a log of this size. They begin at chunks, so no chunk lies in two."""
    step = max(1, RANGE // CHUNK) * CHUNK
    return [_Range(path, at, min(size, at + step)) for at in range(HEAD, max(size, HEAD + 1), step)]


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in self.paths:
            try:
                system, at = where(path)
                out += ranges(path, system.get_file_info(at).size or 0)
            except OSError as e:
                out.append(_Range(path, 0, 0, f"unreadable: {e}"))
        return sorted(out, key=lambda r: r.begin - r.end)

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        try:
            if part.problem:
                raise OSError(part.problem)
            for row in chunks(part):
                rows.append(row)
                if len(rows) == BATCH:
                    yield _batch(rows)
                    rows = []
        except OSError as e:
            rows.append((part.path, None, None, str(e)))
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.binary(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["path", "at", "chunk", "note"])


def chunks(part: _Range) -> Iterator[tuple]:
    """(path, place, chunk, note) of a range's chunks; the first range looks at the log's header. Places that hold no
    chunk are passed over, a chunk that is cut off has a note and no bytes."""
    system, at = where(part.path)
    with system.open_input_file(at) as f:
        if part.begin == HEAD and f.read_at(8, 0) != b"ElfFile\0":
            yield part.path, None, None, "not an event log"
            return
        for place in range(part.begin, part.end, CHUNK):
            if f.read_at(8, place) == b"ElfChnk\0":
                chunk = f.read_at(CHUNK, place)
                yield (part.path, place, chunk, None) if len(chunk) >= 512 else (part.path, place, None, "cut off")


class EventLogs(DataSource):
    """path, at, chunk and note of the logs that the option `paths` names, one a line."""

    @classmethod
    def name(cls) -> str:
        return "event_log_chunks"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader([p for p in self.options.get("paths", "").split("\n") if p])


def log_chunks(spark: SparkSession, paths: list[str]) -> DataFrame:
    spark.dataSource.register(EventLogs)
    return spark.read.format(EventLogs.name()).option("paths", "\n".join(paths)).load()
