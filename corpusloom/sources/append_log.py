"""Append-only JSON Lines logs as a Spark data source: whole lines by byte offset, in batches and as a stream.

A log may be written to while it is read. What follows a file's last line end is a torn tail: a stream holds it back until
the line is ended, and a batch drops it or takes it. Files are read in ranges of bytes, so a large log is many tasks' work,
and a stream remembers one number a file.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from corpusloom.runtime import ship

LINES = "file string, offset long, text string"


def opened(path: str):
    """(file system, path within it) of a URI or a plain path: local, shared or an object store."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def files_below(path: str) -> dict[str, int]:
    """Sizes of a log's files by their path: the path itself or what lies below it, hidden files and folders aside."""
    from pyarrow import fs

    store, at = opened(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.File:
        return {at: info.size}
    found = store.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True))
    shown = lambda f: not any(x.startswith((".", "_")) for x in f.path.removeprefix(at).split("/"))
    return {f.path: f.size for f in found if f.type == fs.FileType.File and shown(f)}


def last_end(path: str, file: str, start: int, size: int, step: int = 1 << 20) -> int:
    """Where the last line that is ended ends, at `start` or later: found from the end backwards."""
    store, _ = opened(path)
    with store.open_input_file(file) as f:
        end = size
        while end > start:
            at = max(start, end - step)
            found = f.read_at(end - at, at).rfind(b"\n")
            if found >= 0:
                return at + found + 1
            end = at
    return start


class Range(InputPartition):
    def __init__(self, file: str, start: int, end: int, limit: int):
        """Lines that begin at `start` or later and before `end`; none reaches beyond `limit`."""
        self.file, self.start, self.end, self.limit = file, start, end, limit


def lines_in(path: str, part: Range, step: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(offset, line without its end) of the lines that begin in a range; one that begins before it is the range's before."""
    store, _ = opened(path)
    with store.open_input_file(part.file) as f:
        at, rest, whole = part.start, b"", part.start == 0
        read = at if whole else at - 1  # the byte before tells whether a line begins here
        at = read
        while read < part.limit:
            piece = f.read_at(min(step, part.limit - read), read)
            if not piece:
                break
            read += len(piece)
            pieces = (rest + piece).split(b"\n")
            rest = pieces.pop()
            for line in pieces:
                if whole:
                    if at >= part.end:
                        return
                    yield at, line
                whole = True
                at += len(line) + 1
            if whole and at >= part.end:
                return
        if rest and whole and at < part.end:
            yield at, rest


def ranges(file: str, start: int, end: int, size: int) -> list[Range]:
    return [Range(file, at, min(end, at + size), end) for at in range(start, end, size)]


class _Reading:
    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("rangebytes", options.get("rangeBytes", 64 << 20)))

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        offsets, texts, held = [], [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([partition.file] * len(offsets), pa.string()), pa.array(offsets, pa.int64()), pa.array(texts, pa.string())], names=["file", "offset", "text"])

        for at, line in lines_in(self.path, partition):
            line = line.removesuffix(b"\r")
            if at == 0:
                line = line.removeprefix(b"\xef\xbb\xbf")
            offsets.append(at)
            texts.append(line.decode("utf-8", "replace"))
            held += len(line)
            if held > 8 << 20 or len(offsets) >= 10_000:
                yield out()
                offsets, texts, held = [], [], 0
        if offsets:
            yield out()


class _Batch(_Reading, DataSourceReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.torn = options.get("torntail", options.get("tornTail", "drop"))
        if self.torn not in ("drop", "keep"):
            raise ValueError("tornTail is drop or keep")

    def partitions(self) -> list[Range]:
        found = []
        for file, size in sorted(files_below(self.path).items()):
            found += ranges(file, 0, size if self.torn == "keep" else last_end(self.path, file, 0, size), self.size)
        return found or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return super().read(partition) if partition.file else iter(())


class _Stream(_Reading, DataSourceStreamReader):
    """Offsets are {file: bytes whose lines are ended}; a file that is new starts at 0, one that has gone stays as it was."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.seen: dict[str, int] = {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {"files": "{}"}

    def latestOffset(self) -> dict:  # noqa: N802
        for file, size in files_below(self.path).items():
            self.seen[file] = last_end(self.path, file, min(size, self.seen.get(file, 0)), size) if size > self.seen.get(file, 0) else self.seen.get(file, 0)
        return {"files": json.dumps(self.seen, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        before, after = json.loads(start["files"]), json.loads(end["files"])
        found = []
        for file, upto in sorted(after.items()):
            found += ranges(file, before.get(file, 0), upto, self.size)
        return found

    def commit(self, end: dict) -> None:
        pass


class AppendLog(DataSource):
    """format("append_log"): columns file, offset (of the line's first byte) and text; options path, tornTail, rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return "append_log"

    def schema(self) -> str:
        return LINES

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(dict(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return _Stream(dict(self.options))


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(AppendLog)


def read_log(spark: SparkSession, path: str, torn_tail: str = "drop", range_bytes: int = 64 << 20) -> DataFrame:
    """(file, offset, text) of a log's lines. CR LF is a line end too, a leading BOM is dropped; bytes that are not UTF-8
    become U+FFFD. A folder without files, or one that is not there, has no lines."""
    register(spark)
    return spark.read.format("append_log").option("tornTail", torn_tail).option("rangeBytes", str(range_bytes)).load(path)


def stream_log(spark: SparkSession, path: str, range_bytes: int = 64 << 20) -> DataFrame:
    """The same as a stream: every line once, when it is ended, also where files grow or are added between runs."""
    register(spark)
    return spark.readStream.format("append_log").option("rangeBytes", str(range_bytes)).load(path)
