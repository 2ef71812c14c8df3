"""Manuscript folders as a data source of their own: all files as a batch, new and changed ones as a stream.

Spark's file sources leave out empty files and names that start with an underscore, list on the driver, and remember paths,
so that a file rewritten in place never arrives again. Here tasks list: each partition takes the folders whose name falls
into its share. A stream's offset is a time mark; a batch holds the files whose modification time lies between two marks, so
every revision that is still there when its batch runs arrives once, a batch that is run again finds the same files, and
nothing but two numbers passes through the driver.
"""

from __future__ import annotations

import datetime
import os
import time
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from fnmatch import fnmatchcase
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

FORMAT = "manuscript_folders"
_START = -(1 << 62)
_END = 1 << 62
_BYTES = 16 << 20  # of contents in one Arrow batch, or one longer file
_ROWS = 4096
_FEW = 64  # folders a share, at most which what lies in them is dealt out
_EPOCH = datetime.datetime(1970, 1, 1, tzinfo=datetime.timezone.utc)


def filesystem(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and the folder's path there."""
    if "://" not in root and not root.startswith("file:"):
        return fs.LocalFileSystem(), root
    return fs.FileSystem.from_uri(root.replace("s3a://", "s3://", 1))


def _folder_names(system: fs.FileSystem, top: str, number: int, shares: int) -> Iterator[str]:
    """Names of the folders in ``top`` that fall into a share; those of a local disk one by one, and no others are looked at."""

    def own(name: str) -> bool:
        return zlib.crc32(name.encode("utf-8", "surrogateescape")) % shares == number

    if not isinstance(system, fs.LocalFileSystem):
        found = system.get_file_info(fs.FileSelector(top, allow_not_found=True))
        yield from (f.base_name for f in found if f.type == fs.FileType.Directory and own(f.base_name))
        return
    try:
        entries = os.scandir(top)
    except FileNotFoundError:
        return
    with entries:
        yield from (e.name for e in entries if own(e.name) and e.is_dir())


def _few(system: fs.FileSystem, top: str, most: int) -> bool:
    """Whether ``top``, on a local disk, holds at most so many names; no more of them are looked at."""
    if not isinstance(system, fs.LocalFileSystem):
        return False
    try:
        entries = os.scandir(top)
    except FileNotFoundError:
        return False
    with entries:
        return sum(1 for _ in islice(entries, most + 1)) <= most


@dataclass
class Share(InputPartition):
    """What one task lists, and the time marks between which files were modified (microseconds).

    Folders in ``top`` go to shares by name, or, where these are ``few``, what lies in them does.
    """

    number: int
    shares: int
    after: int
    until: int
    few: bool = False


class _Folders:
    """Lists and reads; pickled to the tasks."""

    def __init__(self, options: dict[str, str]) -> None:
        self.root = options["path"] if "path" in options else options["root"]
        self.shares = int(options.get("shares", "8"))
        self.content = options.get("content", "false") == "true"
        self.pattern = options.get("pattern", "*")
        self.lag = float(options.get("lag", "2"))
        self.every = float(options.get("every", "0"))

    def shared(self, after: int, until: int) -> list[Share]:
        system, base = filesystem(self.root)
        few = _few(system, f"{base}/manuscripts", _FEW * self.shares)
        return [Share(i, self.shares, after, until, few) for i in range(self.shares)]

    def _inside(self, system: fs.FileSystem, top: str, part: Share) -> Iterator[fs.FileInfo]:
        """Files in the folders of a share."""
        if not part.few:
            for folder in _folder_names(system, top, part.number, part.shares):
                yield from system.get_file_info(fs.FileSelector(f"{top}/{folder}", recursive=True, allow_not_found=True))
            return
        for folder in _folder_names(system, top, 0, 1):
            try:
                entries = os.scandir(f"{top}/{folder}")
            except FileNotFoundError:  # taken away since it was listed
                continue
            with entries:
                for e in entries:
                    if zlib.crc32(f"{folder}/{e.name}".encode("utf-8", "surrogateescape")) % part.shares != part.number:
                        continue
                    inside = f"{top}/{folder}/{e.name}"
                    if e.is_dir():
                        yield from system.get_file_info(fs.FileSelector(inside, recursive=True, allow_not_found=True))
                    else:
                        yield system.get_file_info(inside)

    def _found(self, part: Share) -> Iterator[tuple[fs.FileSystem, str, fs.FileInfo]]:
        system, base = filesystem(self.root)
        top = f"{base}/manuscripts"
        for info in self._inside(system, top, part):
            if info.is_file and fnmatchcase(info.base_name, self.pattern) and part.after < info.mtime_ns // 1000 <= part.until:
                yield system, f"/manuscripts/{info.path[len(top) + 1 :]}", info

    def read(self, part: Share) -> Iterator[pa.RecordBatch]:
        paths, lengths, times, contents, held = [], [], [], [], 0

        def batch() -> pa.RecordBatch:
            fields = {"path": pa.array(paths, pa.string()), "length": pa.array(lengths, pa.int64()), "mtime": pa.array(times, pa.timestamp("us", "UTC"))}
            if self.content:
                fields["content"] = pa.array(contents, pa.binary())
            return pa.RecordBatch.from_arrays(list(fields.values()), names=list(fields))

        for system, path, info in self._found(part):
            if self.content:
                try:
                    with system.open_input_stream(info.path) as source:
                        contents.append(source.read())
                except FileNotFoundError:  # taken away since it was listed
                    continue
                held += len(contents[-1])
            paths.append(path)
            lengths.append(len(contents[-1]) if self.content else info.size)
            times.append(_EPOCH + datetime.timedelta(microseconds=info.mtime_ns // 1000))
            if held >= _BYTES or len(paths) >= _ROWS:
                yield batch()
                paths, lengths, times, contents, held = [], [], [], [], 0
        if paths:
            yield batch()


class _Batch(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folders = _Folders(options)

    def partitions(self) -> Sequence[InputPartition]:
        return self.folders.shared(_START, _END)

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        return self.folders.read(partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folders = _Folders(options)

    def initialOffset(self) -> dict:
        return {"until": _START}

    def latestOffset(self) -> dict:
        """Now, less the lag; a multiple of ``every`` seconds, so that batches without news are no more frequent."""
        until = int((time.time() - self.folders.lag) * 1e6)
        step = int(self.folders.every * 1e6)
        return {"until": until // step * step if step else until}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return self.folders.shared(start["until"], end["until"])

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        return self.folders.read(partition)


class ManuscriptFolders(DataSource):
    """Files below ``<path>/manuscripts/<id>/``: path, length, mtime and, with ``content=true``, content.

    Options: ``shares`` (tasks that list), ``pattern`` (of file names), ``content``; for streams ``lag``, the seconds after
    which a modified file counts as finished, and ``every``, the least seconds between two marks.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        content = ", content binary" if self.options.get("content", "false") == "true" else ""
        return f"path string, length long, mtime timestamp{content}"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(dict(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(dict(self.options))


def _options(spark: SparkSession, content: bool, shares: int | None, pattern: str) -> dict[str, str]:
    """Every share reads the names of the top folder, so their number follows the cores, not the data."""
    spark.dataSource.register(ManuscriptFolders)
    usual = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return {"shares": str(shares or usual), "content": str(content).lower(), "pattern": pattern}


def read_folders(spark: SparkSession, root: str, content: bool = False, pattern: str = "*", shares: int | None = None) -> DataFrame:
    """(path, length, mtime[, content]) of every file; paths start with ``/manuscripts/``."""
    return spark.read.format(FORMAT).options(**_options(spark, content, shares, pattern)).load(root)


def stream_folders(
    spark: SparkSession, root: str, content: bool = False, pattern: str = "*", shares: int | None = None, lag: float = 2, every: float = 0
) -> DataFrame:
    """The same columns as a stream of new and changed files."""
    options = _options(spark, content, shares, pattern) | {"lag": str(lag), "every": str(every)}
    return spark.readStream.format(FORMAT).options(**options).load(root)
