"""Files of exact names as a data source: a batch either puts all its files in place or none.

Tasks write below a staging folder of the job, each attempt below a folder of its own: numbered files, in portions of
``_PORTION`` with a list of their places. The commit only names the attempts that count; files of failed, repeated or
speculative attempts are never looked at. A second job then moves the files of those attempts to their places, a rename each,
portion by portion; it can be repeated, since what is moved is no longer there. The driver sees a row a portion, and staging
holds few folders, which the driver takes away.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from quire.functions.values import safe_name
from quire.sources.folders import filesystem

FORMAT = "exact_files"
_PORTION = 4096  # files
_PLACES = "places.json"


@dataclass
class Attempt(WriterCommitMessage):
    """The staging folder of a task's attempt that ended well."""

    folder: str


class _Writer(DataSourceWriter):
    def __init__(self, folder: str, job: str) -> None:
        self.folder, self.job = folder, job

    def _staging(self) -> tuple[fs.FileSystem, str]:
        system, base = filesystem(self.folder)
        return system, f"{base}/.staging-{self.job}"

    def write(self, iterator: Iterator[Row]) -> Attempt:
        system, staging = self._staging()
        task = TaskContext.get()
        name = f"{task.partitionId() if task else 0}-{task.attemptNumber() if task else 0}-{uuid.uuid4().hex[:8]}"
        places: list[str] = []
        portion = 0

        def listed() -> None:
            with system.open_output_stream(f"{staging}/{name}/{portion}/{_PLACES}", compression=None) as out:
                out.write(json.dumps(places).encode())

        for row in iterator:
            if not places:
                system.create_dir(f"{staging}/{name}/{portion}", recursive=True)
            with system.open_output_stream(f"{staging}/{name}/{portion}/{len(places)}", compression=None) as out:
                out.write(bytes(row["content"]))
            places.append(f"{row['folder']}/{row['file_name']}")
            if len(places) == _PORTION:
                listed()
                places, portion = [], portion + 1
        if places:
            listed()
        return Attempt(name)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, staging = self._staging()
        system.create_dir(staging, recursive=True)
        with system.open_output_stream(f"{staging}/committed.json", compression=None) as out:
            out.write(json.dumps([m.folder for m in messages if m is not None]).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, staging = self._staging()
        if system.get_file_info(staging).type == fs.FileType.Directory:
            system.delete_dir(staging)


class ExactFiles(DataSource):
    """Sink of rows (folder, file_name, content). Options: ``path``, ``job`` (a name that no other job has)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "folder string, file_name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], self.options["job"])


def _moved(folder: str, job: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = filesystem(folder)
        for batch in batches:
            for name in batch.column("portion").to_pylist():
                made: set[str] = set()
                top, n = f"{base}/.staging-{job}/{name}", 0
                with system.open_input_stream(f"{top}/{_PLACES}", compression=None) as source:
                    places = json.loads(source.read())
                for i, place in enumerate(places):
                    target = f"{base}/{place}"
                    parent = target.rsplit("/", 1)[0]
                    if parent not in made:
                        system.create_dir(parent, recursive=True)
                        made.add(parent)
                    try:
                        system.move(f"{top}/{i}", target)
                        n += 1
                    except FileNotFoundError:  # moved by an attempt before this one
                        if system.get_file_info(target).type != fs.FileType.File:
                            raise
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["files"])

    return run


def write_exact(files: DataFrame, folder: str) -> int:
    """Put ``content`` (text or bytes) of each row at ``folder/<folder>/<file_name>``; returns the number of files.

    Names are made safe first (``safe_name``), those of ``folder`` each by itself where it is a path of several, so that none
    leads out of ``folder``; null and empty names, and null contents, write no file. Two rows of the same place are an error, found before anything is written. Files that are there already are replaced. If the
    first job fails nothing is in place; if the second fails the files stay in staging, and none is ever in place in part.
    """
    spark = files.sparkSession
    spark.dataSource.register(ExactFiles)
    steps = F.filter(F.split(F.col("folder").cast("string"), "/"), lambda p: p != "")
    path = F.nullif(F.array_join(F.transform(steps, safe_name), "/"), F.lit(""))
    named = files.select(path.alias("folder"), safe_name(F.col("file_name")).alias("file_name"), F.col("content").cast("binary").alias("content"))
    named = named.where("folder is not null and file_name is not null and content is not null")
    twice = named.groupBy("folder", "file_name").count().where("count > 1").first()
    if twice is not None:
        raise ValueError(f"{twice['count']} rows for {twice['folder']}/{twice['file_name']}")
    job = uuid.uuid4().hex
    named.write.format(FORMAT).option("job", job).mode("append").save(folder)
    system, base = filesystem(folder)
    staging = f"{base}/.staging-{job}"
    with system.open_input_stream(f"{staging}/committed.json", compression=None) as source:
        attempts = json.loads(source.read())
    n, portions = 0, [f"{a}/{p.base_name}" for a in attempts for p in system.get_file_info(fs.FileSelector(f"{staging}/{a}", allow_not_found=True))]
    if portions:
        # dealt out one by one, so that no task gets many of them
        tasks = min(len(portions), 4 * spark.sparkContext.defaultParallelism)
        rows = spark.createDataFrame([(i % tasks, p) for i, p in enumerate(portions)], "task int, portion string")
        rows = rows.repartitionByRange(tasks, "task").select("portion")
        n = rows.mapInArrow(_moved(folder, job), "files long").agg(F.sum("files")).first()[0] or 0
    system.delete_dir(staging)
    return n
