"""Readers: file inventory, canonical text, metadata layers, bibliographies, galleys, JATS."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.bibtex import bib_authors, bib_entries
from quire.functions.text import decoded, normalize_doi, split_front_matter, unix_newlines
from quire.profile import (
    ARCHIVE_SUFFIX,
    BIBLIOGRAPHY_NAME,
    CANONICAL_NAME,
    GALLEYS,
    REGISTRY_NAME,
    THEME_NAME,
)
from quire.sources.folders import filesystem, read_folders

_ID = r"/manuscripts/([^/]+)/(.*)$"
FILE_COLUMNS = ("manuscript_id", "area", "path", "name", "ext", "length", "mtime")


def located(files: DataFrame, path: Column) -> DataFrame:
    """Add manuscript_id, area, path inside the folder, name and suffix from a full path."""
    inside = F.regexp_extract(path, _ID, 2)
    first = F.substring_index(inside, "/", 1)
    area = F.when(F.instr(inside, "/") == 0, "root").when(first.isin("source", "figures", "ojs"), first)
    name = F.element_at(F.split(inside, "/"), -1)
    return files.select(
        F.regexp_extract(path, _ID, 1).alias("manuscript_id"),
        F.coalesce(area, F.lit("other")).alias("area"),
        inside.alias("path"),
        name.alias("name"),
        F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)).alias("ext"),
        *[F.col(c) for c in files.columns if c not in FILE_COLUMNS[:5]],
    )


def scan_files(spark: SparkSession, root: str, shares: int | None = None) -> DataFrame:
    """Inventory of every file below ``root/manuscripts``, without reading any.

    Spark's own file sources leave out empty files and names that start with
    an underscore, which are part of a manuscript folder. ``shares`` tasks list
    the folders, each those whose names fall into its share; nothing passes
    through the driver, and nothing is shuffled.
    """
    return located(read_folders(spark, root, shares=shares), F.col("path"))


def scan_bytes(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Inventory rows with ``content`` of the files whose name matches a glob pattern."""
    raw = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .load(f"{root}/manuscripts")
        .withColumnRenamed("modificationTime", "mtime")
    )
    return located(raw, F.col("path"))


def _scan_text(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """(path, text) of each file called ``name``; line ends become ``\\n``."""
    raw = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", name)
        .text(folder, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    )
    return raw.withColumn("text", unix_newlines("text"))


def _scan_articles(spark: SparkSession, root: str, name: str) -> DataFrame:
    """(manuscript_id, text) of each file called ``name`` that lies directly in a manuscript's folder; line ends become ``\\n``.

    The tasks that list the folders read the files, so that no list of files passes through the driver and small files don't
    cost a task each few. Empty files and hidden folders have no row, as with Spark's own file sources.
    """
    found = located(read_folders(spark, root, content=True, pattern=name), F.col("path"))
    hidden = F.col("manuscript_id").rlike(r"^(_[^=]*$|\.)") | F.endswith("manuscript_id", F.lit("._COPYING_"))
    found = found.filter((F.col("area") == "root") & (F.col("length") > 0) & ~hidden)
    return found.select("manuscript_id", unix_newlines(F.col("content").cast("string")).alias("text"))


def scan_canonical(spark: SparkSession, root: str) -> DataFrame:
    """(manuscript_id, front_matter, body, text) of every canonical article."""
    return canonical_rows(_scan_articles(spark, root, CANONICAL_NAME))


def canonical_rows(texts: DataFrame) -> DataFrame:
    """(manuscript_id, front_matter, body, text) of (manuscript_id, text) articles."""
    return texts.withColumn("__fm", split_front_matter(F.col("text"))).select(
        "manuscript_id", "__fm.front_matter", "__fm.body", "text"
    )


def _read_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contents of the files (root, manuscript_id, path), several in one batch of bounded bytes."""

    def made(keys: list[str], texts: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(texts, pa.string())], names=["manuscript_id", "text"])

    for batch in batches:
        keys, texts, held, systems = [], [], 0, {}
        for root, key, path in zip(*[batch.column(c).to_pylist() for c in ("root", "manuscript_id", "path")], strict=True):
            if root not in systems:
                systems[root] = filesystem(root)
            system, base = systems[root]
            with system.open_input_stream(f"{base}/manuscripts/{key}/{path}") as source:
                texts.append(source.read().decode("utf-8", "replace"))
            keys.append(key)
            held += len(texts[-1])
            if held >= 16 << 20:
                yield made(keys, texts)
                keys, texts, held = [], [], 0
        yield made(keys, texts)


def scan_registry(spark: SparkSession, root: str, files: DataFrame | None = None) -> DataFrame:
    """(manuscript_id, text) of the editors' metadata files; a folder without one has no row.

    The file name starts with an underscore, so Spark's file sources don't see
    it: the tasks that list the folders read these files, or, given an
    inventory, tasks open those that it names.
    """
    if files is None:
        found = located(read_folders(spark, root, content=True, pattern=REGISTRY_NAME), F.col("path")).filter(F.col("area") == "root")
        texts = found.select("manuscript_id", decoded(F.col("content")).alias("text"))
    else:
        found = files.filter((F.col("area") == "root") & (F.col("name") == REGISTRY_NAME))
        named = found.select(F.lit(root).alias("root"), "manuscript_id", "path")
        texts = named.mapInArrow(_read_texts, "manuscript_id string, text string")
    return texts.withColumn("text", unix_newlines(F.col("text")))


def scan_theme(spark: SparkSession, root: str) -> DataFrame:
    """(theme, text) of every journal theme."""
    texts = _scan_text(spark, f"{root}/themes", THEME_NAME)
    return texts.select(F.regexp_extract("path", r"/themes/([^/]+)/", 1).alias("theme"), "text")


def dealt(texts: DataFrame) -> DataFrame:
    """The rows spread evenly over two tasks a core: a small file of many short texts is else one task's work."""
    spark = texts.sparkSession
    return texts.repartition(min(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism))


def bibliography_rows(texts: DataFrame) -> DataFrame:
    """(manuscript_id, key, type, fields, authors, year, title, doi) of (manuscript_id, text) BibTeX rows."""
    entries = dealt(texts.select("manuscript_id", "text")).select("manuscript_id", F.posexplode(bib_entries(F.col("text"))).alias("pos", "e"))
    parsed = entries.select("manuscript_id", "pos", "e.key", "e.type", "e.fields")
    year = F.coalesce(F.col("fields")["year"], F.substring(F.col("fields")["date"], 1, 4))
    return parsed.select(
        "*",
        bib_authors(F.col("fields")["author"]).alias("authors"),
        year.alias("year"),
        F.col("fields")["title"].alias("title"),
        normalize_doi(F.col("fields")["doi"]).alias("doi"),
    )


def scan_bibliography(spark: SparkSession, root: str) -> DataFrame:
    """One row per entry of every manuscript's bibliography file."""
    return bibliography_rows(_scan_articles(spark, root, BIBLIOGRAPHY_NAME))


def encode_galleys(files: DataFrame) -> DataFrame:
    """Add ``filesize`` and single-line ``b64`` for the ``content`` bytes."""
    # base64() may break lines every 76 characters, depending on a session setting
    one_line = F.translate(F.base64("content"), "\r\n", "")
    return files.withColumn("filesize", F.octet_length("content").cast("long")).withColumn("b64", one_line)


def scan_galleys(spark: SparkSession, root: str) -> DataFrame:
    """Rendered outputs lying in the manuscript folders, with their bytes."""
    found = scan_bytes(spark, root, "article.{pdf,html,xml}").filter(F.col("area") == "root")
    return found.filter(F.col("name").isin(*[g[0] for g in GALLEYS]))


def scan_jats(spark: SparkSession, root: str) -> DataFrame:
    """(manuscript_id, xml) of the rendered article XML."""
    texts = _scan_articles(spark, root, GALLEYS[2][0])
    return texts.withColumnRenamed("text", "xml")


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples(index=False):
            for member, length, content, error in _unpacked(row.content):
                yield pd.DataFrame(
                    {
                        "manuscript_id": [row.manuscript_id],
                        "archive": [row.path],
                        "member": [member],
                        "length": [length],
                        "mtime": [row.mtime],
                        "content": [content],
                        "error": [error],
                    }
                )


def _unpacked(content: bytes | BinaryIO, largest: int | None = None) -> Iterator[tuple[str | None, int, bytes | None, str | None]]:
    """(name, length, bytes, error) of each member; what can't be read has an error and no bytes."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(content) if isinstance(content, bytes) else content)
    except Exception as problem:  # not an archive, or a broken one
        yield None, 0, None, str(problem) or type(problem).__name__
        return
    with archive:
        for item in archive.infolist():
            if item.is_dir():
                continue
            if largest is not None and item.file_size > largest:
                yield item.filename, item.file_size, None, f"larger than {largest} bytes"
                continue
            try:
                yield item.filename, item.file_size, archive.read(item), None
            except Exception as problem:  # encrypted, damaged or of an unknown method
                yield item.filename, item.file_size, None, str(problem) or type(problem).__name__


def _archive_members(files: DataFrame) -> DataFrame:
    archives = files.filter(
        (F.col("area") == "source") & (F.col("ext") == ARCHIVE_SUFFIX) & (F.size(F.split("path", "/")) == 2)
    ).select("manuscript_id", "path", "mtime", "content")
    schema = "manuscript_id string, archive string, member string, length long, mtime timestamp, content binary, error string"
    return archives.mapInPandas(_members, schema)


def unpack_archives(root: str, files: DataFrame, largest: int = 1 << 30) -> DataFrame:
    """(manuscript_id, area, path, name, ext, archive, length, mtime, content, error): members of the archives that an inventory names.

    Tasks open the archives where they lie and give one member after the other,
    so an archive may be larger than a worker's memory. A member of more than
    ``largest`` bytes, or one that can't be read, has an error and no content; an
    archive that can't be opened is one such row without a path.
    """
    schema = "manuscript_id string, archive string, member string, length long, mtime timestamp, content binary, error string"

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["manuscript_id", "archive", "member", "length", "mtime", "content", "error"]
        for batch in batches:
            for i, (key, path) in enumerate(zip(batch.column("manuscript_id").to_pylist(), batch.column("path").to_pylist(), strict=True)):
                system, base = filesystem(root)
                with system.open_input_file(f"{base}/manuscripts/{key}/{path}") as source:
                    for member, length, content, error in _unpacked(source, largest):
                        fields = [pa.array([x], t) for x, t in ((key, pa.string()), (path, pa.string()), (member, pa.string()), (length, pa.int64()))]
                        yield pa.RecordBatch.from_arrays([*fields, batch.column("mtime").slice(i, 1), pa.array([content], pa.binary()), pa.array([error], pa.string())], names=names)

    archives = files.filter((F.col("area") == "source") & (F.col("ext") == ARCHIVE_SUFFIX) & (F.size(F.split("path", "/")) == 2))
    found = archives.select("manuscript_id", "path", "mtime").mapInArrow(members, schema)
    path = F.concat(F.lit("/manuscripts/"), "manuscript_id", F.lit("/source/"), "member")
    return located(found.withColumn("path", F.coalesce(path, F.concat(F.lit("/manuscripts/"), "manuscript_id", F.lit("/")))), F.col("path")).drop("member")


def broken_archives(files: DataFrame) -> DataFrame:
    """(manuscript_id, archive, member, error) of archives, or members of them, that can't be read."""
    return _archive_members(files).filter(F.col("error").isNotNull()).select("manuscript_id", "archive", "member", "error")


def explode_archives(files: DataFrame) -> DataFrame:
    """Members of every archive at the top of ``source/`` as rows of the inventory, with bytes.

    ``files`` carries ``content``. The result is one row per member, so the
    archive bytes never leave the task that read them. An archive member wins
    over a loose file of the same path, as unpacking overwrites it; of several
    archives the last in name order wins.
    """
    members = _archive_members(files).filter(F.col("error").isNull()).drop("error")
    path = F.concat(F.lit("/manuscripts/"), "manuscript_id", F.lit("/source/"), "member")
    return located(members.withColumn("path", path), F.col("path")).drop("member")


def with_archives(files: DataFrame) -> DataFrame:
    """Inventory in which archives are replaced by their members (``content`` kept)."""
    key = ["manuscript_id", "path"]
    unpacked = explode_archives(files)
    latest = unpacked.groupBy(*key).agg(F.max("archive").alias("archive"))
    unpacked = unpacked.join(latest, [*key, "archive"], "left_semi").drop("archive")
    loose = files.join(unpacked.select(*key), key, "left_anti")
    return loose.unionByName(unpacked)
