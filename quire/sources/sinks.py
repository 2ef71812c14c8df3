"""Writers: tables keyed by manuscript, with an optional one-file-per-manuscript export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.values import package_filename, safe_name
from quire.profile import CANONICAL_NAME, GALLEYS
from quire.sources.exact import write_exact


def _write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_canonical(canonical: DataFrame, path: str) -> None:
    """(manuscript_id, text) as a Parquet table; one file per article would not scale."""
    _write_table(canonical.select("manuscript_id", F.lit(CANONICAL_NAME).alias("file_name"), "text"), path)


def write_jats(articles: DataFrame, path: str) -> None:
    _write_table(articles.select("manuscript_id", F.lit(GALLEYS[2][0]).alias("file_name"), "xml"), path)


def write_packages(packages: DataFrame, path: str) -> None:
    """(manuscript_id, file_name, xml); the name comes from the article id."""
    name = package_filename(F.col("article_id"))
    _write_table(packages.select("manuscript_id", name.alias("file_name"), "xml"), path)


def annotations(findings: DataFrame) -> DataFrame:
    """One ``value`` line per finding: ``::level file=F::message``, without ``file=`` when null."""
    place = F.coalesce(F.concat(F.lit(" file="), "file"), F.lit(""))
    return findings.select(F.concat(F.lit("::"), "level", place, F.lit("::"), "message").alias("value"))


def write_findings(findings: DataFrame, path: str) -> None:
    annotations(findings).write.mode("overwrite").text(path)


def export_files(table: DataFrame, folder: str, text: str) -> int:
    """Write ``text`` of each row to ``folder/<manuscript_id>/<file_name>``: all files or none (``write_exact``)."""
    return write_exact(table.select(safe_name(F.col("manuscript_id")).alias("folder"), "file_name", F.col(text).alias("content")), folder)
