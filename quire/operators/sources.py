"""Choosing each manuscript's source file, and checks on what lies in its folder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import normal_path
from quire.operators.findings import finding
from quire.profile import (
    CANONICAL_NAME,
    MAIN_FILE_NAMES,
    METAFILE_SUFFIXES,
    NO_BIBLIOGRAPHY,
    OFFICE_LOCK_PREFIX,
    SOURCE_PLACEHOLDER,
    SOURCE_SUFFIXES,
)

LAST_RUNG = len(MAIN_FILE_NAMES) + 2


def source_candidates(files: DataFrame, strict: bool = False) -> DataFrame:
    """Files with a supported suffix that are no archives and no Office lock files.

    ``strict`` also drops the folder template's placeholder file, which is
    otherwise a candidate like any other Markdown file.
    """
    keep = F.lower("ext").isin(*SOURCE_SUFFIXES) & ~F.startswith(F.col("name"), F.lit(OFFICE_LOCK_PREFIX))
    if strict:
        keep = keep & (F.col("name") != SOURCE_PLACEHOLDER)
    return files.filter(keep)


def prefer(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``first``, and of ``second`` only for keys that ``first`` lacks."""
    return first.unionByName(second.join(first.select(*keys).distinct(), list(keys), "left_anti"))


def source_fallback(candidates: DataFrame) -> DataFrame:
    """Candidates of ``source/``; files lying directly in the folder only when there are none."""
    return prefer(
        candidates.filter(F.col("area") == "source"), candidates.filter(F.col("area") == "root"), ["manuscript_id"]
    )


def source_rung(name: Column, is_latex: Column, has_document: Column) -> Column:
    """1..3 for a main file name, 4 for LaTeX with a document start, 5 for the rest."""
    lowered = F.lower(name)
    rung = F.when(lowered == MAIN_FILE_NAMES[0], 1)
    for place, main in enumerate(MAIN_FILE_NAMES[1:], start=2):
        rung = rung.when(lowered == main, place)
    return rung.when(is_latex & F.coalesce(has_document, F.lit(False)), LAST_RUNG - 1).otherwise(LAST_RUNG)


def choose_source(
    candidates: DataFrame,
    keys: Sequence[str] = ("manuscript_id",),
    name: str = "name",
    path: str = "path",
    length: str = "length",
    is_latex: Column | None = None,
    has_document: Column | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Exactly one candidate per key: lowest rung; on the last rung the largest; then path order.

    A minimum over structs, so the choice is combined before the shuffle and a
    key with very many candidates costs one row per task.
    """
    latex = F.lower("ext") == ".tex" if is_latex is None else is_latex
    rung = source_rung(F.col(name), latex, F.col("has_document") if has_document is None else has_document)
    size = F.when(rung == LAST_RUNG, -F.col(length)).otherwise(F.lit(0))
    rank = F.struct(rung.alias("rung"), size.alias("size"), F.col(path).alias("path"))
    kept = F.struct(*[F.col(c) for c in (name, length, *keep)])
    best = candidates.groupBy(*keys).agg(F.min(F.struct(rank.alias("rank"), kept.alias("kept"))).alias("best"))
    return best.select(
        *keys,
        F.col("best.rank.rung").alias("rung"),
        F.col("best.rank.path").alias(path),
        *[F.col(f"best.kept.{c}").alias(c) for c in (name, length, *keep)],
    )


def route_format(ext: Column) -> Column:
    """Which converter a source needs."""
    lowered = F.lower(ext)
    return (
        F.when(lowered.isin(".qmd", ".md", ".rmd"), "markdown")
        .when(lowered.isin(".docx", ".doc"), "word")
        .when(lowered == ".tex", "latex")
        .otherwise("unsupported")
    )


def unsourced(manuscripts: DataFrame, candidates: DataFrame) -> DataFrame:
    """Error finding for manuscripts with no candidate, or none of a supported format."""
    usable = candidates.filter(route_format(F.col("ext")) != "unsupported")
    bare = manuscripts.select("manuscript_id").join(usable, ["manuscript_id"], "left_anti")
    return finding(bare, "error", "source", F.lit("No supported source file found."), F.lit(None))


def choose_bibliography(files: DataFrame, source: DataFrame) -> DataFrame:
    """First ``.bib`` in path order at or below the folder of each LaTeX source."""
    folders = source.filter(route_format(F.col("ext")) == "latex").select(
        "manuscript_id", F.regexp_replace("path", r"[^/]*$", "").alias("folder")
    )
    bibs = files.filter(F.lower("ext") == ".bib").select("manuscript_id", "path")
    near = bibs.join(folders, ["manuscript_id"]).filter(F.startswith(F.col("path"), F.col("folder")))
    return near.groupBy("manuscript_id").agg(F.min("path").alias("bibliography"))


def no_bibliography(manuscripts: DataFrame, files: DataFrame) -> DataFrame:
    """Warning finding for manuscripts without any ``.bib`` file."""
    bibs = files.filter(F.lower("ext") == ".bib")
    bare = manuscripts.select("manuscript_id").join(bibs, ["manuscript_id"], "left_anti")
    return finding(bare, "warning", "no-bibliography", F.lit(NO_BIBLIOGRAPHY), F.lit(None))


def metafile_figures(files: DataFrame) -> DataFrame:
    """Vector metafiles below ``figures/``."""
    return files.filter((F.col("area") == "figures") & F.lower("ext").isin(*METAFILE_SUFFIXES))


def metafile_links(files: DataFrame) -> DataFrame:
    """(manuscript_id, replacements): old path to the path of the converted PNG."""
    figures = metafile_figures(files).select(
        "manuscript_id",
        F.struct("path", F.regexp_replace("path", r"\.[^.]*$", ".png").alias("to")).alias("pair"),
    )
    pairs = figures.groupBy("manuscript_id").agg(F.sort_array(F.collect_set("pair")).alias("pairs"))
    return pairs.select("manuscript_id", F.map_from_entries("pairs").alias("replacements"))


_IMAGE = r"!\[[^\]]*\]\(\s*<?([^)\s>]+)"
_TAG = r"""(?i)<img\b[^>]*?\ssrc\s*=\s*["']([^"'>]+)["']"""


def image_links(bodies: DataFrame) -> DataFrame:
    """Distinct (manuscript_id, path) of the local images a body shows, in Markdown or in tags; paths are normalized."""
    shown = F.concat(*[F.regexp_extract_all("body", F.lit(p), F.lit(1)) for p in (_IMAGE, _TAG)])
    links = bodies.select("manuscript_id", F.explode(shown).alias("path"))
    local = links.filter(~F.col("path").rlike(r"^[a-z][a-z0-9+.-]*:"))
    return local.withColumn("path", normal_path(F.col("path"))).distinct()


def figure_integrity(links: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(linked but not in the folder, in ``figures/`` but not linked)."""
    key = ["manuscript_id", "path"]
    figures = files.filter(F.col("area") == "figures").select(*key)
    return links.join(files.select(*key), key, "left_anti"), figures.join(links, key, "left_anti")


def passthrough(texts: DataFrame) -> DataFrame:
    """Markdown-like sources become canonical text unchanged."""
    return texts.select("manuscript_id", F.lit(CANONICAL_NAME).alias("file_name"), "text")


def union_inputs(*inputs: DataFrame) -> DataFrame:
    """Canonical rows of every input format in one schema."""
    out = inputs[0]
    for other in inputs[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out
