"""Canonical article text: front matter completed from what the source carried."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import macro_argument, rewrite_links, split_front_matter, split_keywords, strip
from quire.functions.values import let
from quire.profile import BIBLIOGRAPHY_NAME, SKELETON_FRONT_MATTER, Profile


def extract_macros(tex: DataFrame, profile: Profile, text: str = "text") -> DataFrame:
    """Add ``abstract``, ``keywords`` and ``recommended_citation`` from a LaTeX source."""
    source = F.col(text)
    return tex.withColumns(
        {
            "abstract": macro_argument(source, profile.abstract_macro),
            "keywords": macro_argument(source, profile.keywords_macro),
            "recommended_citation": macro_argument(source, profile.citation_macro),
        }
    )


def assemble_front_matter(text: Column, abstract: Column, keywords: Column) -> Column:
    """Canonical text of a converted source.

    Abstract, keywords and bibliography lines are added when their word does
    not occur anywhere in the front matter; a text without any front matter
    gets the skeleton to fill in.
    """
    listed = F.array_join(split_keywords(keywords), ", ")

    def assemble(parts: Column) -> Column:
        front = F.coalesce(parts["front_matter"], F.lit(""))
        lines = (
            ("abstract", F.concat(F.lit("\nabstract: >\n  "), abstract, F.lit("\n"))),
            ("keywords", F.concat(F.lit("\nkeywords: ["), listed, F.lit("]\n"))),
        )
        return _completed(front, lines, parts["body"])

    return let(split_front_matter(text), assemble)


def _completed(front: Column, lines: tuple, body: Column) -> Column:
    if lines:
        (word, line), *others = lines
        return let(_with_line(front, word, line), lambda f: _completed(f, tuple(others), body))
    listed = strip(_with_line(front, "bibliography", F.lit(f"\nbibliography: {BIBLIOGRAPHY_NAME}\n")))
    filled = F.concat(F.lit("---\n"), listed, F.lit("\n---\n\n"), body)
    empty = F.concat(F.lit(f"---\n{SKELETON_FRONT_MATTER}\n---\n\n"), body, F.lit("\n"))
    return F.when(strip(front) != "", filled).otherwise(empty)


def _with_line(front: Column, word: str, line: Column) -> Column:
    absent = ~F.contains(front, F.lit(word)) & line.isNotNull()
    return F.when(absent, F.concat(front, line)).otherwise(front)


def assemble_canonical(converted: DataFrame, replacements: DataFrame | None = None) -> DataFrame:
    """(manuscript_id, file_name, text) of (manuscript_id, text, abstract, keywords) converted sources.

    ``replacements`` (manuscript_id, map) rewrites links to converted figures
    before the text is put together.
    """
    rows = converted
    if replacements is not None:
        rows = rows.join(replacements, ["manuscript_id"], "left")
        rows = rows.withColumn("text", rewrite_links(F.col("text"), F.col("replacements")))
    text = assemble_front_matter(F.col("text"), F.col("abstract"), F.col("keywords"))
    return rows.select("manuscript_id", F.lit("article.qmd").alias("file_name"), text.alias("text"))
