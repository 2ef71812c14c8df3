"""Truthiness, defaults and format strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import let as let
from quire.functions.text import strip
from quire.profile import DEFAULT_ARTICLE_ID, DEFAULT_JOURNAL_PATH, DEFAULT_LOCALE


def is_missing(kind: Column, value_json: Column) -> Column:
    """True for absent, null, false, zero, empty text, empty list and empty map."""
    return (
        F.when(kind.isNull() | (kind == "null"), True)
        .when(kind.isin("int", "float"), F.coalesce(value_json.try_cast("double") == 0, F.lit(False)))
        .when(kind == "bool", value_json == "false")
        .when(kind == "str", value_json == '""')
        .when(kind == "list", value_json == "[]")
        .when(kind == "map", F.coalesce(value_json == "{}", F.lit(False)))
        .otherwise(False)
    )


def optional(value: Column) -> Column:
    """The value, or null when it is empty, so that XML and JSON leave the field out."""
    return F.when(value.cast("string") != "", value)


def or_default(value: Column, default: Column | str) -> Column:
    """The value unless it is null or empty text."""
    fallback = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(F.nullif(value.cast("string"), F.lit("")), fallback)


def locale_of(lang: Column) -> Column:
    return F.replace(or_default(lang, DEFAULT_LOCALE), F.lit("-"), F.lit("_"))


def doi_url(doi: Column) -> Column:
    return F.concat(F.lit("https://doi.org/"), optional(doi))


def orcid_url(orcid: Column) -> Column:
    return F.concat(F.lit("https://orcid.org/"), optional(orcid))


def article_type_attr(article_type: Column) -> Column:
    return F.lower(optional(article_type))


def license_sentence(license_name: Column) -> Column:
    return F.concat(F.lit("Published under the "), optional(license_name), F.lit(" license."))


def masthead_line(journal: Column, year: Column, volume: Column, article_id: Column) -> Column:
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (journal, year, volume, article_id)]
    return F.format_string("%s, %s, vol %s, %s", *parts)


def footer_line(journal: Column, year: Column, volume: Column, doi: Column, article_id: Column) -> Column:
    """The running footer carries the DOI, or the article id when there is none."""
    return masthead_line(journal, year, volume, or_default(doi, F.coalesce(article_id.cast("string"), F.lit(""))))


def issn_note(issn: Column) -> Column:
    return F.coalesce(F.concat(F.lit(" (ISSN: "), optional(issn), F.lit(")")), F.lit(""))


def galley_filename(article_id: Column, extension: Column) -> Column:
    return F.concat_ws(".", F.coalesce(article_id.cast("string"), F.lit(DEFAULT_ARTICLE_ID)), extension)


def package_filename(article_id: Column) -> Column:
    return F.concat(F.coalesce(article_id.cast("string"), F.lit(DEFAULT_ARTICLE_ID)), F.lit("_ojs_import.xml"))


def safe_name(name: Column) -> Column:
    """A name that stays in its folder: ``/``, ``\\`` and null characters as percent codes, names of dots only too; null if empty."""
    text = name.cast("string")
    for mark, code in (("/", "%2F"), ("\\", "%5C"), ("\0", "%00")):
        text = F.replace(text, F.lit(mark), F.lit(code))
    dots = F.when(text.rlike(r"^\.+$"), F.replace(text, F.lit("."), F.lit("%2E"))).otherwise(text)
    return F.when(dots != "", dots)


def noreply(journal_path: Column) -> Column:
    path = F.coalesce(journal_path.cast("string"), F.lit(DEFAULT_JOURNAL_PATH))
    return F.concat(F.lit("noreply@"), path, F.lit(".invalid"))


def join_names(names: Column) -> Column:
    """``a`` / ``a and b`` / ``a, b, and c``."""
    n = F.size(names)
    head = F.array_join(F.slice(names, F.lit(1), F.greatest(n - 1, F.lit(0))), ", ")
    return (
        F.when(n <= 0, "")
        .when(n == 1, F.try_element_at(names, F.lit(1)))
        .when(n == 2, F.array_join(names, " and "))
        .otherwise(F.concat(head, F.lit(", and "), F.try_element_at(names, F.lit(-1))))
    )


def keyword_line(keywords: Column) -> Column:
    return F.array_join(keywords, ", ")


def short_author(count: Column, first: Column, second: Column) -> Column:
    """In-text author: one name, two with ``&``, from three on the first and ``et al.``"""
    return (
        F.when(count == 1, first)
        .when(count == 2, F.concat_ws(" & ", first, second))
        .when(count >= 3, F.concat(first, F.lit(" et al.")))
    )


def bibliography_authors(names: Column) -> Column:
    """Reference-list authors: up to 20 in full, from 21 on the first 19, an ellipsis and the last."""
    n = F.size(names)
    last = F.try_element_at(names, F.lit(-1))
    head = F.array_join(F.slice(names, F.lit(1), F.greatest(n - 1, F.lit(0))), ", ")
    return (
        F.when(n <= 0, "")
        .when(n == 1, last)
        .when(n <= 20, F.concat(head, F.lit(", & "), last))
        .otherwise(F.concat(F.array_join(F.slice(names, 1, 19), ", "), F.lit(", . . . "), last))
    )


def year_letters(position: Column) -> Column:
    """a..z for 1..26, then aa, ab, ..., zz, aaa and so on, of any length."""

    def letter(n: Column) -> Column:
        return F.char(F.lit(97) + F.pmod(n - 1, F.lit(26)))

    def step(done: Column, _: Column) -> Column:
        left = done["left"]
        text = F.when(left > 0, F.concat(letter(left), done["text"])).otherwise(done["text"])
        return F.struct(F.when(left > 0, (left - 1 - F.pmod(left - 1, F.lit(26))) / 26).otherwise(0).cast("long").alias("left"), text.alias("text"))

    start = F.struct(position.cast("long").alias("left"), F.lit("").alias("text"))
    # fourteen letters hold every long
    long_ = F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, step, lambda d: d["text"])
    return F.when(position <= 26, letter(position)).otherwise(long_)


def is_blank(text: Column) -> Column:
    return strip(F.coalesce(text, F.lit(""))) == ""
