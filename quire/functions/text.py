"""Text functions over whole documents: white space, front matter, macros, names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.profile import DOCUMENT_START, WHITESPACE, WHITESPACE_CHARACTERS

_WS = WHITESPACE
_FRONT_MATTER = rf"(?s)^---{_WS}*\n(.*?)\n---{_WS}*\n"
# runs that are more than one space, so that most spaces of a text are no match
_RUNS = rf"[{_WS}&&[^ ]]{_WS}*| {_WS}+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where lambdas inside use it many times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    """Remove Unicode white space at both ends (``trim`` only knows the space)."""
    return F.btrim(text, F.lit(WHITESPACE_CHARACTERS))


def collapse_ws(text: Column) -> Column:
    """Every run of white space becomes one space; none at the ends."""
    return F.trim(F.regexp_replace(text, _RUNS, " "))


def unix_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def split_front_matter(text: Column) -> Column:
    """``struct(front_matter, body)``; front_matter is null when the text has none.

    The block opens at the first character, ends at the first ``---`` line and
    that line must be followed by a newline.
    """
    whole = F.regexp_extract(text, _FRONT_MATTER, 0)
    found = F.length(whole) > 0
    return F.struct(
        F.when(found, F.regexp_extract(text, _FRONT_MATTER, 1)).alias("front_matter"),
        F.when(found, F.substring(text, F.length(whole) + 1, F.length(text))).otherwise(text).alias("body"),
    )


def has_latex_document(text: Column) -> Column:
    return F.contains(text, F.lit(DOCUMENT_START))


def macro_argument(tex: Column, macro: str) -> Column:
    """Brace-balanced argument of the first ``\\macro{...}``, white space collapsed; null when absent.

    The text is cut at its closing braces: the argument ends at the first cut by
    which as many braces have closed as have opened. Most arguments end within a
    few cuts, so the rest of the text is left in one piece unless they don't. A
    brace that never closes takes everything up to the character before the last.
    """
    opening = f"\\{macro}{{"
    at = F.instr(tex, opening)

    def within(rest: Column, cuts: int) -> Column:
        """Characters of the argument if it ends within so many cuts, else null."""

        def step(state: Column, piece: Column) -> Column:
            length = F.length(piece)
            depth = state["depth"] + length - F.length(F.replace(piece, F.lit("{"), F.lit(""))) - 1
            used = state["used"] + length
            more = F.struct(depth.alias("depth"), F.when(depth > 0, used + 1).otherwise(used).alias("used"))
            return F.when(state["depth"] == 0, state).otherwise(more)

        start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("used"))
        # the last piece is what follows the last cut, not something that a brace closes
        closed = let(F.split(rest, r"\}", cuts), lambda p: F.slice(p, F.lit(1), F.size(p) - 1))
        return F.aggregate(closed, start, step, lambda s: F.when(s["depth"] == 0, s["used"]))

    def argument(rest: Column) -> Column:
        size = F.coalesce(within(rest, 64), within(rest, -1), F.greatest(F.length(rest) - 1, F.lit(0)))
        return collapse_ws(F.substring(rest, F.lit(1), size))

    return F.when(at > 0, let(F.substring(tex, at + len(opening), F.length(tex)), argument))


def split_keywords(text: Column) -> Column:
    """Items between commas or semicolons, stripped; empty items stay."""
    return F.transform(F.split(text, "[,;]", -1), strip)


def split_name(name: Column) -> Column:
    """``struct(given, family, name)`` of a one-string name: the last token is the family name."""
    tokens = F.split(strip(name), rf"{_WS}+", -1)
    several = F.size(tokens) >= 2
    return F.struct(
        F.when(several, F.array_join(F.slice(tokens, F.lit(1), F.size(tokens) - 1), " ")).otherwise("").alias("given"),
        F.when(several, F.element_at(tokens, -1)).otherwise(name).alias("family"),
        name.alias("name"),
    )


def rewrite_links(body: Column, replacements: Column) -> Column:
    """Replace each key of the map by its value, one after the other in map order."""
    return F.aggregate(
        F.coalesce(F.map_entries(replacements), F.array()),
        body,
        lambda text, pair: F.replace(text, pair["key"], pair["value"]),
    )


def normalize_doi(text: Column) -> Column:
    """Bare lower-case DOI: resolver address and ``doi:`` prefix removed."""
    bare = F.regexp_replace(F.lower(strip(text)), r"^(?:https?://(?:dx\.)?doi\.org/|doi\.org/|doi:\s*)", "")
    return F.when(bare != "", bare)


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """Substitute ``{name}`` marks; a mark without a value becomes empty."""
    out = template
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def escape_xml(text: Column) -> Column:
    out = F.replace(text.cast("string"), F.lit("&"), F.lit("&amp;"))
    for mark, entity in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(mark), F.lit(entity))
    return out


def decoded(content: Column) -> Column:
    """Bytes as text; bytes that aren't UTF-8 are left out."""
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.replace(F.make_valid_utf8(text), F.lit("\ufffd"), F.lit("")))


def normal_path(path: Column) -> Column:
    """A relative path without ``.`` and ``..`` steps, doubled slashes and percent codes."""
    plain = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)

    def step(done: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(done) > 0) & (F.coalesce(F.get(done, F.size(done) - 1), F.lit("..")) != "..")
        return F.when(part.isin("", "."), done).when(up, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(F.concat(done, F.array(part)))

    return F.aggregate(F.split(plain, "/"), F.array().cast("array<string>"), step, lambda parts: F.array_join(parts, "/"))
