"""BibTeX entries: key and type by expression, the field map by a small Arrow UDF."""

from __future__ import annotations

import itertools
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ENTRY_HEAD = r"(?s)^\s*@\s*(\w+)\s*[{(]\s*([^,\s})]*)"
_FIELD_START = re.compile(r"([A-Za-z][\w-]*)\s*=\s*")


def split_entries(text: Column) -> Column:
    """Array of entry texts; an entry opens with ``@`` at the start of a line."""
    pieces = F.split(text, r"(?m)^(?=[ \t]*@)", -1)
    return F.filter(pieces, lambda p: p.rlike(_ENTRY_HEAD) & ~p.rlike(r"(?i)^\s*@\s*(comment|string|preamble)\b"))


def entry_type(entry: Column) -> Column:
    return F.lower(F.regexp_extract(entry, _ENTRY_HEAD, 1))


def entry_key(entry: Column) -> Column:
    return F.regexp_extract(entry, _ENTRY_HEAD, 2)


_MARK = re.compile(r'\\.|["{},()#]', re.S)


def _value(text: str, at: int, closing: str) -> tuple[list[str], int]:
    """The parts that ``#`` joins to the value at ``at``, and where it ends: a comma or the entry's end outside braces and quotes."""
    depth, quoted, parts, start = 0, False, [], at
    for found in _MARK.finditer(text, at):
        mark = found.group()
        outside = depth == 0 and not quoted
        if mark == '"' and depth == 0:
            quoted = not quoted
        elif outside and mark in (closing, ","):
            return [*parts, text[start : found.start()]], found.start()
        elif outside and mark == "#":
            parts.append(text[start : found.start()])
            start = found.end()
        elif mark in "{}":
            depth += 1 if mark == "{" else -1
    return [*parts, text[start:]], len(text)


def _plain(part: str, strings: dict[str, str]) -> str:
    raw = part.strip()
    if len(raw) >= 2 and raw[0] + raw[-1] in ("{}", '""'):
        return raw[1:-1]
    return strings.get(raw.lower(), raw)


# a field whose value is one braced, quoted or bare piece without further marks: most are
_BRACED = r"\{([^{}\\]*(?:\{[^{}\\]*\}[^{}\\]*)*)\}"
_COMMON = {c: re.compile(rf',\s*([A-Za-z][\w-]*)\s*=\s*(?:{_BRACED}|"([^"{{}}\\]*)"|([^\s{{}}(),"#=\\]+))\s*(?=[,{c}])') for c in "})"}


def _fields(entry: str | None, strings: dict[str, str] | None = None, at: int | None = None) -> dict[str, str]:
    fields: dict[str, str] = {}
    entry, strings = entry or "", strings or {}
    opening = re.search(r"[{(]", entry)
    closing = ")" if opening and opening.group() == "(" else "}"
    common, at = _COMMON[closing], entry.find(",") if at is None else at
    while at >= 0:
        if found := common.match(entry, at):
            name, braced, quoted, bare = found.groups()
            value, at = braced if braced is not None else quoted if quoted is not None else strings.get(bare.lower(), bare), found.end()
        elif found := _FIELD_START.search(entry, at):
            name = found.group(1)
            parts, at = _value(entry, found.end(), closing)
            value = "".join([_plain(p, strings) for p in parts])
        else:
            break
        name = name.lower()
        if name not in fields:
            fields[name] = " ".join(value.split())
    return fields


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def bib_fields(entries: pd.Series) -> pd.Series:
    """Fields of each entry, names in lower case, one outer pair of braces or quotes removed."""
    return entries.map(_fields)


_START = re.compile(r"^[ \t]*@\s*(\w+)\s*[{(]\s*([^,\s})]*)", re.M)
_FIELDS = T.MapType(T.StringType(), T.StringType())
_ENTRIES = T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("type", T.StringType()), T.StructField("fields", _FIELDS)]))


def _entries(text: str | None) -> tuple[list[str], list[str], list[list[tuple[str, str]]]]:
    """(keys, types, fields) of a bibliography; ``@string`` names are replaced in what follows them."""
    keys, kinds, fields, strings = [], [], [], {}
    starts = [*_START.finditer(text or ""), None]
    for found, following in itertools.pairwise(starts):
        kind = found.group(1).lower()
        piece = text[found.start() : following.start() if following else len(text)]
        if kind == "string":
            strings |= {k: v for k, v in _fields(piece, strings, 0).items() if k not in strings}
        elif kind not in ("comment", "preamble"):
            keys.append(found.group(2))
            kinds.append(kind)
            fields.append(list(_fields(piece, strings).items()))
    return keys, kinds, fields


@F.arrow_udf(_ENTRIES)
def bib_entries(texts: pa.Array) -> pa.Array:
    """All entries of each bibliography in order, as flat arrays of a whole batch.

    An entry opens with ``@`` at the start of a line. Abbreviations that an ``@string`` defines stand for their text in all
    entries and abbreviations after it, alone or in a value joined with ``#``; unknown names stay as they are.
    """
    keys, kinds, names, values, per_text, per_entry = [], [], [], [], [0], [0]
    for text in texts.to_pylist():
        found = _entries(text)
        keys += found[0]
        kinds += found[1]
        for fields in found[2]:
            names += [k for k, _ in fields]
            values += [v for _, v in fields]
            per_entry.append(len(names))
        per_text.append(len(keys))
    maps = pa.MapArray.from_arrays(pa.array(per_entry, pa.int32()), pa.array(names, pa.string()), pa.array(values, pa.string()))
    rows = pa.StructArray.from_arrays([pa.array(keys, pa.string()), pa.array(kinds, pa.string()), maps], names=["key", "type", "fields"])
    return pa.ListArray.from_arrays(pa.array(per_text, pa.int32()), rows)


def bib_authors(field: Column) -> Column:
    """``array<struct<family,given>>`` of an author field; a braced name is one family name."""
    people = F.filter(F.split(F.coalesce(field, F.lit("")), r"\s+and\s+(?![^{}]*\})", -1), lambda p: F.trim(p) != "")

    def person(name: Column) -> Column:
        name = F.trim(name)
        comma = F.instr(name, ",") > 0
        braced = name.rlike(r"^\{.*\}$")
        family = (
            F.when(braced, F.regexp_replace(name, r"^\{|\}$", ""))
            .when(comma, F.trim(F.substring_index(name, ",", 1)))
            .otherwise(F.regexp_extract(name, r"(\S+)$", 1))
        )
        given = (
            F.when(braced, "")
            .when(comma, F.trim(F.substring(name, F.instr(name, ",") + 1, F.length(name))))
            .otherwise(F.trim(F.regexp_replace(name, r"\S+$", "")))
        )
        return F.struct(family.alias("family"), given.alias("given"))

    return F.transform(people, person)
