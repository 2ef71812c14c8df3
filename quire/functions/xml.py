"""Front matter of article XML, read by a real XML parser: elements with attributes, texts and byte offsets."""

from __future__ import annotations

import re
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_OPENING = re.compile(rb"""<[^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*>""")
_ATTRIBUTE = re.compile(rb"""\s+([^\s=]+)\s*=\s*(?:"[^"]*"|'[^']*')""")

ELEMENT = "struct<parent:string,tag:string,namespace:string,attrs:map<string,string>,text:string,start:int,depth:int>"
_PORTION = 256  # texts
SCOPE = "struct<name:string,start:int,inside:int,until:int,closed:boolean>"
TOKENS = f"struct<error:string,article:int,kind_start:int,kind_end:int,scopes:array<{SCOPE}>,elements:array<{ELEMENT}>>"

_ELEMENT = pa.struct([
    ("parent", pa.string()), ("tag", pa.string()), ("namespace", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())),
    ("text", pa.string()), ("start", pa.int32()), ("depth", pa.int32()),
])
_SCOPE = pa.struct([("name", pa.string()), ("start", pa.int32()), ("inside", pa.int32()), ("until", pa.int32()), ("closed", pa.bool_())])
_TOKENS = pa.struct([
    ("error", pa.string()), ("article", pa.int32()), ("kind_start", pa.int32()), ("kind_end", pa.int32()),
    ("scopes", pa.list_(_SCOPE)), ("elements", pa.list_(_ELEMENT)),
])


class _Reader:
    """Handlers of one document: keeps the first ``article`` and the first element of each scope."""

    def __init__(self, data: bytes, scopes: tuple[str, ...]) -> None:
        self.data, self.wanted = data, scopes
        self.article: dict | None = None
        self.scopes: dict[str, dict] = {}
        self.elements: list[dict] = []
        self.open: list[tuple[str, dict[str, str], dict | None, dict | None]] = []  # (tag, namespaces, scope begun here, element)
        self.inside: dict | None = None
        self.parser = expat.ParserCreate("utf-8")
        self.parser.buffer_text = True
        self.parser.StartElementHandler = self.start
        self.parser.EndElementHandler = self.end
        self.parser.CharacterDataHandler = self.text

    def _opening(self) -> tuple[int, bytes]:
        at = self.parser.CurrentByteIndex
        found = _OPENING.match(self.data, at)
        if found is None:
            raise ValueError("an element comes from an entity")
        return at, found.group()

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        above = self.open[-1][1] if self.open else {}
        declared = {a.partition(":")[2]: v for a, v in attrs.items() if a == "xmlns" or a.startswith("xmlns:")}
        names = above | declared if declared else above
        scope = element = None
        if self.inside is not None:
            prefix = tag.partition(":")[0] if ":" in tag else ""
            element = {"parent": self.inside["name"], "tag": tag, "namespace": names.get(prefix) or None, "attrs": list(attrs.items()), "text": "", "start": self._opening()[0], "depth": len(self.open) - self.inside["level"]}
            self.elements.append(element)
        elif tag in self.wanted and tag not in self.scopes:
            at, opening = self._opening()
            scope = {"name": tag, "start": at, "inside": at + len(opening), "closed": opening.endswith(b"/>"), "level": len(self.open)}
            self.scopes[tag] = self.inside = scope
        if tag == "article" and self.article is None:
            at, opening = self._opening()
            kind = next((m for m in _ATTRIBUTE.finditer(opening) if m.group(1) == b"article-type"), None)
            self.article = {"at": at + len(b"<article"), "kind": (at + kind.start(), at + kind.end()) if kind else (None, None)}
        if self.open and self.open[-1][3] is not None:
            self.open[-1][3]["mixed"] = True  # its text ends at its first child
        self.open.append((tag, names, scope, element))

    def end(self, tag: str) -> None:
        _, _, scope, _ = self.open.pop()
        if scope is not None:
            scope["until"] = scope["inside"] if scope["closed"] else self.parser.CurrentByteIndex
            self.inside = None

    def text(self, data: str) -> None:
        element = self.open[-1][3] if self.open else None
        if element is not None and "mixed" not in element:
            element["text"] += data


def front_of(data: bytes, scopes: tuple[str, ...]) -> dict:
    """Tokens of one document; ``error`` and nothing else if it is not well-formed."""
    nothing = dict.fromkeys(("error", "article", "kind_start", "kind_end", "scopes", "elements"))
    reader = _Reader(data, scopes)
    try:
        reader.parser.Parse(data, True)
    except (expat.ExpatError, ValueError) as problem:
        return nothing | {"error": str(problem)}
    article = reader.article or {"at": None, "kind": (None, None)}
    return {
        "error": None, "article": article["at"], "kind_start": article["kind"][0], "kind_end": article["kind"][1],
        "scopes": list(reader.scopes.values()), "elements": reader.elements,
    }


def tokens_of(texts: pa.Array, scopes: tuple[str, ...]) -> pa.Array:
    """Tokens of a batch; Python's objects, many times the size of their text, are of a portion of it, the rest is Arrow."""
    parts = (texts.slice(i, _PORTION).to_pylist() for i in range(0, max(1, len(texts)), _PORTION))
    return pa.concat_arrays([pa.array([None if t is None else front_of(t.encode(), scopes) for t in part], _TOKENS) for part in parts])


def front_tokens(xml: Column, scopes: tuple[str, ...]) -> Column:
    """``struct(error, article, kind_start, kind_end, scopes, elements)`` of an XML text, in Arrow batches; null for null.

    ``elements`` are those inside the first element of each scope name, at any depth, in order: entities, character
    references and CDATA are text, comments and processing instructions are nothing, a repeated attribute is an error.
    ``text`` is what stands before an element's first child; ``namespace`` follows the declarations in force. Offsets count
    bytes of UTF-8: of an element's ``<``; of a scope's content (``inside`` to ``until``; ``closed`` means ``<x/>``); behind
    the name in the opening tag of ``article``, and of its article-type attribute with the space before it.
    """

    @F.arrow_udf(TOKENS)
    def tokens(texts: pa.Array) -> pa.Array:
        return tokens_of(texts, scopes)

    return tokens(xml.cast("string"))
