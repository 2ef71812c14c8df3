"""Body structure: headings, citations and link keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import strip
from quire.functions.values import let

# a fenced block is one piece; every other line is a piece of its own
_PIECES = r"(?m)(?s:^(?:```|~~~)[^\n]*\n.*?(?:^(?:```|~~~)[^\n]*(?:\n|\z)|\z))|[^\n]*\n|[^\n]+\z"
_HEADING = r"^#{1,6}[ \t]"
_UNNUMBERED = r"\{[^}]*(?:\.unnumbered|(?<=\{)-(?=\}))[^}]*\}[ \t]*$"

_CODE = r"(?s)^(?:```|~~~).*?^(?:```|~~~)|(`+)(?!`).+?(?<!`)\1(?!`)"
_KEY = r"(?<![\\\w.@])@(?:\{([^}\n]+)\}|([\p{L}\p{N}_](?:[:.#$%&\-+?<>~/]*+[\p{L}\p{N}_])*+))"
_CLUSTER = r"\[[^\[\]]*?" + _KEY + r"[^\[\]]*\]|" + _KEY


def split_sections(body: Column) -> Column:
    """Array of ``struct(level, title, unnumbered, text)``; text before the first heading has level 0.

    Heading marks inside fenced code do not count. A body without fences is cut
    at its headings; only one with fences is taken apart line by line.
    """

    def cut(pieces: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(1), F.size(pieces)), lambda i: F.element_at(pieces, i).rlike(_HEADING))
        starts = F.when(F.size(pieces) > 0, F.array_distinct(F.concat(F.array(F.lit(1)), heads)))
        return let(
            F.coalesce(starts, F.array().cast("array<int>")),
            lambda s: F.transform(
                s, lambda at, n: _section(pieces, at, F.coalesce(F.get(s, n + 1), F.size(pieces) + 1))
            ),
        )

    plain = F.transform(F.filter(F.split(body, r"(?m)^(?=#{1,6}[ \t])", -1), lambda p: p != ""), _piece)
    fenced = F.contains(body, F.lit("```")) | F.contains(body, F.lit("~~~"))
    return F.when(fenced, let(F.regexp_extract_all(body, F.lit(_PIECES), F.lit(0)), cut)).otherwise(plain)


def _piece(piece: Column) -> Column:
    """A section that is one text: its first line is the heading, if it is one."""
    first = F.substring_index(piece, "\n", 1)
    level = F.length(F.regexp_extract(first, r"^(#{1,6})[ \t]", 1))
    headed = level > 0
    return F.struct(
        level.alias("level"),
        F.when(headed, _title(first)).alias("title"),
        (headed & first.rlike(_UNNUMBERED)).alias("unnumbered"),
        F.when(headed, F.substring(piece, F.length(first) + 2, F.length(piece))).otherwise(piece).alias("text"),
    )


def _title(line: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(line, r"^#{1,6}[ \t]+", ""), r"\{[^}]*\}[ \t]*$", ""))


def _section(pieces: Column, at: Column, until: Column) -> Column:
    first = F.element_at(pieces, at)
    level = F.length(F.regexp_extract(first, r"^(#{1,6})[ \t]", 1))
    headed = level > 0
    line = F.regexp_replace(first, r"\n$", "")
    return F.struct(
        level.alias("level"),
        F.when(headed, _title(line)).alias("title"),
        (headed & line.rlike(_UNNUMBERED)).alias("unnumbered"),
        F.array_join(
            F.when(headed, F.slice(pieces, at + 1, until - at - 1)).otherwise(F.slice(pieces, at, until - at)), ""
        ).alias("text"),
    )


def sections(bodies: DataFrame, key: str = "manuscript_id", body: str = "body") -> DataFrame:
    """(key, pos, level, title, unnumbered, text), one row per section of the whole body."""
    cut = bodies.select(key, F.posexplode(split_sections(F.col(body))).alias("pos", "s"))
    return cut.select(key, "pos", "s.level", "s.title", "s.unnumbered", "s.text")


def section_tree(cut: DataFrame, key: str = "manuscript_id") -> DataFrame:
    """Headings of ``sections`` as a contents tree: adds ``parent``, ``number`` and ``path``.

    A heading's parent is the nearest one before it of a smaller level, by ``pos``; null at the top. ``path`` holds the titles
    from the top down to the heading. ``number`` counts numbered siblings, below the parent's number (``1.2.3``); headings
    marked unnumbered, and all below them, have none and aren't counted. What stands before the first heading is no row.

    One walk over an article's headings, collected in one row as its text was. ``contents`` gives the same from bodies.
    """
    rows = cut.where(F.col("level") > 0).groupBy(F.col(key).alias("__key"))
    heads = F.array_sort(F.collect_list(F.struct(*cut.columns)), lambda a, b: F.when(a["pos"] < b["pos"], -1).when(a["pos"] > b["pos"], 1).otherwise(0))
    types = {c: dict(cut.dtypes)[c] for c in cut.columns}
    return rows.agg(heads.alias("h")).select(F.explode(_tree(F.col("h"), types)).alias("t")).select("t.h.*", "t.parent", "t.number", "t.path")


def contents(bodies: DataFrame, key: str = "manuscript_id", body: str = "body") -> DataFrame:
    """``section_tree`` of the ``sections`` of bodies, made where the bodies are: no shuffle and no sorting."""
    cut = F.transform(
        split_sections(F.col(body)),
        lambda s, i: F.struct(i.alias("pos"), *[s[c].alias(c) for c in ("level", "title", "unnumbered", "text")]),
    )
    types = {"pos": "int", "level": "int", "title": "string", "unnumbered": "boolean", "text": "string"}
    tree = bodies.select(key, F.explode(_tree(F.filter(cut, lambda s: s["level"] > 0), types)).alias("t"))
    return tree.select(key, "t.h.*", "t.parent", "t.number", "t.path")


def _tree(heads: Column, types: dict[str, str]) -> Column:
    """Array of ``struct(h, parent, number, path)`` of an article's headings ``h`` in order.

    The stack holds the open headings below a root of level 0, each with how many numbered ones it has had so far. Only the
    start is cast, to types that allow nulls everywhere; in every step a cast would copy all that is there so far.
    """
    fields = ", ".join(f"`{c}`: {t}" for c, t in types.items())
    opened = f"struct<level: int, pos: {types['pos']}, numbered: int, number: string, path: array<string>>"
    made = f"array<struct<h: struct<{fields}>, parent: {types['pos']}, number: string, path: array<string>>>"
    root = F.struct(*[F.lit(v).alias(n) for n, v in (("level", 0), ("pos", None), ("numbered", 0), ("number", ""))], F.array().alias("path"))
    start = F.struct(F.array(root).cast(f"array<{opened}>").alias("stack"), F.array().cast(made).alias("out"))

    def step(done: Column, h: Column) -> Column:
        def under(stack: Column) -> Column:
            up = F.element_at(stack, -1)
            count = up["numbered"] + F.when(h["unnumbered"], 0).otherwise(1)
            own = F.concat(F.when(up["number"] == "", "").otherwise(F.concat(up["number"], F.lit("."))), count.cast("string"))
            row = F.struct(F.when(~h["unnumbered"], own).alias("number"), F.concat(up["path"], F.array(h["title"])).alias("path"))
            parent = F.struct(*[(count if n == "numbered" else up[n]).alias(n) for n in ("level", "pos", "numbered", "number", "path")])

            def grown(r: Column) -> Column:
                head = F.struct(h["level"].cast("int").alias("level"), h["pos"].alias("pos"), F.lit(0).alias("numbered"), r["number"].alias("number"), r["path"].alias("path"))
                line = F.struct(h.alias("h"), up["pos"].alias("parent"), r["number"].alias("number"), r["path"].alias("path"))
                return F.struct(
                    F.concat(F.slice(stack, 1, F.size(stack) - 1), F.array(parent, head)).alias("stack"),
                    F.concat(done["out"], F.array(line)).alias("out"),
                )

            return let(row, grown)

        return let(F.filter(done["stack"], lambda x: x["level"] < h["level"]), under)

    return F.aggregate(heads, start, step, lambda done: done["out"])


def extract_citations(bodies: DataFrame, key: str = "manuscript_id", body: str = "body") -> DataFrame:
    """(key, cluster_no, pos_in_cluster, cite_key, narrative, prefix) of every cited key.

    A bracket with at least one ``@key`` is a cluster; a bare ``@key`` is a
    narrative citation. Code is masked first, and the ``@`` of an email address
    does not count.
    """
    text = F.col(body)
    coded = F.contains(text, F.lit("`")) | F.contains(text, F.lit("~~~"))
    text = F.when(F.contains(text, F.lit("@")), text).otherwise("")  # nothing is cited without one
    masked = F.when(coded, F.regexp_replace(text, "(?m)" + _CODE, " ")).otherwise(text)
    clusters = bodies.select(
        key, F.posexplode(F.regexp_extract_all(masked, F.lit("(?U)" + _CLUSTER), F.lit(0))).alias("cluster_no", "c")
    )
    narrative = ~F.startswith(F.col("c"), F.lit("["))
    inside = F.when(narrative, F.col("c")).otherwise(F.expr("substring(c, 2, length(c) - 2)"))
    cited = F.filter(F.split(inside, ";", -1), lambda p: p.rlike("(?U)" + _KEY))
    keys = clusters.select(key, "cluster_no", narrative.alias("narrative"), F.posexplode(cited).alias("pos_in_cluster", "p"))
    braced, plain = (F.regexp_extract("p", "(?U)" + _KEY, g) for g in (1, 2))
    return keys.select(
        key,
        "cluster_no",
        "pos_in_cluster",
        F.when(braced != "", braced).otherwise(plain).alias("cite_key"),
        "narrative",
        strip(F.regexp_extract("p", r"(?sU)^(.*?)-?" + _KEY, 1)).alias("prefix"),
    )


def cited_set(citations: DataFrame, key: str = "manuscript_id") -> DataFrame:
    return citations.select(key, "cite_key").distinct()


def link_keys(pages: DataFrame, key: str, html: str, pattern: str = r'href="([^"]*)"') -> DataFrame:
    """(key, link, uses): how often each page uses each link target."""
    found = pages.select(key, F.explode(F.regexp_extract_all(html, F.lit(pattern), F.lit(1))).alias("link"))
    return found.groupBy(key, "link").agg(F.count(F.lit(1)).alias("uses"))
