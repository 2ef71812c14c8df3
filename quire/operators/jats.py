"""Archival article XML: which front-matter elements exist, which are wanted, adding the missing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import escape_xml, strip
from quire.functions.values import article_type_attr, license_sentence, optional
from quire.functions.xml import front_tokens

SCOPES = ("journal-meta", "article-meta")


def jats_elements(articles: DataFrame, key: str = "manuscript_id", xml: str = "xml") -> DataFrame:
    """(key, parent, tag, attrs, text, ord, namespace): one row per element inside the two metadata scopes.

    An XML parser reads them, so quotes, entities, CDATA and comments count for what they are; articles that are not
    well-formed have no rows here and one in ``jats_errors``.
    """
    parsed = articles.select(key, front_tokens(F.col(xml), SCOPES).alias("t"))
    flat = parsed.select(key, F.posexplode("t.elements").alias("ord", "e"))
    return flat.select(key, "e.parent", "e.tag", "e.attrs", "e.text", "ord", "e.namespace")


def jats_errors(articles: DataFrame, key: str = "manuscript_id", xml: str = "xml") -> DataFrame:
    """(key, error) of articles that can't be read or hold no ``article`` element."""
    parsed = articles.select(key, front_tokens(F.col(xml), SCOPES).alias("t"))
    return parsed.select(key, _error(F.col("t")).alias("error")).where("error is not null")


def _error(tokens: Column) -> Column:
    return F.coalesce(tokens["error"], F.when(tokens.isNotNull() & tokens["article"].isNull(), "No <article> element found — not a JATS file?"))


# --- wanted elements ---------------------------------------------------------

# (element looked for, attribute value it is told apart by, scope, place); "before:x" falls back to the
# scope's first or last position, as given after the slash
_PLACES = {
    "journal-title": ("journal-meta", None, "first"),
    "issn": ("journal-meta", None, "last"),
    "publisher": ("journal-meta", None, "last"),
    "article-id": ("article-meta", ("pub-id-type", "doi"), "first"),
    "article-categories": ("article-meta", None, "before:title-group/first"),
    "volume": ("article-meta", None, "last"),
    "elocation-id": ("article-meta", None, "last"),
    "permissions": ("article-meta", None, "last"),
    "abstract": ("article-meta", ("abstract-type", "summary"), "before:kwd-group/last"),
    "custom-meta-group": ("article-meta", None, "last"),
}


def _tag(name: str, inner: Column, attrs: str = "") -> Column:
    return F.concat(F.lit(f"<{name}{attrs}>"), inner, F.lit(f"</{name}>"))


def _wanted_xml(pub: Column, earned: Column) -> dict[str, Column]:
    """XML of each wanted element; null when its value is empty."""

    def value(name: str) -> Column:
        return escape_xml(optional(pub[name]))

    def subject(kind: str, name: str) -> Column:
        group = _tag("subj-group", _tag("subject", value(name)), f' subj-group-type="{kind}"')
        return F.coalesce(group, F.lit(""))

    def custom(name: str, text: Column) -> Column:
        meta = F.concat(_tag("meta-name", F.lit(name)), _tag("meta-value", escape_xml(text)))
        return F.coalesce(_tag("custom-meta", meta), F.lit(""))

    subjects = F.concat(subject("heading", "article_type"), subject("subject", "discipline"))
    href = F.coalesce(F.concat(F.lit(' xlink:href="'), value("license_url"), F.lit('"')), F.lit(""))
    sentence = _tag("license-p", escape_xml(license_sentence(pub["license"])))
    licence = F.concat(F.lit("<license"), href, F.lit(">"), sentence, F.lit("</license>"))
    lay = escape_xml(F.when(F.col("__lay"), strip(pub["lay_summary"])))
    extras = F.concat(
        custom("open-science-badges", optional(earned)),
        custom("recommended-citation", strip(optional(pub["recommended_citation"]))),
    )
    return {
        "journal-title": _tag("journal-title-group", _tag("journal-title", value("journal"))),
        "issn": _tag("issn", value("issn")),
        "publisher": _tag("publisher", _tag("publisher-name", value("publisher"))),
        "article-id": _tag("article-id", value("doi"), ' pub-id-type="doi"'),
        "article-categories": _tag("article-categories", optional(subjects)),
        "volume": _tag("volume", value("volume")),
        "elocation-id": _tag("elocation-id", value("article_id")),
        "permissions": _tag("permissions", licence),
        "abstract": _tag(
            "abstract", F.concat(_tag("title", F.lit("Lay Summary")), _tag("p", lay)), ' abstract-type="summary"'
        ),
        "custom-meta-group": _tag("custom-meta-group", optional(extras)),
    }


def jats_front(meta: DataFrame, earned: Column, key: str = "manuscript_id") -> DataFrame:
    """(key, ord, parent, tag, place, attr_name, attr_value, xml): the wanted element rows of each article.

    Publication fields come from the struct column ``pub``; ``earned`` is the
    badge list of the article.
    """
    lay = F.coalesce(F.col("pub")["lay_summary"] != "", F.lit(False))
    xml = _wanted_xml(F.col("pub"), earned)
    entries = []
    for ord_, (tag, (parent, attr, place)) in enumerate(_PLACES.items()):
        row = F.struct(
            F.lit(ord_).alias("ord"),
            F.lit(parent).alias("parent"),
            F.lit(tag).alias("tag"),
            F.lit(place).alias("place"),
            F.lit(attr and attr[0]).cast("string").alias("attr_name"),
            F.lit(attr and attr[1]).cast("string").alias("attr_value"),
            xml[tag].alias("xml"),
        )
        entries.append(F.when(xml[tag].isNotNull(), row))
    return meta.withColumn("__lay", lay).select(key, F.inline(F.array_compact(F.array(*entries))))


def insert_if_absent(existing: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All existing rows plus the wanted rows whose keys none of them has; applying it twice changes nothing."""
    new = wanted.join(existing.select(*keys), list(keys), "left_anti")
    return existing.unionByName(new)


def missing_elements(existing: DataFrame, wanted: DataFrame, key: str = "manuscript_id") -> DataFrame:
    """Wanted rows that are absent from the article, told apart by an attribute where the rule says so."""
    have = existing.select(
        key,
        "parent",
        "tag",
        F.explode(F.concat(F.array(F.struct(F.lit("").alias("key"), F.lit("").alias("value"))), F.map_entries(F.coalesce("attrs", F.create_map().cast("map<string,string>"))))).alias("attr"),
    ).select(key, "parent", "tag", F.col("attr.key").alias("attr_name"), F.col("attr.value").alias("attr_value")).distinct()
    lookup = wanted.withColumns({c: F.coalesce(c, F.lit("")) for c in ("attr_name", "attr_value")})
    return lookup.join(have, [key, "parent", "tag", "attr_name", "attr_value"], "left_anti")


# --- whole documents ----------------------------------------------------------


def _edit(start: Column, end: Column, rank: int, text: Column) -> Column:
    return F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), text.cast("binary").alias("text"))


def _like(elements: Column, tag: str, attr: tuple[str, str] | None = None) -> Column:
    """The elements of a name, and of an attribute's value where one is given."""

    def same(e: Column) -> Column:
        named = e["tag"] == tag
        return named if attr is None else named & F.coalesce(F.element_at(e["attrs"], F.lit(attr[0])) == attr[1], F.lit(False))

    return F.filter(elements, same)


def _edits(wanted: dict[str, Column], tokens: Column, scope: str) -> list[Column]:
    """Edits that put the missing elements of a scope in their places; null where there is nothing to do."""
    own = {tag: (attr, place) for tag, (parent, attr, place) in _PLACES.items() if parent == scope}
    there = F.get(F.filter(tokens["scopes"], lambda s: s["name"] == scope), 0)
    inside = F.filter(tokens["elements"], lambda e: e["parent"] == scope)
    edits, head, tail = [], [], []
    for tag, (attr, place) in own.items():
        piece = F.when(F.size(_like(inside, tag, attr)) == 0, wanted[tag])
        if place.startswith("before:"):
            target, place = place.removeprefix("before:").split("/")
            at = F.get(_like(inside, target), 0)["start"]
            edits.append(F.when(at.isNotNull() & piece.isNotNull(), _edit(at, at, 1, piece)))
            piece = F.when(at.isNull(), piece)
        head, tail = ([piece, *head], tail) if place == "first" else (head, [*tail, piece])
    first, last = F.concat_ws("", *head), F.concat_ws("", *tail)
    whole = F.concat(F.lit(">"), first, last, F.lit(f"</{scope}>"))
    closed, new = there["closed"], F.concat(first, last) != ""
    return [
        *edits,
        F.when(~closed & (first != ""), _edit(there["inside"], there["inside"], 0, first)),
        F.when(~closed & (last != ""), _edit(there["until"], there["until"], 2, last)),
        F.when(closed & new, _edit(there["inside"] - 2, there["inside"], 0, whole)),
    ]


def _applied(text: Column, edits: Column) -> Column:
    """The text with all edits made; they don't overlap."""
    data = text.cast("binary")

    def step(done: Column, e: Column) -> Column:
        before = F.substring(data, done["at"] + 1, e["start"] - done["at"])
        return F.struct(F.concat(done["out"], before, e["text"]).alias("out"), e["end"].alias("at"))

    start = F.struct(F.lit(b"").alias("out"), F.lit(0).alias("at"))
    rest = lambda done: F.concat(done["out"], F.substring(data, done["at"] + 1, F.octet_length(data)))
    return F.aggregate(F.array_sort(edits), start, step, rest).cast("string")


def enrich_jats(articles: DataFrame, earned: Column, xml: str = "xml", pub: str = "pub") -> DataFrame:
    """Add the missing front-matter elements to each article's XML and set its article type.

    Elements that are there are never touched, also the closing badge group, so
    a second run changes nothing. Without ``journal-meta`` its part is skipped,
    without ``article-meta`` the rest; a text that is not well-formed, or has no
    ``<article>``, stays as it is and ``jats_error`` says why. The XML parser gives
    offsets only; the text is put together by expressions and never shuffled.
    """
    wanted_cols = _wanted_xml(F.col(pub), earned)
    names = {tag: f"__w_{i}" for i, tag in enumerate(wanted_cols)}
    lay = F.coalesce(F.col(pub)["lay_summary"] != "", F.lit(False))
    staged = articles.withColumn("__t", front_tokens(F.col(xml), SCOPES)).withColumn("__lay", lay)
    staged = staged.withColumns({names[t]: c for t, c in wanted_cols.items()})
    wanted, tokens = {t: F.col(names[t]) for t in wanted_cols}, F.col("__t")
    kind = escape_xml(article_type_attr(F.col(pub)["article_type"]))
    typed = _edit(tokens["article"], tokens["article"], 0, F.concat(F.lit(' article-type="'), kind, F.lit('"')))
    untyped = _edit(tokens["kind_start"], tokens["kind_end"], 1, F.lit(""))
    edits = [F.when(kind.isNotNull(), typed), F.when(kind.isNotNull() & tokens["kind_start"].isNotNull(), untyped)]
    for scope in SCOPES:
        edits += _edits(wanted, tokens, scope)
    error = _error(tokens)
    staged = staged.withColumn("__e", F.array_compact(F.array(*edits)))
    out = F.when(error.isNull() & (F.size("__e") > 0), _applied(F.col(xml), F.col("__e"))).otherwise(F.col(xml))
    kept = [c for c in articles.columns if c not in (xml, "jats_error")]
    return staged.select(*kept, out.alias(xml), error.alias("jats_error"))
