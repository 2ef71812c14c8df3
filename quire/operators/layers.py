"""Layered metadata: journal theme < editors' registry < authors' front matter."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire import profile as fixed
from quire.functions.text import fill_template
from quire.functions.values import footer_line, let, locale_of, or_default
from quire.functions.yaml import yaml_nodes
from quire.operators.skew import number_rows
from quire.profile import DEFAULT_HOMEPAGE, Profile

SEP = "\x1f"


def parse_layer(texts: DataFrame, text: str, key: str) -> DataFrame:
    """(key, nodes, error) of a YAML text column; unreadable YAML leaves no nodes and says why."""
    return texts.select(key, yaml_nodes(F.col(text)).alias("y")).select(key, "y.nodes", "y.error")


# --- layers in one row -------------------------------------------------------


def _tagged(nodes: Column, rank: int) -> Column:
    """Nodes with their layer's rank and a prefix-comparable path key."""
    return F.transform(
        F.coalesce(nodes, F.array()),
        lambda n: F.struct(
            F.lit(rank).alias("rank"),
            F.concat(F.array_join(n["path"], SEP), F.lit(SEP)).alias("key"),
            n["path"].alias("path"),
            n["kind"].alias("kind"),
            n["value_json"].alias("value_json"),
            n["ord"].alias("ord"),
        ),
    )


def _cut_off(everything: Column, n: Column) -> Column:
    """A higher layer has something other than a map above this node."""
    return F.exists(
        everything,
        lambda h: (h["rank"] > n["rank"])
        & (h["kind"] != "map")
        & (F.length(h["key"]) < F.length(n["key"]))
        & F.startswith(n["key"], h["key"]),
    )


def _replaced(placed: Column, n: Column) -> Column:
    """A higher layer has a node at this path, unless both are maps."""
    return F.exists(
        placed,
        lambda h: (h["rank"] > n["rank"]) & (h["key"] == n["key"]) & ((h["kind"] != "map") | (n["kind"] != "map")),
    )


def _first_seen(placed: Column, n: Column) -> Column:
    same = F.filter(placed, lambda m: m["key"] == n["key"])
    return F.array_min(F.transform(same, lambda m: F.struct(m["rank"].alias("r"), m["ord"].alias("o"))))


def _merged(placed: Column, alive: Column) -> Column:
    winners = F.filter(alive, lambda n: ~F.exists(alive, lambda h: (h["key"] == n["key"]) & (h["rank"] > n["rank"])))

    def value(n: Column) -> Column:
        # a merged map is empty only when every layer's map at the path is
        filled = F.exists(alive, lambda h: (h["key"] == n["key"]) & h["value_json"].isNull())
        return F.when(~((n["kind"] == "map") & filled), n["value_json"])

    ordered = F.array_sort(
        F.transform(
            winners,
            lambda n: F.struct(
                _first_seen(placed, n).alias("seen"),
                n["path"].alias("path"),
                F.array_join(n["path"], SEP).alias("key"),
                n["kind"].alias("kind"),
                value(n).alias("value_json"),
            ),
        )
    )
    return F.transform(
        ordered,
        lambda n, i: F.struct(n["path"], n["key"], n["kind"], n["value_json"], i.cast("int").alias("ord")),
    )


def merge_nodes(*layers: Column) -> Column:
    """Deep merge of node arrays, later layers winning, as one array in merged key order.

    A node is masked by a higher layer's non-map node at its path or above it,
    and a non-map node also by a higher layer's map at its path. Nodes that are
    not cut off from above decide the key order, replaced ones too. Everything
    happens inside the row: one article's metadata is a few dozen nodes, and no
    shuffle is needed.
    """
    everything = F.concat(*[_tagged(layer, rank) for rank, layer in enumerate(layers)])
    return let(
        everything,
        lambda every: let(
            F.filter(every, lambda n: ~_cut_off(every, n)),
            lambda placed: let(
                F.filter(placed, lambda n: ~_replaced(placed, n)), lambda alive: _merged(placed, alive)
            ),
        ),
    )


def theme_for(manuscripts: DataFrame, themes: DataFrame) -> DataFrame:
    """Attach the journal's default nodes; Spark broadcasts the themes if their size in bytes allows it."""
    return manuscripts.join(themes.withColumnRenamed("nodes", "theme_nodes"), ["theme"], "left")


def merge_metadata(manuscripts: DataFrame, themes: DataFrame, registry: DataFrame, front: DataFrame) -> DataFrame:
    """(manuscript_id, theme, nodes, error) of (manuscript_id, theme) manuscripts.

    ``themes`` is (theme, nodes); ``registry`` and ``front`` are (manuscript_id,
    nodes, error). A layer that could not be read puts its reason in ``error``.
    """
    layered = (
        theme_for(manuscripts, themes.select("theme", "nodes"))
        .join(registry.select("manuscript_id", F.col("nodes").alias("r_nodes"), F.col("error").alias("r_error")), ["manuscript_id"], "left")
        .join(front.select("manuscript_id", F.col("nodes").alias("f_nodes"), F.col("error").alias("f_error")), ["manuscript_id"], "left")
    )
    return layered.select(
        "manuscript_id",
        "theme",
        merge_nodes(F.col("theme_nodes"), F.col("r_nodes"), F.col("f_nodes")).alias("nodes"),
        F.coalesce("r_error", "f_error").alias("error"),
    )


# --- layers as rows ----------------------------------------------------------


def union_layers(*layers: DataFrame) -> DataFrame:
    """Node rows of several layers, ranked in the given order."""
    out = None
    for rank, layer in enumerate(layers):
        ranked = layer.withColumn("rank", F.lit(rank))
        out = ranked if out is None else out.unionByName(ranked)
    return out


def merge_rows(nodes: DataFrame, key: str = "manuscript_id") -> DataFrame:
    """The merge of :func:`merge_nodes` on (key, rank, path, kind, value_json) rows; maps are rows too.

    Works per (key, path) instead of per key, so a key with very many nodes
    spreads over tasks. Only paths that are a map in one layer and something
    else in another can cut nodes off, which leaves a short table to look
    prefixes up in; the aggregate after that look-up keeps the partitioning of
    the first one.

    With a column ``ord``, each layer's own node order, the result has an ``ord``
    too: the merged key order, from 0. A path stands where the first layer that
    has it, and isn't cut off from above, put it, also where a later layer
    replaced it. Places are numbered range by range (``number_rows``), so a key
    with very many nodes is numbered by many tasks.
    """
    ordered = "ord" in nodes.columns
    place = F.col("ord") if ordered else F.lit(0)
    at = F.concat(F.array_join("path", SEP), F.lit(SEP))
    by_path = (
        nodes.groupBy(key, at.alias("at"))
        .agg(F.first("path").alias("path"), F.collect_set(F.struct("rank", "kind", "value_json", place.alias("ord"))).alias("versions"))
        .withColumn("leaf_rank", _top_rank(lambda v: v["kind"] != "map"))
        .withColumn("map_rank", _top_rank(lambda v: v["kind"] == "map"))
    )
    both = F.col("leaf_rank").isNotNull() & F.col("map_rank").isNotNull()
    cuts = by_path.filter(both).select(key, F.col("at").alias("above"), F.col("leaf_rank").alias("cut"))
    above = F.transform(
        F.when(F.size("path") > 1, F.sequence(F.lit(1), F.size("path") - 1)),
        lambda d: F.concat(F.array_join(F.slice("path", F.lit(1), d), SEP), F.lit(SEP)),
    )
    looked_up = by_path.withColumn("above", F.explode_outer(above)).join(cuts, [key, "above"], "left")
    kept = [F.first(c).alias(c) for c in ("path", "versions", "leaf_rank", "map_rank")]
    masked = looked_up.groupBy(key, "at").agg(*kept, F.max("cut").alias("cut"))

    def survives(v: Column) -> Column:
        hidden = v["rank"] < F.greatest("cut", "leaf_rank")
        replaced = (v["kind"] != "map") & (v["rank"] < F.col("map_rank"))
        return ~F.coalesce(hidden, F.lit(False)) & ~F.coalesce(replaced, F.lit(False))

    placed = F.filter("versions", lambda v: v["rank"] >= F.coalesce("cut", v["rank"]))
    seen = F.array_min(F.transform(placed, lambda v: F.struct(v["rank"].alias("r"), v["ord"].alias("o"))))
    merged = masked.withColumn("best", F.array_max(F.filter("versions", survives))).withColumn("seen", seen)
    alive = merged.filter(F.col("best").isNotNull())
    out = [key, "path", F.col("best.rank").alias("rank"), F.col("best.kind").alias("kind"), F.col("best.value_json").alias("value_json")]
    if not ordered:
        return alive.select(*out)
    numbered = number_rows(alive.select(*out, "seen", "at"), [key], [F.col("seen.r"), F.col("seen.o"), F.col("at")], "__place")
    return numbered.withColumn("ord", F.col("__place") - 1).drop("__place", "seen", "at")


def _top_rank(which: Callable[[Column], Column]) -> Column:
    return F.array_max(F.transform(F.filter("versions", which), lambda v: v["rank"]))


def theme_rank(nodes: DataFrame, key: str = "manuscript_id") -> DataFrame:
    """(key, path, rank): the highest layer that sets each path, masks not considered.

    Rows are dealt out first: layers lie in different tasks, so combining before the shuffle would only hold nearly all
    paths of a task in memory.
    """
    return nodes.select(key, "path", "rank").repartition(key, "path").groupBy(key, "path").agg(F.max("rank").alias("rank"))


# --- lookups -----------------------------------------------------------------


def node_key(dotted: str) -> str:
    return SEP.join(dotted.split("."))


def node_at(nodes: Column, dotted: str) -> Column:
    """The merged node at ``a.b.c`` or null; parts are map keys, so a dot inside a key never matches."""
    wanted = node_key(dotted)
    return F.try_element_at(F.filter(nodes, lambda n: n["key"] == wanted), F.lit(1))


def json_at(nodes: Column, dotted: str) -> Column:
    """JSON text of the node at a dotted path."""
    return node_at(nodes, dotted)["value_json"]


def json_lookup(json: Column, dotted: str) -> Column:
    """Scalar text at a dotted path of a JSON document; each part is a key, not a pattern."""
    path = "$" + "".join(f'["{part}"]' for part in dotted.split("."))
    return F.try_variant_get(F.try_parse_json(json), path, "string")


def json_text(kind: Column, value_json: Column) -> Column:
    """A scalar node as text, as Python's ``str`` would show it; null for null, maps and lists."""
    return (
        F.when(kind.isin("str", "date"), F.get_json_object(F.concat(F.lit('{"v":'), value_json, F.lit("}")), "$.v"))
        .when(kind == "bool", F.initcap(value_json))
        .when(kind.isin("int", "float"), value_json)
    )


def get_path(nodes: Column, dotted: str) -> Column:
    """Scalar text at a dotted path."""
    return let(node_at(nodes, dotted), lambda n: json_text(n["kind"], n["value_json"]))


def children(nodes: Column, parent: Sequence[str]) -> Column:
    """Direct children of a map node, in merged key order."""
    above = SEP.join(parent) + SEP
    return F.filter(nodes, lambda n: (F.size(n["path"]) == len(parent) + 1) & F.startswith(n["key"], F.lit(above)))


def list_texts(node: Column) -> Column:
    """Items of a list node as text; a single scalar counts as a one-item list."""

    def texts(n: Column) -> Column:
        scalar = F.coalesce(json_text(n["kind"], n["value_json"]), F.lit(""))
        return F.when(n["kind"] == "list", F.from_json(n["value_json"], "array<string>")).otherwise(
            F.array_compact(F.array(F.when(scalar != "", scalar)))
        )

    return let(node, texts)


_OWN = (
    "journal", "issn", "publisher", "homepage", "volume", "year", "article-id", "doi", "article-type",
    "discipline", "running-head", "lay-summary", "recommended-citation", "license", "license-url",
    "accent", "card-bg", "card-border",
)
_OJS = ("journal-path", "section-ref", "user-group-ref", "uploader", "schema-version")


def scalar_texts(nodes: Column) -> Column:
    """Map from path key to text of every scalar node, to look many fields up at once."""
    scalars = F.filter(nodes, lambda n: ~n["kind"].isin("map", "list"))
    return F.map_from_entries(
        F.transform(
            scalars, lambda n: F.struct(n["key"].alias("key"), json_text(n["kind"], n["value_json"]).alias("value"))
        )
    )


def project_meta(merged: DataFrame, profile: Profile) -> DataFrame:
    """Typed columns of the merged metadata; unknown paths stay in ``nodes``."""
    ns = profile.namespace
    nodes = F.col("nodes")

    def flags(name: str) -> Column:
        return F.transform(
            children(nodes, [ns, name]),
            lambda n: F.struct(
                F.element_at(n["path"], -1).alias("key"), n["kind"].alias("kind"), n["value_json"].alias("value_json")
            ),
        )

    def text(dotted: str) -> str:
        return f"try_element_at(__t, '{node_key(dotted)}')"

    def fields(parent: str, names: Sequence[str]) -> str:
        return ", ".join(f"{text(f'{parent}.{n}')} as {n.replace('-', '_')}" for n in names)

    staged = merged.withColumns(
        {
            "__t": scalar_texts(nodes),
            "__k": list_texts(node_at(nodes, "keywords")),
            "__b": list_texts(node_at(nodes, "bibliography")),
            "__f": flags("badges"),
            "__l": flags("badge-links"),
        }
    )
    return staged.selectExpr(
        "manuscript_id",
        "theme",
        *[f"{text(n)} as {n}" for n in ("title", "abstract", "lang", "date")],
        "__k as keywords",
        "__b as bibliography",
        f"struct({fields(ns, _OWN)}, __f as badges, __l as badge_links) as pub",
        f"struct({fields('ojs', _OJS)}) as ojs",
        f"{text('footer-template')} as footer_template",
        "map(" + ", ".join(f"'{name}', {text(f'{ns}.{name}')}" for name, _ in _links(profile)) + ") as links",
    )


def _links(profile: Profile) -> tuple[tuple[str, str], ...]:
    """Link fields with their fall-backs: the journal's home page, and the theme's own."""
    return (("homepage", DEFAULT_HOMEPAGE), *profile.project_links)


def with_defaults(meta: DataFrame, profile: Profile) -> DataFrame:
    """Fill the fields that have a fall-back: license, colours, running head, footer, links, OJS names.

    ``footer`` is the footer template with its marks filled, ``{doi}`` by the
    article id where there is no DOI; ``{page}`` stays for whoever sets pages.
    Without a template it is the usual line. ``links`` holds the home page and
    the profile's ``project_links``, each with its fall-back.
    """
    pub, ojs, links = F.col("pub"), F.col("ojs"), F.col("links")
    footer_id = or_default(pub["doi"], pub["article_id"])
    marks = {"journal": pub["journal"], "year": pub["year"], "volume": pub["volume"], "doi": footer_id}
    filled = F.when(F.col("footer_template") != "", fill_template(F.col("footer_template"), marks))
    filled_links = [x for name, default in _links(profile) for x in (F.lit(name), or_default(links[name], default))]
    return meta.withColumns(
        {
            "locale": locale_of(F.col("lang")),
            "license": or_default(pub["license"], fixed.DEFAULT_LICENSE),
            "accent": or_default(pub["accent"], fixed.DEFAULT_ACCENT),
            "card_bg": or_default(pub["card_bg"], fixed.DEFAULT_CARD_BACKGROUND),
            "card_border": or_default(pub["card_border"], fixed.DEFAULT_CARD_BORDER),
            "running_head": or_default(pub["running_head"], F.col("title")),
            "footer_id": footer_id,
            "footer": F.coalesce(filled, footer_line(pub["journal"], pub["year"], pub["volume"], pub["doi"], pub["article_id"])),
            "links": F.create_map(*filled_links),
            "section_ref": F.coalesce(ojs["section_ref"], F.lit(fixed.DEFAULT_SECTION)),
            "user_group_ref": F.coalesce(ojs["user_group_ref"], F.lit(fixed.DEFAULT_USER_GROUP)),
            "uploader": F.coalesce(ojs["uploader"], F.lit(fixed.DEFAULT_UPLOADER)),
        }
    )
