"""Open-science badges: unpivot, order, collapse, group and list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.values import is_missing, join_names, let
from quire.profile import BADGES, LINKED_BADGES

FLAGS = "array<struct<key:string,kind:string,value_json:string>>"
_BY_KEY = {key: (place, *rest) for place, (key, *rest) in enumerate(BADGES)}


def _flag(flags: Column, key: str) -> Column:
    return F.try_element_at(F.filter(flags, lambda f: f["key"] == key), F.lit(1))


def _shown(flag: Column) -> Column:
    """A flag switches its badge on unless it is absent, null or false; empty text counts as on."""
    off = (flag["kind"] == "bool") & (flag["value_json"] == "false")
    return F.coalesce((flag["kind"] != "null") & ~off, F.lit(False))


def _exactly_true(flag: Column) -> Column:
    return F.coalesce((flag["kind"] == "bool") & (flag["value_json"] == "true"), F.lit(False))


def _link(links: Column, key: str) -> Column:
    def shown(link: Column) -> Column:
        text = F.get_json_object(F.concat(F.lit('{"v":'), link["value_json"], F.lit("}")), "$.v")
        return F.coalesce(F.when(link["kind"] != "null", text), F.lit(""))

    return let(_flag(links, key), shown)


def reprocert_variant(ai: Column, human: Column) -> Column:
    """Which of the three reproducibility certificates two flags stand for; null for none."""
    return (
        F.when(ai & human, "reprocert-hai").when(ai, "reprocert-ai").when(human, "reprocert-human")
    )


def active_badges(meta: DataFrame, flags: Column, links: Column, key: str = "manuscript_id") -> DataFrame:
    """(key, ord, badge, label, file_png, file_svg, link) of the badges shown, in display order.

    The nine possible badges are tested inside the row, so nothing is joined
    and the order needs no sort.
    """
    ai, human = (let(_flag(flags, f"reprocert-{who}"), _exactly_true) for who in ("ai", "human"))
    variant = reprocert_variant(ai, human)
    entries = []
    for badge, (place, label, png, svg) in _BY_KEY.items():
        certificate = badge.startswith("reprocert-")
        on = F.coalesce(variant == badge, F.lit(False)) if certificate else let(_flag(flags, badge), _shown)
        link = _link(links, "reprocert" if certificate else badge)
        entry = F.struct(
            F.lit(place).alias("ord"),
            F.lit(badge).alias("badge"),
            F.lit(label).alias("label"),
            F.lit(png).alias("file_png"),
            F.lit(svg).alias("file_svg"),
            link.alias("link"),
        )
        entries.append(F.when(on, entry))
    return meta.select(key, F.inline(F.array_compact(F.array(*entries))))


def group_adjacent(badges: DataFrame, key: str = "manuscript_id") -> DataFrame:
    """Add ``group_no``: neighbours with the same non-empty link share a group."""
    # at most nine badges per key, so the group always fits one task
    order = Window.partitionBy(key).orderBy("ord")
    same = (F.col("link") != "") & (F.col("link") == F.lag("link").over(order))
    flagged = badges.withColumn("__new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return flagged.withColumn("group_no", F.sum("__new").over(running).cast("int")).drop("__new")


def badge_rows(grouped: DataFrame, file: str = "file_png", key: str = "manuscript_id") -> DataFrame:
    """(key, group_no, label, link, files): one summary row per badge group."""
    members = F.sort_array(F.collect_list(F.struct("ord", "label", F.col(file).alias("file"))))
    rows = grouped.groupBy(key, "group_no").agg(members.alias("m"), F.first("link").alias("link"))
    return rows.select(key, "group_no", join_names(F.col("m.label")).alias("label"), "link", F.col("m.file").alias("files"))


def masthead_badges(badges: DataFrame) -> DataFrame:
    """Icons of the title block: only four kinds of badge link to their report."""
    kind = F.when(F.startswith(F.col("badge"), F.lit("reprocert-")), "reprocert").otherwise(F.col("badge"))
    target = F.when(kind.isin(*LINKED_BADGES) & (F.col("link") != ""), F.col("link"))
    return badges.withColumn("href", target)


def earned_badges(flags: Column) -> Column:
    """Truthy badge keys in merged key order, joined with ``, ``; the archival record lists raw keys."""
    earned = F.filter(flags, lambda f: ~is_missing(f["kind"], f["value_json"]))
    return F.array_join(F.transform(earned, lambda f: f["key"]), ", ")


def flags_of(values: dict[str, Column]) -> Column:
    """Badge flags from boolean columns, in the given order; null columns are explicit nulls."""
    return F.array(
        *[
            F.struct(
                F.lit(key).alias("key"),
                F.when(value.isNull(), "null").otherwise("bool").alias("kind"),
                F.coalesce(value.cast("boolean").cast("string"), F.lit("null")).alias("value_json"),
            )
            for key, value in values.items()
        ]
    )


def links_of(values: dict[str, Column]) -> Column:
    """Badge links from text columns."""
    return F.array(
        *[
            F.struct(
                F.lit(key).alias("key"),
                F.when(value.isNull(), "null").otherwise("str").alias("kind"),
                F.coalesce(F.to_json(F.array(value)).substr(F.lit(2), F.length(F.to_json(F.array(value))) - 2), F.lit("null")).alias("value_json"),
            )
            for key, value in values.items()
        ]
    )
