"""Authors and affiliations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import split_name, strip
from quire.functions.values import noreply
from quire.operators.layers import json_at


def _items(json_list: Column) -> Column:
    """Items of a JSON list as variants; anything but a list has none."""
    parsed = F.when(F.startswith(json_list, F.lit("[")), F.parse_json(json_list))
    return F.coalesce(parsed.cast("array<variant>"), F.array().cast("array<variant>"))


def _is_map(item: Column) -> Column:
    return F.startswith(F.schema_of_variant(item), F.lit("OBJECT"))


def _field(item: Column, name: str) -> Column:
    return F.try_variant_get(item, f"$.{name}", "variant")


def _as_json(item: Column) -> Column:
    """Comparable form of a reference: typed JSON text, so 1 and "1" differ; absent is null."""
    return F.coalesce(F.to_json(item), F.lit("null"))


def _shown(item: Column, name: str) -> Column:
    """A scalar field as text: absent is empty, null is the text None."""
    value = _field(item, name)
    text = F.try_variant_get(item, f"$.{name}", "string")
    return F.when(value.isNull(), "").when(F.is_variant_null(value), "None").otherwise(text)


def _plain(item: Column, name: str) -> Column:
    return F.coalesce(F.try_variant_get(item, f"$.{name}", "string"), F.lit(""))


def _truthy(item: Column) -> Column:
    text = F.to_json(item)
    return F.coalesce(~text.isin("null", "false", "0", "0.0", '""', "[]", "{}"), F.lit(False))


def affiliation_items(merged: DataFrame) -> DataFrame:
    """(manuscript_id, number, aff_id, name): list positions from 1, non-map items counted but left out."""
    items = merged.select(
        "manuscript_id", F.posexplode(_items(json_at(F.col("nodes"), "affiliations"))).alias("pos", "item")
    ).filter(_is_map(F.col("item")))
    return items.select(
        "manuscript_id",
        (F.col("pos") + 1).alias("number"),
        _as_json(_field(F.col("item"), "id")).alias("aff_id"),
        _plain(F.col("item"), "name").alias("name"),
    )


def number_affiliations(items: DataFrame, key: str = "manuscript_id") -> DataFrame:
    """One row per affiliation id; a repeated id keeps its last name and number."""
    return items.groupBy(key, "aff_id").agg(F.max("number").alias("number"), F.max_by("name", "number").alias("name"))


def author_items(merged: DataFrame) -> DataFrame:
    """(manuscript_id, seq, item): the map items of the author list, numbered from 0."""
    people = F.filter(_items(json_at(F.col("nodes"), "author")), _is_map)
    return merged.select("manuscript_id", F.posexplode(people).alias("seq", "item"))


def authors(items: DataFrame) -> DataFrame:
    """(manuscript_id, seq, given, family, name, email, orcid, orcid_given, corresponding)."""
    item = F.col("item")
    name = _field(item, "name")
    mapped = name.isNull() | _is_map(name)
    given, family = _shown(name, "given"), _shown(name, "family")
    given, family = F.coalesce(given, F.lit("")), F.coalesce(family, F.lit(""))
    literal = F.try_variant_get(name, "$.literal", "string")
    whole = F.when(F.coalesce(literal, F.lit("")) != "", literal).otherwise(
        strip(F.concat(given, F.lit(" "), family))
    )
    text = F.when(F.is_variant_null(name), "None").otherwise(F.try_variant_get(name, "$", "string"))
    parts = split_name(text)
    return items.select(
        "manuscript_id",
        "seq",
        F.when(mapped, given).otherwise(parts["given"]).alias("given"),
        F.when(mapped, family).otherwise(parts["family"]).alias("family"),
        F.when(mapped, whole).otherwise(text).alias("name"),
        _plain(item, "email").alias("email"),
        _plain(item, "orcid").alias("orcid"),
        _field(item, "orcid").isNotNull().alias("orcid_given"),
        _truthy(_field(item, "corresponding")).alias("corresponding"),
    )


def affiliation_refs(items: DataFrame) -> DataFrame:
    """(manuscript_id, seq, pos, ref, inline_name): what each author points at, in order."""
    refs = items.select(
        "manuscript_id",
        "seq",
        F.posexplode(_items(F.to_json(_field(F.col("item"), "affiliations")))).alias("pos", "r"),
    )
    r = F.col("r")
    inline = F.when(_is_map(r), F.nullif(_plain(r, "name"), F.lit("")))
    ref = F.when(_is_map(r), _as_json(_field(r, "ref"))).otherwise(_as_json(r))
    return refs.select("manuscript_id", "seq", "pos", ref.alias("ref"), inline.alias("inline_name"))


def resolve_affiliations(refs: DataFrame, affiliations: DataFrame, key: str = "manuscript_id") -> DataFrame:
    """(key, seq, pos, number, name) of each reference: listed affiliation, else inline name, else dropped.

    An inline affiliation is numbered after those its author already has, which
    may repeat a number of the list. The references of one author come from one
    row, so a window over an author holds few, and it leaves the rows in place for
    what is grouped by author next.
    """
    listed = affiliations.select(key, F.col("aff_id").alias("ref"), F.col("number").alias("listed"), F.col("name").alias("listed_name"))
    found = refs.join(listed, [key, "ref"], "left")
    kept = found.filter(F.col("listed").isNotNull() | F.col("inline_name").isNotNull())
    numbered = kept.withColumn("n", F.row_number().over(Window.partitionBy(key, "seq").orderBy("pos")))
    return numbered.select(
        key,
        "seq",
        "pos",
        F.coalesce("listed", "n").cast("int").alias("number"),
        F.when(F.col("listed").isNotNull(), F.col("listed_name")).otherwise(F.col("inline_name")).alias("name"),
    )


def dangling_affiliations(refs: DataFrame, affiliations: DataFrame, key: str = "manuscript_id") -> DataFrame:
    """References that match no listed affiliation."""
    return refs.join(affiliations.select(key, F.col("aff_id").alias("ref")), [key, "ref"], "left_anti")


def affiliation_marks(author_affiliations: DataFrame, key: str = "manuscript_id") -> DataFrame:
    """(key, seq, marks): the numbers of one author's affiliations, comma-separated in order."""
    marks = F.expr("listagg(cast(number as string), ',') within group (order by pos)")
    return author_affiliations.groupBy(key, "seq").agg(marks.alias("marks"))


def author_numbers(authors: DataFrame) -> DataFrame:
    """Add the 1-based ``id`` next to the 0-based ``seq``."""
    return authors.withColumn("id", F.col("seq") + 1)


def author_line(authors: DataFrame, marks: DataFrame, key: str = "manuscript_id") -> DataFrame:
    """(key, author_line): names with their marks, in order."""
    shown = authors.join(marks, [key, "seq"], "left").withColumn(
        "shown", F.concat("name", F.coalesce("marks", F.lit("")))
    )
    line = F.expr("listagg(shown, ', ') within group (order by seq)")
    return shown.groupBy(key).agg(line.alias("author_line"))


def affiliation_line(affiliations: DataFrame, key: str = "manuscript_id") -> DataFrame:
    """(key, affiliation_line): numbered affiliations, in order."""
    shown = affiliations.withColumn("shown", F.concat_ws(" ", F.col("number").cast("string"), "name"))
    line = F.expr("listagg(shown, '; ') within group (order by number)")
    return shown.groupBy(key).agg(line.alias("affiliation_line"))


def first_email(authors: DataFrame, key: str = "manuscript_id") -> DataFrame:
    """(key, email): the first non-empty email in author order."""
    place = F.when(F.col("email") != "", F.col("seq"))
    return authors.groupBy(key).agg(F.min_by("email", place).alias("email"))


def fallback_email(manuscripts: DataFrame, authors: DataFrame, journal_path: Column, key: str = "manuscript_id") -> DataFrame:
    """(key, fallback_email): the first author email, else a no-reply address of the journal."""
    joined = manuscripts.join(first_email(authors, key), [key], "left")
    return joined.select(key, F.coalesce("email", noreply(journal_path)).alias("fallback_email"))


def copyright_holder(manuscripts: DataFrame, authors: DataFrame, journal: Column, key: str = "manuscript_id") -> DataFrame:
    """(key, copyright_holder): the first author's family name, or the journal when there is no author."""
    first = authors.groupBy(key).agg(F.min_by(F.struct("family"), "seq").alias("first"))
    joined = manuscripts.join(first, [key], "left")
    holder = F.when(F.col("first").isNotNull(), F.col("first.family")).otherwise(journal)
    return joined.select(key, holder.alias("copyright_holder"))
