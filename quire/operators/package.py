"""Import packages: galleys, nested article records and their XML."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quire.functions.text import collapse_ws
from quire.functions.values import galley_filename, optional, orcid_url
from quire.operators.findings import finding
from quire.profile import GALLEYS, NO_GALLEYS
from quire.sources.folders import filesystem

_SWORD = "http://pkp.sfu.ca/SWORD"
_XSI = "http://www.w3.org/2001/XMLSchema-instance"
_BYTES = 32 << 20  # of galleys in one batch, or those of one article
_SCHEMA = "http://pkp.sfu.ca/SWORD native.xsd"


def galley_spec() -> Column:
    """The fixed galley list; its positions are the file ids."""
    return F.array(
        *[
            F.struct(
                F.lit(i).alias("file_id"),
                F.lit(name).alias("name"),
                F.lit(label).alias("label"),
                F.lit(genre).alias("genre"),
                F.lit(media).alias("mimetype"),
            )
            for i, (name, label, genre, media) in enumerate(GALLEYS, start=1)
        ]
    )


def present_files(files: DataFrame, file_id: Column, slots: int, key: str = "manuscript_id") -> DataFrame:
    """(key, present): which of the file ids 1..slots a key has, as an ascending array.

    One flag per slot is combined before the shuffle, so duplicates and hot
    keys cost nothing.
    """
    flags = [F.bool_or(file_id == i).alias(f"__{i}") for i in range(1, slots + 1)]
    seen = files.groupBy(key).agg(*flags)
    present = F.array_compact(F.array(*[F.when(F.col(f"__{i}"), F.lit(i)) for i in range(1, slots + 1)]))
    return seen.select(key, present.alias("present"))


def galley_numbers(present: DataFrame, key: str = "manuscript_id") -> DataFrame:
    """(key, file_id, seq): the id keeps its place in the list, ``seq`` counts the present ones from 0."""
    return present.select(key, F.posexplode("present").alias("seq", "file_id"))


def galleys_of(manuscripts: DataFrame, files: DataFrame, key: str = "manuscript_id") -> DataFrame:
    """(key, file_id, name, label, genre, mimetype, found) for each manuscript and list entry."""
    wanted = manuscripts.select(key, F.inline(galley_spec()))
    have = files.filter((F.col("area") == "root") & F.col("name").isin(*[g[0] for g in GALLEYS])).select(
        key, "name", F.lit(True).alias("found")
    )
    joined = wanted.join(have, [key, "name"], "left")
    return joined.withColumn("found", F.coalesce("found", F.lit(False)))


def skipped_galleys(galleys: DataFrame) -> DataFrame:
    return galleys.filter(~F.col("found"))


def has_galleys(galleys: DataFrame, key: str = "manuscript_id") -> DataFrame:
    """Error finding for manuscripts none of whose galleys was rendered."""
    none = galleys.groupBy(key).agg(F.count_if("found").alias("n")).filter(F.col("n") == 0)
    return finding(none, "error", "no-galleys", F.lit(NO_GALLEYS), F.lit(None), key)


def collect_authors(authors: DataFrame, first_affiliation: DataFrame, key: str = "manuscript_id") -> DataFrame:
    """(key, authors): one article's authors as an array in author order."""
    joined = authors.join(first_affiliation, [key, "seq"], "left")
    person = F.struct("seq", "given", "family", "email", "orcid", "corresponding", "affiliation")
    return joined.groupBy(key).agg(F.sort_array(F.collect_list(person)).alias("authors"))


def first_affiliation(author_affiliations: DataFrame, key: str = "manuscript_id") -> DataFrame:
    """(key, seq, affiliation): the package names only an author's first affiliation."""
    return author_affiliations.groupBy(key, "seq").agg(F.min_by("name", "pos").alias("affiliation"))


def collect_galleys(payloads: DataFrame, key: str = "manuscript_id") -> DataFrame:
    """(key, galleys): at most three rendered files per article, in list order, still as bytes.

    ``payloads`` is (key, name, content). The bytes are shuffled once and
    encoded only afterwards, as base64 is a third longer.
    """
    spec = galley_spec()
    place = F.element_at(F.filter(spec, lambda g: g["name"] == F.col("name")), 1)
    rows = payloads.filter(F.col("name").isin(*[g[0] for g in GALLEYS])).withColumn("g", place)
    one = F.struct("g.file_id", "g.label", "g.genre", "g.mimetype", "name", "content")
    return rows.groupBy(key).agg(F.collect_list(one).alias("galleys")).withColumn(
        "galleys", F.array_sort("galleys", lambda a, b: a["file_id"] - b["file_id"])
    )


def listed_galleys(galleys: DataFrame, key: str = "manuscript_id") -> DataFrame:
    """(key, galleys): the rendered files of ``galleys_of``, in list order, by name only."""
    one = F.struct("file_id", "label", "genre", "mimetype", "name")
    return galleys.filter("found").groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("galleys"))


def open_galleys(articles: DataFrame, root: str, key: str = "manuscript_id", galleys: str = "galleys") -> DataFrame:
    """``articles`` with the ``content`` of each listed galley, read from ``root/manuscripts/<key>/``.

    To be called last: joins before it carry names, and the bytes go from the
    file to the package without a shuffle. A batch holds one article, or several
    of together at most ``_BYTES``. A file that is gone has null content.
    """
    schema = T.StructType([
        T.StructField(f.name, T.ArrayType(T.StructType([*f.dataType.elementType.fields, T.StructField("content", T.BinaryType())]))) if f.name == galleys else f
        for f in articles.schema.fields
    ])
    target = to_arrow_schema(schema)
    at, place = articles.columns.index(key), articles.columns.index(galleys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = filesystem(root)

        def opened(path: str) -> bytes | None:
            try:
                with system.open_input_stream(path, compression=None) as source:
                    return source.read()
            except FileNotFoundError:
                return None

        for batch in batches:
            keys, first, held, rows = batch.column(at).to_pylist(), 0, 0, []
            for i, listed in enumerate(batch.column(place).to_pylist()):
                filled = [g | {"content": opened(f"{base}/manuscripts/{keys[i]}/{g['name']}")} for g in listed or ()]
                rows.append(None if listed is None else filled)
                held += sum(len(g["content"] or b"") for g in filled)
                if held >= _BYTES or i + 1 == len(keys):
                    columns = list(batch.slice(first, i + 1 - first).columns)
                    columns[place] = pa.array(rows, target.field(place).type)
                    yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)
                    first, held, rows = i + 1, 0, []

    return articles.mapInArrow(run, schema)


def _text(locale: Column, value: Column) -> Column:
    return F.struct(locale.alias("_locale"), value.alias("_VALUE"))


def _when_filled(value: Column, element: Column) -> Column:
    return F.when(optional(value).isNotNull(), element)


def package_record() -> Column:
    """Nested record of one article: the column layout of the import schema.

    Expects the columns of :func:`quire.operators.layers.with_defaults` plus
    ``authors``, ``galleys``, ``fallback_email`` and ``copyright_holder``.
    """
    locale, date = F.col("locale"), F.coalesce("date", F.lit(""))
    pub = F.col("pub")

    def submission_file(g: Column) -> Column:
        extension = F.element_at(F.split(g["name"], r"\."), -1)
        return F.struct(
            F.lit(_SWORD).alias("_xmlns"),
            g["file_id"].alias("_id"),
            date.alias("_created_at"),
            date.alias("_updated_at"),
            g["file_id"].alias("_file_id"),
            F.lit("proof").alias("_stage"),
            F.lit("true").alias("_viewable"),
            g["genre"].alias("_genre"),
            F.col("uploader").alias("_uploader"),
            g["mimetype"].alias("_filetype"),
            _text(locale, galley_filename(pub["article_id"], extension)).alias("name"),
            F.struct(
                g["file_id"].alias("_id"),
                F.octet_length(g["content"]).alias("_filesize"),
                extension.alias("_extension"),
                F.struct(
                    F.lit("base64").alias("_encoding"),
                    F.translate(F.base64(g["content"]), "\r\n", "").alias("_VALUE"),
                ).alias("embed"),
            ).alias("file"),
        )

    def author(a: Column) -> Column:
        return F.struct(
            F.lit("true").alias("_include_in_browse"),
            F.col("user_group_ref").alias("_user_group_ref"),
            a["seq"].alias("_seq"),
            (a["seq"] + 1).alias("_id"),
            F.when(a["corresponding"], "true").alias("_primary_contact"),
            _text(locale, a["given"]).alias("givenname"),
            _when_filled(a["family"], _text(locale, a["family"])).alias("familyname"),
            F.when(a["affiliation"].isNotNull(), _text(locale, a["affiliation"])).alias("affiliation"),
            F.coalesce(optional(a["email"]), F.col("fallback_email")).alias("email"),
            orcid_url(a["orcid"]).alias("orcid"),
        )

    def article_galley(g: Column, i: Column) -> Column:
        return F.struct(
            F.lit(_SWORD).alias("_xmlns"),
            locale.alias("_locale"),
            F.lit("false").alias("_approved"),
            _identifier("internal", "ignore", g["file_id"].cast("string")).alias("id"),
            _text(locale, g["label"]).alias("name"),
            i.alias("seq"),
            F.struct(g["file_id"].alias("_id")).alias("submission_file_ref"),
        )

    abstract = collapse_ws(F.col("abstract"))
    ids = F.array_compact(
        F.array(
            _identifier("internal", "ignore", F.lit("1")),
            _when_filled(pub["doi"], _identifier("doi", "update", pub["doi"])),
        )
    )
    publication = F.struct(
        F.lit(_SWORD).alias("_xmlns"),
        locale.alias("_locale"),
        F.lit("1").alias("_version"),
        F.lit("3").alias("_status"),
        F.lit("1").alias("_primary_contact_id"),
        F.lit("").alias("_url_path"),
        F.lit("0").alias("_seq"),
        date.alias("_date_published"),
        F.col("section_ref").alias("_section_ref"),
        F.lit("0").alias("_access_status"),
        ids.alias("id"),
        _text(locale, F.coalesce("title", F.lit(""))).alias("title"),
        _when_filled(abstract, _text(locale, abstract)).alias("abstract"),
        optional(pub["license_url"]).alias("licenseUrl"),
        _text(locale, F.col("copyright_holder")).alias("copyrightHolder"),
        F.coalesce(pub["year"], F.lit("")).alias("copyrightYear"),
        F.struct(F.lit(_SWORD).alias("_xmlns"), F.transform(F.col("authors"), author).alias("author")).alias("authors"),
        F.transform(F.col("galleys"), article_galley).alias("article_galley"),
        F.when(
            F.size("keywords") > 0, F.struct(locale.alias("_locale"), F.col("keywords").alias("keyword"))
        ).alias("keywords"),
    )
    return F.struct(
        F.lit(_SWORD).alias("_xmlns"),
        locale.alias("_locale"),
        date.alias("_date_submitted"),
        F.lit("3").alias("_status"),
        F.lit("0").alias("_submission_progress"),
        F.lit("1").alias("_current_publication_id"),
        F.lit("production").alias("_stage"),
        _identifier("internal", "ignore", F.lit("1")).alias("id"),
        F.transform(F.col("galleys"), submission_file).alias("submission_file"),
        publication.alias("publication"),
    )


def _identifier(kind: str, advice: str, value: Column) -> Column:
    return F.struct(F.lit(kind).alias("_type"), F.lit(advice).alias("_advice"), value.alias("_VALUE"))


def render_xml(record: Column, row_tag: str) -> Column:
    """Escaped XML text of a struct: ``_x`` fields are attributes, ``_VALUE`` the text, nulls left out."""
    return F.to_xml(record, {"rowTag": row_tag})


def render_packages(packages: DataFrame, key: str = "manuscript_id") -> DataFrame:
    """(key, article_id, galleys, xml) of the records of :func:`package_record`."""
    # the XML writer takes no prefixed attribute names, so the fixed root element is plain text
    opening = (
        '<?xml version="1.0" encoding="UTF-8"?>\n'
        f'<articles xmlns="{_SWORD}" xmlns:xsi="{_XSI}" xsi:schemaLocation="{_SCHEMA}">\n'
    )
    return packages.select(
        key,
        F.col("pub.article_id").alias("article_id"),
        F.size("galleys").alias("galleys"),
        F.concat(F.lit(opening), render_xml(package_record(), "article"), F.lit("\n</articles>\n")).alias("xml"),
    )


def package_manifest(packages: DataFrame, key: str = "manuscript_id") -> DataFrame:
    """(key, galleys, kilobytes): galley count and size of each package, rounded down."""
    return packages.select(key, "galleys", F.floor(F.octet_length("xml") / 1024).cast("long").alias("kilobytes"))
