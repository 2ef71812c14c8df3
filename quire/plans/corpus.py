"""From a folder tree to findings, enriched XML and import packages.

``root`` holds ``manuscripts/<id>/...`` and ``themes/<name>/theme.yml``. Every
step is a lazy DataFrame; metadata is merged once and reused.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import decoded, has_latex_document, normal_path, unix_newlines
from quire.operators import badges, canonical, findings, jats, layers, package, people, sections, sources
from quire.profile import ARCHIVE_SUFFIX, BIBLIOGRAPHY_NAME, CANONICAL_NAME, REGISTRY_NAME, SOURCE_SUFFIXES, Profile
from quire.session import settled
from quire.sources import files as scans


@dataclass
class Corpus:
    """The tables of one corpus.

    ``theme`` names the journal of every manuscript that ``themes_of`` (manuscript_id, theme) doesn't name one for.
    ``converted`` (manuscript_id, text) is the Markdown that an outside converter made of Word and LaTeX sources.
    """

    spark: SparkSession
    root: str
    theme: str
    profile: Profile = Profile()
    strict_sources: bool = False
    themes_of: DataFrame | None = None
    converted: DataFrame | None = None

    # --- scans ---------------------------------------------------------------

    @cached_property
    def files(self) -> DataFrame:
        return settled(scans.scan_files(self.spark, self.root))

    @cached_property
    def manuscripts(self) -> DataFrame:
        """(manuscript_id, theme) of every folder."""
        ids = self.files.select("manuscript_id").filter(F.col("manuscript_id") != "").distinct()
        if self.themes_of is None:
            return ids.withColumn("theme", F.lit(self.theme))
        named = self.themes_of.groupBy("manuscript_id").agg(F.min("theme").alias("theme"))
        return ids.join(named, ["manuscript_id"], "left").withColumn("theme", F.coalesce("theme", F.lit(self.theme)))

    @cached_property
    def canonical(self) -> DataFrame:
        """(manuscript_id, front_matter, body, text): the source's text, else the article that lies in the folder.

        A Markdown source counts as it is, other sources as ``converted``. A placeholder is no source here, whatever
        ``strict_sources`` says: it would replace a finished article.
        """
        new = self._normal(self.real_source, self.converted).select("manuscript_id", unix_newlines(F.col("text")).alias("text"))
        there = scans.scan_canonical(self.spark, self.root).select("manuscript_id", "text")
        texts = new.unionByName(there.join(new.select("manuscript_id"), ["manuscript_id"], "left_anti"))
        return settled(scans.canonical_rows(texts))

    # --- sources ---------------------------------------------------------------

    @cached_property
    def unpacked(self) -> DataFrame:
        """Inventory with archives replaced by their members, with the bytes of source files only."""
        suffixes = [*SOURCE_SUFFIXES, ARCHIVE_SUFFIX, ".bib"]
        # any case, by name: galleys and figures are listed but not read
        named = ",".join("*" + "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in x) for x in suffixes)
        raw = scans.scan_bytes(self.spark, self.root, f"{{{named}}}")
        inside = F.col("ext").isin(*SOURCE_SUFFIXES, ARCHIVE_SUFFIX) & F.col("area").isin("source", "root")
        return settled(scans.with_archives(raw.filter(inside | (F.col("ext") == ".bib"))))

    def _candidates(self, strict: bool) -> DataFrame:
        text = F.when(F.col("ext") == ".tex", decoded(F.col("content")))
        marked = self.unpacked.withColumn("has_document", F.coalesce(has_latex_document(text), F.lit(False)))
        return sources.source_fallback(sources.source_candidates(marked.drop("content"), strict=strict))

    @cached_property
    def candidates(self) -> DataFrame:
        return self._candidates(self.strict_sources)

    @cached_property
    def real_source(self) -> DataFrame:
        """The chosen source of each manuscript, placeholders left out."""
        chosen = sources.choose_source(self._candidates(True), keep=["ext"])
        return chosen.withColumn("route", sources.route_format(F.col("ext")))

    @cached_property
    def chosen_source(self) -> DataFrame:
        """(manuscript_id, rung, path, name, length, ext, route)."""
        chosen = sources.choose_source(self.candidates, keep=["ext"])
        return chosen.withColumn("route", sources.route_format(F.col("ext")))

    def _macros(self, source: DataFrame) -> DataFrame:
        latex = source.filter(F.col("route") == "latex").select("manuscript_id", "path")
        texts = self.unpacked.filter(F.col("ext") == ".tex").select("manuscript_id", "path", "content")
        text = unix_newlines(decoded(F.col("content")))
        chosen = texts.join(latex, ["manuscript_id", "path"], "left_semi").select("manuscript_id", text.alias("text"))
        return canonical.extract_macros(chosen, self.profile).drop("text")

    @cached_property
    def latex_macros(self) -> DataFrame:
        """(manuscript_id, abstract, keywords, recommended_citation) of the chosen LaTeX sources."""
        return self._macros(self.chosen_source)

    def _passed(self, source: DataFrame) -> DataFrame:
        markdown = source.filter(F.col("route") == "markdown").select("manuscript_id", "path")
        texts = self.unpacked.join(markdown, ["manuscript_id", "path"], "left_semi")
        return sources.passthrough(texts.select("manuscript_id", decoded(F.col("content")).alias("text")))

    @cached_property
    def passed_through(self) -> DataFrame:
        """Canonical rows of the Markdown-like sources."""
        return self._passed(self.chosen_source)

    def _normal(self, source: DataFrame, converted: DataFrame | None) -> DataFrame:
        passed = self._passed(source)
        if converted is None:
            return passed
        found = converted.join(self._macros(source), ["manuscript_id"], "left")
        return sources.union_inputs(passed, canonical.assemble_canonical(found, sources.metafile_links(self.files)))

    def normalized(self, converted: DataFrame | None = None) -> DataFrame:
        """Canonical text of every input format, a placeholder's own included unless ``strict_sources`` is set.

        ``converted`` (manuscript_id, text) is the Markdown an outside converter
        made of the Word and LaTeX sources; macros and figure links are applied here.
        """
        return self._normal(self.chosen_source, converted)

    # --- metadata ----------------------------------------------------------------

    @cached_property
    def themes(self) -> DataFrame:
        """(theme, nodes, error) of every journal."""
        return settled(layers.parse_layer(scans.scan_theme(self.spark, self.root), "text", "theme"))

    @cached_property
    def theme_errors(self) -> DataFrame:
        """(manuscript_id, message) of manuscripts whose journal is unknown or can't be read."""
        known = self.themes.select("theme", F.lit(True).alias("known"), F.col("error").alias("message"))
        named = self.manuscripts.join(known, ["theme"], "left")
        unknown = F.concat(F.lit("unknown theme: "), F.coalesce("theme", F.lit("")))
        return named.select("manuscript_id", F.when(F.col("known"), F.col("message")).otherwise(unknown).alias("message")).where("message is not null")

    @cached_property
    def merged(self) -> DataFrame:
        """(manuscript_id, theme, nodes, error): parsed and merged once, then cut off from the scans."""
        themes = self.themes
        registry = layers.parse_layer(scans.scan_registry(self.spark, self.root, self.files), "text", "manuscript_id")
        front = layers.parse_layer(self.canonical, "front_matter", "manuscript_id")
        return settled(layers.merge_metadata(self.manuscripts, themes, registry, front))

    @cached_property
    def meta(self) -> DataFrame:
        return layers.project_meta(self.merged, self.profile)

    @cached_property
    def author_items(self) -> DataFrame:
        return people.author_items(self.merged)

    @cached_property
    def authors(self) -> DataFrame:
        return people.authors(self.author_items)

    @cached_property
    def affiliations(self) -> DataFrame:
        return people.number_affiliations(people.affiliation_items(self.merged))

    @cached_property
    def author_affiliations(self) -> DataFrame:
        return people.resolve_affiliations(people.affiliation_refs(self.author_items), self.affiliations)

    @cached_property
    def badges(self) -> DataFrame:
        active = badges.active_badges(self.meta, F.col("pub.badges"), F.col("pub.badge_links"))
        return badges.group_adjacent(active)

    # --- validation ----------------------------------------------------------------

    def _file(self, name: str) -> Column:
        return F.concat(F.lit("manuscripts/"), "manuscript_id", F.lit(f"/{name}"))

    @cached_property
    def findings(self) -> DataFrame:
        registry, article = self._file(REGISTRY_NAME), self._file(CANONICAL_NAME)
        unreadable = self.merged.filter(F.col("error").isNotNull())
        placed = self.files.select("manuscript_id", "path").unionByName(self.chosen_bibliography.select("manuscript_id", F.lit(BIBLIOGRAPHY_NAME).alias("path")))
        broken = scans.broken_archives(scans.scan_bytes(self.spark, self.root, "*.[zZ][iI][pP]"))
        unpacking = F.concat(F.lit("cannot unpack "), F.coalesce("member", "archive"), F.lit(": "), "error")
        return settled(
            findings.union_findings(
                findings.validate_fields(self.merged, self.profile, registry),
                findings.validate_authors(self.manuscripts, self.authors, article),
                findings.missing_bibliography(self.meta, placed, article),
                findings.finding(unreadable, "error", "metadata", F.col("error"), registry),
                findings.finding(self.theme_errors, "error", "theme", F.col("message"), registry),
                findings.finding(broken, "error", "archive", unpacking, F.concat(F.lit("manuscripts/"), "manuscript_id", F.lit("/"), "archive")),
                sources.unsourced(self.manuscripts, self.candidates),
                sources.no_bibliography(self.manuscripts, self.unpacked),
            )
        )

    @cached_property
    def conventions(self) -> DataFrame:
        """All field rules with the unwritten ones, and blank ORCIDs."""
        fields = findings.validate_fields(self.merged, self.profile, self._file(REGISTRY_NAME), conventions=True)
        return findings.union_findings(fields, findings.blank_orcids(self.authors, self._file(CANONICAL_NAME)))

    @cached_property
    def verdict(self) -> DataFrame:
        return findings.count_findings(self.manuscripts, self.findings)

    # --- outputs ------------------------------------------------------------------

    @cached_property
    def jats(self) -> DataFrame:
        """(manuscript_id, xml, jats_error) of the articles that passed."""
        ok = findings.renderable(self.meta, self.findings)
        articles = scans.scan_jats(self.spark, self.root).join(ok.select("manuscript_id", "pub"), ["manuscript_id"])
        return jats.enrich_jats(articles, badges.earned_badges(F.col("pub.badges"))).drop("pub")

    @cached_property
    def packages(self) -> DataFrame:
        """(manuscript_id, article_id, galleys, xml) of the articles that passed and have a galley.

        Ids, metadata and names are joined; the rendered bytes are read last and not shuffled.
        """
        meta = layers.with_defaults(findings.renderable(self.meta, self.findings), self.profile)
        path, journal = F.col("ojs.journal_path"), F.coalesce(F.col("pub.journal"), F.lit(""))
        first = package.first_affiliation(self.author_affiliations)
        described = (
            meta.join(package.collect_authors(self.authors, first), ["manuscript_id"], "left")
            .join(people.fallback_email(meta, self.authors, path), ["manuscript_id"])
            .join(people.copyright_holder(meta, self.authors, journal), ["manuscript_id"])
        )
        listed = package.listed_galleys(package.galleys_of(meta.select("manuscript_id"), self.files))
        return package.render_packages(package.open_galleys(described.join(listed, ["manuscript_id"]), self.root))

    @cached_property
    def package_findings(self) -> DataFrame:
        return package.has_galleys(package.galleys_of(self.manuscripts, self.files))

    # --- body -----------------------------------------------------------------------

    @cached_property
    def citations(self) -> DataFrame:
        return sections.extract_citations(self.canonical)

    @cached_property
    def sections(self) -> DataFrame:
        return sections.sections(self.canonical)

    @cached_property
    def refs(self) -> DataFrame:
        """Entries of the bibliographies that an article declares, and of ``references.bib``.

        The file beside a LaTeX source stands for ``references.bib``.
        """
        bib = self.unpacked.filter(F.col("ext") == ".bib")
        chosen = bib.join(self.chosen_bibliography.withColumnRenamed("bibliography", "path"), ["manuscript_id", "path"], "left_semi")
        chosen = chosen.withColumn("path", F.lit(BIBLIOGRAPHY_NAME))
        lying = bib.withColumn("path", normal_path(F.col("path"))).join(chosen.select("manuscript_id", "path"), ["manuscript_id", "path"], "left_anti")
        named = self.meta.select("manuscript_id", F.explode("bibliography").alias("path")).withColumn("path", normal_path(F.col("path")))
        wanted = named.unionByName(self.manuscripts.select("manuscript_id", F.lit(BIBLIOGRAPHY_NAME).alias("path"))).distinct()
        texts = chosen.unionByName(lying).join(wanted, ["manuscript_id", "path"], "left_semi")
        return scans.bibliography_rows(texts.select("manuscript_id", unix_newlines(decoded(F.col("content"))).alias("text")))

    @cached_property
    def chosen_bibliography(self) -> DataFrame:
        """(manuscript_id, bibliography): the file beside the LaTeX source."""
        return sources.choose_bibliography(self.unpacked, self.real_source)


