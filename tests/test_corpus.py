import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from helpers import decoded
from quire.operators import badges, findings, people, references, sections, sources
from quire.plans.corpus import Corpus
from quire.profile import Profile
from quire.sources import files as scans
from quire.sources import sinks


@pytest.fixture(scope="module")
def corpus(spark, root):
    return Corpus(spark, root, theme="jtt")


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_inventory_has_id_area_and_no_content(corpus):
    assert "content" not in corpus.files.columns
    got = rows(corpus.files.filter("manuscript_id = 'JT.1'"), "area", "path", "ext")
    assert ("source", "source/PUT_MANUSCRIPT_HERE.md", ".md") in got
    assert ("figures", "figures/media/a.emf", ".emf") in got
    assert ("root", "article.pdf", ".pdf") in got
    assert rows(corpus.manuscripts, "manuscript_id") == [("JT.1",), ("bad one",), ("zip",)]


def test_source_choice_unpacks_archives_and_falls_back(corpus, spark, root):
    got = {r.manuscript_id: (r.rung, r.path, r.route) for r in corpus.chosen_source.collect()}
    assert got["zip"] == (4, "source/paper.tex", "latex")
    assert got["JT.1"] == (5, "source/PUT_MANUSCRIPT_HERE.md", "markdown")
    assert got["bad one"] == (5, "article.qmd", "markdown")
    strict = Corpus(spark, root, theme="jtt", strict_sources=True)
    assert {r.manuscript_id: r.path for r in strict.chosen_source.collect()}["JT.1"] == "article.qmd"
    bib = sources.choose_bibliography(corpus.unpacked, corpus.chosen_source)
    assert rows(bib, "manuscript_id", "bibliography") == [("zip", "source/parts/refs.bib")]
    assert rows(sources.no_bibliography(corpus.manuscripts, corpus.files), "manuscript_id") == [("bad one",), ("zip",)]
    assert rows(sources.unsourced(corpus.manuscripts, corpus.candidates), "manuscript_id") == []


def test_latex_macros_and_assembly(corpus, spark):
    got = corpus.latex_macros.first()
    assert got.abstract == "An {inner} \\emph{word} here"
    assert got.keywords == "a; b ,c"
    assert got.recommended_citation is None
    converted = spark.createDataFrame([("zip", "Body.")], "manuscript_id string, text string")
    text = {r.manuscript_id: r.text for r in corpus.normalized(converted).collect()}
    assert text["zip"].startswith("---\ntitle: \"TODO: article title\"") is False
    assert "abstract: >\n  An {inner}" in text["zip"]
    assert "keywords: [a, b, c]" in text["zip"]
    assert text["zip"].endswith("bibliography: references.bib\n---\n\nBody.")
    assert text["JT.1"] == "placeholder"


def test_metadata_merge_and_typed_columns(corpus):
    got = {r.manuscript_id: r for r in corpus.meta.collect()}
    good = got["JT.1"]
    assert good.title == "A *title*"
    assert good.abstract == "Some   abstract.\n"
    assert good.keywords == ["one", "two"]
    assert good.bibliography == ["references.bib"]
    assert (good.pub.journal, good.pub.volume, good.pub.year) == ("Journal of Tests & Trials", "1", "2025")
    assert good.date == "2025-01-15"
    assert good.ojs.journal_path == "jtt"
    errors = {r.manuscript_id: r.error for r in corpus.merged.collect()}
    assert errors["zip"] == "top level is a list, not a map" and errors["JT.1"] is None


def test_authors_and_affiliations(corpus):
    assert rows(corpus.authors, "manuscript_id", "seq", "given", "family", "name", "corresponding") == [
        ("JT.1", 0, "Jane", "Doe", "Jane Doe", True),
        ("JT.1", 1, "John Q.", "Public", "John Q. Public", False),
    ]
    assert rows(corpus.affiliations, "number", "name") == [(3, "Second"), (4, "First again")]
    assert rows(corpus.author_affiliations, "seq", "pos", "number", "name") == [
        (0, 0, 3, "Second"),
        (0, 2, 2, "Inline Lab"),
        (1, 0, 4, "First again"),
    ]
    refs = people.affiliation_refs(corpus.author_items)
    assert rows(people.dangling_affiliations(refs, corpus.affiliations), "seq", "ref") == [(0, '"nowhere"'), (0, "null")]
    marks = people.affiliation_marks(corpus.author_affiliations)
    assert rows(people.author_line(corpus.authors, marks), "author_line") == [("Jane Doe3,2, John Q. Public4",)]
    assert rows(people.affiliation_line(corpus.affiliations), "affiliation_line") == [("3 Second; 4 First again",)]


def test_findings_and_verdict(corpus):
    got = rows(corpus.findings.filter("manuscript_id = 'bad one'"), "level", "rule", "message")
    assert ("error", "required", "Missing required field: pub.volume") in got
    assert ("error", "required", "Missing required field: abstract") in got
    assert ("error", "required", "Missing required field: pub.journal") not in got
    assert ("error", "no-authors", "No authors found (front matter 'author:' is empty).") in got
    assert ("error", "bibliography", "bibliography file not found: lost.bib") in got
    assert ("warning", "recommended", "Recommended field missing: pub.doi (DOI)") in got
    assert rows(corpus.findings.filter("manuscript_id = 'JT.1'"), "message") == []
    verdict = {r.manuscript_id: r.passed for r in corpus.verdict.collect()}
    assert verdict == {"JT.1": True, "bad one": False, "zip": False}
    assert rows(corpus.conventions.filter("manuscript_id = 'JT.1'"), "message") == []
    required = findings.validate_required(corpus.merged, corpus.profile, F.lit(None))
    recommended = findings.validate_recommended(corpus.merged, corpus.profile, F.lit(None))
    both = rows(findings.union_findings(required, recommended), "manuscript_id", "message")
    fields = corpus.findings.filter("rule in ('required', 'recommended')")
    assert both == rows(fields, "manuscript_id", "message")


def test_badges(corpus):
    got = rows(corpus.badges, "ord", "badge", "link", "group_no")
    assert got == [
        (1, "open-materials", "", 1),
        (2, "open-data", "", 2),
        (3, "open-code", "", 3),
        (5, "reprocert-hai", "https://x.test/r", 4),
    ]
    summary = rows(badges.badge_rows(corpus.badges), "group_no", "label", "files")
    assert summary[-1] == (4, "Reproducibility Certified (Human & AI)", ["reprocert_hai.png"])
    heads = rows(badges.masthead_badges(corpus.badges), "badge", "href")
    assert ("reprocert-hai", "https://x.test/r") in heads and ("open-data", None) in heads
    earned = corpus.meta.filter("manuscript_id = 'JT.1'").select(badges.earned_badges(F.col("pub.badges")).alias("e"))
    assert earned.first().e == "open-data, open-code, open-materials, reprocert-ai, reprocert-human"


def test_jats_enrichment_is_well_formed_ordered_and_idempotent(corpus):
    row = corpus.jats.first()
    assert row.jats_error is None
    tree = ET.fromstring(row.xml)
    assert tree.get("article-type") == "editorial"
    journal = [e.tag for e in tree.find("front/journal-meta")]
    assert journal == ["journal-title-group", "issn", "publisher"]
    article = [e.tag for e in tree.find("front/article-meta")]
    assert article == [
        "article-id", "article-categories", "title-group", "abstract", "kwd-group", "volume", "elocation-id",
        "permissions", "custom-meta-group",
    ]
    assert tree.find(".//journal-title").text == "Journal of Tests & Trials"
    assert tree.find(".//license").get("{http://www.w3.org/1999/xlink}href").startswith("https://creative")
    from quire.operators.jats import enrich_jats

    again = corpus.jats.drop("jats_error").join(corpus.meta.select("manuscript_id", "pub"), "manuscript_id")
    twice = enrich_jats(again, badges.earned_badges(F.col("pub.badges"))).first()
    assert twice.xml == row.xml


def test_package_parses_and_embeds_galleys(corpus):
    packages = corpus.packages.collect()
    assert [p.manuscript_id for p in packages] == ["JT.1"]
    ns = "{http://pkp.sfu.ca/SWORD}"
    tree = ET.fromstring(packages[0].xml.encode())
    article = tree.find(f"{ns}article")
    assert article.get("locale") == "en_GB" and article.get("stage") == "production"
    ids = [f.get("id") for f in article.findall(f"{ns}submission_file")]
    assert ids == ["1", "3"]
    embed = article.find(f"{ns}submission_file/{ns}file/{ns}embed")
    assert decoded(embed.text) == b"%PDF" + bytes(200)
    galleys = article.findall(f"{ns}publication/{ns}article_galley")
    assert [(g.find(f"{ns}id").text, g.find(f"{ns}seq").text) for g in galleys] == [("1", "0"), ("3", "1")]
    people_ = article.findall(f".//{ns}author")
    assert [(a.get("seq"), a.get("id"), a.get("primary_contact")) for a in people_] == [("0", "1", "true"), ("1", "2", None)]
    assert people_[1].find(f"{ns}email").text == "jane@x.test"
    assert people_[0].find(f"{ns}affiliation").text == "Second"
    assert article.find(f".//{ns}abstract").text == "Some abstract."
    assert [k.text for k in article.findall(f".//{ns}keyword")] == ["one", "two"]
    assert article.find(f".//{ns}copyrightHolder").text == "Doe"
    found = rows(corpus.package_findings, "manuscript_id")
    assert found == [("bad one",), ("zip",)]


def test_citations_refs_and_sections(corpus):
    cited = corpus.citations.filter("manuscript_id = 'JT.1'")
    assert rows(cited, "cluster_no", "pos_in_cluster", "cite_key", "narrative", "prefix") == [
        (0, 0, "doe2020", False, "see"),
        (0, 1, "roe2021", False, ""),
        (1, 0, "undefined", True, ""),
    ]
    # the file beside the LaTeX source counts for its manuscript
    assert rows(corpus.refs.filter("manuscript_id = 'zip'"), "key") == [("doe2020",), ("roe2021",), ("unused",)]
    refs = corpus.refs.filter("manuscript_id = 'JT.1'")
    assert rows(refs, "key", "type", "year", "doi") == [
        ("doe2020", "article", "2020", "10.1/abc"),
        ("roe2021", "article", "2021", None),
        ("unused", "misc", None, None),
    ]
    roe = refs.filter("key = 'roe2021'").first()
    assert roe.fields["title"] == "Quoted, with comma"
    assert [a.family for a in roe.authors] == ["Roe", "Doe", "The and Co"]
    keyed = refs.withColumnRenamed("key", "cite_key")
    keys = ["manuscript_id", "cite_key"]
    assert rows(references.undefined_citations(cited, keyed, keys), "cite_key") == [("undefined",)]
    assert rows(references.uncited_refs(cited, keyed, keys), "cite_key") == [("unused",)]
    assert references.resolve_citations(cited, keyed, keys).count() == 2
    short = {r.key: r.short_author for r in references.short_authors(refs).collect()}
    assert short == {"doe2020": "Doe & Roe", "roe2021": "Roe et al.", "unused": "Example"}
    order = rows(references.sort_references(refs), "position", "key")
    assert order == [(1, "doe2020"), (2, "unused"), (3, "roe2021")]
    assert "month" not in references.clear_date_parts(refs).filter("key = 'doe2020'").first().fields
    got = rows(corpus.sections.filter("manuscript_id = 'JT.1'"), "pos", "level", "title", "unnumbered")
    assert got == [(0, 0, None, False), (1, 1, "Start", False), (2, 2, "Part", True)]
    whole = "".join(r.text for r in corpus.sections.filter("manuscript_id = 'JT.1'").orderBy("pos").collect())
    assert "# not a heading" in whole
    assert rows(sections.cited_set(cited), "cite_key") == [("doe2020",), ("roe2021",), ("undefined",)]


def test_figures(corpus):
    links = sources.image_links(corpus.canonical)
    lost, unused = sources.figure_integrity(links, corpus.files)
    assert rows(lost, "path") == [("figures/gone.png",)]
    assert rows(unused, "path") == [("figures/unused.png",)]
    assert rows(sources.metafile_links(corpus.files), "replacements") == [
        ({"figures/media/a.emf": "figures/media/a.png"},)
    ]


def test_sinks(corpus, spark, tmp_path):
    sinks.write_canonical(corpus.passed_through, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).count() == 2
    sinks.write_jats(corpus.jats, str(tmp_path / "j"))
    assert spark.read.parquet(str(tmp_path / "j")).first().file_name == "article.xml"
    sinks.write_packages(corpus.packages, str(tmp_path / "p"))
    stored = spark.read.parquet(str(tmp_path / "p"))
    assert stored.first().file_name == "JT.1_ojs_import.xml"
    sinks.export_files(stored, str(tmp_path / "e"), "xml")
    assert (tmp_path / "e/JT.1/JT.1_ojs_import.xml").read_text(encoding="utf-8") == stored.first().xml
    sinks.write_findings(corpus.findings, str(tmp_path / "f"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "f")).collect()]
    assert "::error file=manuscripts/bad one/_metadata.yml::Missing required field: abstract" in lines
    from quire.operators.findings import finding

    bare = finding(spark.createDataFrame([("x",)], "manuscript_id string"), "error", "r", F.lit("m"), F.lit(None))
    assert sinks.annotations(bare).first().value == "::error::m"


def test_galley_scan_encodes_on_one_line(spark, root):
    got = scans.encode_galleys(scans.scan_galleys(spark, root)).filter("name = 'article.pdf'").first()
    assert got.filesize == 204 and "\n" not in got.b64 and decoded(got.b64) == bytes(got.content)


# --- stages follow one another ---------------------------------------------------


def test_a_fresh_upload_passes(spark, tmp_path):
    from helpers import ARTICLE, BIB, REGISTRY, THEME, write

    fine = ARTICLE.replace("bibliography: references.bib", "bibliography: ./refs/../lit.bib")
    write(tmp_path / "themes/jtt/theme.yml", THEME)
    write(tmp_path / "themes/broken/theme.yml", "a: [")
    for name in ("fresh", "packed", "broken", "lost"):
        write(tmp_path / f"manuscripts/{name}/_metadata.yml", REGISTRY)
    write(tmp_path / "manuscripts/fresh/source/paper.md", fine)
    write(tmp_path / "manuscripts/fresh/lit.bib", BIB)
    packed = tmp_path / "manuscripts/packed"
    import io
    import zipfile

    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        archive.writestr("paper.tex", b"\\begin{document} caf\xe9 \\end{document}")
        archive.writestr("lib/own.bib", BIB)
    write(packed / "source/all.zip", buffer.getvalue())
    write(tmp_path / "manuscripts/broken/source/bad.zip", b"PK no archive")
    write(tmp_path / "manuscripts/broken/source/paper.md", fine)
    write(tmp_path / "manuscripts/lost/source/paper.md", ARTICLE)
    converted = spark.createDataFrame([("packed", ARTICLE)], "manuscript_id string, text string")
    themes = spark.createDataFrame([("broken", "broken"), ("lost", "nowhere")], "manuscript_id string, theme string")
    corpus = Corpus(spark, str(tmp_path), theme="jtt", profile=Profile(namespace="pub"), themes_of=themes, converted=converted)
    assert {r.manuscript_id: (r.rung, r.path) for r in corpus.chosen_source.collect()}["packed"] == (4, "source/paper.tex")
    passed = {r.manuscript_id: r.passed for r in corpus.verdict.collect()}
    assert passed["fresh"] and not passed["broken"] and not passed["lost"]
    keys = {(r.manuscript_id, r.key) for r in corpus.refs.collect()}
    assert {("fresh", "doe2020"), ("packed", "doe2020")} <= keys
    found = {(r.manuscript_id, r.rule) for r in corpus.findings.collect()}
    assert {("broken", "archive"), ("broken", "theme"), ("lost", "theme"), ("lost", "bibliography")} <= found
    undefined = references.undefined_citations(corpus.citations.select("manuscript_id", F.col("cite_key").alias("key")), corpus.refs, ["manuscript_id", "key"])
    assert rows(undefined.filter("manuscript_id = 'fresh'"), "key") == [("undefined",)]
