import pytest
from pyspark.sql import functions as F

from quire.functions import bibtex, text, values
from quire.operators import badges, canonical, findings, jats, package, people, sections, sources


def apply(spark, fn, *inputs):
    df = spark.createDataFrame([inputs], ", ".join(f"c{i} string" for i in range(len(inputs))))
    return df.select(fn(*[F.col(f"c{i}") for i in range(len(inputs))]).alias("v")).first().v


@pytest.mark.parametrize(
    "given, front, body",
    [
        ("---\na: 1\n---\nrest\n---\n", "a: 1", "rest\n---\n"),
        ("---\na: 1\n---", None, "---\na: 1\n---"),
        ("---\n---\n", None, "---\n---\n"),
        ("﻿---\na: 1\n---\nx", None, "﻿---\na: 1\n---\nx"),
        (" ---\na: 1\n---\nx", None, " ---\na: 1\n---\nx"),
        ("--- \na: 1\nb: 2\n---  \n", "a: 1\nb: 2", ""),
        ("", None, ""),
    ],
)
def test_front_matter(spark, given, front, body):
    got = apply(spark, text.split_front_matter, given)
    assert (got.front_matter, got.body) == (front, body)


def test_carriage_returns_are_dropped(spark):
    assert apply(spark, text.unix_newlines, "a\r\nb\rc\n") == "a\nb\nc\n"


@pytest.mark.parametrize(
    "tex, want",
    [
        ("x\\keywords{a {b} c}d", "a {b} c"),
        ("\\keywords{ a\n\t b }\\keywords{no}", "a b"),
        ("\\keywords{a \\} b} c}", "a \\"),
        ("\\keywords{never {closed} end", "never {closed} en"),
        ("\\keywords{", ""),
        ("\\keywords{}", ""),
        ("\\keyword{a}", None),
    ],
)
def test_macro_argument(spark, tex, want):
    assert apply(spark, lambda c: text.macro_argument(c, "keywords"), tex) == want


def test_white_space_follows_unicode(spark):
    raw = " a \x85b\x1c \n c　"
    assert apply(spark, text.collapse_ws, raw) == " ".join(raw.split())
    assert apply(spark, text.strip, raw) == raw.strip()


def test_keywords_keep_empty_items(spark):
    assert apply(spark, text.split_keywords, " a; b,,c ;") == ["a", "b", "", "c", ""]


@pytest.mark.parametrize("name, want", [("Ann  B. Lee", ("Ann B.", "Lee")), ("Plato", ("", "Plato")), (" Plato ", ("", " Plato "))])
def test_split_name(spark, name, want):
    got = apply(spark, text.split_name, name)
    assert (got.given, got.family, got.name) == (*want, name)


def test_join_names(spark):
    df = spark.createDataFrame([(["a"],), (["a", "b"],), (["a", "b", "c"],), ([],)], "n array<string>")
    assert [r.v for r in df.select(values.join_names(F.col("n")).alias("v")).collect()] == ["a", "a and b", "a, b, and c", ""]


@pytest.mark.parametrize("doi", ["https://doi.org/10.1/AB", "http://dx.doi.org/10.1/ab", "doi: 10.1/Ab", " 10.1/aB "])
def test_normalize_doi(spark, doi):
    assert apply(spark, text.normalize_doi, doi) == "10.1/ab"


def test_template_marks(spark):
    got = apply(spark, lambda j, d: text.fill_template(F.lit("{journal}, {doi}; {page}"), {"journal": j, "doi": d}), "J", None)
    assert got == "J, ; {page}"


def test_defaults(spark):
    assert apply(spark, values.locale_of, "en-GB") == "en_GB" and apply(spark, values.locale_of, None) == "en"
    assert apply(spark, values.noreply, None) == "noreply@journal.invalid"
    assert apply(spark, lambda c: values.galley_filename(c, F.lit("pdf")), None) == "article.pdf"
    assert apply(spark, values.doi_url, "") is None
    assert apply(spark, values.issn_note, "1-2") == " (ISSN: 1-2)"


def test_assembly_adds_only_what_is_absent(spark):
    def build(body, abstract=None, keywords=None):
        return apply(spark, canonical.assemble_front_matter, body, abstract, keywords)

    assert build("---\ntitle: T\n---\nBody", "An a.", "x; y") == (
        "---\ntitle: T\nabstract: >\n  An a.\n\nkeywords: [x, y]\n\nbibliography: references.bib\n---\n\nBody"
    )
    # the test is a substring test on the whole block
    assert build("---\nnote: my abstract\nbibliography: b.bib\n---\nB", "An a.") == (
        "---\nnote: my abstract\nbibliography: b.bib\n---\n\nB"
    )
    plain = build("Just text")
    assert plain.startswith('---\ntitle: "TODO: article title"') and plain.endswith("\n---\n\nJust text\n")
    only = build("Just text", None, "k")
    assert only == "---\nkeywords: [k]\n\nbibliography: references.bib\n---\n\nJust text"


def test_bib_fields_are_brace_aware(spark):
    entry = '@Book(k1, title = {A {B}, and "C"}, note="x {,} y", year=1999, MONTH = {apr},\n url = {http://a/b=c})'
    got = apply(spark, bibtex.bib_fields, entry)
    assert got["title"] == 'A {B}, and "C"' and got["note"] == "x {,} y" and got["url"] == "http://a/b=c"
    assert apply(spark, bibtex.entry_key, entry) == "k1" and apply(spark, bibtex.entry_type, entry) == "book"
    assert len(apply(spark, bibtex.split_entries, "junk\n@comment{x}\n@misc{a,\n t={@b}}\n @misc{c}\n")) == 2


def test_source_ladder(spark):
    rows = [
        ("m", "b/Manuscript.TEX", "Manuscript.TEX", ".tex", 1, False),
        ("m", "a/x.tex", "x.tex", ".tex", 99, True),
        ("d", "z.tex", "z.tex", ".tex", 1, True),
        ("d", "y.docx", "y.docx", ".docx", 50, False),
        ("l", "s.md", "s.md", ".md", 5, False),
        ("l", "t.md", "t.md", ".md", 5, False),
        ("l", "u.md", "u.md", ".md", 4, False),
    ]
    df = spark.createDataFrame(
        rows, "manuscript_id string, path string, name string, ext string, length long, has_document boolean"
    )
    got = {r.manuscript_id: (r.rung, r.path) for r in sources.choose_source(df).collect()}
    assert got == {"m": (2, "b/Manuscript.TEX"), "d": (4, "z.tex"), "l": (5, "s.md")}


def test_badge_truth_and_grouping(spark):
    flags = spark.sql(
        """select 'm' manuscript_id, array(
             named_struct('key', 'openreview', 'kind', 'str', 'value_json', '""'),
             named_struct('key', 'open-data', 'kind', 'bool', 'value_json', 'true'),
             named_struct('key', 'open-materials', 'kind', 'int', 'value_json', '0'),
             named_struct('key', 'open-code', 'kind', 'null', 'value_json', 'null'),
             named_struct('key', 'codecheck', 'kind', 'bool', 'value_json', 'true'),
             named_struct('key', 'reprocert-ai', 'kind', 'str', 'value_json', '"true"')) f,
           array(named_struct('key', 'open-data', 'kind', 'str', 'value_json', '"u"'),
             named_struct('key', 'open-materials', 'kind', 'str', 'value_json', '"u"'),
             named_struct('key', 'openreview', 'kind', 'str', 'value_json', '"u"')) l"""
    )
    active = badges.active_badges(flags, F.col("f"), F.col("l"))
    grouped = badges.group_adjacent(active).orderBy("ord").collect()
    assert [(r.badge, r.group_no) for r in grouped] == [
        ("open-materials", 1), ("open-data", 1), ("codecheck", 2), ("openreview", 3),
    ]
    assert flags.select(badges.earned_badges(F.col("f")).alias("e")).first().e == "open-data, codecheck, reprocert-ai"


def test_jats_scopes_and_errors(spark):
    xml = [
        (1, "<article><front><article-meta/></front></article>"),
        (2, "<article><front><journal-meta><!-- <issn>1</issn> --></journal-meta></front></article>"),
        (3, "<html/>"),
        (4, "<article article-type='x'><journal-meta><issn-l>1</issn-l></journal-meta><article-meta><volume>9</volume></article-meta></article>"),
    ]
    fields = "journal issn publisher volume doi article_type discipline article_id license license_url lay_summary recommended_citation".split()
    pub = F.struct(*[F.lit({"issn": "I", "volume": "1"}.get(f)).cast("string").alias(f) for f in fields])
    df = spark.createDataFrame(xml, "manuscript_id int, xml string").withColumn("pub", pub)
    got = {r.manuscript_id: r for r in jats.enrich_jats(df, F.lit("")).collect()}
    assert got[1].xml == "<article><front><article-meta><volume>1</volume></article-meta></front></article>"
    assert got[2].xml.endswith("<!-- <issn>1</issn> --><issn>I</issn></journal-meta></front></article>")
    assert got[3].xml == "<html/>" and got[3].jats_error
    assert "<issn-l>1</issn-l><issn>I</issn>" in got[4].xml and "<volume>9</volume></article-meta>" in got[4].xml
    elements = jats.jats_elements(df.filter("manuscript_id = 4")).collect()
    assert [(e.parent, e.tag, e.text) for e in elements] == [("journal-meta", "issn-l", "1"), ("article-meta", "volume", "9")]


def test_middle_galley_absent(spark):
    files = spark.createDataFrame([("m", 3), ("m", 1), ("m", 1), ("n", 9)], "manuscript_id string, i int")
    got = package.galley_numbers(package.present_files(files, F.col("i"), 3)).collect()
    assert sorted((r.manuscript_id, r.file_id, r.seq) for r in got) == [("m", 1, 0), ("m", 3, 1)]


def test_fallbacks_without_authors(spark):
    ms = spark.createDataFrame([("m", None), ("n", "p")], "manuscript_id string, path string")
    authors = spark.createDataFrame(
        [("n", 0, "", "Zed"), ("n", 2, "b@x", "B"), ("n", 1, "a@x", "A")], "manuscript_id string, seq int, email string, family string"
    )
    emails = {r.manuscript_id: r.fallback_email for r in people.fallback_email(ms, authors, F.col("path")).collect()}
    assert emails == {"m": "noreply@journal.invalid", "n": "a@x"}
    holders = {r.manuscript_id: r.copyright_holder for r in people.copyright_holder(ms, authors, F.lit("J")).collect()}
    assert holders == {"m": "J", "n": "Zed"}
    none = findings.any_email(authors.filter("manuscript_id = 'm'"))
    assert none.count() == 0


def test_citation_forms(spark):
    body = "[-@a; see @b:c/d., p. 2] @e. \\@no me@mail.org [text](mailto:x@y.org) ``@code`` @{odd key}\n~~~\n@fenced\n~~~\n[no key]"
    df = spark.createDataFrame([("m", body)], "manuscript_id string, body string")
    got = sections.extract_citations(df).orderBy("cluster_no", "pos_in_cluster").collect()
    assert [(r.cite_key, r.narrative) for r in got] == [("a", False), ("b:c/d", False), ("e", True), ("odd key", True)]


def test_section_pieces_cover_the_body(spark):
    body = "intro\n# A {#id .unnumbered}\ntext\n\n```\n# code\n```\n####### seven\n###### \nend"
    df = spark.createDataFrame([("m", body)], "manuscript_id string, body string")
    got = sections.sections(df).orderBy("pos").collect()
    assert [(r.level, r.title, r.unnumbered) for r in got] == [(0, None, False), (1, "A", True), (6, "", False)]
    assert got[1].text == "text\n\n```\n# code\n```\n####### seven\n" and got[2].text == "end"


# --- records that would stop a job -------------------------------------------------


def test_bad_yaml_is_a_finding_of_its_row(spark):
    from quire.functions.yaml import yaml_nodes

    texts = ["a: &a {b: *a}", "author: [{2024-01-01: x}]", "1: a\n'1': b", "x: {y: [", "k: v"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", yaml_nodes("t").alias("y")).collect()
    got = {r.i: ([(".".join(n.path), n.value_json) for n in r.y.nodes], r.y.error) for r in rows}
    assert got[0][1] and got[3][1]
    assert got[1] == ([("author", '[{"2024-01-01": "x"}]')], None)
    assert got[2] == ([("1", '"b"')], None) and got[4] == ([("k", '"v"')], None)


def test_very_long_citation_key(spark):
    from quire.operators.sections import extract_citations

    body = "see @" + "k" * 200_000 + ". And @a:b-c."
    df = spark.createDataFrame([("m", body)], "manuscript_id string, body string")
    assert {len(r.cite_key) for r in extract_citations(df).collect()} == {200_000, 5}


def test_paths_are_normalized(spark):
    from quire.functions.text import decoded, normal_path

    paths = {"./references.bib": "references.bib", "figures/my%20fig.png": "figures/my fig.png", "a/../b//c": "b/c", "../x": "../x", "a+b.png": "a+b.png", "100%": "100%"}
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r.p: r.n for r in df.select("p", normal_path(F.col("p")).alias("n")).collect()} == paths
    raw = spark.createDataFrame([(b"caf\xe9 \xc3\xa9",), (None,)], "c binary")
    assert [r.t for r in raw.select(decoded(F.col("c")).alias("t")).collect()] == ["caf é", None]


def test_attribute_names_count(spark):
    from quire.operators.jats import missing_elements

    have = spark.createDataFrame([("m", "p", "article-id", {"pub-id-type": "pmid", "specific-use": "doi"})], "manuscript_id string, parent string, tag string, attrs map<string,string>")
    want = spark.createDataFrame([("m", "p", "article-id", "pub-id-type", "doi"), ("m", "p", "article-id", "pub-id-type", "pmid")], "manuscript_id string, parent string, tag string, attr_name string, attr_value string")
    assert [r.attr_value for r in missing_elements(have, want).collect()] == ["doi"]


def test_joined_bibliography_values(spark):
    from quire.functions.bibtex import bib_fields

    entry = '@article{k, title = {A} # " and " # {B \\# C}, month = apr # "~1", note = {x # y}, year = 2020}'
    df = spark.createDataFrame([(entry,)], "e string")
    assert df.select(bib_fields("e").alias("f")).first().f == {"title": "A and B \\# C", "month": "apr~1", "note": "x # y", "year": "2020"}
