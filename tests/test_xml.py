import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from quire.functions.xml import front_of, tokens_of
from quire.operators import jats

SCOPES = jats.SCOPES
FIELDS = "journal issn publisher volume doi article_type discipline article_id license license_url lay_summary recommended_citation".split()


def tokens(inner, before="", after=""):
    return front_of(f"{before}<article><front><article-meta>{inner}</article-meta></front>{after}</article>".encode(), SCOPES)


def elements(inner, **more):
    return [(e["tag"], dict(e["attrs"]), e["text"], e["namespace"]) for e in tokens(inner, **more)["elements"]]


def test_quotes_entities_cdata_and_comments():
    assert elements("""<a t="L'avenir" u='say "no" > yes'/>""") == [("a", {"t": "L'avenir", "u": 'say "no" > yes'}, "", None)]
    assert elements("<a b='&lt;&#233;'>x &amp; <![CDATA[<b/>]]><!-- <c/> -->y<d/>z</a>") == [("a", {"b": "<é"}, "x & <b/>y", None), ("d", {}, "", None)]
    assert elements("<!-- <title-group> --><?pi <x/>?>") == []
    assert elements("<a>&e;</a>", before="<!DOCTYPE article [<!ENTITY e 'text'>]>") == [("a", {}, "text", None)]
    assert elements("<p:a xmlns:p='u'><p:b/><c xmlns='v'><d/></c><e/></p:a>")[0:4] == [
        ("p:a", {"xmlns:p": "u"}, "", "u"), ("p:b", {}, "", "u"), ("c", {"xmlns": "v"}, "", "v"), ("d", {}, "", "v"),
    ]


def test_what_is_not_well_formed_is_an_error():
    assert tokens("<a b='1' b='2'/>")["error"].startswith("duplicate attribute")
    assert tokens("<a></b>")["error"].startswith("mismatched tag")
    assert tokens("", after="<open>")["error"] and front_of(b"", SCOPES)["error"] and front_of(b"text", SCOPES)["error"]
    assert tokens("&e;", before="<!DOCTYPE article [<!ENTITY e '<a/>'>]>")["error"] == "an element comes from an entity"


def test_offsets_count_bytes():
    data = "<article article-type='é'><journal-meta/><article-meta id='>'>ü<volume/></article-meta></article>".encode()
    found = front_of(data, SCOPES)
    assert data[found["kind_start"] : found["kind_end"]].decode() == " article-type='é'"
    journal, meta = found["scopes"]
    assert journal["closed"] and data[: journal["inside"]].endswith(b"<journal-meta/>")
    assert data[meta["inside"] : meta["until"]].decode() == "ü<volume/>"
    assert data[found["elements"][0]["start"] :].startswith(b"<volume/>")


def enriched(spark, xml, **values):
    pub = F.struct(*[F.lit(values.get(f)).cast("string").alias(f) for f in FIELDS])
    df = spark.createDataFrame([(1, xml)], "manuscript_id int, xml string").withColumn("pub", pub)
    once = jats.enrich_jats(df, F.lit("")).first()
    again = jats.enrich_jats(jats.enrich_jats(df, F.lit("")), F.lit("")).first()
    assert again.xml == once.xml
    return once


def test_splices_look_past_comments_and_quotes(spark):
    inner = "<!-- <title-group> --><x a='>&lt;title-group>'/><title-group>ü</title-group>"
    got = enriched(spark, f"<article><article-meta>{inner}</article-meta></article>", discipline="D", doi="10/1")
    cats = '<article-categories><subj-group subj-group-type="subject"><subject>D</subject></subj-group></article-categories>'
    doi = '<article-id pub-id-type="doi">10/1</article-id>'
    assert got.xml == "<article><article-meta>" + doi + inner.replace("<title-group>ü", cats + "<title-group>ü") + "</article-meta></article>"
    first = enriched(spark, "<article><article-meta><title-group/></article-meta></article>", discipline="D", doi="10/1")
    assert first.xml == f"<article><article-meta>{doi}{cats}<title-group/></article-meta></article>"


def test_broken_and_null_articles_stay_as_they_are(spark):
    for xml in ("<article><article-meta a='1' a='2'/></article>", "<article><article-meta>", "<html/>", ""):
        got = enriched(spark, xml, volume="1")
        assert got.xml == xml and got.jats_error
    assert enriched(spark, None, volume="1").xml is None


def test_errors_as_rows(spark):
    df = spark.createDataFrame([("a", "<article/>"), ("b", "<x"), ("c", "<y/>"), ("d", None)], "manuscript_id string, xml string")
    assert sorted(r.manuscript_id for r in jats.jats_errors(df).collect()) == ["b", "c"]


def test_objects_of_a_portion_only_are_held():
    text = "<article><front><article-meta>" + "<volume a='1'>v</volume>" * 10 + "</article-meta></front></article>"
    texts = pa.array([text, None] * 5000)
    tracemalloc.start()
    try:
        found = tokens_of(texts, ("article-meta",))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(found) == 10000 and found[1].as_py() is None and len(found[9998].as_py()["elements"]) == 10
    assert peak < 10 << 20
    assert len(tokens_of(pa.array([], pa.string()), ("article-meta",))) == 0
