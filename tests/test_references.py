from pyspark.sql import functions as F

from quire.functions.bibtex import _entries, _fields
from quire.operators import references
from quire.sources.files import bibliography_rows


def test_abbreviations_stand_for_their_text_in_what_follows():
    keys, kinds, fields = _entries(
        'junk @misc{no, a=1}\n@string{J = "The " # {J. of {X}}}\n@String(k = j # ", k")\n@preamble{"x"}\n'
        "@Article{one,\n journal = J, title = {A, \"b\" {C} # d}, note = k # \" \" # 7,\n month = apr }\n"
        "@misc(two, title = \"q {\\\"o} #\", Title = {second}, x = {a\\}b}, j = J)\n@string{j = {other}}\n@misc{three, a = j, b = unknown # j}"
    )
    assert keys == ["one", "two", "three"] and kinds == ["article", "misc", "misc"]
    assert dict(fields[0]) == {"journal": "The J. of {X}", "title": 'A, "b" {C} # d', "note": "The J. of {X}, k 7", "month": "apr"}
    assert dict(fields[1]) == {"title": 'q {\\"o} #', "x": "a\\}b", "j": "The J. of {X}"}
    assert dict(fields[2]) == {"a": "The J. of {X}", "b": "unknownThe J. of {X}"}
    assert _entries(None) == _entries("") == ([], [], [])
    assert _fields("@misc{k, a = {x" + "{" * 50000) != {}  # unclosed braces end with the text


def test_rows_of_texts_without_entries(spark):
    rows = spark.createDataFrame([("a", None), ("b", ""), ("c", "@misc{k, title={T}}\n@misc{k, title={U}}")], "manuscript_id string, text string")
    got = bibliography_rows(rows).collect()
    assert [(r.manuscript_id, r.pos, r.key, r.title) for r in got] == [("c", 0, "k", "T"), ("c", 1, "k", "U")]


def inherited(spark, rows):
    made = [(m, i, k, t, f) for i, (m, k, t, f) in enumerate(rows)]
    refs = spark.createDataFrame(made, "manuscript_id string, pos int, key string, type string, fields map<string,string>")
    return {(r.manuscript_id, r.key, r.pos): (r.parent_state, r.fields) for r in references.inherit_fields(refs).collect()}


def test_fields_come_from_the_nearest_entry_of_a_chain(spark):
    chain = [("m", f"c{i}", "book", {"crossref": f"c{i + 1}", f"f{i}": "x", "near": str(i)}) for i in range(1, 20)]
    rows = [("m", "c0", "inbook", {"crossref": "c1", "title": "own"}), *chain, ("m", "c20", "book", {"title": "End", "year": "1"})]
    rows += [("n", "c1", "book", {"crossref": "c20"}), ("m", "lone", "misc", {"a": "b"}), ("m", "c20", "book", {"title": "second of its key"})]
    got = inherited(spark, rows)
    state, fields = got["m", "c0", 0]
    assert state == "found" and fields["title"] == "own" and fields["booktitle"] == "End" and fields["near"] == "1" and fields["year"] == "1"
    assert {f"f{i}" for i in range(1, 20)} <= set(fields) and fields["crossref"] == "c1"
    assert got["n", "c1", 21] == ("unknown", {"crossref": "c20"}) and got["m", "lone", 22] == (None, {"a": "b"})


def test_rings_inherit_nothing(spark):
    rows = [("m", "a", "misc", {"crossref": "b", "x": "1"}), ("m", "b", "misc", {"crossref": "c", "y": "1"}), ("m", "c", "misc", {"crossref": "b"})]
    rows += [("m", "self", "misc", {"crossref": "self"}), ("m", "d", "misc", {"crossref": "e"}), ("m", "e", "misc", {"z": "1"}), ("m", "blank", "misc", {"crossref": ""})]
    got = {k[1]: v for k, v in inherited(spark, rows).items()}
    assert [got[k][0] for k in ("a", "b", "c", "self", "d", "e", "blank")] == ["ring"] * 4 + ["found", None, None]
    assert got["a"][1] == {"crossref": "b", "x": "1"} and got["d"][1] == {"crossref": "e", "z": "1"}


def test_no_rows(spark):
    assert inherited(spark, [("m", "a", "misc", {"b": "c"})]) == {("m", "a", 0): (None, {"b": "c"})}
    refs = spark.createDataFrame([], "manuscript_id string, pos int, key string, type string, fields map<string,string>")
    assert references.inherit_fields(refs).select(F.col("parent_state")).count() == 0


def cited(spark, rows, **options):
    made = [(m, k, [{"family": f, "given": g} for f, g in people] if people is not None else None, y, t) for m, k, people, y, t in rows]
    refs = spark.createDataFrame(made, "m string, key string, authors array<struct<family:string,given:string>>, year string, title string")
    got = references.disambiguate(refs, ["m"], [F.col("key")], **options)
    assert got.columns == ["m", "key", "authors", "year", "title", "cite_form", "names_shown", "year_suffix"]
    return {r.key: (r.cite_form, r.names_shown, r.year_suffix) for r in got.collect()}


def test_initials_then_names_then_letters(spark):
    a, b, c, d, e = [(x, None) for x in "ABCDE"]
    got = cited(spark, [
        ("m", "1", [("Smith", "Jane")], "2020", "t"), ("m", "2", [("Smith", "Paul-Émile Q.")], "2019", "t"),
        ("n", "3", [("Smith", "Jane")], "2020", "t"),  # alone in its article
        ("m", "4", [a, b, c], "2001", "t"), ("m", "5", [a, b, d], "2001", "t"), ("m", "6", [a, e, d], "2001", "t"),
        ("m", "7", [b, a, c, d], "2001", "t"), ("m", "8", [b, a, c, d], "2001", "t"), ("m", "9", [b, e, c, d], "2001", "t"), ("m", "9b", [b, a, c], "2001", "t"),
        ("m", "a1", [c, d, e], "2001", "t"), ("m", "a2", [c, d, e], "2001", "t"), ("m", "a3", [c, d, e], "2002", "t"),
        ("m", "b1", None, "2001", "Title"), ("m", "b2", [], "2001", "Title"), ("m", "b3", [], None, "Title"), ("m", "b4", [], None, "Title"),
    ])
    assert got["1"] == ("J. Smith", 1, None) and got["2"] == ("P.-É. Q. Smith", 1, None) and got["3"] == ("Smith", 1, None)
    assert got["4"] == ("A, B, & C", 3, None) and got["5"] == ("A, B, & D", 3, None) and got["6"] == ("A, E, et al.", 2, None)
    assert got["7"] == ("B, A, C, et al.", 3, "a") and got["8"] == ("B, A, C, et al.", 3, "b") and got["9"] == ("B, E, et al.", 2, None)
    assert got["9b"] == ("B, A, & C", 3, None)
    assert got["a1"] == ("C et al.", 1, "a") and got["a2"] == ("C et al.", 1, "b") and got["a3"] == ("C et al.", 1, None)
    assert [got[k] for k in ("b1", "b2", "b3", "b4")] == [("Title", 0, "a"), ("Title", 0, "b"), ("Title", 0, "a"), ("Title", 0, "b")]


def test_given_names_where_initials_agree(spark):
    rows = [("m", "1", [("Smith", "Jane")], "2020", "t"), ("m", "2", [("Smith", "John")], "2020", "t"), ("m", "3", [("Smith", None)], "2020", "t")]
    assert cited(spark, rows) == {"1": ("J. Smith", 1, "a"), "2": ("J. Smith", 1, "b"), "3": ("Smith", 1, None)}
    assert cited(spark, rows, given="full") == {"1": ("Jane Smith", 1, None), "2": ("John Smith", 1, None), "3": ("Smith", 1, None)}


def test_bibliographies_of_one_input_task_are_parsed_by_many(spark):
    text = F.concat(F.lit("@misc{k"), F.col("id"), F.lit(", title = {T}}"))
    one = spark.range(0, 400, 1, 1).select(F.col("id").alias("manuscript_id"), text.alias("text"))
    rows = bibliography_rows(one).select("manuscript_id", "key", F.spark_partition_id().alias("task")).collect()
    assert sorted((r.manuscript_id, r.key) for r in rows) == [(i, f"k{i}") for i in range(400)]
    assert len({r.task for r in rows}) > 1


def test_equal_lists_of_names_are_refined_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(references, "settled", lambda df, real=references.settled: written.append(real(df)) or written[-1])
    a, b, c, d, none = [(x, None) for x in ("A", "B", "C", "D", None)]
    lists = [[a, b, c], [a, b, d], [a, c, none]]
    got = cited(spark, [("m", f"{i:03}", lists[i % 3], "2001", "t") for i in range(300)])
    assert [got[k][:2] for k in ("000", "001", "002")] == [("A, B, & C", 3), ("A, B, & D", 3), ("A, C, et al.", 2)]
    assert [got[k][2] for k in ("000", "003", "002", "299")] == ["a", "b", "a", "cv"]
    refined = [t for t in written if "__same" in t.columns]
    assert [t.count() for t in refined] == [3] and refined[0].agg(F.sum("__same")).first()[0] == 300
