import random

from quire.functions.text import collapse_ws, macro_argument
from quire.operators import sections


def tree(spark, bodies):
    cut = sections.sections(spark.createDataFrame(bodies, "manuscript_id string, body string"))
    return {(r.manuscript_id, r.title): (r.parent, r.number, r.path) for r in sections.section_tree(cut).collect()}


def test_contents_tree(spark):
    body = "intro\n# A\n## B\n### C\n# D {-}\n## E\n#### F\n## G\n# H\n### I\n## J\n## K {.unnumbered}\n## L\n"
    got = tree(spark, [("m", body), ("n", "### X\n## Y\n# Z\n### W"), ("none", "text only"), ("null", None), ("empty", "")])
    assert {k[1]: v[1] for k, v in got.items() if k[0] == "m"} == {
        "A": "1", "B": "1.1", "C": "1.1.1", "D": None, "E": None, "F": None, "G": None, "H": "2", "I": "2.1", "J": "2.2", "K": None, "L": "2.3",
    }
    assert got["m", "F"] == (5, None, ["D", "E", "F"]) and got["m", "C"][:2] == (2, "1.1.1") and got["m", "I"] == (8, "2.1", ["H", "I"])
    assert [got["n", t][:2] for t in "XYZW"] == [(None, "1"), (None, "2"), (None, "3"), (2, "3.1")]


def test_cutting_with_and_without_fences_is_the_same(spark):
    body = "pre # no\n#no\n# A {#id .unnumbered}\ntext\n\n####### seven\n##\tB \n\n# C"
    plain = spark.createDataFrame([("m", body), ("e", ""), ("h", "# only")], "manuscript_id string, body string")
    fenced = spark.createDataFrame([("m", body + "\n~~~x"), ("f", "# A\n```\n# no\n```\n# B")], "manuscript_id string, body string")
    rows = lambda df: [(r.pos, r.level, r.title, r.unnumbered, r.text) for r in sections.sections(df).collect() if r.manuscript_id == "m"]
    want = [(0, 0, None, False, "pre # no\n#no\n"), (1, 1, "A", True, "text\n\n####### seven\n"), (2, 2, "B", False, "\n"), (3, 1, "C", False, "")]
    assert rows(plain) == want
    assert rows(fenced) == [*want[:3], (3, 1, "C", False, "~~~x")]
    assert [r.title for r in sections.sections(fenced).where("manuscript_id = 'f'").collect()] == ["A", "B"]


def test_macro_arguments_with_few_many_and_no_closing_braces(spark):
    many = "{x}" * 200
    rows = [("\\k{a {b} c} d}", "a {b} c"), ("\\k{" + many + "end} z", many + "end"), ("\\k{a {b", "a {"), ("\\k{}", ""), ("\\k{", ""), ("\\K{a}", None), ("\\k{a}\\k{b}", "a"), ("\\k{ a \n\t b }", "a b"), ("\\k{" + many + "{", many)]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, t string")
    got = {r.i: r.a for r in df.select("i", macro_argument(df["t"], "k").alias("a")).collect()}
    assert [got[i] for i in range(len(rows))] == [r[1] for r in rows]


def test_every_kind_of_white_space_collapses(spark):
    spaces = " \t\n\x0b\x0c\r\x1c\x1f\x85\xa0       　"
    text = "".join(f"a{s}b {s}c{s} d{s}{s}" for s in spaces) + "​᠎"
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(collapse_ws(df["t"]).alias("x")).first().x == " ".join(["a", "b", "c", "d"] * len(spaces)) + " ​᠎"


def test_contents_of_bodies_are_those_of_their_sections(spark):
    rng = random.Random(3)
    bodies = [(f"m{i}", "pre\n" + "".join(f"{'#' * rng.randrange(1, 7)} T{j}{rng.choice(['', '', ' {-}'])}\nx\n" for j in range(rng.randrange(30)))) for i in range(40)]
    df = spark.createDataFrame([*bodies, ("null", None), (None, "# A\n## B")], "manuscript_id string, body string")
    got = sections.contents(df)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan and "Window" not in plan  # a task's memory doesn't grow with its rows
    rows = sections.section_tree(sections.sections(df))
    assert rows.columns == got.columns and rows.schema.simpleString() == got.schema.simpleString()
    assert sorted(map(repr, got.collect())) == sorted(map(repr, rows.collect()))
    found = {(r.manuscript_id, r.pos): (r.parent, r.number) for r in got.collect()}
    for m, body in bodies:
        marks = [(i, len(line.split()[0]), "{-}" in line) for i, line in enumerate([x for x in body.split("\n") if x.startswith("#")], 1)]
        parents = {i: max([j for j, level, _ in marks if j < i and level < own], default=None) for i, own, _ in marks}
        numbers = {}
        for i, _, plain in marks:
            before = sum(1 for j, _, p in marks if j <= i and parents[j] == parents[i] and not p)
            up = numbers.get(parents[i], "")
            numbers[i] = None if plain or up is None else f"{up}.{before}".lstrip(".")
            assert found[m, i] == (parents[i], numbers[i])
