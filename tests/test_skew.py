import random

import pytest
from pyspark.sql import functions as F

from quire.operators import people, references, skew


@pytest.fixture
def unmerged(spark):
    """Spark would keep so few rows in one range."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def ranges(df, keys, order):
    """Ranges that the rows of each key lie in."""
    return {r.k: r.n for r in skew._ranged(df, keys, order).groupBy("k").agg(F.countDistinct("__range").alias("n")).collect()}


def uneven(spark, seed):
    """A third of the rows on one key, another key just above the limit, many small ones, tied order values."""
    rng = random.Random(seed)
    keys = ["hot"] * 150 + ["warm"] * 25 + [f"k{i % 60}" for i in range(275)]
    rows = [(k, rng.randint(0, 40), i, rng.choice(["a", "a", "b", "", None])) for i, k in enumerate(keys)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "k string, o int, id int, v string").repartition(5)


def runs_of(rows, blank_breaks):
    out, state = {}, {}
    for k, o, i, v in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        number, last = state.get(k, (0, object()))
        joins = v == last and not (blank_breaks and (v or "") == "")
        number = number if joins else number + 1
        state[k] = (number, v)
        out[(k, i)] = number
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_numbering_splits_hot_keys(spark, unmerged, seed):
    rows, df = uneven(spark, seed)
    order = [F.col("o"), F.col("id")]
    assert ranges(df, ["k"], order)["hot"] > 1
    got = {(r.k, r.id): r.n for r in skew.number_rows(df, ["k"], order, "n").collect()}
    want = {}
    for k in {r[0] for r in rows}:
        for n, r in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])), start=1):
            want[(k, r[2])] = n
    assert got == want


@pytest.mark.parametrize("blank_breaks", [False, True])
def test_runs_split_hot_keys(spark, unmerged, blank_breaks):
    rows, df = uneven(spark, 3)
    out = skew.number_runs(df, ["k"], [F.col("o"), F.col("id")], "v", "n", blank_breaks)
    assert {(r.k, r.id): r.n for r in out.collect()} == runs_of(rows, blank_breaks)


def test_one_order_value_and_null_keys(spark):
    rows = [(None if i % 2 else "a", 1, i) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, o int, id int").repartition(3)
    got = {(r.k, r.id): r.n for r in skew.number_rows(df, ["k"], [F.col("o"), F.col("id")], "n").collect()}
    assert got == {(k, i): i // 2 + 1 for k, _, i in rows}


def test_year_letters_go_past_z(spark):
    refs = spark.createDataFrame([("Doe", 2020, i) for i in range(20000)] + [("Roe", 2020, 0)], "who string, y int, i int")
    out = references.year_suffix(refs, ["who", "y"], [F.col("i")])
    got = {(r.who, r.i): r.year_suffix for r in out.collect()}
    assert [got[("Doe", i)] for i in (0, 25, 26, 51, 52)] == ["a", "z", "aa", "az", "ba"]
    letters = [chr(97 + i) for i in range(26)]
    words = [*letters, *(a + b for a in letters for b in letters), *(a + b + c for a in letters for b in letters for c in letters)]
    assert [got[("Doe", i)] for i in range(18278)] == words and got[("Doe", 18278)] == "aaaa"
    assert got[("Roe", 0)] is None


def test_author_lists_up_to_and_past_twenty(spark):
    sizes = {"one": 1, "two": 2, "three": 3, "twenty": 20, "many": 25}
    rows = [(k, i, f"N{i:02d}") for k, n in sizes.items() for i in range(n)]
    people = spark.createDataFrame(rows, "k string, seq int, family string")
    got = {r.k: r for r in references.author_lists(people, "k", "seq", "family").collect()}
    assert [got[k].short_author for k in sizes] == ["N00", "N00 & N01", "N00 et al.", "N00 et al.", "N00 et al."]
    assert got["three"].bibliography_authors == "N00, N01, & N02"
    assert got["twenty"].bibliography_authors == ", ".join(f"N{i:02d}" for i in range(19)) + ", & N19"
    assert got["many"].bibliography_authors == ", ".join(f"N{i:02d}" for i in range(19)) + ", . . . N24"


def test_affiliations_of_an_author_are_numbered_in_place(spark):
    refs = spark.createDataFrame([("m", 0, 0, "a", None), ("m", 0, 2, None, "In"), ("m", 0, 1, "gone", None), ("m", 1, 0, None, "In"), ("n", 0, 5, "a", "x")], "manuscript_id string, seq int, pos int, ref string, inline_name string")
    listed = spark.createDataFrame([("m", "a", 7, "A")], "manuscript_id string, aff_id string, number int, name string")
    found = people.resolve_affiliations(refs, listed)
    # not written between and read again, and ready for what is grouped by author
    assert "FileScan" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [("m", 0, 0, 7, "A"), ("m", 0, 2, 2, "In"), ("m", 1, 0, 1, "In"), ("n", 0, 5, 1, "x")]
