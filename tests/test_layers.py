import random

from pyspark.sql import functions as F

from quire.functions import yaml as reader
from quire.functions.values import is_missing
from quire.operators import layers

NODES = "array<struct<path:array<string>,kind:string,value_json:string,ord:int>>"


def tree(rng, depth=0):
    out = {}
    for key in rng.sample("abc", rng.randint(0, 3)):
        pick = rng.random()
        if pick < 0.5 and depth < 2:
            out[key] = tree(rng, depth + 1)
        else:
            out[key] = rng.choice([None, [1], {}, rng.randint(0, 9), "x"])
    return out


def merge(base, override):
    out = dict(base)
    for key, value in override.items():
        both = isinstance(out.get(key), dict) and isinstance(value, dict)
        out[key] = merge(out[key], value) if both else value
    return out


def nodes_of(value):
    out = []
    reader._walk(value, (), out)
    return [(list(path), kind, value, i) for i, (path, kind, value) in enumerate(out)]


def key_order(nodes):
    order = {}
    for path, *_ in nodes:
        order.setdefault(tuple(path[:-1]), []).append(path[-1])
    return order


def test_both_merges_agree_with_a_recursive_merge(spark):
    rng = random.Random(7)
    triples = [[tree(rng) for _ in range(3)] for _ in range(400)]
    df = spark.createDataFrame(
        [(i, *map(nodes_of, t)) for i, t in enumerate(triples)], f"id int, a {NODES}, b {NODES}, c {NODES}"
    ).repartition(8)
    merged = df.select("id", layers.merge_nodes(F.col("a"), F.col("b"), F.col("c")).alias("m"))
    in_row = {r.id: [(n.path, n.kind, n.value_json) for n in r.m] for r in merged.collect()}
    exploded = layers.union_layers(*[df.select("id", F.inline(c)) for c in "abc"])
    as_rows, row_order = {}, {}
    for r in sorted(layers.merge_rows(exploded, "id").collect(), key=lambda r: (r.id, r.ord)):
        as_rows.setdefault(r.id, set()).add((tuple(r.path), r.kind, r.value_json if r.kind != "map" else None))
        row_order.setdefault(r.id, []).append((r.path, r.ord))
    for i, (theme, registry, front) in enumerate(triples):
        want = nodes_of(merge(merge(theme, registry), front))
        flat = [(p, k, v) for p, k, v, _ in want]
        assert sorted(in_row[i], key=str) == sorted(flat, key=str)
        assert key_order(in_row[i]) == key_order(flat)
        assert key_order(row_order.get(i, [])) == key_order(flat) and [o for _, o in row_order.get(i, [])] == list(range(len(flat)))
        assert as_rows.get(i, set()) == {(tuple(p), k, v if k != "map" else None) for p, k, v in flat}


def test_theme_rank_is_the_highest_layer(spark):
    rows = spark.createDataFrame([(1, 0, ["a"]), (1, 2, ["a"]), (1, 1, ["b"])], "id int, rank int, path array<string>")
    assert {(r.path[0], r["rank"]) for r in layers.theme_rank(rows, "id").collect()} == {("a", 2), ("b", 1)}


def test_yaml_kinds_and_bad_input(spark):
    text = "a: 1\nb: {c: yes, d: 2025-01-02}\ne: [x, 2]\nf:\ng: {}\nh: 1.5\ni: ''\n1: z\n"
    rows = [(0, text), (1, "a: [unclosed"), (2, "- list"), (3, ""), (4, None)]
    got = {r.id: r for r in layers.parse_layer(spark.createDataFrame(rows, "id int, t string"), "t", "id").collect()}
    kinds = {".".join(n.path): (n.kind, n.value_json) for n in got[0].nodes}
    assert kinds == {
        "a": ("int", "1"), "b": ("map", None), "b.c": ("bool", "true"), "b.d": ("date", '"2025-01-02"'),
        "e": ("list", '["x", 2]'), "f": ("null", "null"), "g": ("map", "{}"), "h": ("float", "1.5"),
        "i": ("str", '""'), "1": ("str", '"z"'),
    }
    assert got[1].error and got[2].error == "top level is a list, not a map"
    assert got[3].error is None and got[3].nodes == [] and got[4].nodes == []


def test_falsy_values_are_missing(spark):
    rows = [
        ("int", "0", True), ("int", "5", False), ("float", "0.0", True), ("str", '""', True), ("str", '" "', False),
        ("bool", "false", True), ("bool", "true", False), ("null", "null", True), (None, None, True),
        ("list", "[]", True), ("list", "[0]", False), ("map", "{}", True), ("map", None, False), ("date", '"2025-01-01"', False),
    ]
    df = spark.createDataFrame(rows, "kind string, value_json string, want boolean")
    assert df.filter(is_missing(F.col("kind"), F.col("value_json")) != F.col("want")).count() == 0


def test_lookup_needs_exact_keys(spark):
    df = spark.createDataFrame([("a: {b: 1}\na.b: 2\n",)], "t string").select(reader.yaml_nodes("t").alias("y"))
    one = df.select(layers.merge_nodes(F.col("y.nodes")).alias("n"))
    assert one.select(layers.get_path(F.col("n"), "a.b").alias("v")).first().v == "1"
    json = spark.createDataFrame([('{"a": {"b": 3}, "a.b": 4}',), ("not json",)], "j string")
    assert [r.v for r in json.select(layers.json_lookup(F.col("j"), "a.b").alias("v")).collect()] == ["3", None]


def test_theme_ranks_are_dealt_out_before_they_are_combined(spark):
    rows = spark.createDataFrame([(1, ["a"], 0), (1, ["a"], 2), (1, ["a", "b"], 1), (2, ["a"], 0)], "id int, path array<string>, rank int")
    ranked = layers.theme_rank(rows, "id")
    assert sorted((r.id, r.path, r["rank"]) for r in ranked.collect()) == [(1, ["a"], 2), (1, ["a", "b"], 1), (2, ["a"], 0)]
    plan = ranked._jdf.queryExecution().sparkPlan().toString()
    assert plan.rindex("HashAggregate") < plan.index("RepartitionByExpression" if "RepartitionByExpression" in plan else "Exchange")
