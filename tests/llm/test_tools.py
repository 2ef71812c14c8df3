import json

from quire.llm.tools import chat_calls, linked_calls

SCHEMAS = {"add": {"a": ("BIGINT", True), "b": ("BIGINT", False)}}
CALLS = [
    ("c1", "add", '{"b": 2, "a": 1}', None), ("c2", "add", '{"a": "x"}', "c1"), ("c3", "add", '{"a":1,"z":[{"y":1,"x":null}]}', "c2"), ("c4", "none", "{}", "gone"),
    ("c5", "add", "not json", "c6"), ("c6", "add", '{"a":1}', "c5"), ("c7", None, None, "c5"), (None, "add", '{"a":1}', None), ("c1", "add", '{"b": 2, "a": 1}', None), ("c8", "add", "[1]", None),
]


def test_links_order_and_canonical_json(spark):
    calls = spark.createDataFrame(CALLS, "id string, name string, arguments string, after string")
    results = spark.createDataFrame([("c1", 'two "é"\n'), ("c1", "z"), ("c9", "lost"), (None, "x"), ("c2", None)], "id string, content string")
    found = linked_calls(calls, results, SCHEMAS).collect()
    assert sorted((r.kind, r.id, r.n_results, json.loads(r.json)["result"], r.valid) for r in found if r.kind != "call") == [("further", "c1", 1, "z", None), ("orphan", "c9", 1, "lost", None)]
    rows = {r.id: r for r in found if r.kind == "call"}
    assert {k: (r.position, r.valid, r.n_results) for k, r in rows.items()} == {
        "c1": (0, True, 2), "c2": (1, False, 1), "c3": (2, False, 0), "c4": (0, False, 0), "c5": (None, False, 0), "c6": (None, True, 0), "c7": (None, False, 0), "c8": (0, False, 0),
    }
    for r in rows.values():
        assert json.dumps(json.loads(r.json), sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r.json
    assert json.loads(rows["c1"].json) == {"arguments": {"a": 1, "b": 2}, "id": "c1", "name": "add", "position": 0, "result": 'two "é"\n'}


def test_no_call_and_no_result_is_lost(spark):
    calls = spark.createDataFrame(
        [("a", "add", '{"a":2}', None, "x"), ("a", "add", '{"a":1}', None, "x"), ("a", "add", '{"a":1}', None, "y"), ("b", "add", '{"a":1}', "a", "z"), (None, "add", "{}", None, "")],
        "id string, name string, arguments string, after string, Kind string",
    )
    long = "w " * 200000
    results = spark.createDataFrame([("a", "2", 1), ("a", "1", 1), ("a", "1", 1), ("a", None, 1), ("o", "p", 1), ("o", "q", 1), ("n", None, 1), ("b", long, 1)], "id string, content string, position int")
    found = linked_calls(calls, results, SCHEMAS).collect()
    got = sorted(((r.id, r.kind, r.position, r.valid, r.n_results, json.loads(r.json).get("arguments"), json.loads(r.json)["result"]) for r in found), key=str)
    assert got == sorted([
        ("a", "call", 0, True, 4, {"a": 1}, "1"), ("a", "conflict", None, False, 0, {"a": 2}, None), ("a", "further", None, None, 1, None, "2"), ("a", "further", None, None, 1, None, None),
        ("b", "call", 1, True, 1, {"a": 1}, long), ("o", "orphan", None, None, 1, None, "p"), ("o", "orphan", None, None, 1, None, "q"), ("n", "orphan", None, None, 1, None, None),
    ], key=str)


def test_long_chain_and_empty_tables(spark):
    calls = spark.createDataFrame([(f"k{i}", "add", "{}", f"k{i - 1}" if i else None) for i in range(300)], "id string, name string, arguments string, after string")
    results = spark.createDataFrame([], "id string, content string")
    assert {r.id: r.position for r in linked_calls(calls, results, SCHEMAS).collect()} == {f"k{i}": i for i in range(300)}
    assert linked_calls(calls.limit(0), results, SCHEMAS).count() == 0


def test_chats(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", None), (1, 2, "assistant", "a"), (1, 3, "user", "u"), (None, 0, "user", "x"), (2, None, "user", "x"), (3, 0, None, "r"), (1, 3, "user", "u")]
    calls, results = chat_calls(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert {(r.id, r.after) for r in calls.collect()} == {("1:0", "1:-2"), ("1:1", "1:0"), ("1:3", "1:1"), ("3:0", "3:-2")}
    assert [(r.id, r.content) for r in results.collect()] == [("1:1", "a")]
