"""YAML text to tree nodes: the one parser Spark has no built-in for."""

from __future__ import annotations

import datetime
import itertools
import json

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODE = T.StructType(
    [
        T.StructField("path", T.ArrayType(T.StringType())),
        T.StructField("kind", T.StringType()),
        T.StructField("value_json", T.StringType()),
        T.StructField("ord", T.IntegerType()),
    ]
)
NODES = T.ArrayType(NODE)
PARSED = T.StructType([T.StructField("nodes", NODES), T.StructField("error", T.StringType())])


_KINDS = {type(None): "null", dict: "map", list: "list", bool: "bool", int: "int", float: "float", str: "str", datetime.date: "date", datetime.datetime: "date"}
_json = json.JSONEncoder(ensure_ascii=False, default=str).encode


def _kind(value: object) -> str:
    return _KINDS.get(type(value), "str")


def _texted(value: object) -> object:
    """Maps with text keys throughout; of keys with one text the last counts."""
    if isinstance(value, dict):
        return {str(k): _texted(v) for k, v in value.items()}
    return [_texted(v) for v in value] if isinstance(value, list) else value


def _walk(tree: dict, path: tuple, out: list) -> None:
    """Append (path, kind, value as JSON) of every node in document order."""
    for key, value in tree.items():
        here, kind = (*path, key), _kind(value)
        if kind == "map":
            out.append((here, kind, None if value else "{}"))
            _walk(value, here, out)
        else:
            out.append((here, kind, _json(value)))


def _parse(text: str | None) -> tuple[list, str | None]:
    import yaml

    if text is None:
        return [], None
    nodes: list = []
    try:
        tree = yaml.load(text, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader))
        if not tree:
            return [], None
        if not isinstance(tree, dict):
            return [], f"top level is a {_kind(tree)}, not a map"
        _walk(_texted(tree), (), nodes)
    except Exception as problem:  # whatever is wrong with one text is a finding of that text
        return [], " ".join(str(problem).split()) or type(problem).__name__
    return nodes, None


@F.arrow_udf(PARSED)
def yaml_nodes(texts: pa.Array) -> pa.Array:
    """One row per YAML text: its nodes in document order, or the reason it cannot be read.

    Maps are nodes too (``value_json`` is ``{}`` when empty, else null); lists are leaves.
    The nodes of a whole batch are built as flat arrays.
    """
    errors, nodes, places, ends = [], [], [], [0]
    for text in texts.to_pylist():
        found, error = _parse(text)
        nodes += found
        places += range(len(found))
        ends.append(len(nodes))
        errors.append(error)
    paths = [n[0] for n in nodes]
    steps = pa.array([step for path in paths for step in path], pa.string())
    edges = pa.array(itertools.accumulate((len(path) for path in paths), initial=0), pa.int32())
    fields = [pa.ListArray.from_arrays(edges, steps), *[pa.array([n[k] for n in nodes], pa.string()) for k in (1, 2)], pa.array(places, pa.int32())]
    flat = pa.StructArray.from_arrays(fields, names=[f.name for f in NODE.fields])
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat), pa.array(errors, pa.string())], names=["nodes", "error"])
