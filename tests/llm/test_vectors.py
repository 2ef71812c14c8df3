import numpy as np
import pytest
from pyspark.sql import types as T

from quire.llm import vectors
from quire.llm.vectors import near_duplicates

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), T.StructField("component_id", T.StringType())])


def brute(rows):
    ok = [i for i, (v, e, label) in enumerate(rows) if v is not None and label is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    comp, links = {i: rows[i][0] for i in range(len(rows))}, dict.fromkeys(range(len(rows)), 0)
    pairs = []
    for i in ok:
        for j in ok:
            if i < j and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.98:
                    pairs.append((i, j))
                    links[i] += 1
                    links[j] += 1
    changed = True
    while changed:
        changed = False
        for i, j in pairs:
            if comp[i] != comp[j]:
                comp[i] = comp[j] = min(comp[i], comp[j])
                changed = True
    return sorted(((rows[i][0], links[i], comp[i], None if rows[i][0] is None else rows[i][0] == comp[i]) for i in range(len(rows))), key=str)


@pytest.mark.parametrize("block", [1024, 16])
def test_agrees_with_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rng = np.random.default_rng(block)
    rows = []
    for k in range(240):
        center = np.random.default_rng(k % 12).normal(size=8)
        rows.append((k, (center + rng.normal(scale=0.12, size=8)).astype(np.float32).tolist(), k % 3))
    rows += [(500 + k, rows[5][1], rows[5][2]) for k in range(4)] + [(600, (2 * np.float32(rows[7][1])).tolist(), rows[7][2])]
    rows += [(700, None, 1), (701, [], 1), (702, [0.0] * 8, 1), (703, [1.0, None] + [0.0] * 6, 1), (704, [float("nan")] * 8, 1), (705, [float("inf")] * 8, 1)]
    rows += [(706, rows[1][1], None), (707, [1.0, 0.0], 1), (708, [1.0, 0.0], 1), (None, rows[1][1], 1), (9, rows[9][1], 0), (9, rows[9][1], 0)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(4)
    got = near_duplicates(docs).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=str) == brute(rows)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
