from hashlib import sha256
from math import floor

import numpy as np
import pytest
from pyspark.sql import types as T

from quire.llm import clusters
from quire.llm.clusters import cluster, drift

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("distance", T.StringType()), T.StructField("block", T.StringType())])
LONG = (1 << 63) - 1


def lloyd(rows, k, rounds, seed, dimensions):
    """Plain rounds in Python's integers."""
    kept = [(i, [floor(v * 1024) if abs(v) < 1e300 else int(v) * 1024 for v in e]) for i, e in rows if e is not None and len(e) == dimensions and all(v is not None and np.isfinite(v) for v in e)]
    order = sorted(kept, key=lambda r: (r[0] is None, sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [q for _, q in order[:k]]

    def nearest(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, q in kept:
            groups.setdefault(nearest(q)[1], []).append(q)
        centroids = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if j in groups else c for j, c in enumerate(centroids)]
    found = [(i, *nearest(q)) for i, q in kept]
    inertia = {j: sum(d for _, d, c in found if c == j) for j in range(k)}
    return [(i, j, min(d, LONG), min(inertia[j], LONG), min(sum(inertia.values()), LONG), sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, d, j in found]


def check(spark, rows, partitions=3, **options):
    given = {"k": 8, "rounds": 10, "seed": 3, "dimensions": 4} | options
    scans = []
    docs = spark.createDataFrame([(i, e, "x", "y") for i, e in rows], SCHEMA).repartition(partitions)
    got = cluster(docs, scans=scans, **given)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(lloyd(rows, **given), key=str)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("quire_clusters")]
    return scans


@pytest.mark.parametrize("block", [1, 7, 512])
def test_agrees_with_plain_rounds(spark, monkeypatch, block):
    monkeypatch.setattr(clusters, "BLOCK", block)
    rng = np.random.default_rng(block)
    n = 60 if block == 1 else 500
    rows = [(i, (rng.normal(size=4) + 3 * rng.integers(-1, 2, 4)).tolist()) for i in range(n)]
    rows += [(n + i, [1.5, -2.25, 0.0, 3.0]) for i in range(40)]  # copies
    rows += [(3, rows[3][1]), (None, [0.0, 1.0, -1.0, 2.0]), (None, [0.5] * 4)]
    rows += [(9001, None), (9002, []), (9003, [1.0] * 3), (9004, [1.0, None, 1.0, 1.0]), (9005, [float("nan")] * 4), (9006, [float("-inf")] * 4)]
    scans = check(spark, rows)
    if block > 1:
        assert scans[0] == n + 43 and sum(scans[1:]) < 5 * scans[0]  # most vectors are settled by bounds


def test_components_of_any_size(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=4) * 10.0 ** int(rng.choice([0, 4, 5, 9, 30, 300]))).tolist()) for i in range(60)]
    check(spark, rows + [(99, [1.7e308, -1.7e308, 1.0, 0.0])], k=5, rounds=4)


def test_ties_few_vectors_and_none(spark):
    check(spark, [(i, [float(i % 2), 0.0, 0.0, 0.0]) for i in range(20)], k=8)  # many equal centroids; clusters without vectors
    check(spark, [(1, [0.0] * 4), (2, [1.0] * 4)])
    assert cluster(spark.createDataFrame([], SCHEMA), dimensions=4).count() == 0
    assert cluster(spark.createDataFrame([(1, None, "x", "y")], SCHEMA), dimensions=4).count() == 0


def test_drift_bounds_every_point_and_is_often_less_than_the_whole():
    rng = np.random.default_rng(0)
    less = 0
    for _ in range(300):
        centre, old, new = rng.normal(size=(3, 6)) * rng.choice([0.1, 1, 10], (3, 1))
        radius = float(rng.choice([0.01, 0.5, 2]))
        bound = drift(centre, radius, old, new)
        x = rng.normal(size=(400, 6))
        x = centre + radius * x / np.linalg.norm(x, axis=1)[:, None] * rng.random((400, 1)) ** (1 / 6)
        nearer = np.linalg.norm(x - old, axis=1) - np.linalg.norm(x - new, axis=1)
        assert nearer.max() <= bound + 1e-12
        less += bound < 0.9 * np.linalg.norm(new - old)
    assert less > 100


def test_state_and_vectors_meet_without_a_shuffle(spark):
    rows = [(i, np.random.default_rng(i).normal(size=4).tolist(), "x", "y") for i in range(50)]
    kept = spark.createDataFrame(rows, SCHEMA).selectExpr("vec_id id", "embedding e")
    tables = clusters._Tables(spark, 4)
    numbered = clusters._blocks(kept, 4).selectExpr("*", "monotonically_increasing_id() block")
    blocks = tables.write(numbered.repartition(4, "block"))
    state = tables.write(clusters._round(blocks, None, clusters.Step([[0] * 4, [9] * 4]), 4))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = clusters._round(blocks, state, clusters.Step([[0] * 4, [9] * 4], [[0] * 4, [9] * 4], [1.0, 1.0]), 4)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    tables.drop()
    assert "Join" in plan and "Exchange" not in plan
