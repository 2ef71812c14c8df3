import random

import pytest

from quire.llm.graph import components


def brute(links):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        p, q = root(a), root(b)
        parent[max(p, q)] = min(p, q)
    return {x: root(x) for x in parent}


@pytest.mark.parametrize("links", [
    [],
    [(5, 5)],
    [(i, i + 1) for i in range(200)],
    [(0, i) for i in range(1, 300)] + [(1000, 1001)],
    [(random.Random(3).randrange(10**6) + 0 * k, k) for k in range(50)] + [(k, k + 7) for k in range(0, 400, 3)],
])
def test_components_are_named_by_their_least_node(spark, links):
    shuffled = links[:]
    random.Random(1).shuffle(shuffled)
    got = components(spark.createDataFrame(shuffled, "a long, b long").repartition(4)).collect()
    want = {n: c for n, c in brute([x for x in links if x[0] != x[1]]).items()}
    assert {r["node"]: r["component"] for r in got} == want and len(got) == len(want)
