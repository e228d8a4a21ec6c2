import random

import pytest

from fidelmill.llm.graph import components


def brute(edges):
    up = {}

    def top(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {x: top(x) for x in up}


@pytest.mark.parametrize("at_once", [1, 20, 1 << 20])
def test_components_match_union_find(spark, at_once):
    r = random.Random(3)
    edges = [(r.randint(0, 150), r.randint(0, 150)) for _ in range(110)] + [(i, i + 1) for i in range(200, 240)] + [(500, i) for i in range(501, 540)] + [(7, 7)]
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "u long, v long").repartition(5), at_once=at_once).collect()}
    assert got == brute([e for e in edges if e[0] != e[1]])


def test_long_paths_and_a_hub(spark):
    """A path of some thousand nodes and a node with thousands of neighbours."""
    edges = [(i, i + 1) for i in range(3000)] + [(10_000, i) for i in range(20_000, 23_000)] + [(i, i + 1) for i in range(22_999, 25_000)]
    got = components(spark.createDataFrame(edges, "u long, v long").repartition(7), at_once=100)
    rows = {(r.component, r.n) for r in got.groupBy("component").count().withColumnRenamed("count", "n").collect()}
    assert rows == {(0, 3001), (10_000, 5002)}


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
