"""Components against union-find."""

import random

from fixtura.llm.components import components


def _union(edges):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for u, v in edges:
        a, b = root(u), root(v)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in up}


def test_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(i + 1, i) for i in range(40, 70)] + [(200, 200 + i) for i in range(1, 80)] + [(500, 500), (7, 9), (9, 7)]
    edges += [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(90)]
    rng.shuffle(edges)
    df = spark.createDataFrame(edges + [(None, 1), (3, None)], "u long, v long")
    assert {r.node: r.component for r in components(df).collect()} == _union(edges)


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
