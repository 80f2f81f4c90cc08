"""Connected components against union-find, with hubs, chains and awkward edges."""

import random

from plumbline.operators.graph import connected_components
from plumbline.operators.skew import join_per_key


def by_force(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(1000, 1040)]  # a chain
    edges += [(5, 100 + i) for i in range(300)] + [(990, 500 + i) for i in range(300)]  # hubs that are least and largest
    edges += [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(150)]
    edges += [(7, 7), (None, 3), (3, None), (5, 100), (100, 5)]
    frame = spark.createDataFrame(edges, "a long, b long")
    found = connected_components(frame, "a", "b").collect()
    assert {r.node: r.component for r in found} == by_force(edges) and len(found) == len(by_force(edges))
    assert connected_components(frame.limit(0), "a", "b").count() == 0


def test_join_per_key(spark):
    rows = spark.createDataFrame([(k, i) for i, k in enumerate([1] * 5000 + list(range(2, 1500)) + [None])], "k long, i long")
    per_key = rows.where("k > 0").groupBy("k").count().selectExpr("k", "count as n", "k * 10 as ten")
    out = join_per_key(rows, per_key, "k", "n", 6499)
    assert out.columns == ["k", "i", "ten"] and out.count() == 6498 and out.where("ten <> k * 10").count() == 0
