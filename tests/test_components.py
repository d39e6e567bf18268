import random

import pytest

from plotweave.operators.components import connected_components


def labels(spark, edges):
    rows = connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert len({r.node for r in rows}) == len(rows)
    return {r.node: r.label for r in rows}


def brute(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


@pytest.mark.parametrize("n", [1_000, 10_000])
def test_chains_in_random_order(spark, n):
    ids = list(range(n))
    random.Random(n).shuffle(ids)
    got = labels(spark, list(zip(ids, ids[1:])))
    assert len(got) == n and set(got.values()) == {0}


def test_random_graphs_and_a_hot_node(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(3_000), rng.randrange(3_000)) for _ in range(1_400)]
    edges += [(9_000, 10_000 + i) for i in range(5_000)] + [(20_000 + i, 19_000) for i in range(500)] + [(20_499, 9_000)]
    edges += edges[:50] + [(7, 7), (50_000, 50_000), (None, 5), (60_000, None)]
    assert labels(spark, edges) == brute(edges)


def test_empty(spark):
    assert labels(spark, []) == {} and labels(spark, [(4, 4)]) == {4: 4}
