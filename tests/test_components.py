"""Components by contraction: random graphs against union by hand, and how fast chains and stars shrink."""

import random

import pytest

from conftest import tuples
from redpencil.operators.components import connected_components, contractions

EDGE_DDL = "a bigint, b bigint"


def by_hand(nodes, edges):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed, n_edges", [(1, 0), (2, 25), (3, 70)])
def test_random_graphs(spark, seed, n_edges):
    rng = random.Random(seed)
    nodes = range(1, 81)
    edges = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(n_edges)]  # with loops
    edges += [(b, a) for a, b in edges[:10]]
    got = connected_components(spark.createDataFrame([(n,) for n in nodes], "item_no bigint"), spark.createDataFrame(edges, EDGE_DDL))
    assert dict(tuples(got)) == by_hand(nodes, edges) and got.count() == len(nodes)


def test_star_is_one_group_after_two_rounds(spark):
    n = 20_000
    edges = spark.range(1, n).selectExpr("7 AS a", "IF(id = 7, 0, id) AS b")
    rounds = contractions(edges)
    assert len(rounds) <= 2
    found = connected_components(spark.range(n).toDF("item_no"), edges)
    assert [tuple(r) for r in found.groupBy("component").count().collect()] == [(0, n)]


def test_chain_shrinks_with_every_round(spark):
    n = 5_000
    edges = spark.range(1, n).selectExpr("id - 1 AS a", "id AS b")
    sizes = [r.leaders.count() for r in contractions(edges)]
    assert sizes[0] == n and all(later <= 0.6 * size for size, later in zip(sizes, sizes[1:]))


def test_groups_that_end_in_different_rounds(spark):
    chain = [(k, k + 1) for k in range(100, 400)]
    edges = [*chain, (1, 2), (50, 60), (60, 70)]
    nodes = sorted({n for e in edges for n in e} | {5000})
    got = connected_components(spark.createDataFrame([(n,) for n in nodes], "item_no bigint"), spark.createDataFrame(edges, EDGE_DDL))
    assert dict(tuples(got)) == by_hand(nodes, edges)
