"""Ancestors at any depth, in cycles and in large trees."""

import random

from brindle.operators import sync


def ancestors(spark, edges, asked):
    nodes = spark.createDataFrame(edges, "node long, parent long").repartition(4)
    found = [r[0] for r in sync.tree_ancestors(nodes, spark.createDataFrame([(a,) for a in asked], "node long"), "node", "parent").collect()]
    assert len(found) == len(set(found))
    return set(found)


def test_a_chain_of_five_thousand(spark):
    edges = [(i, i + 1) for i in range(5000)] + [(5000, None)]
    assert ancestors(spark, edges, [0]) == set(range(1, 5001))
    assert ancestors(spark, edges, [4990, 4995]) == set(range(4991, 5001))


def test_random_trees(spark):
    pick = random.Random(5)
    edges = [(i, pick.randrange(max(0, i - 3), i)) for i in range(1, 400)] + [(0, None), (7, 4), (None, 3), (900, 901)]
    up = {}
    for a, b in edges:
        if a is not None and b is not None:
            up.setdefault(a, set()).add(b)
    for asked in ([399], [5, 380, 381], [0], [12345], [900], []):
        want, work = set(), list(asked)
        while work:
            new = up.get(work.pop(), set()) - want
            want |= new
            work += new
        assert ancestors(spark, edges, asked) == want


def test_cycles_end_and_are_reported(spark):
    edges = [(1, 2), (2, 3), (3, 1), (4, 1), (5, 5), (6, 7), (7, None), (8, 4), (9, 8)]
    assert ancestors(spark, edges, [9]) == {8, 4, 1, 2, 3}
    assert ancestors(spark, edges, [1]) == {1, 2, 3} and ancestors(spark, edges, [5, 6]) == {5, 7}
    nodes = spark.createDataFrame(edges, "node long, parent long")
    assert {r[0] for r in sync.tree_cycles(nodes, "node", "parent").collect()} == {1, 2, 3, 5}
    assert sync.tree_cycles(nodes.where("node > 5"), "node", "parent").count() == 0
    ring = spark.range(101).selectExpr("id as node", "(id + 1) % 101 as parent")
    assert sync.tree_cycles(ring, "node", "parent").count() == 101


def test_a_million_nodes_under_a_hot_parent(spark):
    nodes = spark.range(1, 1_000_001).selectExpr("id as node", "if(id % 3 = 0, 1, id div 2) as parent")  # a third of all stand under node 1
    asked = spark.range(999_000, 1_000_001).selectExpr("id as node")
    found = {r[0] for r in sync.tree_ancestors(nodes, asked, "node", "parent").collect()}
    want = set()
    for n in range(999_000, 1_000_001):
        while n > 0:
            n = 1 if n % 3 == 0 else n // 2
            if n in want:
                break
            want.add(n)
    assert found == want
