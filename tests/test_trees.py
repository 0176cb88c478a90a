"""Rooting, paths and branches of trees of any depth."""

import random

import pytest

from gridloom.operators import graph

from test_operators import brute_tree


def near_of(spark, pairs):
    return graph.adjacency(spark.createDataFrame(pairs, "src string, dst string"))


@pytest.mark.parametrize("seed", [0, 2])
def test_rooted_tree_is_that_of_a_queue(spark, seed):
    rng = random.Random(seed)
    names = [str(i) for i in rng.sample(range(500), 60)]
    pairs = [(names[rng.randrange(max(0, i - 1 - 5 * seed), i)], names[i]) for i in range(1, 50)] + [("x", "y"), ("y", "z"), ("z", "x")]  # a cycle that can't be reached
    source = names[rng.randrange(50)]
    tree = graph.rooted_tree(near_of(spark, pairs), source)
    parent, depth, branch = brute_tree(pairs, source)
    got = {r["node"]: r for r in tree.collect()}
    assert {n: r["parent"] for n, r in got.items()} == parent and {n: r["depth"] for n, r in got.items()} == depth
    assert sorted(got, key=lambda n: (got[n]["depth"], got[n]["path"])) == list(parent)  # the queue's order
    assert {r["node"]: r["branch"] for r in graph.branches(tree).collect()} == branch


def test_rooted_tree_of_little(spark):
    assert [tuple(r)[:3] for r in graph.rooted_tree(near_of(spark, [("a", "b")]), "nowhere").collect()] == [("nowhere", None, 0)]
    assert sorted(tuple(r)[:3] for r in graph.rooted_tree(near_of(spark, [("a", "b")]), "b").collect()) == [("a", "b", 1), ("b", None, 0)]
    for pairs in ([("a", "b"), ("b", "c"), ("c", "a")], [("a", "b"), ("b", "c"), ("c", "d"), ("d", "b"), ("b", "e")], [(x, y) for x in "abcd" for y in "abcd" if x < y]):
        with pytest.raises(ValueError):
            graph.rooted_tree(near_of(spark, pairs), "a")


def test_a_long_chain(spark, monkeypatch):
    """A chain of 100,000 nodes takes rounds by its logarithm."""
    steps = []
    before = graph.Rounds.step
    monkeypatch.setattr(graph.Rounds, "step", lambda self, df: (steps.append(1), before(self, df))[1])
    n = 100_000
    near = graph.adjacency(spark.range(1, n).selectExpr("cast(id - 1 as string) AS src", "cast(id as string) AS dst"))
    tree = graph.rooted_tree(near, "0")
    assert tree.filter("depth <> cast(node as int) OR cast(parent as int) <> depth - 1").count() == 0 and tree.count() == n
    assert len(steps) <= 2 * 19  # two tours


@pytest.mark.parametrize("seed", [1])
def test_main_path_and_branches_of_a_deep_tree(spark, seed):
    rng = random.Random(seed)
    parent = {str(i): str(max(0, i - 1 - rng.randrange(3) * (rng.random() < 0.2))) for i in range(1, 200)}
    value = {str(i): float(rng.randrange(4)) for i in range(200)}
    children, total = {}, dict(value)
    for i in range(199, 0, -1):
        children.setdefault(parent[str(i)], []).append(str(i))
        total[parent[str(i)]] += total[str(i)]
    way, at = [("0", 0)], "0"
    while at in children:
        at = min(children[at], key=lambda c: (-total[c], c))
        way.append((at, len(way)))
    tree = graph.rooted_by_parent(spark.createDataFrame([("0", None), *parent.items()], "node string, parent string"), ancestors=False)
    assert "ancestors" not in tree.columns
    sums = graph.subtree_sums(tree, spark.createDataFrame(list(value.items()), "bus string, kw double"), "bus", "kw")
    assert {r["node"]: r["downstream"] for r in sums.collect()} == total
    assert sorted(map(tuple, graph.main_path(tree, sums).collect())) == sorted(way)
    branch = brute_tree([(p, c) for c, p in parent.items()], "0")[2]
    assert {r["node"]: r["branch"] for r in graph.branches(tree).collect()} == branch
