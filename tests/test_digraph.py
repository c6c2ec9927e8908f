"""Searches, strong components and layers against plain loops, in one task and over stored tables."""

import numpy as np
import pytest

from quarrykit import digraph
from quarrykit.digraph import layers, reachable, strong_components


def _graph(seed, n=60, m=110):
    rng = np.random.default_rng(seed)
    rows = [tuple(map(int, x)) for x in rng.integers(0, n, (m, 2))]
    # a ring, a tail, a self link, a repeat and nulls
    return rows + [(k, k + 1) for k in range(100, 109)] + [(109, 100), (109, 200), (200, 201), (300, 300), (1, 2), (1, 2), (None, 3), (3, None)]


def _edges(spark, rows, kind="long"):
    made = [tuple(None if x is None else x if kind == "long" else f"n{x:05d}" for x in r) for r in rows]
    return spark.createDataFrame(made, f"source {kind}, target {kind}")


def _closure(rows):
    after = {}
    for a, b in rows:
        if a is not None and b is not None:
            after.setdefault(a, set()).add(b)
    nodes = set(after) | {b for own in after.values() for b in own}
    reach = {}
    for a in nodes:
        seen, todo = {a}, [a]
        while todo:
            new = after.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        reach[a] = seen
    return after, reach


@pytest.fixture()
def rounds(monkeypatch):
    """Names of the tables that loops store."""
    names, plain = [], digraph.stored
    monkeypatch.setattr(digraph, "stored", lambda df, name: names.append(name) or plain(df, name))
    return names


@pytest.mark.parametrize("local", [digraph.LOCAL, 0])
def test_search_equals_plain_loop(spark, local):
    rows = _graph(1)
    _, reach = _closure(rows)
    seeds = spark.createDataFrame([(5,), (100,), (100,), (999,), (None,)], "node long")
    got = [r.node for r in reachable(_edges(spark, rows), seeds, local).collect()]
    assert sorted(got) == sorted(reach.get(5, {5}) | reach[100] | {999})
    assert reachable(_edges(spark, rows), seeds.limit(0), local).count() == 0
    assert [r.node for r in reachable(_edges(spark, []), seeds.where("node = 5"), local).collect()] == [5]


def test_search_of_a_chain_takes_few_rounds(spark, rounds):
    n = 4000
    order = np.random.default_rng(2).permutation(n + 1).tolist()
    chain = list(zip(order, order[1:]))
    seeds = spark.createDataFrame([(order[0],)], "node long")
    assert reachable(_edges(spark, chain), seeds, local=0).count() == n + 1
    assert rounds.count("reached") + rounds.count("jump") < 3 * n.bit_length()


@pytest.mark.parametrize(("local", "kind"), [(digraph.LOCAL, "string"), (digraph.LOCAL, "long"), (40, "long")])
def test_strong_components_equal_plain_loop(spark, local, kind):
    rows = _graph(3)
    _, reach = _closure(rows)
    name = (lambda x: x) if kind == "long" else (lambda x: f"n{x:05d}")
    want = {}
    for a in reach:
        own = {b for b in reach[a] if a in reach[b]}
        if len(own) > 1:
            want[name(a)] = name(min(own))
    got = strong_components(_edges(spark, rows, kind), local)
    assert {r.node: r.component for r in got.collect()} == want and got.count() == len(want)
    assert strong_components(_edges(spark, [], kind), local).count() == 0


def test_strong_components_of_a_chain_take_few_rounds(spark, rounds):
    n = 150
    rows = [(k, k + 1) for k in range(n)] + [(n + 1, n), (n, n + 1)]
    assert sorted(map(tuple, strong_components(_edges(spark, rows), local=n // 3).collect())) == [(n, n), (n + 1, n)]
    assert rounds.count("pivots") < n.bit_length()


@pytest.mark.parametrize("local", [digraph.LOCAL, 60])
def test_layers_equal_longest_paths(spark, local):
    rows = _graph(4, m=70)
    after, reach = _closure(rows)
    same = {a: min(b for b in reach[a] if a in reach[b]) for a in reach}
    onward = {}
    for a, own in after.items():
        onward.setdefault(same[a], set()).update(same[b] for b in own if same[b] != same[a])
    depth = {}

    def longest(a):
        if a not in depth:
            depth[a] = max((longest(b) + 1 for b in onward.get(a, ())), default=0)
        return depth[a]

    got = layers(_edges(spark, rows), local)
    assert {r.node: r.layer for r in got.collect()} == {a: longest(same[a]) for a in reach}
    assert layers(_edges(spark, []), local).count() == 0
