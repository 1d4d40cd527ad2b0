"""All shortest paths, against a breadth-first search from every node."""

import random
from collections import defaultdict, deque

import pytest

from entigraph.operators import graph

SCHEMA = "id string, source_entity_id string, target_entity_id string, relationship_type string"


def brute(edges, a, b, depth):
    near = defaultdict(set)
    for _, x, y, _ in edges:
        if x != y:
            near[x].add(y)
            near[y].add(x)
    if a == b:
        return {(a,)}
    far, front = {a: 0}, deque([a])
    while front:
        x = front.popleft()
        for y in near[x]:
            if y not in far:
                far[y] = far[x] + 1
                front.append(y)
    if b not in far or far[b] > depth:
        return set()
    paths = [(b,)]
    for d in range(far[b] - 1, -1, -1):
        paths = [(y, *p) for p in paths for y in near[p[0]] if far.get(y) == d]
    return set(paths)


@pytest.mark.parametrize(("n", "m", "depth"), [(14, 18, 5), (8, 30, 2)])
def test_all_shortest_paths(spark, n, m, depth):
    rng = random.Random(n)
    edges = [(str(i), f"v{rng.randrange(n)}", f"v{rng.randrange(n)}", "T") for i in range(m)]
    edges += [("x", "v0", "v1", "T"), ("y", "v1", "v0", "T"), ("z", "v2", "v2", "T")]
    pairs = [(f"v{rng.randrange(n)}", f"v{rng.randrange(n)}") for _ in range(8)] + [("v0", "v1"), ("v3", "v3"), ("v0", "nowhere")]
    got = graph.shortest_paths(spark.createDataFrame(edges, SCHEMA), spark.createDataFrame([*pairs, pairs[0], (None, "v1")], "source string, target string"), depth)
    rows = [(r.source, r.target, r.hops, tuple(r.path)) for r in got.collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == {(a, b, len(p) - 1, p) for a, b in pairs for p in brute(edges, a, b, depth)}


def test_types_and_one_path(spark):
    edges = spark.createDataFrame([("1", "a", "b", "T"), ("2", "b", "c", "T"), ("3", "a", "c", "U"), ("4", "a", "B", "T"), ("5", "B", "c", "T")], SCHEMA)
    pair = spark.createDataFrame([("a", "c")], "source string, target string")
    assert sorted(tuple(r.path) for r in graph.shortest_paths(edges, pair, 4, ("T",)).collect()) == [("a", "B", "c"), ("a", "b", "c")]
    assert graph.shortest_path(edges, "a", "c", 4) == ["a", "c"] and graph.shortest_path(edges, "a", "zz", 4) is None
    assert graph.shortest_paths(edges, pair.limit(0), 4).count() == 0


def test_an_end_of_many_pairs_goes_on_once(spark, monkeypatch):
    fronts, hop = [], graph._hop
    monkeypatch.setattr(graph, "_hop", lambda front, *rest: (fronts.append(front.count()), hop(front, *rest))[1])
    edges = spark.createDataFrame([(str(i), f"s{i}", "m", "T") for i in range(50)] + [("a", "m", "t", "T"), ("b", "m", "t", "T")], SCHEMA)
    pairs = spark.createDataFrame([(f"s{i}", "t") for i in range(50)], "source string, target string")
    got = sorted(tuple(r.path) for r in graph.shortest_paths(edges, pairs, 2).collect())
    assert got == sorted((f"s{i}", "m", "t") for i in range(50))
    assert max(fronts) == 1
