import hashlib
import math

import numpy as np
import pytest

from entigraph.llm import clustering

SCHEMA = "vec_id long, embedding array<float>, cluster int, distance string, `a.b` int"


def brute(rows, k=16, rounds=3, dim=64):
    kept = [(i, tuple(math.floor(64 * float(np.float32(x))) for x in v)) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    mark = lambda i: (i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else "")
    centroids = [v for i, v in sorted(kept, key=lambda r: (mark(r[0]), r[1]))[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min((far(v, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        members = [[] for _ in centroids]
        for _, v in kept:
            members[nearest(v)[1]].append(v)
        centroids = [tuple(sum(xs) // len(m) for xs in zip(*m, strict=True)) if m else c for m, c in zip(members, centroids, strict=True)]
    last = [(i, *nearest(v)) for i, v in kept]
    per = {j: sum(d for _, d, c in last if c == j) for _, _, j in last}
    sha = {j: hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest() for j in per}
    return sorted([(i, c, d, per[c], sum(per.values()), sha[c]) for i, d, c in last], key=str)


def corpus(seed, n, spread=1.0):
    rng = np.random.default_rng(seed)
    heads = rng.standard_normal((9, 64))
    rows = [(i, (heads[rng.integers(9)] + spread * rng.standard_normal(64)).astype(np.float32).tolist()) for i in range(n)]
    rows += [(n + i, rows[0][1]) for i in range(n // 2)]  # a third are equal
    odd = [None, [], [1.0] * 63, [float("nan")] + [0.0] * 63, [float("inf")] + [0.0] * 63, [None] + [0.0] * 63, [1.0] * 65]
    return rows + [(10_000 + i, v) for i, v in enumerate(odd)] + [(None, rows[1][1]), rows[2], rows[2], (3, [0.0] * 64)]


@pytest.mark.parametrize(("n", "spread"), [(400, 1.0), (300, 0.05), (20, 1.0), (6, 1.0)])
def test_against_brute_force(spark, n, spread):
    rows = corpus(n, n, spread)
    got = clustering.clusters(spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_ties_and_equal_starts(spark):
    rows = [(1, [0.0] * 64), (1, [0.0] * 64), (2, [1.0] * 64), (3, [0.5] * 64), (4, [-0.3] * 64)]
    got = clustering.clusters(spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
    assert clustering.clusters(spark.createDataFrame([], SCHEMA)).count() == 0


def test_too_large(spark):
    from pyspark.errors import PySparkException

    with pytest.raises(PySparkException, match="too large"):
        clustering.clusters(spark.createDataFrame([(1, [1e9] * 64, 1, "x", 2)], SCHEMA)).collect()
    with pytest.raises(ValueError):
        clustering.clusters(spark.createDataFrame([], SCHEMA), k=1 << 30)


def test_cover_tree():
    """Children hold all points of their node, once each, and stand apart; radii are true."""
    rng = np.random.default_rng(3)
    points = np.concatenate([np.floor(64 * (h + s * rng.standard_normal((60, 3)))) for h in rng.standard_normal((8, 3)) * 9 for s in (0.1, 1)]).astype(np.int32)
    points = np.unique(points, axis=0)
    nodes, order = clustering.cover_tree(points)
    assert sorted(order.tolist()) == list(range(len(points))) and len(nodes) > 50
    for node in nodes:
        x = points[order[node["lo"] : node["hi"]]].astype(float)
        assert np.isclose(np.sqrt(((x - points[node["center"]]) ** 2).sum(1)).max(), node["radius"])
        below = nodes[node["first"] : node["first"] + node["n"]]
        if len(below):
            assert below[0]["lo"] == node["lo"] and below[-1]["hi"] == node["hi"] and (below["lo"][1:] == below["hi"][:-1]).all()
            heads = points[below["center"]].astype(float)
            apart = np.sqrt(((heads[:, None] - heads[None]) ** 2).sum(2)) + 1e9 * np.eye(len(heads))
            assert apart.min() > clustering._SHRINK * node["radius"] * (1 - 1e-9)
            assert below["radius"].max() <= clustering._SHRINK * node["radius"] * (1 + 1e-9)


def test_pruning(monkeypatch):
    """Where vectors have structure most pairs are never measured, and the outcome is that of comparing all."""
    rng = np.random.default_rng(4)
    heads = rng.standard_normal((40, 64)) * 20
    points = np.unique(np.floor(64 * (heads[rng.integers(40, size=1000)] + 0.1 * rng.standard_normal((1000, 64)))).astype(np.int32), axis=0)
    nodes, order = clustering.cover_tree(points)
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order))
    nodes["center"] = place[nodes["center"]]
    centroids = np.floor(64 * heads).astype(np.int64)
    tree = clustering.Centroids(centroids)
    measured, exact = [], clustering.squared
    monkeypatch.setattr(clustering, "squared", lambda a, b: measured.append(len(a)) or exact(a, b))
    got = clustering.assigned(points[order], nodes, tree)
    want = ((points[order][:, None].astype(np.int64) - centroids[None]) ** 2).sum(2).argmin(1)
    assert (got == want).all() and sum(measured) < 0.2 * len(points) * len(centroids)
