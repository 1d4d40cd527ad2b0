import numpy as np
from pyspark.sql import functions as F

from entigraph.llm import ann

SCHEMA = "vec_id long, embedding array<float>, score int, rank int"


def brute(rows, k=10, every=100):
    good = {}
    for i, v in rows:
        if i is not None and v and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good.setdefault(i, np.array(v, np.float32).astype(float))
    ids = np.array(list(good))
    m = np.array([good[i] for i in ids])
    out = {}
    for i in ids[ids % every == 0]:
        d = np.sqrt(((m - good[i]) ** 2).sum(1))
        out[int(i)] = [(int(ids[t]), float(d[t])) for t in np.lexsort((ids, d)) if ids[t] != i][:k]
    return out


def corpus(n=3000):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(16).astype(np.float32).tolist()) for i in range(n)]
    same = rng.standard_normal(16).astype(np.float32).tolist()
    rows += [(n + i, same) for i in range(n // 2)]  # a third of the rows
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] * 16, [None] + [1.0] * 15, [1.0] * 3]
    return rows + [(100_000 + 100 * i, v) for i, v in enumerate(odd)] + [(None, same), (n, same)]


def test_recall_and_scores(spark):
    rows = corpus()
    want = brute(rows)
    for options in ({}, {"bin_least": 64, "query_block": 7}):
        got = {}
        for r in ann.nearest(spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA), F.col("vec_id") % 100 == 0, **options).collect():
            got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
        assert set(got) == set(want)
        hits = 0
        for q, near in want.items():
            mine = [got[q][j] for j in range(1, 11)]
            assert mine == sorted(mine, key=lambda x: (x[1], x[0]))
            hits += len({v for v, _ in mine} & {v for v, _ in near})
            truth = dict(near)
            assert all(abs(truth[v] - s) < 1e-12 for v, s in mine if v in truth)
        assert hits >= 0.95 * 10 * len(want)


def test_few_rows(spark):
    rows = [(0, [1.0] * 16), (1, [2.0] * 16), (2, [2.0] * 16)]
    got = ann.nearest(spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA), F.col("vec_id") % 100 == 0).orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(0, 1, 1, 4.0), (0, 2, 2, 4.0)]
    assert ann.nearest(spark.createDataFrame(rows[:1], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0
    assert ann.nearest(spark.createDataFrame([], SCHEMA), F.lit(True)).count() == 0


def test_fitting_is_bounded():
    """The largest sample the defaults allow, split into as many lists as it leads to, needs little beside itself."""
    import tracemalloc

    rng = np.random.default_rng(2)
    points = rng.standard_normal((65_536, 16))
    tracemalloc.start()
    centroids = ann.two_level(points, 4096)
    ann.nearest_of(points, centroids)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 3500 < len(centroids) < 4700 and peak < 200 << 20


def test_few_bytes(spark):
    """Samples and bins that hold few vectors change nothing in what is returned but the recall."""
    rows = corpus(600)
    got = ann.nearest(spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA), F.col("vec_id") % 100 == 0, sample_bytes=256 * 128, bin_bytes=64 * 128)
    want, hits = brute(rows), 0
    for r in got.collect():
        hits += any(v == r.vec_id for v, _ in want[r.query_id])
    assert hits >= 0.9 * sum(map(len, want.values()))
