"""All overlapping pairs, against plain loops."""

import random
from datetime import datetime, timedelta

from entigraph.operators import temporal

SCHEMA = "id string, k string, start timestamp_ntz, end timestamp_ntz"
T0 = datetime(2024, 1, 1)


def corpus():
    rng = random.Random(1)
    rows = []
    for i in range(300):
        start = T0 + timedelta(seconds=rng.choice([rng.randrange(10), rng.randrange(100_000), -rng.randrange(5_000_000_000)]))
        length = rng.choice([0, -5, 1, 2, 3, 1000, 1024, 90_000, 10_000_000])
        rows.append((f"e{i}", rng.choice(["x", "x", "x", "y", None]), start, None if i % 40 == 0 else start + timedelta(seconds=length)))
    return rows + [("n", "x", None, T0), ("same1", "x", T0, T0 + timedelta(microseconds=1)), ("same2", "x", T0, T0 + timedelta(microseconds=1))]


def test_overlaps(spark):
    rows = corpus()
    good = [(i, k, s, e) for i, k, s, e in rows if k and s and (e is None or e > s)]
    far = datetime.max
    want = set()
    for i, k, s, e in good:
        for j, m, t, u in good:
            if k == m and (s, i) < (t, j) and t < (e or far):
                end = min(e or far, u or far)
                want.add((k, i, j, t, None if end == far else end))
    got = temporal.overlaps(spark.createDataFrame(rows, SCHEMA), ["k"]).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_the_long_one_meets_all(spark):
    """An edge inside a long one that isn't its neighbour is found."""
    rows = [("long", "x", T0, T0 + timedelta(days=100)), ("a", "x", T0 + timedelta(days=1), T0 + timedelta(days=2)), ("b", "x", T0 + timedelta(days=50), T0 + timedelta(days=51))]
    got = temporal.overlaps(spark.createDataFrame(rows, SCHEMA), ["k"])
    assert {(r.a, r.b) for r in got.collect()} == {("long", "a"), ("long", "b")}
    assert temporal.overlaps(got.limit(0).selectExpr("a AS id", "k", "start", "end"), ["k"]).count() == 0
