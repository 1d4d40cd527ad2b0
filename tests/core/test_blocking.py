"""Candidates by shared words, conflicts and duplicates, against plain loops over all pairs."""

import difflib
import random

import pytest

from entigraph.operators import blocking, resolve

SCHEMA = "id string, entity_text string, kind string, properties map<string,string>, embedding array<float>"


def corpus(n=160):
    rng = random.Random(3)
    words = ["bank", "of", "north", "south", "Trust", "co", "ltd", "first"]
    rows = []
    for i in range(n):
        text = " ".join(rng.choices(words, [40, 30, 5, 5, 4, 3, 2, 1], k=rng.randint(1, 6)))
        text = rows[0][1] if i % 3 == 2 else text
        properties = None if i % 11 == 0 else {k: rng.choice(["a", "a", "a", "alpha beta", "alpha beta", "gamma"]) for k in rng.sample(["x", "y", "z"], rng.randint(0, 2))}
        vector = None if i % 7 == 0 else [rng.gauss(0, 1), rng.gauss(0, 1)]
        rows.append((f"e{i:04d}", text, rng.choice("AB"), properties, vector))
    return rows + [("f1", "", "A", None, None), ("f2", "  ", "A", {}, None), ("f3", "x x", "A", {}, None), ("f4", "x", "A", {}, None), ("f5", None, "A", None, None)]


def words_of(text):
    return set(text.lower().split())


def index(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def score(a, b):
    if a.lower() == b.lower():
        return 1.0
    if not a or not b:
        return 0.0
    return (index(set(a.lower().split(" ")), set(b.lower().split(" "))) + index(set(a.lower()), set(b.lower()))) / 2


def cosine(x, y):
    dot = lambda a, b: sum(p * q for p, q in zip(a, b, strict=True))
    return dot(x, y) / (dot(x, x) * dot(y, y)) ** 0.5


@pytest.mark.parametrize(("w", "hot"), [(0.6, 1000), (0.6, 1), (0.3, 2), (1.0, 1)])
def test_no_pair_is_lost(spark, w, hot):
    rows = [r for r in corpus() if r[1] is not None]
    got = {(r.block.kind, r.a, r.b) for r in blocking.alike_classes(blocking.classes(spark.createDataFrame(rows, SCHEMA), ["kind"]), w, hot).collect()}
    texts = {(k, t.lower()) for _, t, k, _, _ in rows}
    assert got == {(k, a, b) for k, a in texts for m, b in texts if k == m and a < b and index(words_of(a), words_of(b)) >= w - 1e-9}


def test_counts(spark):
    rows = [r for r in corpus() if r[1] and r[1].strip()]
    got = {r.id: r.n for r in blocking.candidate_counts(spark.createDataFrame(rows, SCHEMA), ["kind"], 0.6).collect()}
    near = lambda a, b: a.lower() == b.lower() or index(words_of(a), words_of(b)) >= 0.6 - 1e-9
    assert got == {i: sum(j != i and k == m and near(t, u) for j, u, m, _, _ in rows) for i, t, k, _, _ in rows}


@pytest.mark.parametrize("most", [1, 5, 1000])
def test_conflicts(spark, most):
    rows = corpus()
    want = []
    for i, t, k, p, x in rows:
        own = []
        for j, u, m, q, y in rows:
            if i == j or k != m or t is None or u is None:
                continue
            s, c = score(t, u), cosine(x, y) if x and y else None
            if s >= 0.8:
                own.append((i, j, "high_confidence_duplicate" if c is not None and c >= 0.9 else "possible_duplicate", (s + c) / 2 if c is not None and c >= 0.9 else s))
            elif p and q and any(score(p[key], q[key]) < 0.7 for key in p.keys() & q.keys()):
                own.append((i, j, "inconsistent_attributes", 0.7))
        want += own[:most]
    frame = spark.createDataFrame([r for r in rows if r[1] is not None], SCHEMA)
    got = [(*tuple(r)[:3], round(r.score, 5)) for r in blocking.conflicts(frame, ["kind"], most=most).collect()]
    assert sorted(got) == sorted((*w[:3], round(w[3], 5)) for w in want)


@pytest.mark.parametrize("least", [0.65, 0.85])
def test_duplicates_by_mean(spark, least):
    rows = [r for r in corpus() if r[1] is not None]
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()

    def attributes(p, q):
        p, q = p or {}, q or {}
        common = p.keys() & q.keys()
        return 1.0 if not p and not q else sum(ratio(p[c], q[c]) for c in common) / len(common) if common else 0.0

    reps = {}
    for i, t, k, p, x in sorted(rows):
        reps.setdefault((k, t.lower(), str(x), str(sorted((p or {}).items())) + str(p is None)), (i, t.lower(), k, p, x))
    want = {}
    for i, t, k, p, x in reps.values():
        for j, u, m, q, y in reps.values():
            if i < j and k == m:
                s = ((t == u) + ratio(t, u) + (cosine(x, y) if x and y else 0.0) + attributes(p, q)) / 4
                if s >= least:
                    want[i, j] = s
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {(r.a_id, r.b_id): r.score for r in blocking.duplicates_by_mean(frame, ["kind"], least).collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-5 for x in want)
    assert sum(r.n for r in blocking.same_entities(frame, ["kind"]).collect()) == len(rows)


def test_duplicates_are_every_pair(spark):
    rows = [r for r in corpus(60) if r[1]]
    got = {(r.a_id, r.b_id) for r in resolve.duplicates(spark.createDataFrame(rows, SCHEMA), ["kind"]).collect()}
    assert got == {(i, j) for i, t, k, _, _ in rows for j, u, m, _, _ in rows if i < j and k == m and score(t, u) >= 0.8}


def test_hot_text_is_compared_once(spark):
    """A text that many share makes one class, so its conflicts stay a few an entity."""
    rows = spark.range(30_000).selectExpr("format_string('%06d', id) AS id", "if(id % 3 = 0, concat('one ', id), 'the same') AS entity_text", "'A' AS kind")
    got = blocking.conflicts(rows, ["kind"])
    assert got.count() == 20_000 * 5


def test_what_entities_of_one_value_share_is_found_once(spark):
    """Values are compared by value and not by entity, and those alike carry their scores: no side with properties is joined again."""
    rows = spark.range(3_000).selectExpr("format_string('%05d', id) AS id", "concat('t', id) AS entity_text", "'A' AS kind", "map('v', if(id % 2 = 0, 'left', 'on top')) AS properties")
    plan = blocking.conflicts(rows, ["kind"], most=2)._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Join" in line and "_properties" in line for line in plan.splitlines())
    assert "exists(" not in plan
    got = blocking.conflicts(rows, ["kind"], most=2).collect()
    assert {(r.entity_id, r.other_id) for r in got} == {(f"{i:05d}", f"{j:05d}") for i in range(3_000) for j in ((1, 3) if i % 2 == 0 else (0, 2))}
