import random
import time

import numpy as np

from entigraph.llm import decontaminate as dc

SCHEMA = "doc_id long, text string, item_id int, h int"
BENCH = "item_id long, text string, h int"


def brute(docs, bench, least=10, identity=0.8):
    """All diagonals of all pairs, with whole words compared."""
    out = set()
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
    for d, text in docs:
        words = low(text)
        for i, item_text in bench:
            item = low(item_text)
            for diagonal in range(-len(item) + 1, len(words)) if item else ():
                lo, hi = max(diagonal, 0), min(diagonal + len(item), len(words))
                equal = [words[p] == item[p - diagonal] for p in range(lo, hi)]
                begin, end, n = best(equal)
                if n >= min(least, len(item)) and n >= identity * (end - begin):
                    out.add((d, i))
    return out


def best(equal):
    top, at, run, begin = (0, 0), (0, 0), 0, 0
    for p, e in enumerate(equal):
        if run <= 0:
            run, begin = 0, p
        run += 1 if e else -2
        if run > top[0]:
            top, at = (run, 0), (begin, p + 1)
    return at[0], at[1], sum(equal[at[0] : at[1]])


def corpus():
    rng = random.Random(8)
    vocab = ["".join(rng.choices("abcdefg", k=4)) for _ in range(500)]
    bench = [(i, " ".join(rng.choices(vocab, k=rng.randint(12, 40)))) for i in range(15)] + [(20, "only three words"), (21, None), (22, ""), (None, "x y"), (0, "another text under the same id as before and some more")]
    docs = []
    for d in range(120):
        words = rng.choices(vocab, k=rng.randint(0, 80))
        if d % 3 == 0:
            item = bench[rng.randrange(15)][1].split()
            for _ in range(d % 4):
                item[rng.randrange(len(item))] = "changed"
            at = rng.randint(0, len(words))
            words[at:at] = item
        docs.append((d, " ".join(words).upper() if d % 5 == 0 else "\n".join(words)))
    docs += [(200, None), (201, "  "), (None, bench[0][1]), (202, "so only THREE words here"), (0, docs[0][1]), (203, "w " * 20_000 + bench[2][1])]
    return docs, bench


def test_joins_of_any_kind_equal_brute_force(spark):
    rows, items = corpus()
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], SCHEMA)
    bench = spark.createDataFrame([(i, t, 3) for i, t in items], BENCH)
    want = brute(rows[:-1], items) | {(203, 2)}
    broadcast = dc.overlaps(docs, bench).collect()
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        shuffled = dc.overlaps(docs, bench).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert {(r.doc_id, r.item_id) for r in broadcast} == want
    assert sorted((tuple(r) for r in broadcast), key=str) == sorted((tuple(r) for r in shuffled), key=str)
    kept = dc.clean(docs, bench)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in rows} - {d for d, _ in want}


def test_verify_finds_any_stretch_that_counts():
    """Ten equal words and 80 %, in any stretch of the diagonal."""
    rng = np.random.default_rng(1)
    tail = ([0, 1, 1, 1, 0, 1, 1]) * 6
    cases = [np.array([1] * 12 + tail, bool)] + [rng.random(rng.integers(10, 60)) < rng.choice([0.6, 0.75, 0.85]) for _ in range(300)]
    for equal in cases:
        n = len(equal)
        item = np.arange(n)
        total = np.concatenate([[0], np.cumsum(equal)])
        want = any(total[e] - total[b] >= max(10, 0.8 * (e - b)) for b in range(n) for e in range(b + 1, n + 1))
        found = dc.verify(np.where(equal, item, -1), item, 0, 10, 0.8)
        assert (found is not None) == want
        if found:
            begin, end, matched, identity = found
            assert matched == equal[begin:end].sum() >= 10 and identity == matched / (end - begin) >= 0.8
    assert dc.verify(np.where(cases[0], np.arange(54), -1), np.arange(54), 0, 10, 0.8)


def test_repeated_items_ties_and_hot_seeds(spark):
    """Repeated items are one; of equal overlaps the first counts; one word repeated does not multiply."""
    item = " ".join(f"w{i}" for i in range(20))
    rows = [(1, f"{item} and again {item}"), (2, "x " * 100_000), (3, "a b " * 500), (3, "a b " * 500)]
    bench = [(5, item), (5, item), (6, "x " * 200), (7, "b a " * 40), (8, "x"), (None, item)]
    began = time.perf_counter()
    got = sorted(dc.overlaps(spark.createDataFrame([(d, t, 1, 2) for d, t in rows], SCHEMA), spark.createDataFrame([(i, t, 3) for i, t in bench], BENCH)).drop("text_hash").collect(), key=str)
    assert [tuple(r) for r in got] == [
        (1, 5, 0, 20, 20, 1.0),
        (1, None, 0, 20, 20, 1.0),
        (2, 6, 0, 200, 200, 1.0),
        (2, 8, 0, 1, 1, 1.0),
        (3, 7, 1, 81, 80, 1.0),
        (3, 7, 1, 81, 80, 1.0),
    ]
    assert time.perf_counter() - began < 60


def test_empty(spark):
    docs, bench = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], BENCH)
    some = spark.createDataFrame([(1, "a b c", 1, 1)], SCHEMA)
    assert dc.overlaps(docs, bench).count() == dc.overlaps(some, bench).count()  == 0
    assert dc.clean(some, bench).count() == 1
