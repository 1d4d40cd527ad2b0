import random
from collections import defaultdict

import pytest

from entigraph.llm import mixing

SCHEMA = "doc_id long, source string, text string, size int, copies int, s int"


def target_by_rounds(sizes, share=1.5, epochs=2.0):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, room, out = dict(weight), share * sum(sizes.values()), {}
    while left:
        per = room / sum(left.values())
        above = [s for s in left if per * left[s] > epochs * sizes[s]]
        if not above:
            return out | {s: per * w for s, w in left.items()}
        for s in above:
            out[s] = epochs * sizes[s]
            room -= out[s]
            del left[s]
    return out


@pytest.mark.parametrize("gather_most", [4096, 3])
def test_targets_and_taken(spark, gather_most):
    rng = random.Random(11)
    rows = [(i, rng.choice(["a", "a", "a", "b", "Z", "é", "c", None, "d"]), " ".join(["w"] * int(rng.paretovariate(1.2) * 10))) for i in range(800)]
    rows += [(900, "b", None), (901, "b", ""), (902, None, " \t"), (903, "empty", None), (None, "c", "no id"), (5, "twice", "x y z"), (5, "twice", "x y z")]
    docs = spark.createDataFrame([(d, s, t, 1, 2, 3) for d, s, t in rows], SCHEMA)
    got = mixing.mix(docs, gather_most=gather_most).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, s, t in rows:
        sizes[s] += len((t or "").split())
    want, taken, largest = target_by_rounds(sizes), defaultdict(int), defaultdict(int)
    for r in got:
        assert r.size == len((r.text or "").split()) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert r.taken == r.copies * r.size and 0 <= r.taken <= 2 * r.size
        assert r.copies >= int(want[r.source] / sizes[r.source] + 1e-9) if sizes[r.source] else True
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(4, 0.02 * want[s]), s
    again = mixing.mix(docs.repartition(7), gather_most=gather_most).collect()
    assert sorted((str(r.doc_id), r.size, r.taken) for r in again) == sorted((str(r.doc_id), r.size, r.taken) for r in got)


def test_documents_repeat(spark):
    rows = [(i, "ab"[i % 2], "w " * (i + 1), 7, 8, 9) for i in range(50)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(r.copies for r in mixing.mix(docs).collect())
    assert {r["size"] for r in out.collect()} == {7}


def test_heavy_documents_come_later(spark):
    rows = [(i, "s", ("clean words here " if i % 2 else "1!2?3# 4$5%6^ 7&8*9 ") * 5, 0, 0, 0) for i in range(2000)] + [(5000 + i, "t", "x " * 30, 0, 0, 0) for i in range(400)]
    rows += [(9000, "u", "y " * 4, 0, 0, 0)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA), share=0.4).where("source = 's'").collect()
    good = sum(r.copies for r in got if r.doc_id % 2)
    assert good > 1.5 * sum(r.copies for r in got if not r.doc_id % 2)


def test_repeated_rows_meet_the_target(spark):
    """A source of 40 equal rows is due half of them once more; of a source whose budget ends at a long
    document, small ones that come later fill the rest."""
    rows = [(7, "same", "w " * 10, 0, 0, 0)] * 40 + [(100 + i, "big", "v " * (3000 if i % 10 == 0 else 30), 0, 0, 0) for i in range(300)]
    for most in (1024, 2):
        got = mixing.mix(spark.createDataFrame(rows, SCHEMA), gather_most=most).collect()
        assert len(got) == len(rows)
        for s, smallest in (("same", 10), ("big", 30)):
            mine = [r for r in got if r.source == s]
            assert abs(sum(r.taken for r in mine) - mine[0].target) <= smallest
        assert {r.copies for r in got if r.source == "same"} <= {0, 1, 2}


def test_only_repeated_rows(spark):
    """40 rows of 10 words beside a source of 0 words: a target of 600 is met by 20 second copies."""
    rows = [(7, "same", "w " * 10, 0, 0, 0)] * 40 + [(8, "none", None, 0, 0, 0)] * 3
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r.copies for r in got if r.source == "same") == [1] * 20 + [2] * 20
    assert all(r.copies <= 2 for r in got) and sum(r.taken for r in got) == 600
    assert mixing.mixed_documents(spark.createDataFrame(rows, SCHEMA)).where("source = 'same'").count() == 60


def test_empty(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
