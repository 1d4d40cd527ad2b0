"""The join over pieces and the greedy leaders, against plain loops."""

import difflib
import random

import pytest

from entigraph.operators import alike, resolve

SCHEMA = "block string, item string, place int"


def ratio(a, b):
    return difflib.SequenceMatcher(None, a, b).ratio()


def mixed(seed, n):
    """Texts of many lengths, with copies that lose, gain, swap and move characters."""
    rng = random.Random(seed)
    out = ["", "a", "b", "aa", "ab", "ba", "é", "漢字", "aaaaaaaaaaaaaaaa", "aaaaaaaaaaaaaaab"]
    while len(out) < n:
        text = "".join(rng.choices("abcdeé #0123", k=rng.randint(1, 40)))
        out.append(text)
        for _ in range(rng.randint(0, 4)):
            t = list(text)
            for _ in range(rng.randint(1, max(1, len(t) // 5))):
                at = rng.randrange(len(t)) if t else 0
                what = rng.randrange(4)
                if what == 0 and t:
                    del t[at]
                elif what == 1:
                    t.insert(at, rng.choice("abcé#9"))
                elif what == 2 and t:
                    t[at] = rng.choice("abcé#9")
                elif t:
                    t = t[at:] + t[:at] if rng.random() < 0.2 else t
            out.append("".join(t))
    out = list(dict.fromkeys(out))[:n]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("t", [0.6, 0.85, 1.0])
def test_no_pair_is_lost(spark, t):
    words = mixed(int(t * 100), 260)
    rows = alike.measured(spark.createDataFrame([(("x", "y")[i % 2], w, i) for i, w in enumerate(words)], SCHEMA))
    got = {(r.leader_place, r.place) for r in alike.pairs(rows, rows, t).collect()}
    assert got == {(i, j) for j in range(len(words)) for i in range(j) if (j - i) % 2 == 0 and ratio(words[i], words[j]) >= t}


@pytest.mark.parametrize("options", [{"batch": 16, "batch_most": 40}, {"batch": 290, "pairs_most": 50}])
def test_leaders(spark, options, monkeypatch):
    if "batch" in options:
        monkeypatch.setattr(alike, "_FEW_LEADERS", 0)
    words = mixed(7, 300)
    want, leaders = {}, []
    for w in words:
        lead = next((x for x in leaders if ratio(x, w) >= 0.8), None)
        leaders += [w] if lead is None else []
        want[w] = lead if lead is not None else w
    got = alike.greedy_leaders(spark.createDataFrame([("x", w, i) for i, w in enumerate(words)], SCHEMA), 0.8, **options)
    assert {r.item: r.leader for r in got.collect()} == want


def test_threshold_too_low(spark):
    with pytest.raises(ValueError):
        alike.greedy_leaders(spark.createDataFrame([], SCHEMA), 0.5)


def test_survivor(spark):
    """The most confident member stands for its cluster, the earliest of equals; no confidence counts as none."""
    rows = [("1", "acme corp", "A", 0.5), ("2", "ACME corp", "A", 0.9), ("3", "acme corp.", "A", 0.9), ("4", "acme corp", "B", None), ("5", "other", "A", None), ("6", "othera", "A", None)]
    got = resolve.resolve_fuzzy(spark.createDataFrame(rows, "id string, entity_text string, entity_type string, confidence double"))
    assert {tuple(r) for r in got.collect()} == {("A", "acme corp", "2", 0.9, 3), ("B", "acme corp", "4", None, 1), ("A", "other", "5", None, 2)}


def test_many_alike_never_meet(spark):
    """A block where all texts are alike falls to its first leader; nobody else is compared."""
    rows = spark.range(5000).selectExpr("'x' AS block", "format_string('Customer number %08d', id) AS item", "id AS place")
    got = alike.greedy_leaders(rows, 0.85)
    assert got.count() == 5000 and got.select("leader").distinct().count() < 20


def test_numbered_names_take_few_rounds(spark, monkeypatch):
    """Names that differ in their digits fall to few leaders, so heads grow and rounds stay few."""
    names = [f"Customer#{i * 7:09d}" for i in range(3000)] + ["é" * 70 + "x", "é" * 69 + "xy", "日本" * 40]
    want, found = {}, []
    for name in names:
        lead = next((x for x in found if difflib.SequenceMatcher(None, x, name).ratio() >= 0.85), None)
        found += [name] if lead is None else []
        want[name] = lead or name
    written = []
    settled = alike.settled
    monkeypatch.setattr(alike, "settled", lambda df: written.append(1) or settled(df))
    rows = spark.createDataFrame([("a", x, i) for i, x in enumerate(names)] + [("b", names[1], 0)], "block string, item string, place int")
    got = {(r.block, r.item): r.leader for r in alike.greedy_leaders(rows, 0.85, batch=8).collect()}
    assert got == {("a", x): lead for x, lead in want.items()} | {("b", names[1]): names[1]}
    assert len(written) <= 25
