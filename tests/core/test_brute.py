"""Registered queries that SQL cannot say, against plain loops over the same rows."""

import difflib
import re
from collections import defaultdict

import pytest

from entigraph.fixtures import entities, table
from entigraph.functions import similarity as sim
from entigraph.operators import alike, chunking, resolve
from entigraph.plans import analytics, more, pairs, registry, texts  # noqa: F401  (they register their queries)


def leaders(items, threshold):
    """The rule as it is told: in order, the first leader that is alike, or a new one."""
    out, found = {}, []
    for item in items:
        lead = next((x for x in found if difflib.SequenceMatcher(None, x, item).ratio() >= threshold), None)
        if lead is None:
            found.append(item)
        out[item] = lead or item
    return out


def test_r02_fuzzy_resolution(spark, sf_dir):
    by_type = defaultdict(list)
    for r in entities(spark, sf_dir).collect():
        by_type[r.entity_type].append(r)
    want = set()
    for kind, rows in by_type.items():
        first = {}
        for r in sorted(rows, key=lambda r: r.id):
            first.setdefault(r.entity_text.lower(), r.id)
        lead = leaders(sorted(first, key=first.get), 0.85)
        groups = defaultdict(list)
        for r in rows:
            groups[lead[r.entity_text.lower()]].append((r.confidence, r.id))
        for x, members in groups.items():
            confidence, earliest = min(members, key=lambda m: (-m[0], m[1]))
            want.add((kind, x, earliest, confidence, len(members)))
    assert {tuple(r) for r in registry.QUERIES["r02_fuzzy_resolution"](spark, sf_dir).collect()} == want


@pytest.mark.parametrize("batch", [2, 128])
def test_leaders_in_rounds(spark, batch):
    """Texts that differ in their first letters merge, and small rounds give the same as one."""
    words = ["smith john", "jmith john", "xmith john", "john smith", "smith jon", "alpha", "alfa", "alpha beta", "zzz", "alphb", "betaalpha", ""]
    want = leaders(words, 0.8)
    rows = spark.createDataFrame([("a", w, i) for i, w in enumerate(words)] + [("b", "alpha", 0)], "block string, item string, place int")
    got = {(r.block, r.item): r.leader for r in alike.greedy_leaders(rows, 0.8, batch=batch).collect()}
    assert got == {("a", w): x for w, x in want.items()} | {("b", "alpha"): "alpha"}
    assert want["jmith john"] == "smith john"


def test_r05_leader_clusters(spark, sf_dir):
    want = {(x, item) for item, x in leaders(sorted({r.p_name for r in table(spark, sf_dir, "part").collect()}), 0.8).items()}
    assert {tuple(r) for r in registry.QUERIES["r05_leader_clusters"](spark, sf_dir).collect()} == want


def test_f15_hybrid(spark, sf_dir):
    names = {r.n_nationkey: r.n_name for r in table(spark, sf_dir, "nation").collect()}
    words = lambda t: set(re.sub(r"[^a-z0-9\s]", "", t.lower()).split())
    got = registry.QUERIES["f15_hybrid_similarity"](spark, sf_dir).collect()
    assert len(got) == len(names) * (len(names) - 1) // 2
    for r in got:
        x, y = names[r.a], names[r.b]
        want = 0.4 * difflib.SequenceMatcher(None, x, y).ratio() + 0.3 * sim.jaro_winkler_of(x, y) + 0.3 * len(words(x) & words(y)) / len(words(x) | words(y))
        assert r.s == pytest.approx(want, abs=2e-6)


def test_n12_related_in_sentences(spark, sf_dir):
    """All pairs of types in one sentence, by the fixed map; counted by plain loops over a few documents."""
    docs = table(spark, sf_dir, "documents").orderBy("doc_id").collect()[:40]
    extra = [(-1, "Jane Miller opened 1234567890 at Vietcombank. Then 5,000.50 USD on 01/02/2024 went to BIDV! thẻ tín dụng")]
    frame = spark.createDataFrame([(d.doc_id, d.text) for d in docs] + extra, "doc_id long, text string")
    chunks = chunking.chunked(frame, chunking.cut_at_ends, size=1000, overlap=200)
    want = []
    for r in chunks.collect():
        found = sorted(((m.start(), m.end(), m[0], k) for k, p in chunking.ENTITY_PATTERNS.items() for m in re.finditer(p, r.chunk, re.I)), key=lambda f: f[0])
        at = 0
        for piece in re.split(r"[.!?]", r.chunk):
            inside = [f for f in found if f[0] >= at and f[1] <= at + len(piece)]
            want += [(r.doc_id, r.chunk_index, a[2], b[2], chunking.PAIR_RELATIONS.get((a[3], b[3]), "related_to")) for a in inside for b in inside if a[0] < b[0] and a[3] != b[3]]
            at += len(piece) + 1
    got = [tuple(r)[:5] for r in chunking.related_in_sentences(chunking.entity_spans(chunks), chunking.sentences(chunks)).collect()]
    assert sorted(got) == sorted(want)
    kinds = {g[4] for g in got if g[0] == -1}
    assert {"has_account", "related_to"} <= kinds


@pytest.mark.parametrize("name", ["t01_sliding_limiter", "t02_token_bucket"])
def test_limiters(spark, sf_dir, name):
    calls = defaultdict(list)
    for r in table(spark, sf_dir, "events").selectExpr("user_id", "event_id", "unix_micros(cast(ts as timestamp)) / 1e6 AS t").collect():
        calls[r.user_id].append((r.t, r.event_id))
    want = {}
    for own in calls.values():
        accepted, tokens, then = [], 3.0, None
        for t, event in sorted(own):
            if name.startswith("t01"):
                want[event] = sum(a > t - 86_400 for a in accepted) < 3
                accepted += [t] * want[event]
            else:
                tokens = min(3.0, tokens + (t - (t if then is None else then)) * 3 / 86_400)
                want[event], then = tokens >= 1, t
                tokens -= want[event]
    assert {r.call_id: r.allowed for r in registry.QUERIES[name](spark, sf_dir).collect()} == want


def test_o03_map_fuzzy(spark, sf_dir):
    from entigraph.plans.analytics import _MAP_ROWS

    want = {}
    words = lambda t: set(re.sub("[_-]", " ", t.lower()).split(" "))
    for (kind,) in entities(spark, sf_dir).select("entity_type").distinct().collect():
        for key, uri, _ in _MAP_ROWS:
            ratio = difflib.SequenceMatcher(None, kind.lower(), key.lower()).ratio()
            shared = len(words(kind) & words(key)) / max(len(words(kind)), len(words(key)))
            score = max(ratio, shared) if ratio < 0.8 and shared > 0.3 else ratio
            if score > 0.6:
                want[kind] = max(want.get(kind, (0, "")), (score, uri))
    got = {r.entity_type: (r.score, r.class_uri) for r in registry.QUERIES["o03_map_fuzzy"](spark, sf_dir).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k][0] - want[k][0]) < 1e-9 and got[k][1] == want[k][1] for k in want)
