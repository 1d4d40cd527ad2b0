import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from entigraph.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS, ITEMS = "doc_id long, text string, n long, score int, rank int, `a.b` int", "item_id long, text string, item int, doc_id int"


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=20):
    held = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item, text in items:
        found = []
        for doc, c in held:
            m = 75 + 25 * sum(c.values()) * n_docs // n_terms
            score = sum(w[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        out += [(item, rank, None if none else doc, -s) for rank, (s, none, doc) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def corpus(seed=1, n=300):
    rng = random.Random(seed)
    words = ["the", "of", "Ärger", "naïve", "漢字"] + [f"w{i}" for i in range(200)]
    some = lambda most: " ".join(rng.choices(words, [50 / (i + 1) for i in range(len(words))], k=rng.randint(1, most)))
    docs = [(i, some(60)) for i in range(n)]
    docs += [(1000 + i, docs[0][1]) for i in range(n // 2)]  # a third are equal
    docs += [(5000, None), (5001, ""), (5002, "-- !!"), (None, docs[3][1]), (7, docs[7][1]), (5003, "The,OF\x00the of" + " w5" * 40_000)]
    items = [(i, some(40)) for i in range(25)] + [(30, None), (31, ""), (32, "unheard"), (None, docs[3][1]), (3, docs[0][1]), (3, docs[0][1]), (33, "w5 W5 w5")]
    return docs, items


@pytest.mark.parametrize("options", [{}, {"k": 3}, {"items_most": 700, "block_most": 2000}])
def test_against_brute_force(spark, options):
    docs, items = corpus()
    got = lexical.search(spark.createDataFrame([(*d, 1, 2, 3, 4) for d in docs], DOCS), spark.createDataFrame([(*i, 1, 2) for i in items], ITEMS), **options)
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items, options.get("k", 20))


def test_empty(spark):
    docs, items = spark.createDataFrame([(1, "a", 1, 2, 3, 4)], DOCS), spark.createDataFrame([(1, "a", 1, 2)], ITEMS)
    assert lexical.search(docs.limit(0), items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0
    assert lexical.search(docs, items.withColumn("text", F.lit(None).cast("string"))).count() == 0
    assert lexical.search(docs.withColumn("text", F.lit("...")), items).count() == 0


def test_bounds_hold_and_spare_most(spark):
    """Impacts lie between the byte less one and the byte; few documents are rescored."""
    docs, items = corpus(2, 2000)
    rows = spark.createDataFrame([(*d, 1, 2, 3, 4) for d in docs], DOCS)
    group = next(lexical.item_groups(spark.createDataFrame([(*i, 1, 2) for i in items[:25]], ITEMS), 1 << 20))
    counted = lexical.counts(rows, group.vocabulary)
    n_docs, n_terms = counted.agg(F.count("*"), F.sum("n")).first()
    index = lexical.indexed(counted, n_docs, n_terms)
    for r in index.limit(500).collect():
        m = 75 + 25 * r.n * n_docs // n_terms
        for tf, b in zip(r.tfs, r.impacts, strict=True):
            assert (b - 1) * lexical.STEP < 1_000_000_000 * tf // (1000 * tf + 12 * m) <= b * lexical.STEP
    import numpy as np

    df = lexical.holders(counted, len(group.vocabulary))
    blocks = lexical.blocks_of(group, np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64), 1 << 20)
    bars = lexical.thresholds(index, blocks, len(group.ids), 20)
    tried = lexical.rescored(index, blocks, bars, n_docs, n_terms, 20).groupBy("item").agg(F.max("n_rescored")).collect()
    assert (bars > 0).all() and sum(r[1] for r in tried) < 0.2 * 25 * n_docs
