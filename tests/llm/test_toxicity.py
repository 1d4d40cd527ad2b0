import random
import zlib

import numpy as np

from entigraph.llm import toxicity as tx

SCHEMA = "doc_id long, text string, toxic int, score int"


def marks(text, lexicon=None):
    found = tx.features(text, lexicon or tx.Lexicon(), tx.grammar())
    return {m for m, x in zip(tx.MARKS, found[1:6], strict=True) if x}


def test_grammar():
    assert marks("What an idiot.") == {"plain"}
    assert marks("You are an idiot!") == {"aimed"}
    assert marks("This is not an idiot") == {"negated"}
    assert marks("not there. an idiot") == {"plain"}
    assert marks("She said what an idiot") == {"reported"}
    assert marks("They will kill you") == {"threat"} == marks("I shall kill you")
    assert marks("I will not hurt it") == set() == marks("") == marks("kill time")
    assert marks("Zorpling", tx.Lexicon(prefixes={"zorp": 2.0})) == {"plain"}


def test_grammar_decides_where_words_do_not():
    """The same insults in toxic and clean texts: aimed in the one, denied or reported in the other."""
    rng = random.Random(5)
    rude, ways = ["idiot", "moron", "scum", "loser"], (["You are a {}.", "They are stupid, you {}!", "I will kill you."], ["He is not an {}.", "She said what a {}.", "Nobody wrote {} here."])
    texts, toxic = [], []
    for i in range(600):
        filler = [" ".join(rng.choices(["red", "tree", "walks", "slowly"], k=6)) + "." for _ in range(4)]
        texts.append(" ".join([*filler[:2], rng.choice(ways[i % 2]).format(rng.choice(rude)), *filler[2:]]))
        toxic.append(1 - i % 2)
    right = {}
    for name, cascade in (("grammar", tx.grammar()), ("words", tx.Grammar(tx.insult()))):
        rows = np.array([tx.features(t, tx.Lexicon(), cascade) for t in texts])
        w = tx._fit(rows[:300], np.array(toxic[:300], float), np.ones(300))
        right[name] = np.mean((rows[300:] @ w > 0) == np.array(toxic[300:], bool))
    assert right["grammar"] >= 0.95 and right["words"] <= 0.85


def test_clauses_not_words():
    """Two insults in one clause make a stronger clause than in two, and the share counts clauses."""
    one, two = (tx.features(t, tx.Lexicon(), tx.grammar()) for t in ("what a stupid idiot. the end.", "how stupid. what an idiot."))
    assert one[8] > two[8] and one[7] == 1 / 3 and two[7] == 2 / 3


def test_sample_is_bounded(spark):
    """Repeated doc_ids and repeated labels: never more than ``sample_most`` rows."""
    docs = spark.createDataFrame([(i, f"text {i} {j}") for i in range(300) for j in range(3)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300) for _ in range(2)] + [(0, 1)], "doc_id long, toxic int")
    sample, there = tx._sample(docs, labels, 100)
    assert sample.count() == 100 == sample.select("doc_id", "toxic").distinct().count()
    assert sum(there.values()) <= 301


def corpus():
    rng = random.Random(9)
    vocab = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(800)]
    rows, labels = [], []
    for i in range(1200):
        words = rng.choices(vocab, k=rng.randint(5, 120))
        toxic = i % 6 == 0
        if toxic:
            for _ in range(rng.randint(2, 5)):
                words[rng.randrange(len(words))] = rng.choice(["scum", "idiot"]) if i % 12 else "grubl" + rng.choice(["ing", "ed", "er", "s"])
        rows.append((i, " ".join(words)))
        if i % 10 < 8:
            labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_rows(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([(*r, 9, 9) for r in rows] + [(5000, None, 0, 0), (5001, "", 0, 0), (None, "you idiot scum", 0, 0), (0, rows[0][1], 0, 0), (5002, "word " * 60_000, 0, 0)], SCHEMA)
    model = tx.train(docs, spark.createDataFrame([(*r, 1) for r in labels] + [(None, 1, 1), (3, None, 1)], "doc_id long, toxic int, text int"))
    assert any(p.startswith("grub") for p in model.lexicon.prefixes)
    got = tx.score(docs, model).collect()
    assert len(got) == len(rows) + 5
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [r for r in got if r.held_out and r.doc_id < 1200]
    assert held and all(r.predicted == int(r.doc_id % 6 == 0) for r in held)
    assert {r.predicted for r in got if r.doc_id in (5000, 5001, 5002)} == {0}
    kept = tx.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in got)


def test_without_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "You are a stupid idiot, you loser.", 0, 0), (2, "A fine day.", 0, 0)], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.predicted for r in tx.score(docs, tx.train(docs, none)).orderBy("doc_id").collect()] == [1, 0]
    assert tx.score(docs.limit(0), tx.train(docs.limit(0), none)).count() == 0
