"""Columns of documents whose names are those the stages use themselves, or that need quoting."""

import pytest

from entigraph.llm import decontaminate, linededup, mixing, simhash, toxicity

OWN = ["_hash", "_id", "_bad_id", "_bad_text", "fp", "component", "node", "text_hash", "row", "size", "key", "copies_of", "taken_by", "w", "d", "i", "h", "a.b", "c d", "x`y", "least", "mix_key", "ps"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, " ".join(f"word{i % 7}{j}" for j in range(30)), "en", "ab"[i % 2], *[f"{n}{i}" for n in OWN]) for i in range(21)]
    names = ", ".join("`" + n.replace("`", "``") + "` string" for n in OWN)
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, {names}")


def test_simhash(docs):
    kept = simhash.one_of_each(docs, k=5)
    assert kept.columns == docs.columns
    assert {tuple(r) for r in kept.collect()} <= {tuple(r) for r in docs.collect()} and kept.count() <= 7


def test_decontaminate(spark, docs):
    bench = spark.createDataFrame([(1, " ".join(f"word3{j}" for j in range(15)), "x")], "item_id long, text string, _bad_id string")
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in range(21) if i % 7 != 3}


def test_mixing(docs):
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert {tuple(r) for r in out.collect()} <= {tuple(r) for r in docs.collect()} and out.count() >= 21


def test_others(spark, docs):
    assert linededup.drop_frequent_lines(docs).count() == 21
    labels = spark.createDataFrame([(i, i % 2) for i in range(21)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert toxicity.keep_clean(docs, model, threshold=2.0).columns == docs.columns
