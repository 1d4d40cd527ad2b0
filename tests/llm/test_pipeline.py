"""Each stage of the pipeline against a brute-force version of its decision, on its own input."""

import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from entigraph.llm import mixing, toxicity
from entigraph.llm.common import documents

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(12)
    vocab = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(6000)]
    fresh = lambda n: rng.choices(vocab, k=n)
    bench = [(i, " ".join(fresh(25))) for i in range(10)]
    rows, labels, kinds = [], [], {}
    for i in range(400):
        words, kind = fresh(rng.randint(60, 160)), "clean"
        if i % 8 == 1:
            kind = "toxic"
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["scum", "idiot", "trash"]))
        elif i % 20 == 2:
            kind = "leak"
            words[5:5] = bench[rng.randrange(10)][1].split()
        elif i % 10 == 4:
            kind = "copy"
            words = rows[i - 4][1].split(" ")
            if i % 20 == 4:
                words[len(words) // 2] = "changed"
        kinds[i] = kind
        rows.append((i, " ".join(words), "en", f"src{i % 5}", 0))
        labels.append((i, 1, int(kind == "toxic")))
    rows += [(500, None, None, None, None), (None, rows[3][1], "en", "src1", 1), (3, rows[3][1], "en", "src1", 1), (501, "", "en", "", 0)]
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, kinds, bench


def as_rows(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_stages(spark, tables):
    folder, rows, kinds, bench = tables
    docs = documents(spark, folder)
    stage = {name: (lambda d, f=f: f(spark, d, folder).cache()) for name, f in corpus_pipeline.STAGES}

    kept = stage["toxicity"](docs)
    assert kept.columns == docs.columns
    model = toxicity.train(docs, documents(spark, folder, "labels"))
    brute = [(d, t) for d, t, *_ in rows if model.score([toxicity.features(t or "", model.lexicon, toxicity.grammar())])[0] < 0.7]
    assert as_rows(kept) == sorted(brute, key=str)
    assert {d for d, _ in brute} == {d for d, *_ in rows} - {d for d, k in kinds.items() if k == "toxic"}

    one = stage["simhash_near_dedup"](kept)
    shingles = {i: frozenset(tuple((t or "").split()[j : j + 5]) for j in range(max(1, len((t or "").split()) - 4))) for i, (_, t) in enumerate(brute)}
    left, winners = set(shingles), []
    while left:
        group, front = set(), [left.pop()]
        while front:
            i = front.pop()
            group.add(i)
            near = {j for j in left if len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j])}
            left -= near
            front += near
        winners.append(min((brute[i] for i in group), key=lambda r: (r[0] is None, r[0] or 0)))
    assert as_rows(one) == sorted(winners, key=str)

    clean = stage["benchmark_decontamination"](one)
    grams = {tuple(w[i : i + 12]) for _, t in bench for w in [t.split()] for i in range(len(w) - 11)}
    holds = lambda t: any(tuple(w[i : i + 12]) in grams for w in [(t or "").split()] for i in range(len(w) - 11))
    assert as_rows(clean) == [r for r in as_rows(one) if not holds(r[1])]
    assert len(as_rows(clean)) < len(as_rows(one))

    mixed = stage["source_mixing"](clean)
    assert as_rows(mixed) == sorted(((r.doc_id, r.text) for r in mixing.mix(clean).collect() for _ in range(r.copies)), key=str)

    from tokenizers import Tokenizer

    model = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = sorted(stage["token_output"](mixed).collect(), key=lambda r: r.start)
    ids = {t: np.array(model.encode(t or "", add_special_tokens=False).ids + [0], "<u4") for _, t in as_rows(mixed)}
    want = sorted((str(d), len(ids[t]), zlib.crc32(ids[t].tobytes())) for d, t in as_rows(mixed))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]


def test_run(spark, tables):
    folder, *_ = tables
    assert corpus_pipeline.run(spark, folder).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    labels, bench = spark.createDataFrame([], "doc_id long, toxic int"), spark.createDataFrame([], "item_id long, text string")
    import tempfile

    with tempfile.TemporaryDirectory() as folder:
        docs.write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        bench.write.parquet(f"{folder}/benchmark.parquet")
        assert corpus_pipeline.run(spark, folder).count() == 0
