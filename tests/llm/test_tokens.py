import heapq
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from entigraph.llm import tokens

P = pytest.importorskip("public_tokenizers")


def direct(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids


def test_pieces_give_the_ids_of_whole_texts():
    from tokenizers import Tokenizer

    whole, enc = Tokenizer.from_file(P.path("byte_bpe_50k.json")), tokens.encoder(P.path("byte_bpe_50k.json"))
    rng = random.Random(1)
    parts = [" ", "  ", "   ", "\n", "\n\n", "\t", " ", "a", "Word", "'s", "don't", "12", "3", "!", "...", "é", "日本", "<|endoftext|>", "　", "😀", "\r\n", "\x1c", ",", "ab,", "é.", "x?!", "it's;"]
    for _ in range(4000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 12)))
        assert enc.ids(text).tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_long_pieces_are_not_remembered(monkeypatch):
    """Texts without spaces leave nothing behind, and a full cache is emptied without changing any id."""
    enc = tokens.Encoder(P.path("byte_bpe_50k.json"))
    texts = [chr(0x4E00 + i) * 3000 for i in range(30)] + ["a " + chr(0x5E00 + i) * 3000 + ". b" for i in range(30)]
    assert [i.tolist() for i in enc.many(texts)] == [direct(t) for t in texts]
    assert not enc.long and all(len(p) <= 64 for p in [*enc.known, *enc.begin])
    monkeypatch.setattr(tokens, "_CACHED_BYTES", 2000)
    for text in ("one two three four.", "five six seven eight!", "one nine ten, eleven"):
        assert enc.ids(text).tolist() == direct(text)
        assert enc.held < 10_000


def test_common_pieces_outlast_a_full_cache(monkeypatch):
    """What is held stays bounded, and pieces met early and often are not learned again each time it is full."""
    monkeypatch.setattr(tokens, "_CACHED_BYTES", 100_000)
    enc, plain = tokens.Encoder(P.path("byte_bpe_50k.json")), tokens.Encoder(P.path("byte_bpe_50k.json"))
    for i in range(40):
        text = "x the house of " + " ".join(f"rare{i}q{j}" for j in range(50))
        assert enc.ids(text).tolist() == plain.model.encode(text, add_special_tokens=False).ids
        assert enc.held <= 120_000 and {"the", "house", "of"} <= enc.known.keys()
    enc.forget(10_000)
    assert enc.held <= 11_000 and "the" in enc.known and enc.ids("x the house").tolist() == plain.ids("x the house").tolist()


def test_lengths_are_optimal():
    rng = np.random.default_rng(0)
    for n in (2, 3, 17, 200):
        counts = rng.integers(1, 1000, n)
        heap = [int(c) for c in counts]
        heapq.heapify(heap)
        cost = 0
        while len(heap) > 1:
            both = heapq.heappop(heap) + heapq.heappop(heap)
            cost += both
            heapq.heappush(heap, both)
        assert (tokens.code_lengths(counts, 30) * counts).sum() == cost
        tight = int(np.ceil(np.log2(n)))
        limited = tokens.code_lengths(counts, tight)
        assert limited.max() <= tight and (2.0**-limited).sum() <= 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=400), st.integers(9, 20))
def test_round_trip_of_ids(ids, most):
    ids = np.array(ids, np.int64)
    code = tokens.Code(tokens.code_lengths(np.bincount(ids, minlength=301), most))
    coded = [code.encode(part) for part in (ids[:150], ids[150:151], ids[151:])]
    lengths = np.array([len(ids[:150]), len(ids[150:151]), len(ids[151:])])
    bits, marks = b"".join(c[0] for c in coded), b"".join(c[1] for c in coded)
    assert code.decode(bits, *tokens.stretches(lengths, np.array([len(c[0]) for c in coded]), marks)).tolist() == ids.tolist()


def test_round_trip_of_documents(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(["the", "Cat\n", "é", "", "sat!", "12"], k=rng.randint(0, 40)))) for i in range(200)]
    rows += [(500, None), (501, ""), (502, "long " * 90_000), (7, "again"), (7, "again"), (None, "no id")]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, start int")
    got = [tuple(r) for r in tokens.round_trip(docs, P.path("byte_bpe_50k.json")).orderBy("start").collect()]
    encoded = {t: direct(t) + [0] for t in {t or "" for _, t in rows}}
    assert [r[0] for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d))
    assert [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got])[:-1].tolist()]
    want = sorted((d, len(encoded[t or ""]), zlib.crc32(np.array(encoded[t or ""], "<u4").tobytes())) for d, t in rows if d is not None)
    assert sorted((r[0], r[2], r[3]) for r in got if r[0] is not None) == want


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert tokens.round_trip(docs, P.path("byte_bpe_50k.json")).count() == 0


def test_a_run_is_encoded_once(monkeypatch):
    """Words that only differ in the marks and lines around them are learned once; ids stay those of whole texts."""
    enc = tokens.Encoder(P.path("byte_bpe_50k.json"))
    words = [f"thonti{a}{b}ble" for a in "aeiou" for b in "aeiou"]
    texts = [" ".join(f"x {w}{m}" for w in words) for m in ("", ",", "***", "!'s", ".\n\nEn", ".\nTible,", "\n\n", "é×", "ɏ", "ɐ")]
    assert [i.tolist() for i in enc.many(texts)] == [direct(t) for t in texts]
    learned = [p for p in enc.known if p.startswith("thonti")]
    # a piece with the apostrophe, the cross or the last letter is learned whole
    assert len(learned) == 5 * len(words)


def test_texts_cut_together_give_the_ids_of_whole_texts():
    """Heads, spaces at either end, empty texts, line ends and characters of every class, many texts at a time."""
    from tokenizers import Tokenizer

    whole, enc = Tokenizer.from_file(P.path("byte_bpe_50k.json")), tokens.Encoder(P.path("byte_bpe_50k.json"))
    rng = random.Random(5)
    parts = [" ", " ", "  ", "\n", "\n\n", "\n\n\n", "\t", "a", "Wörd", "×", "÷", "ɏ", "ɐ", "'", "'s", "'S", "12", "²", "<", "|", "<|endoftext|>", "_", " ", "　", "́", "ß", "\x00", "\x7f", "µ", "日", "😀", "-", ".", ", "]
    for _ in range(60):
        texts = ["".join(rng.choices(parts, k=rng.randint(0, 9))) for _ in range(100)]
        assert [i.tolist() for i in enc.many(texts)] == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)], texts
