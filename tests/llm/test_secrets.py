import random
import re
import time

from pyspark.sql import functions as F

from entigraph.llm import secrets

SCHEMA = "doc_id long, text string, blob int, path int"
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    text = text or ""
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [(k, s, e) for s, _, k, e in sorted(out)]


def corpus():
    rng = random.Random(4)
    parts = ["password", "PASSWD", "Token", "api_key", "apikey", "=", ":", '"', "'", " ", "abcdefabcdef012345", "AKIA", "ABCDEFGH12345678", "é😀", "secret=", "short", "\n", "-._/+", "deadbeef" * 5, "ſecret", "toKen"]
    rows = [(i, "".join(rng.choices(parts, k=rng.randint(0, 30)))) for i in range(500)]
    return rows + [(1000, None), (1001, ""), (None, "token: abcdefghijklmnop"), (1, rows[1][1]), (1002, rows[5][1]), (1003, "a" * 100_000), (1004, "token=password: abcdefghijklmnop token=secret=abcdefghijklmnop")]


def test_spans_and_ledger(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], SCHEMA)
    ledger = str(tmp_path / "ledger")
    want = sorted((str(d), brute(t)) for d, t in rows)
    half = docs.where("doc_id % 2 = 0")
    secrets.scan(half, ledger)
    before = secrets.read_ledger(spark, ledger)[0].count()
    assert before == 3 * half.select(F.coalesce("text", F.lit(""))).distinct().count()
    got = secrets.scan(docs, ledger).collect()
    assert sorted((str(r.path), [tuple(f) for f in r.findings]) for r in got) == want
    # nothing is left to scan, and a new version of one rule scans for that rule alone
    assert secrets.unseen(docs, secrets.read_ledger(spark, ledger)[0]).isEmpty()
    newer = (*secrets.RULES[:2], secrets.Rule("hex", 2, r"[0-9a-f]{20,}"))
    todo = secrets.unseen(docs, secrets.read_ledger(spark, ledger)[0], newer)
    assert {tuple(r.todo) for r in todo.collect()} == {("hex@2",)}
    got = secrets.scan(docs, ledger, newer).collect()
    assert sorted((str(r.path), [tuple(f) for f in r.findings]) for r in got) == sorted((d, [f for f in fs if f[0] != "hex" or f[2] - f[1] >= 20]) for d, fs in want)


def test_many_matches_in_one_text(spark, tmp_path):
    """40 000 matches of each kind in one text: work in proportion, and every one of them found."""
    text = "token=abcdefghijklmnop AKIAABCDEFGHIJKLMN 0123456789abcdef0 é " * 40_000
    began = time.perf_counter()
    found = secrets.scan(spark.createDataFrame([(1, text, 0, 0)], SCHEMA), str(tmp_path / "l")).first().findings
    assert time.perf_counter() - began < 30
    assert len(found) == 120_000
    for i, (kind, at, size) in enumerate((("assign", 0, 22), ("access", 23, 18), ("hex", 42, 17))):
        assert [tuple(f) for f in found[i::3]] == [(kind, 62 * j + at, 62 * j + at + size) for j in range(40_000)]


def test_empty(spark, tmp_path):
    assert secrets.scan(spark.createDataFrame([], SCHEMA), str(tmp_path / "l")).count() == 0
