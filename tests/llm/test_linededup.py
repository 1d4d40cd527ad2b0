import random
import zlib
from collections import Counter

import numpy as np

from entigraph.llm import linededup

SCHEMA = "doc_id long, text string, positions int, n_lines int"


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})


def brute(rows, least=3, least_chars=1, keep_first=False):
    df = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if len(k) >= least_chars)
    out, seen = [], set()
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    for i in order:
        lines = (rows[i][1] or "").split("\n")
        kept = []
        for x in lines:
            frequent = len(key(x)) >= least_chars and df[key(x)] >= least
            if not frequent or keep_first and key(x) not in seen:
                kept.append(x)
            seen.add(key(x))
        out.append((rows[i][0], len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(3)
    lines = [f"Line {i} É" for i in range(40)]
    rows = [(i, "\n".join(rng.choice((" ", "", "\t")) + rng.choice(lines) for _ in range(rng.randint(1, 9)))) for i in range(60)]
    rows += [(i, f"unique {i}\nCommon LINE\r\n\n common line ") for i in range(60, 300)]
    return rows + [(300, None), (301, ""), (302, "\n\n"), (303, "x\n" * 5000)]


def test_all_lines_go(spark):
    rows = corpus() + [(304, "Common line"), (304, "Common line"), (None, "common line\nz")]
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], SCHEMA)
    got = linededup.drop_frequent_lines(docs, least_docs=3)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)
    got = linededup.drop_frequent_lines(docs, least_docs=9, least_chars=7)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, 9, 7)


def test_first_stays(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], SCHEMA).repartition(5)
    got = linededup.drop_frequent_lines(docs, least_docs=2, keep_first=True)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, 2, keep_first=True)


def test_bitmaps(spark):
    docs = spark.createDataFrame([(1, "a\nb\na"), (2, "b"), (3, "c")], "doc_id long, text string")
    row = {r.doc_id: r for r in linededup.keep_bitmaps(docs, least_docs=2).collect()}
    assert set(row) == {1, 2}
    assert np.unpackbits(np.frombuffer(zlib.decompress(row[1].keep), np.uint8))[:3].tolist() == [1, 0, 1]


def test_empty(spark):
    assert linededup.drop_frequent_lines(spark.createDataFrame([], SCHEMA)).count() == 0
