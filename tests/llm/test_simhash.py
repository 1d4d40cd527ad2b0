import random
import re

import xxhash

from entigraph.llm import simhash

SCHEMA = "doc_id long, text string, component long, fp int"


def fingerprint(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, most=4):
    fps = [fingerprint(t) for _, t in rows]
    left, out = set(range(len(rows))), {}
    while left:
        group, front = set(), [left.pop()]
        while front:
            i = front.pop()
            group.add(i)
            near = {j for j in left if (fps[i] ^ fps[j]).bit_count() <= most}
            left -= near
            front += near
        ids = [rows[i][0] for i in group if rows[i][0] is not None]
        out |= {i: min(ids) if ids else None for i in group}
    return sorted(((rows[i][0], f"{fps[i]:016x}", out[i]) for i in range(len(rows))), key=str)


def corpus():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdeé", k=5)) for _ in range(300)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(1, 90)))) for i in range(60)]
    base = rng.choices(words, k=400)
    for i in range(60, 110):  # a dense group
        copy = list(base)
        copy[rng.randrange(400)] = "other"
        rows.append((i, "\n".join(copy)))
    rows += [(7, None), (8, "  \t"), (None, rows[3][1]), (None, "alone in the world here"), (9, rows[4][1].upper()), (9, rows[4][1].upper()), (5, "One  TWO"), (300, "x " * 30_000)]
    return rows


def test_components_equal_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], SCHEMA)
    for bucket_most in (1024, 24):  # the second splits large buckets
        got = simhash.near_duplicates(docs, bucket_most=bucket_most).collect()
        assert sorted(((r.doc_id, bytes(r.fp).hex(), r.component_id) for r in got), key=str) == brute(rows)


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_wide_fingerprints_catch_near_copies(spark):
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(4000)]
    rows = []
    for g in range(30):
        base = rng.choices(words, k=300)
        rows.append((10 * g, " ".join(base)))
        for i in range(1, 4):
            copy = list(base)
            for _ in range(2):
                copy[rng.randrange(300)] = "changed"
            rows.append((10 * g + i, " ".join(copy)))
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], SCHEMA)
    for bucket_most in (1024, 4):
        got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, k=5, most=44, bits=256, n_blocks=16, n_agree=1, permutations=3, bucket_most=bucket_most).collect()}
        assert got == {d: d // 10 * 10 for d, _ in rows}
