"""SimHash near-duplicates by pigeonhole blocks.

Fingerprints are split into blocks; a pair that differs in few bits must agree on some of them.
Rows meet on the agreeing blocks only, and Hamming distance is verified where they meet.

* Texts are reduced to fingerprints where they are read; equal fingerprints become one node before
  any row is multiplied, so exact copies (a third of the table, say) cost one row per map task.
* A node is sent once per combination of agreeing blocks.  Buckets with one node are dropped by a
  grouped count.  Buckets over ``bucket_most`` nodes are not gathered: they are split again on their
  remaining bits by the same rule until they fit (nodes are distinct, so b open bits hold 2**b at
  most); for distances of 8 and more, where that rule would fan out, they are dealt into chunks and
  every pair of chunks is compared.
* Within a bucket all pairs are compared as arrays, but only a spanning forest leaves the task.

Cases: a null or blank text has fingerprint zero and links like any other; a null doc_id keeps its
fingerprint, links others, but gives no component name (component_id is null if nothing else is
reachable); repeated rows are rows of their own; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, free_name, mix64, quoted, signed, staged, text_or_empty, text_slices, window_hashes, windows
from .components import components

_LANES = np.uint64(0x0101010101010101)


def majority_bits(hashes: np.ndarray, doc_from: np.ndarray) -> np.ndarray:
    """For each run of 64-bit hashes the fingerprint whose bit is set if it is set in over half of them."""
    n = np.diff(doc_from)
    fingerprint = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if not len(full):
        return fingerprint
    pieces = -(-n[full] // 255)  # a byte lane counts to 255
    piece_from = np.concatenate([[0], np.cumsum(pieces)])
    begin = np.repeat(doc_from[:-1][full], pieces) + 255 * (np.arange(piece_from[-1]) - np.repeat(piece_from[:-1], pieces))
    for shift in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(shift)) & _LANES, begin)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), piece_from[:-1], axis=0)
        for byte in range(8):
            over = (2 * counts[:, byte] > n[full]).astype(np.uint64)
            fingerprint[full] |= over << np.uint64(8 * byte + shift)
    return fingerprint


def shingle_runs(words: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, last word) of all shingles of k words, whole texts where shorter, and their runs by document."""
    n = words.counts()
    begin, doc = windows(words.doc_from, k)
    last = begin + k - 1
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        begin = np.concatenate([begin, words.doc_from[:-1][short]])
        last = np.concatenate([last, words.doc_from[1:][short] - 1])
        order = np.argsort(np.concatenate([doc, short]), kind="stable")
        begin, last = begin[order], last[order]
    runs = np.concatenate([[0], np.cumsum(np.where(n == 0, 0, np.maximum(n - k + 1, 1)))])
    return begin, last, runs


def xxh64_fingerprints(data: np.ndarray, offsets: np.ndarray, k: int) -> np.ndarray:
    """One 64-bit fingerprint per document, from the XXH64 (seed 42) of its space-joined shingles."""
    words = Words(data, offsets, hashed=False)
    keep = words.word.copy()
    keep[words.ends[words.ends < len(keep)]] = True  # one separator after each word
    kept = np.concatenate([[0], np.cumsum(keep)])
    joined = words.data.copy()
    joined[~words.word] = 32
    joined = joined[keep].tobytes()
    begin, last, runs = shingle_runs(words, k)
    digest = xxhash.xxh64_intdigest
    spans = zip(kept[words.starts[begin]].tolist(), kept[words.ends[last]].tolist(), strict=True)
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in spans), np.uint64, len(begin))
    return majority_bits(hashes, runs)


def wide_fingerprints(data: np.ndarray, offsets: np.ndarray, k: int, n_words: int) -> np.ndarray:
    """``n_words`` times 64 bits per document; each 64 are derived from one hash of the shingle."""
    words = Words(data, offsets)
    begin, last, runs = shingle_runs(words, k)
    hashes = np.zeros(len(begin), np.uint64)
    full = last - begin + 1 == k
    hashes[full] = window_hashes(words.hashes, begin[full], k)
    for i in np.flatnonzero(~full):
        for h in words.hashes[begin[i] : last[i] + 1]:
            hashes[i : i + 1] = mix64(hashes[i : i + 1] ^ h)
    return np.stack([majority_bits(mix64(hashes + np.uint64(j * 0x9E3779B97F4A7C15 % 2**64)), runs) for j in range(n_words)], axis=1)


def with_fingerprints(docs: DataFrame, k: int = 4, bits: int = 64) -> DataFrame:
    """(doc_id, text_hash, fp): text_hash is xxhash64 of the text; fp is binary, ``bits / 8`` bytes, most
    significant first within each 64."""
    n_words = bits // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(1)):
                if n_words == 1:
                    fp = xxh64_fingerprints(data, offsets, k)[:, None]
                else:
                    fp = wide_fingerprints(data, offsets, k, n_words)
                raw = fp.astype(">u8").tobytes()
                width = 8 * n_words
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array([raw[i : i + width] for i in range(0, len(raw), width)], pa.binary())], names=["doc_id", "text_hash", "fp"])

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"), F.xxhash64(text_or_empty())).mapInArrow(run, "doc_id long, text_hash long, fp binary")


def layouts(bits: int, n_blocks: int, permutations: int) -> list[list[np.ndarray]]:
    """For each permutation the bit positions of each block; the first one is in natural order."""
    rng = np.random.default_rng(20240131)
    orders = [np.arange(bits)] + [rng.permutation(bits) for _ in range(permutations - 1)]
    return [np.array_split(order, n_blocks) for order in orders]


def bit_matrix(fps: list[bytes], bits: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(fps), np.uint8).reshape(-1, bits // 8), axis=1)


def keys_of(matrix: np.ndarray, positions: np.ndarray, salt: int) -> np.ndarray:
    """64-bit key of the chosen bits of every row, told apart by ``salt``.

    Positions of 64 bits or fewer; the bits and the salt are mixed bijectively up to the final xor."""
    packed = np.zeros(len(matrix), np.uint64)
    for j in positions:
        packed = (packed << np.uint64(1)) | matrix[:, j].astype(np.uint64)
    return mix64(mix64(packed) + np.uint64((salt + 1) * 0x9E3779B97F4A7C15 % 2**64))


def forest(fps: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Spanning forest of the rows (of uint64 words) that differ in ``most`` bits at most."""
    n = len(fps)
    left = np.arange(n)
    out: list[tuple[int, int]] = []
    while len(left):  # breadth first from one row of each component; every row is expanded once
        front, left = [left[0]], left[1:]
        while front and len(left):
            row = front.pop()
            near = np.bitwise_count(fps[left] ^ fps[row]).sum(axis=1) <= most
            if near.any():
                found = left[near]
                out += [(int(row), int(x)) for x in found]
                front += found.tolist()
                left = left[~near]
    return out


def links(nodes: DataFrame, bits: int, most: int, n_blocks: int, n_agree: int, permutations: int = 1, bucket_most: int = 1024) -> DataFrame:
    """Links (a binary, b binary) that connect all of ``nodes`` (fp binary, distinct) within ``most`` bits
    that agree on ``n_agree`` of ``n_blocks`` blocks.  With one permutation and
    ``n_blocks - n_agree >= most`` that is every pair within ``most`` bits."""
    plans = [np.concatenate(c) for blocks in layouts(bits, n_blocks, permutations) for c in combinations(blocks, n_agree)]
    found: list[DataFrame] = []

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                fps = batch.column(0).slice(lo, 4096)
                matrix = bit_matrix(fps.to_pylist(), bits)
                for salt, positions in enumerate(plans):
                    yield pa.RecordBatch.from_arrays([fps, pa.array(signed(keys_of(matrix, positions, salt))), pa.array(np.full(len(fps), salt, np.int64))], names=["fp", "key", "plan"])

    def split_again(depth: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                table = batch.to_pydict()
                matrix = bit_matrix(table["fp"], bits) if batch.num_rows else np.zeros((0, bits), np.uint8)
                plan, keys = np.array(table["plan"], np.int64), np.array(table["key"], np.int64)
                for salt in np.unique(plan):
                    rows = np.flatnonzero(plan == salt)
                    fixed = plans[int(salt) % len(plans)]
                    for path in _path_positions(fixed, bits, most, int(salt) // len(plans), depth):
                        code, positions = path
                        new = keys_of(matrix[rows], positions, code) ^ mix64(keys[rows].view(np.uint64))
                        yield pa.RecordBatch.from_arrays([pa.array([table["fp"][i] for i in rows], pa.binary()), pa.array(signed(new)), pa.array(np.full(len(rows), int(salt) % len(plans) + len(plans) * code, np.int64))], names=["fp", "key", "plan"])

        return run

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for fps in batch.column(0).to_pylist():
                words = np.frombuffer(b"".join(fps), ">u8").astype(np.uint64).reshape(len(fps), -1)
                for i, j in forest(words, most):
                    a.append(fps[i])
                    b.append(fps[j])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    keyed = nodes.select("fp").mapInArrow(spread, "fp binary, key long, plan long")
    for depth in range(64):
        sizes = staged(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "simhash-buckets")
        small = keyed.join(sizes.where(F.col("n") <= bucket_most).select("key"), "key")
        found.append(staged(small.groupBy("key").agg(F.collect_list("fp").alias("fps")).select("fps").mapInArrow(compare, "a binary, b binary").distinct(), "simhash-links"))
        large = sizes.where(F.col("n") > bucket_most).select("key")
        if large.isEmpty():
            break
        if depth == 63:
            raise RuntimeError("a bucket of fingerprints could not be split")
        if most < 8:
            keyed = staged(keyed.join(large, "key").select("fp", "key", "plan"), "simhash-large").mapInArrow(split_again(depth), "fp binary, key long, plan long")
        else:
            keyed = staged(_chunk_pairs(keyed.join(sizes.where(F.col("n") > bucket_most), "key"), bucket_most // 4), "simhash-large")
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out.distinct() if len(found) > 1 else out


def _chunk_pairs(rows: DataFrame, chunk: int) -> DataFrame:
    """Deal each bucket of ``n`` rows into chunks by hash, and send each row to every pair of chunks that holds its own."""
    chunks = F.ceil(F.col("n") / chunk).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit("chunk")), chunks)
    dealt = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    return dealt.select("fp", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "plan")


def _path_positions(fixed: np.ndarray, bits: int, most: int, code: int, depth: int) -> list[tuple[int, np.ndarray]]:
    """How a large bucket is split at ``depth``: its open bits in most + 1 parts, of which a close pair
    agrees on one.  ``code`` spells the parts chosen before; returns (new code, positions of the part)."""
    open_bits = np.setdiff1d(np.arange(bits), fixed)
    n = most + 1
    digits = []
    for _ in range(depth):
        digits.append(code % n)
        code //= n
    for digit in reversed(digits):
        part = np.array_split(open_bits, n)[digit]
        open_bits = np.setdiff1d(open_bits, part)
    spelled = 0
    for digit in reversed(digits):
        spelled = spelled * n + digit
    return [(spelled * n + i, part) for i, part in enumerate(np.array_split(open_bits, n)) if len(part)]


def near_duplicates(docs: DataFrame, k: int = 4, most: int = 4, bits: int = 64, n_blocks: int = 6, n_agree: int = 2, permutations: int = 1, bucket_most: int = 1024) -> DataFrame:
    """(doc_id, text_hash, fp binary, component, component_id) per row: component_id is the smallest doc_id
    reachable over links, component a number of the group that is never null.

    Two fingerprints link if they differ in ``most`` bits at most.  The defaults are exhaustive: of six
    blocks, a pair that differs in four bits agrees on two."""
    rows = staged(with_fingerprints(docs, k, bits), "simhash-rows")
    nodes = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    pairs = links(nodes, bits, most, n_blocks, n_agree, permutations, bucket_most)
    # nodes as longs for the component steps: 64-bit fingerprints are their own number, wider ones a hash
    def as_number(c: str):
        return F.conv(F.hex(c), 16, -10).cast("long") if bits == 64 else F.xxhash64(c)

    comps = components(pairs.select(as_number("a").alias("u"), as_number("b").alias("v")), "simhash-components")
    named = nodes.select("fp", "least", as_number("fp").alias("node")).join(comps, "node", "left").select("fp", "least", F.coalesce("component", "node").alias("component"))
    linked = staged(named, "simhash-named")
    names = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    final = linked.join(names, "component").select("fp", "component", "component_id")
    return rows.join(final, "fp").select("doc_id", "text_hash", "fp", "component", "component_id")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """One row of ``docs`` for each group of near-duplicates: the one with the smallest doc_id (null last),
    then the smallest text hash; of rows repeated exactly, one."""
    groups = near_duplicates(docs, **options)
    winner = groups.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")).alias("w"))
    own_id, own_text = free_name(docs, "_id"), free_name(docs, "_hash")
    kept = staged(winner.select(F.col("w.doc_id").alias(own_id), F.col("w.text_hash").alias(own_text)), "simhash-kept")
    chosen = docs.join(kept, (F.xxhash64(text_or_empty()) == F.col(own_text)) & F.col("doc_id").cast("long").eqNullSafe(F.col(own_id)))
    return chosen.dropDuplicates([own_text, own_id]).select(*map(quoted, docs.columns))
