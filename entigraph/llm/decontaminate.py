"""Benchmark decontamination by spaced seeds.

Fixed masks pick six of ten consecutive words and ignore the rest, so a window still hashes the same
after substitutions in the ignored places.  Hashes of the benchmark's windows and of the documents'
windows are joined, each hash once per text, which gives pairs of a document and an item.  For each pair
the two word sequences are compared on every diagonal that a common seed names: the best-scoring stretch
counts if it has enough equal words and a high enough share of them, or else the longest stretch with
that share, if it has enough equal words.

There is one way for benchmarks of any size: a bitmap of fixed size thins the documents' hashes where
they are made, and Spark decides from the measured sizes what it broadcasts.  A seed that is frequent in
a text, or in an item, is joined once and not once per place; the places are looked up per pair, in
arrays whose size is the length of the document.

Words are maximal runs without white space, lower-cased in A-Z.  Items with fewer words than a mask
spans are hashed whole and must occur word for word.

Cases: null or blank texts on either side match nothing; a null doc_id or item_id stays null in the
result; repeated rows are reported each; an item that the benchmark repeats is one item, and other texts
under the same id are items of their own; of overlaps with as many equal words the first is reported;
empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, flagged, free_name, hash_bits, longest_alike, signed, staged, text_or_empty, text_slices, window_hashes, windows

SPAN = 10
MASKS = ((0, 1, 3, 4, 7, 9), (0, 1, 2, 5, 8, 9), (0, 2, 4, 5, 6, 9), (0, 3, 5, 6, 7, 9))
#: Windows whose hashes are held at once.
_HELD = 1 << 18
_RESULT = "doc_id long, item_id long, text_hash long, doc_start int, doc_end int, matched int, identity double"


def seeds_of(words: Words, short: tuple[int, ...] = ()) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hashes, first words, documents): for each mask, and of all windows of the lengths ``short``."""
    for k in (SPAN, *short):
        begin, doc = windows(words.doc_from, k)
        for lo in range(0, len(begin), _HELD):
            b, d = begin[lo : lo + _HELD], doc[lo : lo + _HELD]
            if k < SPAN:
                yield window_hashes(words.hashes, b, k), b, d
            else:
                for salt, mask in enumerate(MASKS):
                    yield window_hashes(words.hashes, b, SPAN, mask, salt + 1), b, d


class Seeds:
    """The seeds of one text, sorted, with their places."""

    def __init__(self, hashes: np.ndarray, short: tuple[int, ...]):
        self.words = hashes
        words = _Lone(hashes)
        parts = [(h, b) for h, b, _ in seeds_of(words, short)]
        h = np.concatenate([p[0] for p in parts] or [np.zeros(0, np.uint64)])
        at = np.concatenate([p[1] for p in parts] or [np.zeros(0, np.int64)]).astype(np.int32)
        order = np.argsort(h, kind="stable")
        self.hashes, self.at = h[order], at[order]


class _Lone:
    """Words of one text, as ``seeds_of`` takes them."""

    def __init__(self, hashes: np.ndarray):
        self.hashes, self.doc_from = hashes, np.array([0, len(hashes)])


def diagonals(doc: Seeds, item: Seeds) -> np.ndarray:
    """Distinct diagonals with a common seed: the item's first word lies at that word of the document."""
    lo, hi = np.searchsorted(doc.hashes, item.hashes, "left"), np.searchsorted(doc.hashes, item.hashes, "right")
    m = len(item.words)
    seen = np.zeros(len(doc.words) + m, bool)
    for j in np.flatnonzero(hi > lo).tolist():
        seen[doc.at[lo[j] : hi[j]] - item.at[j] + m] = True
    return np.flatnonzero(seen) - m


def best_stretch(equal: np.ndarray) -> tuple[int, int, int]:
    """(begin, end, equal words) of the stretch with the highest sum of +1 for equal and -2 for unequal."""
    total = np.concatenate([[0], np.cumsum(np.where(equal, 1, -2))])
    gain = total - np.minimum.accumulate(total)
    end = int(np.argmax(gain))
    begin = int(np.flatnonzero(total[: end + 1] == total[: end + 1].min())[-1])
    return begin, end, int(equal[begin:end].sum())


def verify(doc: np.ndarray, item: np.ndarray, diagonal: int, least_words: int, least_identity: float) -> tuple[int, int, int, float] | None:
    """(doc_start, doc_end, matched, identity) of the overlap on a diagonal, if it counts."""
    lo, hi = max(diagonal, 0), min(diagonal + len(item), len(doc))
    if hi <= lo:
        return None
    equal = doc[lo:hi] == item[lo - diagonal : hi - diagonal]
    begin, end, matched = best_stretch(equal)
    if matched < min(least_words, len(item)) or matched < least_identity * (end - begin):
        # any stretch that counts can be widened while the share allows, so the longest one counts as well
        begin, end = longest_alike(equal, least_identity)
        matched = int(equal[begin:end].sum())
        if not matched or matched < min(least_words, len(item)):
            return None
        begin, end = begin + int(np.argmax(equal[begin:end])), end - int(np.argmax(equal[begin:end][::-1]))
    return lo + begin, lo + end, matched, matched / (end - begin)


def longest_overlap(doc: Seeds, item: Seeds, least_words: int, least_identity: float) -> tuple[int, int, int, float] | None:
    """(doc_start, doc_end, matched, identity) with the most equal words, the first of several.

    A diagonal has no more equal words in a stretch than in all, so they are tried by that number."""
    found = diagonals(doc, item)
    n, m = len(doc.words), len(item.words)
    equal = np.zeros(len(found), np.int64)
    for j in range(m) if len(found) > 4 * m else ():  # a column at a time where there are many
        at = found + j
        inside = (at >= 0) & (at < n)
        equal[inside] += doc.words[at[inside]] == item.words[j]
    if len(found) <= 4 * m:
        for i, d in enumerate(found.tolist()):
            lo, hi = max(d, 0), min(d + m, n)
            equal[i] = (doc.words[lo:hi] == item.words[lo - d : hi - d]).sum()
    enough = equal >= min(least_words, m)
    found, equal = found[enough], equal[enough]
    best: tuple[int, int, int, float] | None = None
    for i in np.lexsort((found, -equal)).tolist():
        d = int(found[i])
        if best is not None and (equal[i] < best[2] or equal[i] == best[2] and max(d, 0) > best[0]):
            break
        new = verify(doc.words, item.words, d, least_words, least_identity)
        if new and (best is None or (-new[2], new[0], new[1]) < (-best[2], best[0], best[1])):
            best = new
    return best


def overlaps(docs: DataFrame, benchmark: DataFrame, least_words: int = 10, least_identity: float = 0.8) -> DataFrame:
    """(doc_id, item_id, text_hash, doc_start, doc_end, matched, identity): for each document and item that
    overlap, the longest overlap.  Positions count words; ``text_hash`` is xxhash64 of the text."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long"), text_or_empty().alias("item")).distinct().withColumn("i", F.xxhash64("item_id", "item"))
    texts = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"), F.xxhash64(text_or_empty()).alias("d"))

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, data, offsets in text_slices(batch.column(1)):
                words = Words(data, offsets)
                n = words.counts()
                parts = list(seeds_of(words))  # and items shorter than a mask, whole
                for k in range(1, SPAN):
                    mine = np.flatnonzero(n == k)
                    if len(mine):
                        parts.append((window_hashes(words.hashes, words.doc_from[mine], k), words.doc_from[mine], mine))
                for hashes, _, doc in parts:
                    yield pa.RecordBatch.from_arrays([pa.array(signed(hashes)), batch.column(0).take(pa.array(doc + first)), pa.array(n[doc].astype(np.int32))], names=["h", "i", "n_words"])

    wanted = staged(items.select("i", "item").mapInArrow(of_items, "h long, i long, n_words int").distinct(), "benchmark-seeds")
    flags, shift = hash_bits(wanted.select("h").distinct(), "h")
    sent = spark.sparkContext.broadcast(flags)
    short = tuple(sorted(r.n_words for r in wanted.where(F.col("n_words") < SPAN).select("n_words").distinct().collect()))  # 9 at most

    def of_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, data, offsets in text_slices(batch.column(2)):
                words = Words(data, offsets)
                held = []
                for hashes, _, doc in seeds_of(words, short):
                    stay = np.flatnonzero(flagged(sent.value, shift, hashes))
                    held.append(np.stack([signed(hashes[stay]), doc[stay]], axis=1))
                rows = np.unique(np.concatenate(held), axis=0) if held else np.zeros((0, 2), np.int64)
                own = pa.array(rows[:, 1] + first)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, 0])), batch.column(0).take(own), batch.column(1).take(own)], names=["h", "doc_id", "d"])

    there = texts.select("doc_id", "d", "text").mapInArrow(of_documents, "h long, doc_id long, d long")
    pairs = staged(there.join(wanted.select("h", "i"), "h").select("doc_id", "d", "i").distinct(), "benchmark-pairs")
    named = pairs.select(F.col("doc_id").alias("own_id"), F.col("d").alias("own_d"), "i")
    both = texts.join(named, (F.col("d") == F.col("own_d")) & F.col("doc_id").eqNullSafe(F.col("own_id"))).join(items, "i")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int | None, Seeds | None] = (None, None)
        known: dict[int, Seeds] = {}

        def seeds(text: str) -> Seeds:
            raw = np.frombuffer(text.encode(), np.uint8)
            return Seeds(Words(raw, np.array([0, len(raw)])).hashes, short)

        for batch in batches:
            rows, keep = [], []
            for j, (d, i) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                if d != last[0]:  # the pairs of a document follow each other
                    last = (d, seeds(batch.column(4)[j].as_py()))
                if i not in known:
                    if len(known) >= 4096:
                        known.clear()
                    known[i] = seeds(batch.column(5)[j].as_py())
                found = longest_overlap(last[1], known[i], least_words, least_identity)
                if found:
                    keep.append(j)
                    rows.append(found)
            at = pa.array(keep, pa.int64())
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64())
            columns = [batch.column(c).take(at) for c in range(3)] + [pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "text_hash", "doc_start", "doc_end", "matched", "identity"])

    return both.select("doc_id", "item_id", "d", "i", "text", "item").mapInArrow(compare, _RESULT)


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that overlap no item; a row is told by its doc_id and text."""
    bad_id, bad_text = free_name(docs, "_bad_id"), free_name(docs, "_bad_text")
    bad = overlaps(docs, benchmark, **options).select(F.col("doc_id").alias(bad_id), F.col("text_hash").alias(bad_text)).distinct()
    bad = staged(bad, "contaminated")
    return docs.join(bad, (F.xxhash64(text_or_empty()) == F.col(bad_text)) & F.col("doc_id").cast("long").eqNullSafe(F.col(bad_id)), "left_anti")
