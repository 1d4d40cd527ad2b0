"""Ranked lexical search with a two-level quantised index.

The index holds a row per document.  Level one: the ids of its terms and, for each, its impact (the
saturated frequency that a term's weight multiplies) in one byte, rounded upward.  Level two: the exact
counts and the length.  A search reads level one alone: for each item a document's bytes times weights
bound its score from above, the same bytes less one from below.  The k-th lower bound of each item, found
over all documents from a histogram, is its threshold.  Then every document whose upper bound reaches it
is rescored exactly, in whole numbers, from level two; it stands in the same row, so nothing is joined,
and no text, posting list or index row is ever shuffled.

Items are taken in groups of bounded size, and within a group in blocks whose weights fit ``block_most``
bytes; the index of a group holds the terms that its items ask for (``items_most`` bytes of item texts,
which bounds what the driver and the tasks hold), while lengths and totals count all terms.  Terms are told
apart by 64-bit hashes.

The score is that of the contract: the sum over the item's terms, repeats included, of
w * ((1000000000 * tf) div (1000 * tf + 12 * m)).

Cases: a null or empty text has no terms, so such a document is never found and such an item finds nothing;
each row of items is an item of its own, also if ids or texts repeat; each row of documents is a
document, equal scores come by ascending doc_id, null ids last; texts of any length are read whole; empty
tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Words, staged, text_or_empty, text_slices

#: Exact impacts are below this; a byte stands for steps of this many.
IMPACT_LIMIT = 1_000_000
STEP = -(-IMPACT_LIMIT // 255)

#: Bytes other than letters, digits and those of non-ASCII characters part terms.
_TERM_BYTE = np.full(256, 32, np.uint8)
for _lo, _hi in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    _TERM_BYTE[_lo:_hi] = np.arange(_lo, _hi, dtype=np.uint8)

_ABREAST = 512


def term_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all terms, where each text's terms begin)."""
    words = Words(_TERM_BYTE[data], offsets)
    return words.hashes, words.doc_from


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def levelled(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """A document's m from its length."""
    return 100 - 25 + 25 * n * n_docs // n_terms


@dataclass
class Items:
    """A group of items: their ids, and the terms of each as (id, times asked)."""

    ids: list
    vocabulary: np.ndarray  # sorted hashes; a term's id is its place
    asked: list[tuple[np.ndarray, np.ndarray]]


def items_of(rows: list[tuple[int, str]]) -> Items:
    per_item = []
    for _, _, data, offsets in text_slices(pa.array([text for _, text in rows], pa.string())):
        hashes, begins = term_hashes(data, offsets)
        per_item += [np.unique(hashes[a:b], return_counts=True) for a, b in zip(begins[:-1], begins[1:], strict=True)]
    vocabulary = np.unique(np.concatenate([h for h, _ in per_item] or [np.zeros(0, np.uint64)]))
    return Items([i for i, _ in rows], vocabulary, [(np.searchsorted(vocabulary, h), n) for h, n in per_item])


def item_groups(items: DataFrame, items_most: int) -> Iterator[Items]:
    rows, size = [], 0
    for r in items.select(F.col("item_id").cast("long"), text_or_empty().alias("text")).toLocalIterator():
        rows.append((r.item_id, r.text))
        size += len(r.text) + 64
        if size >= items_most:
            yield items_of(rows)
            rows, size = [], 0
    if rows:
        yield items_of(rows)


def counts(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """(doc_id, n, terms, tfs): length of each document that has terms, and its terms of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(1)):
                hashes, begins = term_hashes(data, offsets)
                n = np.diff(begins)
                place = np.searchsorted(vocabulary, hashes)
                known = np.flatnonzero(vocabulary[np.minimum(place, len(vocabulary) - 1)] == hashes)
                doc = np.repeat(np.arange(hi - lo), n)[known]
                key, tf = np.unique(doc * len(vocabulary) + place[known], return_counts=True)
                ends = np.searchsorted(key, np.arange(hi - lo + 1) * len(vocabulary)).astype(np.int32)
                terms = pa.ListArray.from_arrays(ends, pa.array((key % len(vocabulary)).astype(np.int32)))
                tfs = pa.ListArray.from_arrays(ends, pa.array(tf.astype(np.int32)))
                found = pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n.astype(np.int64)), terms, tfs], names=["doc_id", "n", "terms", "tfs"])
                yield found.filter(pa.array(n > 0))

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets from 0) of a list column without nulls."""
    ends = column.offsets.to_numpy().astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), ends - ends[0]


def holders(counted: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each term: counted within tasks, then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size, np.int64)
        for batch in batches:
            held += np.bincount(flat(batch.column(0))[0], minlength=size)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(held[some])], names=["term", "n"])

    df = np.zeros(size, np.int64)
    found = counted.select("terms").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df[found["term"].to_numpy()] = found["n"].to_numpy()
    return df


def indexed(counted: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """``counted`` with ``impacts``, a byte for each term: the first level beside the second."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tf, ends = flat(batch.column("tfs"))
            m = np.repeat(levelled(batch.column("n").to_numpy(), n_docs, n_terms), np.diff(ends))
            bytes_ = (-(-impacts(tf.astype(np.int64), m) // STEP)).astype(np.uint8)
            packed = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(bytes_)])
            yield pa.RecordBatch.from_arrays([*batch.columns, packed], names=[*batch.schema.names, "impacts"])

    return counted.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>, impacts binary")


class Block:
    """Some items, and the weight that each gives to each term."""

    def __init__(self, first: int, asked: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray):
        self.first, self.size = first, len(asked)
        self.terms = np.unique(np.concatenate([t for t, _ in asked]))
        self.weight = np.zeros((len(self.terms), self.size), np.int64)
        for j, (t, n) in enumerate(asked):
            self.weight[np.searchsorted(self.terms, t), j] = n * weights[t]

    def bounds(self, terms: np.ndarray, bytes_: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each document and item the upper bound and the lower one, in steps; and the places and rows of
        the terms that any item asks for."""
        row = np.searchsorted(self.terms, terms)
        place = np.flatnonzero(self.terms[np.minimum(row, len(self.terms) - 1)] == terms)
        row, cut = row[place], np.searchsorted(place, ends)
        both = np.stack([bytes_[place], np.ones(len(place))]).astype(np.float64)
        upper, taken = (np.zeros((len(ends) - 1, self.size)) for _ in range(2))
        weight = self.weight.astype(np.float64)
        for i, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            if a < b:
                upper[i], taken[i] = both[:, a:b] @ weight[row[a:b]]
        return upper, upper - taken, place, row


def blocks_of(items: Items, weights: np.ndarray, block_most: int) -> list[Block]:
    """Blocks of items whose weights take at most ``block_most`` bytes (one item at least)."""
    out: list[Block] = []
    first = terms = 0
    for j in range(len(items.asked) + 1):
        more = len(items.asked[j][0]) if j < len(items.asked) else 0
        if j > first and (j == len(items.asked) or (terms + more) * (j - first + 1) * 8 > block_most):
            if terms:
                out.append(Block(first, items.asked[first:j], weights))
            first, terms = j, 0
        terms += more
    return out


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(documents, their term ids, impact bytes, offsets), some at a time."""
    for lo in range(0, batch.num_rows, _ABREAST):
        piece = batch.slice(lo, _ABREAST)
        terms, ends = flat(piece.column("terms"))
        yield piece, terms, np.frombuffer(b"".join(piece.column("impacts").to_pylist()), np.uint8), ends


def thresholds(index: DataFrame, blocks: list[Block], n_items: int, k: int) -> np.ndarray:
    """Per item its k-th highest lower bound, 0 if fewer are above 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [np.zeros((k, block.size)) for block in blocks]
        for batch in batches:
            for _, terms, bytes_, ends in _pieces(batch):
                for i, block in enumerate(blocks):
                    lower = block.bounds(terms, bytes_, ends)[1]
                    best[i] = np.partition(np.concatenate([best[i], lower]), len(lower), axis=0)[-k:]
        for block, found in zip(blocks, best, strict=True):
            place, item = np.nonzero(found > 0)
            yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int64) + block.first), pa.array(found[place, item].astype(np.int64))], names=["item", "bound"])

    bars = np.zeros(n_items, np.int64)
    steps = index.select("terms", "impacts").mapInArrow(run, "item long, bound long").groupBy("item", "bound").agg(F.count("*").alias("n"))
    so_far = Window.partitionBy("item").orderBy(F.desc("bound"))
    for r in steps.withColumn("n", F.sum("n").over(so_far)).where(F.col("n") >= k).groupBy("item").agg(F.max("bound").alias("bound")).collect():
        bars[r.item] = r.bound
    return bars


def rescored(index: DataFrame, blocks: list[Block], bars: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, doc_id, score, n_rescored): of each task the k best documents of each item, by exact scores of all
    whose upper bound reaches the item's threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[int, bool, int]]] = {}
        tried = np.zeros(len(bars), np.int64)
        for batch in batches:
            for piece, terms, bytes_, ends in _pieces(batch):
                ids = piece.column("doc_id").to_pylist()
                tf = flat(piece.column("tfs"))[0].astype(np.int64)
                m = np.repeat(levelled(piece.column("n").to_numpy(), n_docs, n_terms), np.diff(ends))
                for block in blocks:
                    upper, _, place, row = block.bounds(terms, bytes_, ends)
                    reach = (upper > 0) & (upper >= bars[block.first : block.first + block.size])
                    tried[block.first : block.first + block.size] += reach.sum(0)
                    exact, cut = impacts(tf[place], m[place]), np.searchsorted(place, ends)
                    for i in np.flatnonzero(reach.any(1)):
                        a, b, items = cut[i], cut[i + 1], np.flatnonzero(reach[i])
                        scores = exact[a:b] @ block.weight[np.ix_(row[a:b], items)]
                        doc = (ids[i] is None, ids[i] or 0)
                        for item, score in zip((items + block.first).tolist(), scores.tolist(), strict=True):
                            if score > 0:
                                held = best.setdefault(item, [])
                                held.append((-score, *doc))
                                if len(held) >= 64 * k:
                                    held[:] = heapq.nsmallest(k, held)
        rows = [(item, None if none else doc, -score, int(tried[item])) for item, held in best.items() for score, none, doc in heapq.nsmallest(k, held)]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(4)], names=["item", "doc_id", "score", "n_rescored"])

    return index.mapInArrow(run, "item long, doc_id long, score long, n_rescored long")


def search(docs: DataFrame, items: DataFrame, k: int = 20, items_most: int = 16 << 20, block_most: int = 32 << 20) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k documents of the highest scores above 0."""
    spark, out = docs.sparkSession, None
    for group in item_groups(items, items_most):
        if not len(group.vocabulary):
            continue
        counted = staged(counts(docs, group.vocabulary), "term-counts")
        total = counted.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
        if not total.docs:
            continue
        df = holders(counted, len(group.vocabulary))
        weights = np.floor(1000 * np.log((2 * total.docs + 2) / (2 * df + 1))).astype(np.int64)
        blocks = blocks_of(group, weights, block_most)
        index = staged(indexed(counted, total.docs, total.terms), "lexical-index")
        bars = thresholds(index, blocks, len(group.ids), k)
        found = rescored(index, blocks, bars, total.docs, total.terms, k)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(group.ids)), "item long, item_id long")
        part = ranked.join(names, "item").select("item_id", "rank", "doc_id", "score")
        out = part if out is None else out.unionAll(part)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS a FROM documents),
s AS (SELECT CAST(count(*) AS BIGINT) AS nd, CAST(sum(len(a)) AS BIGINT) AS l FROM d WHERE len(a) > 0),
t AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(a) AS term FROM d) GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(nd) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, s GROUP BY term),
m AS (SELECT r, doc_id, 75 + (25 * CAST(len(a) AS BIGINT) * nd) // l AS m FROM d, s WHERE len(a) > 0),
p AS (SELECT r, term, w * ((1000000000 * tf) // (1000 * tf + 12 * m)) AS x FROM t JOIN w USING (term) JOIN m USING (r)),
b AS (SELECT row_number() OVER () AS j, item_id, {_TERMS} AS a FROM benchmark),
q AS (SELECT j, term, count(*) AS times FROM (SELECT j, unnest(a) AS term FROM b) GROUP BY j, term),
z AS (SELECT j, r, CAST(sum(times * x) AS BIGINT) AS score FROM q JOIN p USING (term) GROUP BY j, r),
o AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY j ORDER BY score DESC, doc_id ASC NULLS LAST) AS INTEGER) AS rank
      FROM z JOIN b USING (j) JOIN m USING (r) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 20
"""
