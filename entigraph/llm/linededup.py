"""Line deduplication.

Lines are reduced to 128-bit hashes of their keys where they are read.  The hashes are range-partitioned
on (hash, document, position) and sorted the same way, so a line that stands in a third of all documents
is cut over several partitions instead of filling one.  Each partition streams its runs of equal hashes;
only a partition's first and last run can go on elsewhere, and those are settled by a grouped sum of
their lengths.  What leaves is one zlib-compressed keep bitmap per document, not text.

A key is the line with space and \\t-\\r stripped at both ends and A-Z lower-cased.  A document is a row:
repeated rows count each.

Cases: a null or empty text is one empty line; a null doc_id is an id like any other; lines whose key is
shorter than ``least_chars`` always stay; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_width, staged, text_or_empty

_STRIPPED = b" \t\n\x0b\x0c\r"
_LINES = "h1 long, h2 long, doc_id long, d long, n_lines int, positions array<int>"
_RUNS = "kind int, part int, first boolean, n long, " + _LINES


def line_hashes(docs: DataFrame, least_chars: int = 1) -> DataFrame:
    """One row per document and distinct key: its hash, the document and where the key stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, d, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines = text.encode().split(b"\n")
                where: dict[bytes, list[int]] = {}
                for i, line in enumerate(lines):
                    key = line.strip(_STRIPPED)
                    if key and (least_chars <= 1 or len(key.decode()) >= least_chars):
                        where.setdefault(xxhash.xxh3_128_digest(key.lower()), []).append(i)
                out += [(key, doc_id, d, len(lines), places) for key, places in where.items()]
            keys = np.frombuffer(b"".join(r[0] for r in out), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[:, 0]), pa.array(keys[:, 1]), *(pa.array([r[i] for r in out], kind) for i, kind in ((1, pa.int64()), (2, pa.int64()), (3, pa.int32()), (4, pa.list_(pa.int32()))))],
                names=["h1", "h2", "doc_id", "d", "n_lines", "positions"],
            )

    texts = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    return texts.select("doc_id", F.xxhash64("text").alias("d"), "text").mapInArrow(run, _LINES)


def _stream(least_docs: int):
    """Stream sorted rows; kind 0: a row of a run that is long enough, 1: a row of a short run at the
    partition's edge, 2: the length of a run at the edge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def rows(kind: int, table: pa.Table | pa.RecordBatch, first: np.ndarray, n: int = 0) -> pa.RecordBatch:
            size = table.num_rows
            head = [pa.array(np.full(size, kind, np.int32)), pa.array(np.full(size, part, np.int32)), pa.array(first), pa.array(np.full(size, n, np.int64))]
            return pa.RecordBatch.from_arrays([*head, *table.columns], names=["kind", "part", "first", "n", *table.schema.names])

        held: list[pa.RecordBatch] = []  # rows of the open run while it is short
        open_key, open_n, at_edge, example = None, 0, True, None

        def close(edge: bool) -> Iterator[pa.RecordBatch]:
            if open_key is not None and edge:
                yield rows(2, example, np.array([False]), open_n)
                for i, piece in enumerate(held):
                    yield rows(1, piece, np.arange(piece.num_rows) + i == 0)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1)
            begin = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]])
            for a, b in [(0, begin[1])] + ([(begin[-2], begin[-1])] if len(begin) > 2 else []):  # this batch's first and last run
                if a and len(begin) > 3:  # whole runs in between
                    lengths = np.diff(begin[1:-1])
                    chosen = np.repeat(lengths >= least_docs, lengths)
                    if chosen.any():
                        first = np.zeros(len(chosen), bool)
                        first[begin[1:-2] - begin[1]] = True
                        middle = batch.slice(begin[1], begin[-2] - begin[1]).filter(pa.array(chosen))
                        yield rows(0, middle, first[chosen])
                key = (int(keys[a, 0]), int(keys[a, 1]))
                if key != open_key:
                    yield from close(at_edge)
                    at_edge = open_key is None
                    open_key, open_n, held, example = key, 0, [], batch.slice(a, 1)
                piece = batch.slice(a, b - a)
                begins = open_n == 0
                open_n += b - a
                if open_n >= least_docs:
                    for i, old in enumerate(held):
                        yield rows(0, old, np.arange(old.num_rows) + i == 0)
                    yield rows(0, piece, (np.arange(b - a) == 0) & begins)
                    held = []
                else:
                    held.append(piece)
        yield from close(True)

    return run


def keep_bitmaps(docs: DataFrame, least_docs: int = 10, least_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """(doc_id, d, n_lines, keep): documents that lose lines; ``d`` is xxhash64 of the text, ``keep`` a
    zlib-compressed bitmap with a set bit for each line that stays.

    Keys that stand in ``least_docs`` documents or more lose their lines: all of them, or with
    ``keep_first`` all but the first in order of document and position."""
    lines = staged(line_hashes(docs, least_chars), "lines")
    order = ["h1", "h2", "doc_id", "d"]
    runs = staged(lines.repartitionByRange(shuffle_width(docs), *order).sortWithinPartitions(*order).mapInArrow(_stream(least_docs), _RUNS), "line-runs")
    edges = runs.where("kind = 2").groupBy("h1", "h2").agg(F.sum("n").alias("total"), F.min("part").alias("least_part"))
    short = runs.where("kind = 1").join(edges.where(F.col("total") >= least_docs), ["h1", "h2"])
    columns = ["doc_id", "d", "n_lines", "positions", "first"]
    if keep_first:
        sure = runs.where("kind = 0").join(edges, ["h1", "h2"], "left")
        same = F.col("first") & (F.col("part") == F.coalesce("least_part", "part"))
        lost = sure.withColumn("first", same).select(columns).unionAll(short.withColumn("first", same).select(columns))
        lost = lost.withColumn("positions", F.when(F.col("first"), F.expr("slice(positions, 2, greatest(size(positions) - 1, 0))")).otherwise(F.col("positions")))
    else:
        lost = runs.where("kind = 0").select(columns).unionAll(short.select(columns))
    grouped = lost.groupBy("doc_id", "d", "n_lines").agg(F.flatten(F.collect_list("positions")).alias("positions"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = []
            for n, places in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                keep = np.ones(n, bool)
                keep[places] = False
                maps.append(zlib.compress(np.packbits(keep).tobytes(), 6))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(maps, pa.binary())], names=["doc_id", "d", "n_lines", "keep"])

    return grouped.mapInArrow(pack, "doc_id long, d long, n_lines int, keep binary")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept): every row of ``docs`` with the lines its bitmap keeps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n_lines, n_dropped = [], [], []
            for text, packed in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if packed is None:
                    n_lines.append(text.count("\n") + 1)
                    n_dropped.append(0)
                    kept.append(text)
                    continue
                lines = text.split("\n")
                keep = np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8))[: len(lines)]
                stay = [line for line, bit in zip(lines, keep.tolist(), strict=True) if bit]
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(stay))
                kept.append("\n".join(stay))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept"])

    texts = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).withColumn("d", F.xxhash64("text"))
    maps = bitmaps.select(F.col("doc_id").alias("map_id"), F.col("d").alias("map_d"), "keep")
    joined = texts.join(maps, (F.col("d") == F.col("map_d")) & F.col("doc_id").eqNullSafe(F.col("map_id")), "left")
    return joined.select("doc_id", "text", "keep").mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept string")


def drop_frequent_lines(docs: DataFrame, least_docs: int = 10, least_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept) for every row of ``docs``."""
    return apply_bitmaps(docs, keep_bitmaps(docs, least_docs, least_chars, keep_first))


ORACLE_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
l AS (SELECT r, doc_id, unnest(generate_series(1, len(a))) AS i, unnest(a) AS line FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10),
m AS (SELECT k.*, f.key IS NOT NULL AS drops FROM k LEFT JOIN f ON k.key = f.key)
SELECT min(doc_id) AS doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE drops) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT drops), '')) AS kept_sha256
FROM m GROUP BY r
"""
