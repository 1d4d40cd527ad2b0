"""A gram index for searches in texts: posting lists in buckets, in segments that are only ever added.

A segment holds its rows, numbered and in parts, and for each gram of three characters and each part a list of the
numbers that hold it, as gaps in bytes of seven bits; lists lie in folders by a hash of the gram.  A search reads
the folders of its own grams, counts first, then the lists of the rarest few, and then only the parts of rows that are
left; these are compared with the text itself, so the outcome is that of a scan.  A list is no longer than a part
has rows, so no gram is hot.

A row that is added again takes the place of the one with its id in earlier segments; a removal is a row with a
null text.  ``compact`` writes what stands into one new segment.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType

from ..functions.similarity import levenshtein

SIZE = 3
#: Lists that a search for a part of a text reads: the rarest of its grams.
LISTS = 4


def grams_of(text: str) -> list[str]:
    return sorted({text[i : i + SIZE] for i in range(len(text) - SIZE + 1)})


def _grams(text: Column) -> Column:
    n = F.length(text)
    return F.when(n >= SIZE, F.array_distinct(F.transform(F.sequence(F.lit(1), n - (SIZE - 1)), lambda i: F.substring(text, i, F.lit(SIZE))))).otherwise(F.array().cast("array<string>"))


def coded(numbers: np.ndarray) -> bytes:
    """Ascending numbers as their gaps, seven bits a byte, the last byte of each below 128."""
    gaps = np.diff(numbers, prepend=0).astype(np.uint64)
    width = np.maximum(1, -(-np.array([int(g).bit_length() for g in gaps]) // 7)) if len(gaps) else np.zeros(0, int)
    ends = np.cumsum(width)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for j in range(int(width.max(initial=0))):
        has = width > j
        out[(ends - width)[has] + j] = (gaps[has] >> np.uint64(7 * j)).astype(np.uint8) & 127 | ((width[has] > j + 1) << 7).astype(np.uint8)
    return out.tobytes()


def decoded(raw: bytes) -> np.ndarray:
    data = np.frombuffer(raw, np.uint8)
    ends = np.flatnonzero(data < 128)
    if not len(ends):
        return np.zeros(0, np.int64)
    begins = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(data)) - np.repeat(begins, ends - begins + 1)
    gaps = np.add.reduceat((data & 127).astype(np.uint64) << (7 * place).astype(np.uint64), begins)
    return np.cumsum(gaps).astype(np.int64)


@F.arrow_udf(BinaryType())
def _coded(lists: pa.Array) -> pa.Array:
    values, ends = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    return pa.array([coded(values[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())


@F.arrow_udf(ArrayType(LongType()))
def _decoded(raw: pa.Array) -> pa.Array:
    return pa.array([decoded(x) for x in raw.to_pylist()], pa.list_(pa.int64()))


@dataclass
class GramIndex:
    """An index below ``path``, over rows with an ``id`` and a text in ``text``; all columns are kept."""

    spark: SparkSession
    path: str
    text: str = "entity_text"
    buckets: int = 64

    def _segments(self) -> list[str]:
        try:
            done = self.spark.read.schema("segment string").json(f"{self.path}/segments").collect()
        except AnalysisException:
            return []
        return sorted(r.segment for r in done)

    def add(self, rows: DataFrame) -> None:
        """Write a segment; it counts from when its name is written, after its files."""
        name = f"{len(self._segments()):06d}"
        at = f"{self.path}/{name}"
        numbered = rows.withColumn("_n", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_n", 33))
        numbered.write.mode("overwrite").partitionBy("_part").parquet(f"{at}/rows")
        kept = self.spark.read.parquet(f"{at}/rows").select("_n", "_part", F.explode(_grams(F.lower(self.text))).alias("gram"))
        lists = kept.groupBy("gram", "_part").agg(F.array_sort(F.collect_list("_n")).alias("ns"))
        posted = lists.select("gram", F.col("_part").alias("part"), F.size("ns").alias("n"), _coded("ns").alias("list"), F.pmod(F.xxhash64("gram"), F.lit(self.buckets)).cast("int").alias("bucket"))
        posted.repartition(self.buckets, "bucket").sortWithinPartitions("bucket", "gram", "part").write.mode("overwrite").partitionBy("bucket").parquet(f"{at}/lists")
        self.spark.createDataFrame([(name,)], "segment string").coalesce(1).write.mode("append").json(f"{self.path}/segments")

    def rows(self) -> DataFrame:
        """What stands: of each id the row of the last segment, without removals."""
        names = self._segments()
        if not names:
            raise ValueError(f"no index at {self.path}")
        out = None
        for i, name in enumerate(names):
            own = self._standing(self._rows(name), names[i + 1 :])
            out = own if out is None else out.unionByName(own)
        return out

    def _rows(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}/rows")

    def _standing(self, found: DataFrame, later: list[str]) -> DataFrame:
        for name in later:
            found = found.join(self._rows(name).select("id"), "id", "left_anti")
        return found.where(F.col(self.text).isNotNull()).drop("_n", "_part")

    def compact(self, to: str) -> GramIndex:
        new = GramIndex(self.spark, to, self.text, self.buckets)
        new.add(self.rows())
        return new

    def _lists(self, name: str, grams: list[str]) -> DataFrame:
        folders = [r.b for r in self.spark.createDataFrame([(g,) for g in grams], "g string").select(F.pmod(F.xxhash64("g"), F.lit(self.buckets)).cast("int").alias("b")).distinct().collect()]
        return self.spark.read.parquet(f"{self.path}/{name}/lists").where(F.col("bucket").isin(folders) & F.col("gram").isin(grams))

    def _candidates(self, name: str, grams: list[str], shared: int) -> DataFrame:
        """Rows of a segment with ``shared`` of ``grams`` or more, from their lists alone; of the grams as many are left out, the
        most frequent ones, as that allows."""
        counted = {r.gram: r.n for r in self._lists(name, grams).groupBy("gram").agg(F.sum("n").alias("n")).collect()}
        rare = sorted(grams, key=lambda g: (counted.get(g, 0), g))
        if shared == len(grams):
            rare, need = rare[:LISTS], min(LISTS, shared)
        else:
            rare, need = rare[: len(grams) - shared + 1], 1
        lists = self._lists(name, rare)
        held = lists.select("part", F.explode(_decoded("list")).alias("n")).groupBy("part", "n").agg(F.count("*").alias("hits")).where(F.col("hits") >= need)
        parts = [r.part for r in lists.groupBy("part").agg(F.count("*").alias("k")).where(F.col("k") >= need).select("part").collect()]
        rows = self._rows(name).where(F.col("_part").isin(parts))
        return rows.join(held.select(F.col("n").alias("_n")), "_n", "left_semi")

    def _search(self, grams: list[str], shared: int, true: Column) -> DataFrame:
        names = self._segments()
        if shared < 1:
            return self.rows().where(true)
        out = None
        for i, name in enumerate(names):
            own = self._standing(self._candidates(name, grams, shared).where(true), names[i + 1 :])
            out = own if out is None else out.unionByName(own)
        return out

    def containing(self, part: str) -> DataFrame:
        """Rows whose text contains ``part`` in either case, score 1; parts shorter than a gram are scanned for."""
        grams = grams_of(part.lower())
        return self._search(grams, len(grams), F.contains(F.lower(self.text), F.lower(F.lit(part)))).withColumn("score", F.lit(1.0))

    def fuzzy(self, text: str, above: float = 0.8) -> DataFrame:
        """Rows whose text has an edit similarity above ``above``.

        An edit spoils ``SIZE`` grams at most; where that leaves none to share (low thresholds, short texts) rows are scanned."""
        grams = grams_of(text.lower())
        n = len(text)
        edits = lambda longest: int(np.ceil((1 - above) * longest - 1e-9)) - 1
        longest = range(n, int(n / max(above, 1e-9)) + 1)
        repeats = max(0, n - SIZE + 1) - len(grams)
        shared = min((n - SIZE + 1 - SIZE * max(0, edits(x)) - repeats for x in longest), default=0)
        score = levenshtein(F.lower(self.text), F.lower(F.lit(text)))
        near = (1.0 - F.abs(F.length(self.text) - n) / F.greatest(F.length(self.text), F.lit(n), F.lit(1)) > above) & (score > above)
        return self._search(grams, shared, near).withColumn("score", score)
