"""Shared folder, staged tables and vectorised word arithmetic for the operators here."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """Folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Where the session names none, a local master gets a temporary folder of our own; a cluster, whose
    executors would not see it, gets an error."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    set_by_user = spark.sparkContext.getCheckpointDir()
    if set_by_user:
        return set_by_user
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="entigraph-")
    _OWN.append(own)
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir()


@atexit.register
def _remove_own() -> None:
    for folder in _OWN:
        shutil.rmtree(folder, ignore_errors=True)


def _own_root(spark: SparkSession) -> str:
    return f"{shared_root(spark).rstrip('/')}/entigraph-{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in this application's part of the shared folder."""
    return f"{_own_root(spark)}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Delete all that this application staged.  Results that were not yet written out can no longer be read."""
    remove(spark, _own_root(spark))


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts the lineage and gives Spark its true size."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged_by(df: DataFrame, name: str, key: str) -> tuple[DataFrame, DataFrame]:
    """As ``staged``, in buckets of ``key``: (the bucketed table, the same files as plain Parquet).

    Joins of the first on ``key`` move only their other side; the second is for joins where that side has
    hot keys, which Spark splits only if it shuffles both."""
    spark, path, table = df.sparkSession, shared_path(df.sparkSession, name), f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    width = shuffle_width(df)
    rows = df.repartition(width, key).write.option("compression", "zstd").option("path", path)
    rows.bucketBy(width, key).sortBy(key).saveAsTable(table)
    return spark.table(table), spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``shared_path`` named, in whatever file system it lies."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or that with underscores added until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def quoted(name: str) -> str:
    """A column's name as an expression takes it, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def shuffle_width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------------------------------------
# Words.  A word is a maximal run of bytes other than space and \t \n \v \f \r; all of those are
# single bytes in UTF-8, so cutting bytes equals cutting characters.

_WORD_BYTE = np.ones(256, bool)
_WORD_BYTE[[9, 10, 11, 12, 13, 32]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 2**64)


class _Powers:
    """P**i and P**-i modulo 2**64, grown on demand."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(1 << 20, 1 << (n - 1).bit_length())
            for name, base in (("up", _P), ("down", _P_INV)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(cls, name, np.cumprod(steps, dtype=np.uint64))
        return cls.up[:n], cls.down[:n]


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser (splitmix64), so that all bits depend on all bits."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


#: Bytes that are looked at together; a longer word is looked at whole.
_PIECE = 1 << 20


class Words:
    """The words of a run of documents, lower-cased in A-Z, as flat arrays.

    ``hashes``: a 64-bit hash per word.  ``doc_from``: for document i the words
    ``doc_from[i]:doc_from[i + 1]``.  ``starts``/``ends``: byte spans in ``data``.

    Long runs are worked through in pieces that end between words, so what is held beside the text and
    three numbers a word does not grow with it."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True, hashed: bool = True):
        self.data = _LOWER[data] if lower else data
        self.word = _WORD_BYTE[data]
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        lo = 0
        while lo < len(data):
            hi = self._piece_end(lo, offsets)
            parts.append(self._piece(lo, hi, offsets, hashed))
            lo = hi
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
        self.starts, self.ends, hashes = (np.concatenate([p[j] for p in parts] or [none[j]]) for j in range(3))
        self.doc_from = np.searchsorted(self.starts, offsets)
        if hashed:
            self.hashes = hashes

    def _piece_end(self, lo: int, offsets: np.ndarray) -> int:
        """The first place ``_PIECE`` bytes on or later where no word goes on."""
        at = lo + _PIECE
        while at < len(self.word):
            gap = np.flatnonzero(~self.word[at : at + _PIECE])
            if len(gap):
                at += int(gap[0])
                break
            at += _PIECE
        end = int(np.searchsorted(offsets, lo + _PIECE))
        return min(at, len(self.word), int(offsets[end]) if end < len(offsets) else len(self.word))

    def _piece(self, lo: int, hi: int, offsets: np.ndarray, hashed: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        word = self.word[lo:hi]
        first, last = word.copy(), word.copy()
        same_doc = np.ones(len(word), bool)
        same_doc[offsets[(offsets > lo) & (offsets < hi)] - lo] = False
        first[1:] &= ~(word[:-1] & same_doc[1:])
        last[:-1] &= ~(word[1:] & same_doc[1:])
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        hashes = np.zeros(0, np.uint64)
        if hashed:
            up, down = _Powers.of(len(word) + 1)
            total = np.zeros(len(word) + 1, np.uint64)
            np.cumsum((self.data[lo:hi].astype(np.uint64) + np.uint64(1)) * up[: len(word)], dtype=np.uint64, out=total[1:])
            hashes = mix64((total[ends] - total[starts]) * down[starts])
        return starts + lo, ends + lo, hashes

    def counts(self) -> np.ndarray:
        return np.diff(self.doc_from)


def text_slices(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut an Arrow string column into runs of whole documents of about ``most`` bytes at most.

    Yields (first row, row after the last, bytes, offsets into them); a null is an empty text.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    n = len(texts)
    if not n:
        return
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def windows(doc_from: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, document) of every window of ``k`` words that lies in one document."""
    n = np.maximum(np.diff(doc_from) - k + 1, 0)
    doc = np.repeat(np.arange(len(n)), n)
    begin = np.repeat(doc_from[:-1] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    return begin, doc


def window_hashes(hashes: np.ndarray, begin: np.ndarray, k: int, offsets: tuple[int, ...] | None = None, salt: int = 0) -> np.ndarray:
    """Order-dependent hash of the words at ``begin + offsets`` (all of 0..k-1 if none are given)."""
    out = np.full(len(begin), np.uint64(salt * 0x632BE59BD9B4E019 & (2**64 - 1)), np.uint64)
    for j in offsets if offsets is not None else range(k):
        out = (out ^ hashes[begin + j]) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return mix64(out)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def hash_bits(hashes: DataFrame, column: str, most_bits: int = 27) -> tuple[np.ndarray, int]:
    """(packed flags, shift): flag ``h >>> shift``, lowest bit of a byte first, is set for each hash h of a
    long column.

    Built by Spark as bitmaps of 4 KB, of which at most 2**most_bits / 32768 come back (16 MB), however
    many hashes there are; with more hashes more flags are set, and none is ever missing."""
    n = hashes.count()
    bits = min(most_bits, max(15, (128 * n + 1).bit_length()))
    place = F.shiftrightunsigned(F.col(column), 64 - bits) + 1
    rows = hashes.select(F.bitmap_bucket_number(place).alias("b"), F.bitmap_bit_position(place).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("m")).collect()
    flags = np.zeros((1 << bits) // 8, np.uint8)
    for r in rows:
        flags[(r.b - 1) * 4096 : r.b * 4096] = np.frombuffer(bytes(r.m), np.uint8)
    return flags, 64 - bits


def flagged(flags: np.ndarray, shift: int, hashes: np.ndarray) -> np.ndarray:
    """Which of ``hashes`` (unsigned) have their flag set."""
    place = (hashes >> np.uint64(shift)).astype(np.int64)
    return (flags[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)


def longest_alike(equal: np.ndarray, share: float, ends: bool = False) -> tuple[int, int]:
    """(begin, end) of the longest stretch with at least ``share`` of its places equal, (0, 0) if none.

    With ``ends`` its first and last places are equal."""
    if not equal.any():
        return 0, 0
    total = np.concatenate([[0.0], np.cumsum(equal - share)])
    opens, closes = total[:-1].copy(), total[1:].copy()
    if ends:
        opens[~equal], closes[~equal] = np.inf, -np.inf
    # the first place from which the sum up to an end is not below 0: lowest sums so far only fall
    begin = np.searchsorted(-np.minimum.accumulate(opens), -closes - 1e-9, "left")
    length = np.arange(1, len(equal) + 1) - begin
    end = int(np.argmax(length))
    return (int(begin[end]), end + 1) if length[end] > 0 else (0, 0)
