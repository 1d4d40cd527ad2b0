"""Token ids in a binary file format: canonical length-limited Huffman code in independent blocks.

Texts are tokenized once; the ids are staged in the shared folder and counted on the way (the counts,
one per id of the vocabulary, are all that reaches the driver).  With the code fixed, documents are
encoded where they are staged, and only their codes are range-partitioned and sorted by doc_id and
written as blocks.  A block is a row of a Parquet table, so any file system that Spark writes will hold it:

    part, block       place in the global order;  first: ids in the part before this block
    doc_ids, lengths  the documents of the block, whole, and their numbers of ids
    sizes, bits       the codes of each document in whole bytes, most significant bit first, and their sizes
    checkpoints       per document, bit offset of every ``EVERY``-th id from its start, little-endian uint32

A block needs nothing but the code lengths to be read, and a reader can begin at any checkpoint: the
decoder runs all checkpoints of a block abreast, one table look-up per id.

Cases: a null text is empty; every document ends with ``end_id``; a null doc_id sorts first; repeated
ids are in order of a hash of their texts; an empty table gives an empty file; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remove, shared_path, shuffle_width, text_or_empty

EVERY = 64
BLOCK_IDS = 1 << 16
#: Bytes of remembered pieces and ids that a worker may hold, counted with what Python adds to each.
_CACHED_BYTES = 192 << 20
#: As many are left to a worker after a task, beside which other stages run.
_KEPT_BYTES = 48 << 20
_ENTRY_BYTES = 200
#: Longer pieces, such as whole texts without spaces, are not remembered.
_LONG = 64
_BLOCKS = "part int, block int, first long, doc_ids array<long>, lengths array<int>, sizes array<int>, bits binary, checkpoints binary"
_STAGED = "doc_ids array<long>, hashes array<long>, lengths array<int>, ids binary, counted binary, counts binary"
#: Bytes of texts that are cut and looked up together.
_TOGETHER = 2 << 20
#: A space with white space on both sides, or at the end after white space: there a cut before the space
#: would change how the tokenizer cuts the text.
_UNSAFE = re.compile(r"\s (?:\s|\Z)")


def _classes() -> np.ndarray:
    """Of each byte: 1 letter (A-Z, a-z, and in two bytes up to U+024F), 2 digit, 3 mark, 4 line end, 0 other."""
    out = np.zeros(256, np.uint8)
    out[33:127] = 3
    out[48:58] = 2
    out[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), *range(0xC3, 0xCA)]] = 1
    out[10], out[39] = 4, 0  # the tokenizer has rules of its own for what follows an apostrophe
    return out


def _spelling() -> np.ndarray:
    """The characters that a byte-level model spells bytes with; the tab is left to part runs."""
    out, free = np.zeros(256, "<u4"), 256
    for byte in range(256):
        plain = 33 <= byte <= 126 or 161 <= byte <= 172 or byte >= 174
        out[byte] = byte if plain else free
        free += not plain
    out[9] = 32
    return out


_CLASS, _SPELLING = _classes(), _spelling()
#: First bytes of white space, and of some other characters.
_MAYBE_SPACE = np.isin(np.arange(256), [*range(9, 14), *range(28, 33), 0xC2, 0xE1, 0xE2, 0xE3])


def _strings(raw: np.ndarray, begins: np.ndarray) -> pa.DictionaryArray:
    """The strings that begin so in ``raw``, each up to the next."""
    offsets = np.append(begins, len(raw)).astype(np.int32)
    return pa.StringArray.from_buffers(len(begins), pa.py_buffer(offsets), pa.py_buffer(raw)).dictionary_encode()


def _bytes(strings: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of the strings, offsets into them)."""
    _, off, data = strings.buffers()
    offsets = np.frombuffer(off, np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def _gather(flat: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches ``which`` of those that ``flat`` is made of, one after another, and where each ends."""
    begins = np.cumsum(lengths) - lengths
    n = lengths[which]
    ends = np.cumsum(n)
    return flat[np.repeat(begins[which] - (ends - n), n) + np.arange(n.sum())], ends


class Encoder:
    """Ids of whole texts by a byte-level BPE of the tokenizers library.

    That kind of tokenizer never joins what stands before a space with what follows it, so texts are cut
    before their spaces and each different piece is looked at once.  Pieces of plain letters, digits, marks and line
    ends are cut on, into the runs that the tokenizer makes of them.  The ids of runs, and of other pieces whole,
    are remembered.  New runs are encoded together by the library's model, spelled as it spells bytes, so that
    it need not cut them; other new pieces as one text, where each begins at a token that begins with a space."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.model, self.spelled = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.spelled.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        names = self.model.get_vocab(with_added_tokens=True)
        self.spaced = np.zeros(max(names.values()) + 1, bool)
        self.spaced[[i for name, i in names.items() if name.startswith("\u0120")]] = True  # the byte 0x20, as this model spells it
        self.widths = np.zeros(len(self.spaced), np.int64)
        self.widths[list(names.values())] = list(map(len, names))
        self.known: dict[str, bytes] = {}  # what follows a space
        self.begin: dict[str, bytes] = {}  # what follows none
        self.held = 0
        self.long: list[str] = []  # of these, long ones; none stays beyond the texts at hand

    def _alone(self, text: str) -> bytes:
        return np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _runs(self, runs: list[str]) -> list[bytes]:
        """Ids of single runs without tabs."""
        out: list[bytes] = []
        for lo in range(0, len(runs), 2000):
            raw = np.frombuffer("\t".join(runs[lo : lo + 2000]).encode(), np.uint8)
            tabs = np.flatnonzero(raw == 9)
            text = _SPELLING[raw].tobytes().decode("utf-32-le")
            ids = np.array(self.spelled.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            last = np.append(tabs, len(raw)) - np.arange(len(tabs) + 1)  # bytes up to the end of each run
            ends = np.cumsum(self.widths[ids])
            at = np.searchsorted(ends, last)
            if at[-1] + 1 != len(ids) or not np.array_equal(ends[at], last):
                raise ValueError("the tokenizer's model does not spell bytes as expected")
            cuts = (4 * (at + 1)).tolist()
            out += map(ids.tobytes().__getitem__, map(slice, [0, *cuts[:-1]], cuts))
        return out

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of whole pieces; a space before each is theirs."""
        found: dict[str, bytes] = {}
        plain = [p for p in pieces if p[0] == " " and len(p) > 1 and not p[1].isspace() and not p[-1].isspace() and "<|" not in p]
        for lo in range(0, len(plain), 2000):
            some = plain[lo : lo + 2000]
            ids = np.frombuffer(self._alone("".join(some)), "<u4")
            at = np.flatnonzero(self.spaced[ids])
            if len(at) != len(some):
                raise ValueError("the tokenizer joins text across spaces")
            raw, begins = ids.tobytes(), (4 * at).tolist()
            found.update(zip(some, map(raw.__getitem__, map(slice, begins, [*begins[1:], len(raw)])), strict=True))
        return [found[p] if p in found else self._alone(p) for p in pieces]

    def _look_up(self, strings: list[str], whole: np.ndarray) -> list[bytes]:
        """Ids of different runs or, where ``whole``, pieces; new ones are learned."""
        known, begin = self.known.get, self.begin.get
        out = [known(x[1:]) if x[0] == " " else begin(x) for x in strings]
        new = [i for i, ids in enumerate(out) if ids is None]
        of = whole[np.array(new, np.int64)]
        for learn, at in ((self._runs, np.compress(~of, new).astype(int).tolist()), (self._pieces, np.compress(of, new).astype(int).tolist())):
            fresh = [strings[i] for i in at]
            for i, x, ids in zip(at, fresh, learn(fresh), strict=True):
                out[i] = ids
                if len(x) <= _LONG:
                    self.held += _ENTRY_BYTES + 6 * len(x)
                    if x[0] == " ":
                        self.known[x[1:]] = ids
                    else:
                        self.begin[x] = ids
        return out

    def forget(self, most: int) -> None:
        """Forget what was learned last beyond ``most`` bytes: common pieces are among the first that were met."""
        if self.held > most:
            share = most / self.held
            self.known, self.begin = (dict(islice(d.items(), int(len(d) * share))) for d in (self.known, self.begin))
            self.held = sum((_ENTRY_BYTES + 6) * len(d) + 6 * sum(map(len, d)) for d in (self.known, self.begin))

    def many(self, texts: list[str] | pa.StringArray) -> list[np.ndarray]:
        """Ids of each text; what is new in any of them is learned at once."""
        if self.held > _CACHED_BYTES:
            self.forget(_CACHED_BYTES // 2)
        if not len(texts):
            return []
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        raw, offsets = _bytes(texts)
        # a head from where a text begins, and a piece from each space
        spaces = np.flatnonzero(raw == 32)
        begins = np.sort(np.concatenate([offsets[:-1], spaces]), kind="stable")
        pieces = _strings(raw, begins)
        which = pieces.indices.to_numpy()
        last = np.searchsorted(spaces, offsets[1:]) + np.arange(1, len(offsets))  # pieces up to the end of each text
        flat, lengths, doubtful = self._encoded(pieces.dictionary)
        flat, ends = _gather(flat, lengths, which)
        ends = np.concatenate([[0], ends])[np.concatenate([[0], last])].tolist()
        out = [flat[lo:hi] for lo, hi in zip(ends, ends[1:], strict=False)]
        for i in np.unique(np.searchsorted(last, np.flatnonzero(doubtful[which]), "right")).tolist() if doubtful.any() else ():
            text = texts[i].as_py()
            if _UNSAFE.search(text):
                out[i] = np.frombuffer(self._alone(text), "<u4")
        return out

    def _encoded(self, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of different pieces, how many each has, whether it may be unsafe to cut before it)."""
        raw, offsets = _bytes(pieces)
        begins, sizes = offsets[:-1], np.diff(offsets)
        if not len(raw):
            return np.zeros(0, "<u4"), np.zeros(len(sizes), np.int64), np.zeros(len(sizes), bool)
        begins, empty = np.minimum(begins, len(raw) - 1), sizes == 0
        kind, second = _CLASS[raw], np.minimum(begins + 1, len(raw) - 1)
        after = (raw[begins] == 32) & ~empty
        doubtful = after & ((sizes == 1) | _MAYBE_SPACE[raw[second]])
        # the space belongs to the run that follows it
        kind[begins[after]] = kind[second[after]]
        odd = kind == 0
        odd[1:] |= (raw[:-1] == 0xC3) & ((raw[1:] == 0x97) | (raw[1:] == 0xB7)) | (raw[:-1] == 0xC9) & (raw[1:] > 0x8F) | (raw[:-1] == 60) & (raw[1:] == 124)
        total = np.concatenate([[0], np.cumsum(odd, dtype=np.int32)])
        whole = (total[offsets[1:]] > total[offsets[:-1]]) | (after & (sizes == 1)) | (kind[begins] == 4)
        cut = np.zeros(len(raw) + 1, bool)
        cut[1:-1] = kind[1:] != kind[:-1]
        # of line ends before something else in a piece, the last is a run of its own
        ended = np.zeros(len(raw) + 1, bool)
        ended[offsets] = True
        cut[1:-2] |= (kind[:-2] == 4) & (kind[1:-1] == 4) & (kind[2:] != 4) & ~ended[2:-1]
        cut[:-1] &= ~np.repeat(whole, sizes)
        cut[begins[~empty]] = True
        at = np.flatnonzero(cut[:-1])
        runs = _strings(raw, at)
        codes = runs.indices.to_numpy()
        entire = np.zeros(len(runs.dictionary), bool)
        entire[codes[np.repeat(whole, sizes)[at]]] = True
        found = self._look_up(runs.dictionary.to_pylist(), entire)
        ids = np.frombuffer(b"".join(found), "<u4")
        flat, ends = _gather(ids, np.fromiter(map(len, found), np.int64, len(found)) >> 2, codes)
        ends = np.concatenate([[0], ends])[np.searchsorted(at, offsets)]
        return flat, np.diff(ends), doubtful

    def ids(self, text: str) -> np.ndarray:
        return self.many([text])[0]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def code_lengths(counts: np.ndarray, most: int) -> np.ndarray:
    """Optimal code lengths of at most ``most`` bits for the counted symbols (0: symbol does not occur).

    Package-merge: at each of ``most`` levels, pairs of the level before compete with the symbols."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if 1 << most < len(used):
        raise ValueError(f"{len(used)} symbols need codes of more than {most} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.int64)
    is_symbol = []  # per level, from the deepest
    packages = np.zeros(0, np.int64)
    for _ in range(most):
        merged = np.concatenate([weights, packages])
        rank = np.argsort(merged, kind="stable")
        is_symbol.append(rank < len(weights))
        row = merged[rank]
        packages = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
    taken = 2 * len(used) - 2
    depth = np.zeros(len(used), np.int64)
    for level in reversed(is_symbol):
        symbols = int(level[:taken].sum())
        depth[:symbols] += 1
        taken = 2 * (taken - symbols)
    lengths[order] = depth
    return lengths


class Code:
    """Canonical code: shorter codes first, equal lengths in order of id."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        used = np.flatnonzero(lengths)
        order = used[np.lexsort((used, lengths[used]))]
        self.bits = int(lengths.max(initial=1))
        self.codes = np.zeros(len(lengths), np.int64)
        widths = self.lengths[order]
        begin = np.concatenate([[0], np.cumsum(np.int64(1) << (self.bits - widths))])
        self.codes[order] = begin[:-1] >> (self.bits - widths)
        self.table = np.zeros(1 << self.bits, np.int64)
        self.table[: begin[-1]] = np.repeat(order, np.diff(begin))

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        widths = self.lengths[ids]
        ends = np.cumsum(widths)
        begins = ends - widths
        total = int(ends[-1]) if len(ids) else 0
        span = -(-(self.bits + 7) // 8)
        at = begins >> 3
        value = self.codes[ids] << (8 * span - widths - (begins & 7))
        out = np.zeros(-(-total // 8) + span, np.int64)
        for j in range(span):
            part = np.bincount(at + j, weights=((value >> (8 * (span - 1 - j))) & 255).astype(np.float64), minlength=len(out))
            out += part.astype(np.int64)
        marks = begins[::EVERY]
        return out[: -(-total // 8)].astype(np.uint8).tobytes(), marks.astype("<u4").tobytes()

    def decode(self, bits: bytes, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The ids of stretches of at most ``EVERY`` that begin at the bits ``at`` and hold ``n`` ids each:
        all stretches are decoded side by side."""
        span = -(-(self.bits + 7) // 8)
        raw = np.frombuffer(bits + b"\0" * (span + self.bits), np.uint8).astype(np.int64)
        words = raw[: len(bits) + self.bits].copy()
        for j in range(1, span):
            words = (words << 8) | raw[j : j + len(words)]
        out = np.zeros((len(at), EVERY), np.int64)
        mask, last = (1 << self.bits) - 1, len(words) - 1
        for step in range(int(n.max(initial=0))):
            peek = (words[np.minimum(at >> 3, last)] >> (8 * span - self.bits - (at & 7))) & mask
            found = self.table[peek]
            out[:, step] = found
            at = at + self.lengths[found]
        return out[np.arange(EVERY) < n[:, None]]


def stretches(lengths: np.ndarray, sizes: np.ndarray, checkpoints: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(first bit, number of ids) of every stretch of documents with so many ids, in so many bytes."""
    lanes = -(-lengths // EVERY)
    begin = np.repeat(8 * (np.cumsum(sizes) - sizes), lanes) + np.frombuffer(checkpoints, "<u4")
    n = np.full(int(lanes.sum()), EVERY, np.int64)
    n[np.cumsum(lanes)[lanes > 0] - 1] = (lengths[lanes > 0] - 1) % EVERY + 1
    return begin.astype(np.int64), n


def stage_ids(docs: DataFrame, tokenizer: str, vocabulary: int, end_id: int, path: str) -> None:
    """Tokenize ``docs`` and write their ids, each with the end id, and the counts of each task.

    Ids are compressed by byte planes; a row holds the documents of about ``BLOCK_IDS`` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, counts, pack = encoder(tokenizer), np.zeros(vocabulary, np.int64), zstandard.ZstdCompressor(level=1)
        kinds = (pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary())
        names = ["doc_ids", "hashes", "lengths", "ids", "counted", "counts"]
        end = np.array([end_id], "<u4")

        def row(*values) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(values, kinds, strict=True)], names=names)

        for batch in batches:
            lo, n = 0, batch.num_rows
            ends = np.cumsum(pa.compute.binary_length(batch.column(1)).to_numpy())
            while lo < n:
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + _TOGETHER, "right")))
                pieces = enc.many(batch.column(1).slice(lo, hi - lo))
                full = np.cumsum([len(p) + 1 for p in pieces])
                while lo < hi:
                    done = len(pieces) - (hi - lo)
                    up = max(done + 1, int(np.searchsorted(full, (full[done - 1] if done else 0) + BLOCK_IDS, "right")))
                    part, some = batch.slice(lo, up - done), pieces[done:up]
                    flat = np.concatenate([x for p in some for x in (p, end)])
                    counts += np.bincount(flat, minlength=vocabulary)
                    planes = pack.compress(flat.view(np.uint8).reshape(-1, 4).T.tobytes())
                    yield row(part.column(0).to_pylist(), part.column(2).to_pylist(), [len(p) + 1 for p in some], planes, None, None)
                    lo += up - done
        enc.forget(_KEPT_BYTES)
        used = np.flatnonzero(counts)
        yield row([], [], [], None, used.astype("<i4").tobytes(), counts[used].astype("<i8").tobytes())

    texts = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).withColumn("h", F.xxhash64("text"))
    texts.mapInArrow(run, _STAGED).write.option("compression", "none").parquet(path)


def count_ids(stage: DataFrame, vocabulary: int) -> np.ndarray:
    """Occurrences of each id over all staged documents; rows are summed by Spark, one per id comes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for ids, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[np.frombuffer(ids, "<i4")] += np.frombuffer(n, "<i8")
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used])], names=["id", "n"])

    counts = np.zeros(vocabulary, np.int64)
    for r in stage.where("counts IS NOT NULL").select("counted", "counts").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r.id] = r.n
    return counts


def write_tokens(docs: DataFrame, path: str, tokenizer: str, vocabulary: int = 50_257, end_id: int = 0, most_bits: int = 16) -> None:
    """Encode ``docs`` (doc_id, text) and write the blocks to ``path``/blocks and the code to ``path``/code."""
    spark = docs.sparkSession
    stage_ids(docs, tokenizer, vocabulary, end_id, f"{path}/staged")
    stage = spark.read.schema(_STAGED).parquet(f"{path}/staged")
    lengths = code_lengths(count_ids(stage, vocabulary), most_bits)
    spark.createDataFrame([(bytearray(lengths.astype(np.uint8).tobytes()),)], "lengths binary").coalesce(1).write.parquet(f"{path}/code")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, unpack = Code(lengths), zstandard.ZstdDecompressor()
        for batch in batches:
            for row in batch.to_pylist():
                flat = np.frombuffer(unpack.decompress(row["ids"]), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()
                ends = np.cumsum(row["lengths"])
                both = [code.encode(flat[e - n : e]) for e, n in zip(ends.tolist(), row["lengths"], strict=True)]
                columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(row["hashes"], pa.int64()), pa.array(row["lengths"], pa.int32()), pa.array([x[0] for x in both], pa.binary()), pa.array([x[1] for x in both], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "h", "n", "bits", "marks"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, first = TaskContext.get().partitionId(), 0, 0
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            ids, _, n, bits, marks = zip(*held, strict=True)
            values = (part, block, first, list(ids), list(n), [len(b) for b in bits], b"".join(bits), b"".join(marks))
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(values, kinds, strict=True)], names=["part", "block", "first", "doc_ids", "lengths", "sizes", "bits", "checkpoints"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(row)
                size += row[2]
                if size >= BLOCK_IDS:
                    yield flush()
                    block, first, size, held = block + 1, first + size, 0, []
        if held:
            yield flush()

    coded = stage.where("counts IS NULL").select("doc_ids", "hashes", "lengths", "ids").mapInArrow(encode, "doc_id long, h long, n int, bits binary, marks binary")
    ids = stage.where("counts IS NULL").select(F.explode("doc_ids").alias("doc_id"))
    ranged = in_ranges(coded, ids, shuffle_width(docs)).sortWithinPartitions("doc_id", "h").drop("range")
    ranged.mapInArrow(blocks, _BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    remove(spark, f"{path}/staged")


def in_ranges(rows: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """``rows`` (doc_id, h, ...) dealt to ``width`` ascending ranges of (doc_id, h), null ids first.

    The ends of the ranges come from a scan of ``ids`` alone, so ``rows`` are not made to find them.  An
    id that fills several ranges is cut by h."""
    if width > 1:
        steps = [i / width for i in range(1, width)]
        ends = ids.agg(F.percentile_approx("doc_id", steps, 10_000).alias("e")).first().e or []
    else:
        ends = []
    bounds = F.array(*[F.lit(int(e)) for e in ends]).cast("array<long>")
    below = F.size(F.filter(bounds, lambda e: e < F.col("doc_id")))
    n = F.size(F.filter(bounds, lambda e: e == F.col("doc_id"))) + 1
    place = below + F.least(F.floor((F.col("h") / float(1 << 63) / 2 + 0.5) * n), n - 1)
    dealt = rows.withColumn("range", F.when(F.col("doc_id").isNull(), 0).otherwise(place).cast("int"))
    return dealt.repartitionById(width, "range")


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document, decoded from the blocks."""
    lengths = np.frombuffer(bytes(spark.read.parquet(f"{path}/code").first().lengths), np.uint8)
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    # one sum per written part: as many rows as the writer had partitions
    sums = blocks.select("part", F.expr("aggregate(lengths, 0L, (a, x) -> a + x)").alias("n")).groupBy("part").agg(F.sum("n").alias("n")).collect()
    base, total = {}, 0
    for row in sorted(sums, key=lambda r: r.part):
        base[row.part] = total
        total += row.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(lengths)
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.array(row["lengths"], np.int64)
                ends = np.cumsum(sizes)
                ids = code.decode(row["bits"], *stretches(sizes, np.array(row["sizes"], np.int64), row["checkpoints"])).astype("<u4")
                raw = memoryview(ids.tobytes())
                starts = base[row["part"]] + row["first"] + ends - sizes
                crcs = [zlib.crc32(raw[4 * (e - s) : 4 * e]) for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
                columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(starts), pa.array(sizes), pa.array(crcs, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([ids[e - s : e].tolist() for s, e in zip(sizes, ends, strict=True)], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return blocks.select("part", "first", "doc_ids", "lengths", "sizes", "bits", "checkpoints").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def round_trip(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write ``docs`` to the shared folder and read them back."""
    path = shared_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, **options)
    return read_tokens(docs.sparkSession, path)
