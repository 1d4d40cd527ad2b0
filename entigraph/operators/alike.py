"""Texts that are alike by the sequence ratio: a self-join over pieces, and greedy leaders over its pairs.

Two texts with a ratio of ``t`` or more leave at most ``d = (1 - t) * (|a| + |b|)`` characters unmatched, so of
the longer one's ``d + 1`` disjoint pieces one at least stands unchanged in the shorter one, moved by no more
than what is unmatched.  Pieces and the shorter texts' character grams meet in an equi-join; lengths, places and a bitmap of
letter counts thin the pairs inside the join, a bounded edit distance once per pair, and only what
remains is measured by the ratio itself.  Nothing is lost, and no block is compared all with all.

Thresholds have to be above 0.5 (below, the pieces have no characters).
"""

from __future__ import annotations

import difflib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from ..functions.similarity import sequence_ratio
from ..session import settled

_EPS = 1e-9


_LETTERS = StructType([StructField("low", LongType()), StructField("high", LongType()), StructField("over", IntegerType())])


@F.arrow_udf(_LETTERS)
def letter_counts(texts: pa.Array) -> pa.Array:
    """A bit for each of 32 classes of characters and each of the counts 1 to 4, and how many characters go beyond those."""
    rows = []
    for text in texts.to_pylist():
        points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
        n = np.bincount(points % 32, minlength=32)
        bits = (n[:, None] > np.arange(4)).reshape(-1)
        low, high = np.packbits(bits, bitorder="little").view(np.int64)
        rows.append((low, high, np.maximum(n - 4, 0).sum()))
    low, high, over = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.StructArray.from_arrays([pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(over, pa.int32())], names=["low", "high", "over"])


def measured(items: DataFrame) -> DataFrame:
    """``items`` (block, item, place) with their lengths and letter counts, as ``pairs`` wants them."""
    return items.select("block", "item", "place", F.length("item").alias("n"), letter_counts("item").alias("letters")).select("block", "item", "place", "n", "letters.*")


def _n_pieces(n: str, t: float) -> str:
    return f"(cast(floor({2 * (1 - t)!r}D * {n} + {_EPS}D) as int) + 1)"


def _pieces(items: DataFrame, t: float) -> DataFrame:
    """A row for each of a text's disjoint pieces, as many as one more than what may stay unmatched."""
    k = _n_pieces("n", t)
    cut = F.expr(f"transform(sequence(0, {k} - 1), i -> struct(cast(i * n div {k} as int) AS at, cast((i + 1) * n div {k} as int) AS stop))")
    rows = items.where("n > 0").select("block", "place", "n", "low", "high", "over", "item", F.explode(cut).alias("c"))
    return rows.select("block", F.expr("substring(item, c.at + 1, c.stop - c.at)").alias("gram"), "place", "n", "low", "high", "over", F.col("c.at").alias("at"))


def _grams(items: DataFrame, t: float) -> DataFrame:
    """A row for each gram as long as a piece of any text that is as long or longer and may still be alike."""
    k = _n_pieces("m", t)
    sizes = F.expr(f"array_distinct(flatten(transform(sequence(n, cast(floor(n * {(2 - t) / t!r}D + {_EPS}D) as int)), m -> array(cast(m div {k} as int), cast((m + {k} - 1) div {k} as int)))))")
    rows = items.where("n > 0").select("block", "place", "n", "low", "high", "over", "item", F.explode(sizes).alias("q"))
    rows = rows.where("q <= n").select("*", F.explode(F.expr("sequence(0, n - q)")).alias("at"))
    return rows.select("block", F.expr("substring(item, at + 1, q)").alias("gram"), "place", "n", "low", "high", "over", "at")


def _met(long: DataFrame, short: DataFrame, t: float, strictly: bool) -> DataFrame:
    """(block, p_long, p_short): pairs with a common piece, thinned by lengths, places and letters."""
    a = long.select("block", "gram", *[F.col(c).alias(f"a_{c}") for c in ("place", "n", "low", "high", "over", "at")])
    b = short.select("block", "gram", *[F.col(c).alias(f"b_{c}") for c in ("place", "n", "low", "high", "over", "at")])
    loose = f"cast(floor({1 - t!r}D * (a_n + b_n) + {_EPS}D) as int)"
    fits = f"""a_n {'>' if strictly else '>='} b_n AND a_n - b_n <= {loose}
        AND 2 * (a_at - b_at) <= {loose} + (a_n - b_n) AND 2 * (b_at - a_at) <= {loose} - (a_n - b_n)
        AND bit_count(a_low & b_low) + bit_count(a_high & b_high) + least(a_over, b_over) >= {t!r}D * (a_n + b_n) / 2 - {_EPS}D"""
    return a.join(b, ["block", "gram"]).where(fits).select("block", F.col("a_place").alias("p_long"), F.col("b_place").alias("p_short"))


def near_pairs(leaders: DataFrame, others: DataFrame, t: float) -> DataFrame:
    """(block, leader, leader_place, item, place): pairs of ``measured`` texts of a block, the leader's place being the
    smaller one: all whose ratio is ``t`` or more, and few others."""
    _above_half(t)
    one = _met(_pieces(leaders, t), _grams(others, t), t, strictly=False).select("block", F.col("p_long").alias("leader_place"), F.col("p_short").alias("place"))
    two = _met(_pieces(others, t), _grams(leaders, t), t, strictly=True).select("block", F.col("p_short").alias("leader_place"), F.col("p_long").alias("place"))
    met = one.unionAll(two).where("leader_place < place").distinct()
    texts = met.join(leaders.select("block", F.col("place").alias("leader_place"), F.col("item").alias("leader")), ["block", "leader_place"]).join(others.select("block", "place", "item"), ["block", "place"])
    size = "(length(leader) + length(item))"
    near = texts.where(f"levenshtein(leader, item, cast(floor({1 - t!r}D * {size} + {_EPS}D) as int)) >= 0")
    return near.select("block", "leader", "leader_place", "item", "place")


def alike(near: DataFrame, t: float) -> DataFrame:
    return near.where(sequence_ratio(F.col("leader"), F.col("item")) >= t)


def pairs(leaders: DataFrame, others: DataFrame, t: float) -> DataFrame:
    """As ``near_pairs``, but only those whose ratio is ``t`` or more."""
    return alike(near_pairs(leaders, others, t), t)


def _above_half(t: float) -> None:
    if t <= 0.5:
        raise ValueError("pieces need a threshold above 0.5")


def _work(items: DataFrame, t: float) -> int:
    """How often pieces and grams of these texts meet."""
    a = _pieces(items, t).groupBy("block", "gram").agg(F.count("*").alias("a"))
    b = _grams(items, t).groupBy("block", "gram").agg(F.count("*").alias("b"))
    return int(a.join(b, ["block", "gram"]).agg(F.sum(F.col("a").cast("double") * F.col("b"))).first()[0] or 0)


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points, a column for each place, each named by its number in the second; -1 where a text has ended)."""
    raw = [np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) for x in texts]
    known, at = np.unique(np.concatenate(raw), return_inverse=True)
    sizes = np.array([len(x) for x in raw])
    out = np.full((sizes.max(), len(raw)), -1, np.int32)
    rows = np.repeat(np.arange(len(raw)), sizes)
    out[np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes), rows] = at
    return out, known


def _common(leader: str, points: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of ``leader``, of at most 64 characters, and each text: the blocks
    that the ratio counts are one, so they have no more characters.  A bit for each place of the leader."""
    mine = np.frombuffer(leader.encode("utf-32-le", "surrogatepass"), np.uint32)
    masks = np.zeros(len(known) + 1, np.uint64)  # the last is for places beyond a text's end
    for i, c in enumerate(mine.tolist()):
        masks[:-1][known == c] |= np.uint64(1 << i)
    free = np.full(points.shape[1], ~np.uint64(0))
    for column in points:
        met = free & masks[column]
        free = (free + met) | (free - met)
    return np.bitwise_count(~free & np.uint64((1 << len(mine)) - 1))


#: Longer texts than three times these are too long for such leaders, as a ratio above 0.5 wants.
_BITS = 64


class _Texts:
    """Texts with their lengths and letter counts, to be compared with one leader at a time."""

    def __init__(self, texts: list[str], n, low, high, over):
        self.texts = texts
        self.n, self.low, self.high, self.over = (np.asarray(c).astype(kind) for c, kind in ((n, np.int64), (low, np.uint64), (high, np.uint64), (over, np.int64)))
        short = np.flatnonzero(self.n <= 3 * _BITS)
        self.column = np.full(len(texts), -1)
        self.column[short] = np.arange(len(short))
        self.points, self.known = _points([texts[i] for i in short]) if len(short) else (None, None)

    def of(self, i: int) -> tuple:
        return self.texts[i], self.n[i], self.low[i], self.high[i], self.over[i]

    def alike(self, leader: tuple, left: np.ndarray, t: float) -> np.ndarray:
        """Which of ``left`` have a ratio of ``t`` or more to ``leader``."""
        text, m, low, high, over = leader
        least = t * (self.n[left] + m) / 2 - _EPS
        same = np.bitwise_count(self.low[left] & low).astype(np.int64) + np.bitwise_count(self.high[left] & high) + np.minimum(self.over[left], over)
        near = np.flatnonzero((np.minimum(self.n[left], m) >= least) & (same >= least))
        column = self.column[left[near]]
        if len(near) and 0 < m <= _BITS and (column >= 0).all():
            near = near[_common(text, self.points[:, column], self.known) >= least[near]]
        out = np.zeros(len(left), bool)
        for i in near.tolist():
            out[i] = difflib.SequenceMatcher(None, text, self.texts[left[i]]).ratio() >= t
        return out


def _first_alike(leaders: DataFrame, others: DataFrame, t: float) -> DataFrame:
    """(block, place, item, leader): those of ``others`` that are alike to a leader of their block, with the first one.

    For leaders that are few enough to be sent to all tasks, and stand before all others: one pass, in which a text
    is compared with no leader after the first that it is alike to."""
    of: dict[str, list[tuple]] = {}
    for r in leaders.where("item IS NOT NULL").select("block", "item", "n", "low", "high", "over").orderBy(leaders["place"]).toArrow().to_pylist():
        bits = (np.uint64(r[c] & (1 << 64) - 1) for c in ("low", "high"))
        of.setdefault(repr(r["block"]), []).append((r["item"], r["n"], *bits, r["over"]))
    sent = leaders.sparkSession.sparkContext.broadcast(of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list[int]] = {}
            for i, block in enumerate(batch.column("block").to_pylist()):
                by.setdefault(repr(block), []).append(i)
            for block, rows in by.items():
                if block not in sent.value:
                    continue
                part = batch.take(pa.array(rows, pa.int64()))
                texts = _Texts(part.column("item").to_pylist(), *(part.column(c).to_numpy() for c in ("n", "low", "high", "over")))
                lead, left = np.full(len(rows), -1), np.arange(len(rows))
                for which, leader in enumerate(sent.value[block]):
                    met = texts.alike(leader, left, t)
                    lead[left[met]] = which
                    left = left[~met]
                    if not len(left):
                        break
                at = np.flatnonzero(lead >= 0)
                kept = part.select(["block", "place", "item"]).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([sent.value[block][x][0] for x in lead[at].tolist()], kept.column(2).type)], names=["block", "place", "item", "leader"])

    kinds = dict(others.dtypes)
    return others.where("item IS NOT NULL").mapInArrow(run, f"block {kinds['block']}, place {kinds['place']}, item {kinds['item']}, leader {kinds['item']}")


def _settle(pdf: pd.DataFrame) -> pd.DataFrame:
    """Greedy leaders of one block's head, from each text's earlier neighbours."""
    pdf = pdf.sort_values("place")
    lead: dict = {}
    out = []
    for place, near in zip(pdf["place"], pdf["near"], strict=True):
        chosen = min((x for x in (near if near is not None else ()) if lead[x]), default=None)
        lead[place] = chosen is None
        out.append(place if chosen is None else chosen)
    return pdf.assign(leader_place=out)[["block", "item", "place", "leader_place"]]


def _settle_small(t: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The same for a head that is small, or has few leaders, from the texts themselves."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        texts = _Texts(pdf["item"].tolist(), pdf["n"], pdf["low"], pdf["high"], pdf["over"])
        lead, left = np.zeros(len(pdf), np.int64), np.arange(len(pdf))
        while len(left):
            first, left = left[0], left[1:]
            met = texts.alike(texts.of(first), left, t)
            lead[first] = lead[left[met]] = first
            left = left[~met]
        return pdf.assign(leader_place=pdf["place"].to_numpy()[lead])[["block", "item", "place", "leader_place"]]

    return run


#: Leaders and characters that are sent to all tasks at most.
_FEW_LEADERS, _FEW_CHARS = 1024, 4 << 20
#: Texts and characters of a head that is settled directly, if few of the one before became leaders.
_DIRECT, _DIRECT_CHARS = 8192, 1 << 20


def greedy_leaders(items: DataFrame, threshold: float, batch: int = 256, work_most: int = 50_000_000, pairs_most: int = 200_000, batch_most: int = 1 << 16) -> DataFrame:
    """(block, item, leader) from distinct (block, item, place), places being distinct in a block: in order of place, an
    item joins the first leader of its block that it is alike to, or becomes one.

    Exact, in rounds.  The first undecided texts of each block, the head, settle among themselves; then all others
    are joined with the leaders that arise, and those that are alike to one are decided (nobody undecided stands
    before a leader).  A head of up to 256 texts is settled directly, and a larger one where at most an eighth of the
    head before became leaders.  Else it grows fourfold a round while most of it
    become leaders; a larger one is joined with itself over pieces, and grows only while that join is
    far from ``work_most`` meetings of pieces and grams and ``pairs_most`` pairs to measure, and shrinks beyond those.
    So many texts that are alike fall to few leaders first and never meet each other, while unlike texts are done in
    few rounds.  A head has at most ``batch_most`` texts, and a block's head is settled by one task."""
    _above_half(threshold)
    kinds = dict(items.dtypes)
    undecided = settled(measured(items))
    order = Window.partitionBy("block").orderBy("place")
    shape = f"block {kinds['block']}, item {kinds['item']}, place {kinds['place']}, leader_place {kinds['place']}"
    done: list[DataFrame] = []
    direct = batch
    while not undecided.isEmpty():
        placed = undecided.withColumn("_nth", F.row_number().over(order))
        while True:
            head = placed.where(F.col("_nth") <= (max(batch, direct) if batch <= 256 else batch)).drop("_nth")
            if batch <= 256:
                first = settled(head.groupBy("block").applyInPandas(_settle_small(threshold), shape))
                break
            head = settled(head)
            work = _work(head, threshold)
            if work <= work_most:
                near = settled(near_pairs(head, head, threshold))
                n_near = near.count()
                if n_near <= pairs_most:
                    met = alike(near, threshold).groupBy("block", "place").agg(F.collect_list("leader_place").alias("near"))
                    with_near = head.select("block", "item", "place").join(met, ["block", "place"], "left").select("block", "item", "place", "near")
                    first = settled(with_near.groupBy("block").applyInPandas(_settle, shape))
                    break
            batch = max(256, batch // 4)
        leaders = undecided.join(first.where("place = leader_place").select("block", "place"), ["block", "place"], "left_semi").select(*undecided.columns)
        done.append(first.join(leaders.select("block", F.col("place").alias("leader_place"), F.col("item").alias("leader")), ["block", "leader_place"]).select("block", "item", "leader"))
        others = undecided.join(first.select("block", "place"), ["block", "place"], "left_anti").select(*undecided.columns)
        size = first.agg(F.count("*").alias("n"), F.count_if(F.expr("place = leader_place")).alias("leaders"), F.sum(F.length("item")).alias("chars")).first()
        few = size.leaders <= _FEW_LEADERS and size.chars <= _FEW_CHARS
        if few:
            joined = settled(_first_alike(leaders, others, threshold))
        else:
            met = pairs(leaders, others, threshold)
            joined = settled(met.groupBy("block", "place").agg(F.min_by(F.struct("leader", "item"), "leader_place").alias("m")).select("block", "place", "m.item", "m.leader"))
        done.append(joined.select("block", "item", "leader"))
        undecided = settled(others.join(joined.select("block", "place"), ["block", "place"], "left_anti").select(*undecided.columns))
        direct = min(4 * max(batch, direct), _DIRECT) if batch <= 256 and 8 * size.leaders <= size.n and 4 * size.chars <= _DIRECT_CHARS else batch
        if 4 * size.leaders >= size.n and (batch <= 256 or 16 * work <= work_most and 16 * n_near <= pairs_most):
            batch = min(batch * 4, batch_most)
    out = undecided.select("block", "item", F.col("item").alias("leader"))
    for d in done:
        out = out.unionAll(d)
    return out


def first_of(score: Column, order: Column, *values: Column) -> Column:
    """``values`` of the row with the highest score, the first in order on ties; no score counts as 0."""
    return F.min_by(F.struct(*values), F.struct(-F.coalesce(score, F.lit(0.0)), order))
