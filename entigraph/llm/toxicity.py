"""Toxicity by a weighted finite-state pattern grammar.

Words are mapped to symbols (insult, threat, target, negation, report, other) and each clause is run
through a cascade of small transducers, composed once: the insult transducer tells a clause's first insult
from further ones, the negation transducer marks what stands in the reach of a negation, the
reported-speech transducer what stands after a verb of saying, the target transducer what is aimed at
somebody, and the threat transducer violence that finds its target.  A clause is scored by the marks it
collects, so "you are no idiot" and "he called them idiots" weigh differently from "you idiot" and "you
stupid idiot"; a text is scored by its matched clauses: their sums for each kind, the strongest of them,
and their share.

Weights come from labelled rows.  Words and word beginnings whose share among toxic texts is far above
that among clean texts become insults, weighted by the logarithm of the ratio; the weight of each kind of
mark is fitted by logistic regression.  Only the text is an input.  Training reads at most
``sample_most`` labelled rows, drawn by hash, half from each class, one text for each doc_id; the counts per word are summed by
Spark, and what reaches the driver is bounded by ``sample_most`` rows of a few numbers and
``lexicon_most`` entries.

Cases: a null or empty text has no marks and takes the score of the intercept; rows with a null doc_id
are never held out and never learned from; a label that repeats counts once, labels that contradict each
other count each; with
no labels of both classes the built-in lexicon and weights are used; repeated rows are scored each; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import Words, staged, text_or_empty, text_slices, window_hashes, windows

#: Words of the grammar in English, German, French and Spanish.
INSULTS = "idiot idiots moron morons fool stupid dumb loser scum trash pathetic worthless imbecile dummkopf trottel imbécile crétin idiota estúpido imbécil".split()
THREATS = "kill killing hurt destroy beat strangle shoot stab töten umbringen schlagen tuer frapper matar golpear".split()
TARGETS = "you your yours he him his she her they them their du dich dein ihr euch sie tu toi vous ton votre il elle ils elles tú te usted ellos ellas vosotros".split()
NEGATIONS = "not no never isn't aren't don't nicht kein keine nie ne pas jamais non nunca jamás tampoco".split()
REPORTS = "said says say wrote writes told called calls quoted claimed sagte sagt schrieb nannte dit écrit appelé dijo dice escribió llamó".split()

O, I, V, T, N, R, END = range(7)
_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;:\n]")
_STOPS = frozenset(".!?;:\n")
PREFIXES = (4, 5, 6, 7)
MARKS = ("plain", "aimed", "negated", "reported", "threat")
#: Before there are labels: the weight of the logarithm of each kind of mark, and the intercept.
PRIOR = np.array([-4.0, 2.5, 3.0, 0.8, 1.0, 2.5, 0.5, 0.5, 0.5])
#: How much a mark counts in the score of its clause.
FORCE = {"plain": 1.0, "aimed": 1.5, "negated": 0.25, "reported": 0.35, "threat": 1.5}


@dataclass(frozen=True)
class Transducer:
    """States, and for (state, symbol) the next state and the set of marks it puts on the symbol."""

    start: int
    arcs: dict[tuple[int, int], tuple[int, frozenset[str]]]

    def step(self, state: int, symbol: int) -> tuple[int, frozenset[str]]:
        return self.arcs.get((state, symbol), (state, frozenset()))


def insult() -> Transducer:
    """A clause's first insult, and those that are piled on it."""
    return Transducer(0, {(0, I): (1, frozenset({"insult"})), (1, I): (1, frozenset({"insult", "piled"})), (1, END): (0, frozenset())})


def negation(reach: int = 3) -> Transducer:
    """After a negation, the next ``reach`` words are in its reach."""
    arcs = {(s, N): (reach, frozenset()) for s in range(reach + 1)} | {(s, END): (0, frozenset()) for s in range(reach + 1)}
    for s in range(1, reach + 1):
        arcs |= {(s, x): (s - 1, frozenset({"negated"} if x in (I, V) else ())) for x in (O, I, V, T, R)}
    return Transducer(0, arcs)


def reported() -> Transducer:
    """After a verb of saying, the rest of the clause is reported."""
    return Transducer(0, {(0, R): (1, frozenset()), (1, END): (0, frozenset()), (1, I): (1, frozenset({"reported"})), (1, V): (1, frozenset({"reported"}))})


def target(reach: int = 4) -> Transducer:
    """An insult or threat is aimed if a target stands at most ``reach`` words before it."""
    arcs = {(s, T): (reach, frozenset()) for s in range(reach + 1)} | {(s, END): (0, frozenset()) for s in range(reach + 1)}
    for s in range(1, reach + 1):
        arcs |= {(s, x): (s - 1, frozenset({"aimed"} if x in (I, V) else ())) for x in (O, I, V, N, R)}
    return Transducer(0, arcs)


def threat() -> Transducer:
    """A verb of violence counts once it is aimed, before or after: state 1 waits for its target."""
    return Transducer(0, {(0, V): (1, frozenset({"violence"})), (1, V): (1, frozenset({"violence"})), (1, T): (0, frozenset({"struck"})), (1, END): (0, frozenset())})


class Grammar:
    """The composition of transducers: one table over tuples of their states, filled as it is used."""

    def __init__(self, *machines: Transducer):
        self.machines = machines
        self.start = tuple(m.start for m in machines)
        self.table: dict[tuple[tuple[int, ...], int], tuple[tuple[int, ...], str | None, bool]] = {}

    def step(self, state: tuple[int, ...], symbol: int) -> tuple[tuple[int, ...], str | None, bool]:
        """The next state, the mark that the symbol is scored under, and whether it is piled on another."""
        key = (state, symbol)
        if key not in self.table:
            moves = [m.step(s, symbol) for m, s in zip(self.machines, state, strict=True)]
            marks = frozenset().union(*(m[1] for m in moves))
            self.table[key] = (tuple(m[0] for m in moves), self.emit(symbol, marks), "piled" in marks)
        return self.table[key]

    @staticmethod
    def emit(symbol: int, marks: frozenset[str]) -> str | None:
        """The one mark that a symbol is scored under."""
        if "insult" in marks:
            return "reported" if "reported" in marks else "negated" if "negated" in marks else "aimed" if "aimed" in marks else "plain"
        if symbol == V and "aimed" in marks and not marks & {"reported", "negated"} or "struck" in marks:
            return "threat"
        return None


@dataclass
class Lexicon:
    """Weights of insults by word and by beginning; ``fixed`` has the symbols of the grammar's own words."""

    words: dict[str, float] = field(default_factory=lambda: dict.fromkeys(INSULTS, 2.0))
    prefixes: dict[str, float] = field(default_factory=dict)
    memo: dict[str, tuple[int, float]] = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        self.fixed = {w: s for s, ws in ((V, THREATS), (T, TARGETS), (N, NEGATIONS), (R, REPORTS)) for w in ws} | dict.fromkeys(_STOPS, END)

    def look(self, word: str) -> tuple[int, float]:
        got = self.memo.get(word)
        if got is None:
            weight = max([self.words.get(word, 0.0), *(self.prefixes.get(word[:k], 0.0) for k in PREFIXES if len(word) >= k)])
            got = (I, weight) if weight > 0 else (self.fixed.get(word, O), 0.0)
            if len(self.memo) > 300_000:
                self.memo.clear()
            self.memo[word] = got
        return got


def features(text: str, lexicon: Lexicon, grammar: Grammar) -> list[float]:
    """[1, log(1 + weight) of the clauses of each kind of mark, distinct insults up to 5, share of matched
    clauses, log(1 + score) of the strongest clause].  In a clause, second insults count double."""
    tokens = _TOKEN.findall(text.lower())
    looked = list(map(lexicon.look, tokens))
    sums = dict.fromkeys(MARKS, 0.0)
    tail = [0.0, 0.0, 0.0]
    if any(s == I or s == V for s, _ in looked):
        state, clauses, matched, distinct = grammar.start, 1, 0, set()
        here = strongest = 0.0  # the score of this clause, and of the best one
        for token, (symbol, weight) in zip(tokens, looked, strict=True):
            state, mark, again = grammar.step(state, symbol)
            if mark:
                weight = weight if symbol == I else 2.0
                matched += here == 0
                here += FORCE[mark] * weight * (1 + again)
                sums[mark] += weight
                strongest = max(strongest, here)
                if symbol == I:
                    distinct.add(token)
            elif symbol == END:
                clauses, here = clauses + 1, 0.0
        tail = [min(len(distinct), 5) / 5, matched / clauses, float(np.log1p(strongest))]
    return [1.0, *(float(np.log1p(sums[m])) for m in MARKS), *tail]


def grammar() -> Grammar:
    return Grammar(insult(), negation(), reported(), target(), threat())


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray

    def score(self, rows: list[list[float]]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.array(rows).reshape(-1, len(self.weights)) @ self.weights, -30, 30)))


def held_out(doc_id: Column) -> Column:
    """True for rows that are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _fit(rows: np.ndarray, toxic: np.ndarray, importance: np.ndarray, pull: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton's method, drawn towards ``PRIOR``."""
    w = PRIOR.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        gradient = rows.T @ (importance * (p - toxic)) + pull * (w - PRIOR)
        hessian = (rows * (importance * p * (1 - p))[:, None]).T @ rows + pull * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _sample(docs: DataFrame, labels: DataFrame, sample_most: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, toxic, text) of at most ``sample_most`` labelled rows that may be learned from, and how
    many such labels there are of each class."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    usable = usable.distinct()
    there = {r.toxic: r.n for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64("doc_id", F.lit("sample")), F.col("doc_id")]
    chosen = staged(usable.where("toxic = 1").orderBy(*order).limit(sample_most // 2).unionAll(usable.where("toxic = 0").orderBy(*order).limit(sample_most // 2)), "toxicity-labels")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    found = texts.join(F.broadcast(chosen), "doc_id")  # at most sample_most pairs of numbers are sent
    return staged(found.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "toxicity-sample"), there


def _apart(sample: DataFrame) -> DataFrame:
    """One row of each group of copies: of rows with the same smallest shingle hash, the one of the smallest id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = []
            for _, _, data, offsets in text_slices(batch.column(2)):
                words = Words(data, offsets)
                for i in range(len(offsets) - 1):
                    own = words.hashes[words.doc_from[i] : words.doc_from[i + 1]]
                    k = min(5, len(own))
                    hashes = window_hashes(own, windows(np.array([0, len(own)]), k)[0], k) if k else np.zeros(1, np.uint64)
                    least.append(int(hashes.min().astype(np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.int64())], names=["doc_id", "toxic", "text", "least"])

    marked = sample.select("doc_id", "toxic", "text").mapInArrow(run, "doc_id long, toxic int, text string, least long")
    return marked.groupBy("least", "toxic").agg(F.min_by("text", "doc_id").alias("text"))


def _candidates(apart: DataFrame) -> DataFrame:
    """(term, whole, toxic, n): texts of each class that hold a word or a beginning of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = {w for w in _TOKEN.findall(text.lower()) if w not in _STOPS}
                terms = {(w, True) for w in found} | {(w[:k], False) for w in found for k in PREFIXES if len(w) >= k}
                counts.update((t, whole, toxic) for t, whole in terms)
            keys = list(counts)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), pa.array([k[2] for k in keys], pa.int32()), pa.array([counts[k] for k in keys], pa.int64())], names=["term", "whole", "toxic", "n"])

    return apart.select("toxic", "text").mapInArrow(run, "term string, whole boolean, toxic int, n long").groupBy("term", "whole").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("b"))


def train(docs: DataFrame, labels: DataFrame, sample_most: int = 12_000, lexicon_most: int = 4_000) -> Model:
    """Learn lexicon and weights from labels (doc_id, toxic) of rows that are not held out."""
    sample, there = _sample(docs, labels, sample_most)
    if set(there) != {0, 1}:
        return Model(Lexicon(), PRIOR)
    apart = staged(_apart(sample), "toxicity-apart")
    size = {r.toxic: r.n for r in apart.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if set(size) != {0, 1}:
        return Model(Lexicon(), PRIOR)
    t, c = float(size[1]), float(size[0])
    a, b = F.col("a"), F.col("b")
    ratio = F.log((a + 0.5) / (t + 1)) - F.log((b + 0.5) / (c + 1))
    share = (a + b) / (t + c)
    z = (a / t - b / c) / F.sqrt(share * (1 - share) * (1 / t + 1 / c) + 1e-12)
    counted = staged(_candidates(apart).select("term", "whole", "a", "b", ratio.alias("ratio"), z.alias("z")).where((F.col("a") >= 4) & (F.col("z") >= 5) & (F.col("ratio") >= 1.5) | F.col("term").isin(*INSULTS) & F.col("whole")), "toxicity-lexicon")
    learned = counted.where((F.col("a") >= 4) & (F.col("z") >= 5) & (F.col("ratio") >= 1.5)).orderBy(F.desc("z"), "term", "whole").limit(lexicon_most).collect()
    lexicon = Lexicon()
    for r in counted.where(F.col("term").isin(*INSULTS) & F.col("whole") & (F.col("a") + F.col("b") >= 20) & (F.col("ratio") < 0.5)).collect():
        lexicon.words.pop(r.term, None)  # a built-in word that the labels speak against
    for r in learned:
        (lexicon.words if r.whole else lexicon.prefixes)[r.term] = float(r.ratio)
    rows = _features(sample.select("toxic", "text"), lexicon, "toxic int").collect()
    toxic = np.array([r.toxic for r in rows], float)
    seen = Counter(toxic.tolist())
    importance = np.array([there[int(y)] / seen[y] for y in toxic]) * len(rows) / sum(there.values())
    return Model(lexicon, _fit(np.array([r.features for r in rows]), toxic, importance))


def _features(rows: DataFrame, lexicon: Lexicon, key: str) -> DataFrame:
    """(key, features array<double>) from (key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = grammar()
        for batch in batches:
            found = [features(t, lexicon, own) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], names=[key.split()[0], "features"])

    return rows.mapInArrow(run, f"{key}, features array<double>")


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted, matched) of every row, and nothing shuffled.

    ``matched``: whether any clause matched."""
    lexicon, weights = Lexicon(model.lexicon.words, model.lexicon.prefixes), model.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, scorer = grammar(), Model(lexicon, weights)
        for batch in batches:
            rows = [features(t, lexicon, own) for t in batch.column(1).to_pylist()]
            found = scorer.score(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), pa.array([any(r[1:]) for r in rows], pa.bool_())], names=["doc_id", "score", "matched"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, score double, matched boolean")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "matched")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, all columns as they are."""
    lexicon, weights, at = Lexicon(model.lexicon.words, model.lexicon.prefixes), model.weights, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, scorer = grammar(), Model(lexicon, weights)
        for batch in batches:
            found = scorer.score([features(t or "", lexicon, own) for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array(found < threshold))

    # names that Spark would have to quote stay out of the way
    plain = StructType([StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(docs.schema)])
    return docs.toDF(*plain.names).mapInArrow(run, plain).toDF(*docs.columns)
