"""Similarities.  What SQL can say is a Column expression; the rest is an Arrow-batched pandas UDF."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .text import normalize, tokens


def null_rule(a: Column, b: Column, score: Column) -> Column:
    """Both null: 1; one null: 0."""
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(score)


def exact(a: Column, b: Column) -> Column:
    return (F.lower(a) == F.lower(b)).cast("double")


def levenshtein(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / longest)


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0).cast("double"), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, least_norm: float = 1e-8) -> Column:
    na, nb = norm(a), norm(b)
    return F.when((na < least_norm) | (nb < least_norm), 0.0).otherwise(dot(a, b) / (na * nb))


def _gap(a: Column, b: Column, whole: Column, distance: Column) -> Column:
    return F.when(whole == 0, 1.0).otherwise(1.0 - distance / whole)


def euclidean(a: Column, b: Column) -> Column:
    d = F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))
    return _gap(a, b, norm(a) + norm(b), d)


def manhattan(a: Column, b: Column) -> Column:
    size = lambda v: _sum(F.transform(v, lambda x: F.abs(x.cast("double"))))
    return _gap(a, b, size(a) + size(b), _sum(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))))


def _sets(a: Column, b: Column) -> tuple[Column, Column, Column, Column]:
    a, b = F.array_distinct(a), F.array_distinct(b)
    return F.size(a), F.size(b), F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))


def jaccard(a: Column, b: Column) -> Column:
    _, _, both, either = _sets(a, b)
    return F.when(either == 0, 0.0).otherwise(both / either)


def dice(a: Column, b: Column) -> Column:
    na, nb, both, _ = _sets(a, b)
    return F.when(na + nb == 0, 0.0).otherwise(2.0 * both / (na + nb))


def overlap(a: Column, b: Column) -> Column:
    na, nb, both, _ = _sets(a, b)
    return F.when(F.least(na, nb) == 0, 0.0).otherwise(both / F.least(na, nb))


def word_and_letter(a: Column, b: Column) -> Column:
    """Mean of the Jaccard indices of words and of characters; equal: 1, an empty side: 0."""
    a, b = F.lower(a), F.lower(b)
    both = (jaccard(F.split(a, " "), F.split(b, " ")) + jaccard(F.split(a, ""), F.split(b, ""))) / 2
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(both)


def severity(score: Column) -> Column:
    return F.when(score >= 0.95, "critical").when(score >= 0.9, "high").when(score >= 0.8, "medium").otherwise("low")


def rescale(x: Column, low: float, high: float, to_low: float, to_high: float) -> Column:
    """Linear, clamped; the middle of the target if the source has no width."""
    if high == low:
        return F.lit((to_low + to_high) / 2)
    return F.greatest(F.lit(to_low), F.least(F.lit(to_high), to_low + (x - low) / (high - low) * (to_high - to_low)))


# -- beyond SQL ------------------------------------------------------------------------------


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of the standard library; the order of the arguments matters."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


@F.pandas_udf(DoubleType())
def mean_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Mean sequence ratio of the texts that stand opposite each other in two lists; 0 for empty lists."""

    def mean(xs: list[str], ys: list[str]) -> float:
        ratios = [1.0 if x == y else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(xs, ys, strict=True)]
        return sum(ratios) / len(ratios) if ratios else 0.0

    return pd.Series([mean(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


def _jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    used = [False] * len(b)
    left = []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                left.append(x)
                break
    right = [y for y, u in zip(b, used, strict=True) if u]
    m = len(left)
    if not m:
        return 0.0
    swapped = sum(x != y for x, y in zip(left, right, strict=True)) // 2
    return (m / len(a) + m / len(b) + (m - swapped) / m) / 3


def jaro_winkler_of(a: str, b: str, scale: float = 0.1) -> float:
    """No boost for a common beginning below 0.7."""
    score = _jaro(a, b)
    if score < 0.7:
        return score
    same = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        same += 1
    return score + same * scale * (1 - score)


@F.pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaro_winkler_of(x or "", y or "") for x, y in zip(a, b, strict=True)])


#: Letters of each digit.
SOUNDS = {"1": "BFPV", "2": "CGJKQSXZ", "3": "DT", "4": "L", "5": "MN", "6": "R"}


def _letters(word: Column) -> Column:
    return F.regexp_replace(F.upper(word), "[^A-Z]", "")


def sound_code(word: Column, length: int = 4) -> Column:
    """First letter, then the digits of the others, each only if it differs from the last one; zeros up to
    ``length``.  Letters without a digit do not come between equal digits; no letter at all: zeros."""
    w = _letters(word)
    spelled = "".join(SOUNDS.values())
    digits = F.translate(F.substring(w, 2, 1_000_000), spelled + "AEIOUHWY", "".join(d * len(x) for d, x in SOUNDS.items()))
    return F.rpad(F.concat(F.substring(w, 1, 1), F.regexp_replace(digits, r"(\d)\1+", "$1")), length, "0")


def metaphone(word: Column) -> Column:
    """Simple phonetic spelling by fixed rules: PH F, SH X, TH 0, C before E, I or Y S and else K, H only at the
    start or after a vowel, vowels only at the start, X KS; doubled sounds stay.

    What is done is in lower case, so that no rule meets the result of another."""
    w = _letters(word)
    for pair, sound in (("PH", "f"), ("SH", "x"), ("TH", "0")):
        w = F.replace(w, F.lit(pair), F.lit(sound))
    w = F.replace(F.regexp_replace(w, "C(?=[EIY])", "s"), F.lit("C"), F.lit("k"))
    w = F.regexp_replace(F.regexp_replace(w, "(^|(?<=[AEIOU]))H", "h"), "H", "")
    w = F.concat(F.substring(w, 1, 1), F.translate(F.substring(w, 2, 1_000_000), "AEIOU", ""))
    return F.upper(F.translate(F.replace(w, F.lit("X"), F.lit("ks")), "DGQVZ", "tkkfs"))


def hybrid(a: Column, b: Column) -> Column:
    """0.4 sequence ratio and 0.3 Jaro-Winkler of the texts, 0.3 Jaccard of their normalized words."""
    return 0.4 * sequence_ratio(a, b) + 0.3 * jaro_winkler(a, b) + 0.3 * jaccard(tokens(a), tokens(b))


METHODS = {"exact": exact, "levenshtein": levenshtein, "fuzzy": sequence_ratio, "jaro_winkler": jaro_winkler, "jaccard": lambda a, b: jaccard(tokens(a), tokens(b)), "dice": lambda a, b: dice(tokens(a), tokens(b)), "overlap": lambda a, b: overlap(tokens(a), tokens(b)), "hybrid": hybrid, "soundex": lambda a, b: (sound_code(a) == sound_code(b)).cast("double"), "metaphone": lambda a, b: (metaphone(a) == metaphone(b)).cast("double")}


def text_similarity(a: Column, b: Column, method: str = "hybrid", normalized: bool = True) -> Column:
    """Dispatch by name, with the rule for nulls."""
    if method not in METHODS:
        raise ValueError(f"unknown similarity {method!r}; known: {sorted(METHODS)}")
    x, y = (normalize(a), normalize(b)) if normalized and method not in ("jaccard", "dice", "overlap", "hybrid") else (a, b)
    return null_rule(a, b, METHODS[method](x, y))


def entity_similarity(text_score: Column, same_type: Column, property_score: Column, semantic: Column | None = None) -> Column:
    """0.4 text, 0.2 type, 0.3 properties, 0.1 semantic (the text score where there is none)."""
    last = F.coalesce(semantic, text_score) if semantic is not None else text_score
    return 0.4 * text_score + 0.2 * same_type.cast("double") + 0.3 * property_score + 0.1 * last
