"""Property maps (map<string,string>) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .similarity import levenshtein, mean_ratio, word_and_letter

_NO_MAP = "cast(map() AS map<string,string>)"


def common_keys(a: Column, b: Column) -> Column:
    return F.array_intersect(F.map_keys(a), F.map_keys(b))


def merge_over(old: Column, new: Column) -> Column:
    """Shallow: keys of ``new`` win."""
    return F.map_zip_with(F.coalesce(old, F.expr(_NO_MAP)), F.coalesce(new, F.expr(_NO_MAP)), lambda k, o, n: F.coalesce(n, o))


def merge_longer(a: Column, b: Column, factor: float = 1.5) -> Column:
    """The second value where it is over ``factor`` times as long as the first, else the first."""
    return F.map_zip_with(a, b, lambda k, x, y: F.when(x.isNull(), y).when(y.isNotNull() & (F.length(y) > factor * F.length(x)), y).otherwise(x))


def merge_verified(a: Column, b: Column, a_verified: Column, b_verified: Column) -> Column:
    """The verified side's value wins; else the longer; else the second."""
    pick = lambda k, x, y: F.when(x.isNull(), y).when(y.isNull(), x).when(a_verified & ~b_verified, x).when(b_verified & ~a_verified, y).when(F.length(x) > F.length(y), x).otherwise(y)
    return F.map_zip_with(a, b, pick)


def differs(a: Column, b: Column, least: float = 0.7) -> Column:
    """Whether some common key has values less alike than ``least``."""
    return F.exists(common_keys(a, b), lambda k: word_and_letter(a[k], b[k]) < least)


def similarity(a: Column, b: Column) -> Column:
    """Mean likeness over common keys times the share of common keys; both empty: 1, one empty: 0."""
    keys = common_keys(a, b)
    number = lambda v: v.try_cast("double")

    def alike(k: Column) -> Column:
        x, y = number(a[k]), number(b[k])
        near = 1.0 - F.abs(x - y) / F.greatest(F.abs(x), F.abs(y), F.lit(1.0))
        return F.when(x.isNotNull() & y.isNotNull(), near).otherwise(levenshtein(a[k], b[k]))

    share = F.size(keys) / F.size(F.array_union(F.map_keys(a), F.map_keys(b)))
    mean = F.aggregate(F.transform(keys, alike), F.lit(0.0), lambda s, v: s + v) / F.size(keys)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0) | (F.size(keys) == 0), 0.0).otherwise(mean * share)


def mean_likeness(a: Column, b: Column) -> Column:
    """Mean sequence ratio of the values of common keys; both empty: 1; one empty, or nothing in common: 0."""
    a, b = F.coalesce(a, F.expr(_NO_MAP)), F.coalesce(b, F.expr(_NO_MAP))
    keys = F.array_sort(common_keys(a, b))
    values = lambda m: F.transform(keys, lambda k: F.coalesce(m[k], F.lit("None")))
    mean = mean_ratio(values(a), values(b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when(F.size(keys) == 0, 0.0).otherwise(mean)


def prompt_text(text: Column, properties: Column) -> Column:
    """The text followed by ``key: value`` of each property in key order: what an embedding is made of."""
    entries = F.array_sort(F.transform(F.map_entries(properties), lambda e: F.concat(e["key"], F.lit(": "), e["value"])))
    return F.concat_ws(" ", text, F.array_join(entries, " "))


def clean(properties: Column, standard: tuple[str, ...] = ("id", "entity_id", "created_at", "updated_at", "embedding")) -> Column:
    """Without the standard fields."""
    return F.map_filter(properties, lambda k, v: ~k.isin(*standard))
