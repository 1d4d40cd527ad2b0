"""Exact, fuzzy, semantic and hybrid search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.similarity import levenshtein
from ..functions.text import tokens


def exact(entities: DataFrame, text: str, types: tuple[str, ...] = ()) -> DataFrame:
    found = entities.where(F.contains(F.lower("entity_text"), F.lower(F.lit(text))))
    if types:
        found = found.where(F.col("entity_type").isin(*types))
    return found.withColumn("score", F.lit(1.0))


def fuzzy(entities: DataFrame, text: str, above: float = 0.5) -> DataFrame:
    """By edit distance; texts whose length alone rules them out are not compared."""
    n = len(text)
    longest = F.greatest(F.length("entity_text"), F.lit(n), F.lit(1))
    near = entities.where(1.0 - F.abs(F.length("entity_text") - n) / longest > above)
    return near.withColumn("score", levenshtein(F.lower("entity_text"), F.lower(F.lit(text)))).where(F.col("score") > above)


def hashed_vectors(docs: DataFrame, width: int = 64) -> DataFrame:
    """(doc_id, embedding): counts of words by a hash of them, ``width`` wide, unit norm; texts without words have none."""
    words = docs.select("doc_id", F.explode(tokens(F.col("text"))).alias("w"))
    place = F.conv(F.substring(F.md5(F.col("w").cast("binary")), 1, 7), 16, 10).cast("long") % width
    counts = words.groupBy("doc_id", place.cast("int").alias("at")).agg(F.count("*").alias("n"))
    filled = counts.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("at", "n"))).alias("m"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return filled.select("doc_id", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: (F.coalesce(F.col("m")[i], F.lit(0)) / F.col("norm")).cast("float")).alias("embedding"))


#: Query vectors that are sent to the executors at once, and numbers in them (32 MB).
QUERY_ROWS, QUERY_NUMBERS = 65_536, 1 << 22
#: Of those, how many are scored at once against up to 4096 rows (8 MB of scores).
QUERIES_AT_ONCE = 256


def semantic(vectors: DataFrame, queries: DataFrame, least: float = 0.5, k: int | None = None) -> DataFrame:
    """(query_id, vec_id, score): all rows at least that near to each row of ``queries``, by cosine, or the
    ``k`` nearest of them, ties to the smaller id.

    ``queries`` is a stated set of query vectors, counted before it is sent; every row of ``vectors`` is
    compared with it, a batch at a time, by a matrix product.  With ``k`` a batch keeps its own best, so what
    is shuffled is bounded by the batches.  More queries go in several parts, by a hash of their ids."""
    asked = queries.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("q")).where("q IS NOT NULL")
    n, numbers = asked.agg(F.count("*"), F.coalesce(F.sum(F.size("q")), F.lit(0))).first()
    n_parts = max(1, -(-n // QUERY_ROWS), -(-numbers // QUERY_NUMBERS))
    part = F.pmod(F.xxhash64("vec_id"), F.lit(n_parts))
    found = None
    for i in range(n_parts):
        near = _near(vectors, asked.where(part == i) if n_parts > 1 else asked, least, k)
        found = near if found is None else found.unionAll(near)
    if k is None:
        return found
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).drop("place")


def _near(vectors: DataFrame, asked: DataFrame, least: float, k: int | None) -> DataFrame:
    rows = asked.toArrow()
    ids = rows.column("vec_id").to_numpy()
    by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    values = [np.asarray(v, float) for v in rows.column("q").to_pylist()]
    for size in {len(v) for v in values}:
        mine = [j for j, v in enumerate(values) if len(v) == size]
        by_size[size] = (ids[mine], np.array([values[j] for j in mine]).reshape(len(mine), size))
    sent = vectors.sparkSession.sparkContext.broadcast(by_size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own_ids, lists = batch.column(0).to_numpy(), batch.column(1)
            sizes = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
            for size, (query_ids, q) in sent.value.items():
                at = np.flatnonzero(sizes == size)
                if not len(at) or not size:
                    continue
                v = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(at), size)
                for lo in range(0, len(at), 4096):
                    for first in range(0, len(q), QUERIES_AT_ONCE):
                        part = slice(first, first + QUERIES_AT_ONCE)
                        yield _scored(own_ids[at[lo : lo + 4096]], v[lo : lo + 4096], query_ids[part], q[part])

    def _scored(own: np.ndarray, v: np.ndarray, query_ids: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
        nv, nq = np.linalg.norm(v, axis=1), np.linalg.norm(q, axis=1)
        score = q @ v.T
        score /= np.maximum(nq, 1e-300)[:, None] * np.maximum(nv, 1e-300)[None]
        score[(nq < 1e-8)[:, None] | (nv < 1e-8)[None]] = 0.0
        keep = (score >= least) & (query_ids[:, None] != own[None])
        if k is not None and len(own) > k:
            # the k-th best of the batch bounds what it sends; all at that score go along
            kth = -np.partition(np.where(keep, -score, np.inf), k - 1, axis=1)[:, k - 1 : k]
            keep &= score >= kth
        i, j = np.nonzero(keep)
        return pa.RecordBatch.from_arrays([pa.array(query_ids[i]), pa.array(own[j]), pa.array(score[i, j])], names=["query_id", "vec_id", "score"])

    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id IS NOT NULL").mapInArrow(run, "query_id long, vec_id long, score double")


def top(scored: DataFrame, k: int, key: str, score: str = "score") -> DataFrame:
    return scored.orderBy(F.desc(score), key).limit(k)


def hybrid(exact_hits: DataFrame, semantic_hits: DataFrame, weight: float = 0.7) -> DataFrame:
    """(id, score): in both, weight x 1 + the rest x semantic; else the one there is."""
    both = exact_hits.select("id", F.lit(1.0).alias("e"), F.lit(None).cast("double").alias("s")).unionAll(semantic_hits.select("id", F.lit(None).cast("double"), F.col("score")))
    merged = both.groupBy("id").agg(F.max("e").alias("e"), F.max("s").alias("s"))
    score = F.when(F.col("e").isNotNull() & F.col("s").isNotNull(), weight * F.col("e") + (1 - weight) * F.col("s")).otherwise(F.coalesce("e", "s"))
    return merged.select("id", score.alias("score"))
