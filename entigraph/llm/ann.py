"""Approximate nearest neighbours by an adaptive dimension scan.

Equal vectors are one: of their ids only the k + 1 smallest can be among anybody's k nearest, so no others
are indexed, and they are one query, whose answer each of them takes without its own id.

Vectors are dealt to lists by their nearest centroid, and lists are packed into bins of at most ``bin_most`` vectors and ``bin_bytes`` (a
large list fills several bins).  A query goes once to each bin that holds a list it probes; a bin is
copied only for every ``query_block`` queries that come to it, so copies keep pace with work.  There, vectors are rotated by a fixed random rotation and held in column blocks; after
each block a hypothesis test compares the partial distance, scaled to all dimensions, with the query's
bound, and candidates that fail it are abandoned.  What survives is measured exactly, on the original
vectors in double precision.

Only fitting is done on a sample, of at most ``sample_most`` distinct vectors and ``sample_bytes`` drawn by hash (16 for each of
as many lists as the square root of their number, 16 384 at least): the centroids, in two levels, the number of lists to probe (the least that finds ``recall`` of the sample's neighbours), and
each query's first bound, the distance of its k-th neighbour in the sample.

Cases: vectors that are null, empty, all zero or hold a null or non-finite component take no part, nor do
rows with a null vec_id or vectors of another length than the most frequent one (ties: the longer);
vec_id is the key, so of repeated rows one is kept, the least vector; a query's own id is no candidate;
with fewer than k candidates all are returned; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged

_SEED = 20240131


def usable(vector: str = "embedding") -> Column:
    return F.expr(f"size({vector}) > 0 AND forall({vector}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists({vector}, x -> x <> 0)")


def vectors(rows: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, v array<double>) of the rows that take part, one per vec_id, and their dimension."""
    fit = rows.where(usable() & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
    size = fit.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    dim = size.d if size else 1
    return fit.where(F.size("v") == dim).groupBy("vec_id").agg(F.min("v").alias("v")), dim


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` to all of ``b``, by way of products: near, not exact."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


#: Bytes of a matrix of distances that are held at once.
_HELD = 16 << 20


def nearest_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The row of ``b`` that is nearest to each row of ``a``, some rows at a time."""
    step = max(1, _HELD // (8 * max(len(b), 1)))
    return np.concatenate([squared(a[lo : lo + step], b).argmin(axis=1) for lo in range(0, len(a), step)] or [np.zeros(0, np.int64)])


def exact(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return np.sqrt(((rows - query) ** 2).sum(axis=1))


@dataclass
class Fit:
    """What is learned from the sample."""

    dim: int
    rotation: np.ndarray
    centroids: np.ndarray
    probes: int
    sample_ids: np.ndarray
    sample: np.ndarray


def k_means(points: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    rng = np.random.default_rng(_SEED)
    centroids = points[rng.choice(len(points), k, replace=False)].copy()
    for _ in range(rounds):
        nearest = nearest_of(points, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, points)
        counts = np.bincount(nearest, minlength=k)
        full = counts > 0
        centroids[full] = sums[full] / counts[full, None]
    return centroids


def two_level(points: np.ndarray, n_lists: int) -> np.ndarray:
    """About ``n_lists`` centroids: of coarse clusters, and within each by its share of the points."""
    coarse = k_means(points, max(1, int(n_lists**0.5)))
    if len(coarse) < 16:
        return k_means(points, n_lists)
    owner = nearest_of(points, coarse)
    parts = [points[owner == c] for c in range(len(coarse))]
    return np.concatenate([k_means(p, max(1, min(len(p), round(n_lists * len(p) / len(points))))) for p in parts if len(p)])


def fit(rows: DataFrame, dim: int, n_rows: int, k: int, recall: float, sample_most: int, sample_bytes: int) -> Fit:
    wanted = int(max(1, min(max(16 * n_rows**0.5, 16_384), sample_most, sample_bytes // (8 * dim))))
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(wanted).toArrow()
    ids = drawn.column("vec_id").to_numpy()
    sample = matrix(drawn.column("v").combine_chunks(), dim).astype(np.float64)
    n_lists = int(max(1, min(n_rows**0.5, len(sample) / 16)))
    centroids = two_level(sample, n_lists)
    n_lists, apart = len(centroids), sample
    rotation = np.linalg.qr(np.random.default_rng(_SEED).standard_normal((dim, dim)))[0]
    # the rank of the list that holds each neighbour, over sample queries
    owner = nearest_of(apart, centroids)
    asked = np.random.default_rng(_SEED + 1).permutation(len(apart))[:256]
    near = np.empty((len(asked), min(k, max(len(apart) - 1, 1))), np.int64)
    for j, own in enumerate(asked):
        distances = squared(apart[own : own + 1], apart)[0]
        distances[own] = np.inf
        near[j] = np.argsort(distances, kind="stable")[: near.shape[1]]
    rank = np.argsort(np.argsort(squared(apart[asked], centroids), axis=1), axis=1)
    needed = np.sort(np.take_along_axis(rank, owner[near], axis=1).ravel())
    probes = int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1
    return Fit(dim, rotation, centroids, min(probes, n_lists), ids, sample)


def abandon(rotated: np.ndarray, query: np.ndarray, alive: np.ndarray, bound: float, block: int, doubt: float) -> np.ndarray:
    """Of the rows ``alive``, those that may be nearer than ``bound``.

    After d of D dimensions, D / d times the partial squared distance estimates the whole; a row goes if
    the estimate is above the bound by more than chance allows, doubt / sqrt(d) standard units."""
    dim = rotated.shape[1]
    partial = np.zeros(len(alive))
    limit = bound * bound
    for lo in range(0, dim, block):
        hi = min(lo + block, dim)
        step = rotated[alive, lo:hi] - query[lo:hi]
        partial = partial + np.einsum("ij,ij->i", step, step)
        most = limit if hi == dim else limit * (hi / dim) * (1 + doubt / np.sqrt(hi)) ** 2
        keep = partial <= most
        alive, partial = alive[keep], partial[keep]
        if not len(alive):
            break
    return alive


def nearest(rows: DataFrame, queries: Column, k: int = 10, recall: float = 0.97, sample_most: int = 65_536, sample_bytes: int = 64 << 20, bin_least: int = 2_048, bin_most: int = 65_536, bin_bytes: int = 64 << 20, query_block: int = 8_192, block: int = 16, doubt: float = 2.1) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row that ``queries`` (a condition on
    vec_id) selects, by Euclidean distance, ties to the smaller vec_id."""
    found, dim = vectors(rows)
    # the smallest ids of each vector; 0.0 and -0.0 are one
    same = Window.partitionBy(F.xxhash64("v"), "v").orderBy("vec_id")
    every_row = staged(found.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))), "ann-rows")
    ids = staged(every_row.withColumn("place", F.row_number().over(same)).where(F.col("place") <= k + 1), "ann-ids")
    table = staged(ids.where("place = 1").select("vec_id", "v"), "ann-vectors")
    n_rows = table.count()
    if not n_rows:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # one query for each vector that is asked for, told by the smallest id of that vector
    names = table.select(F.col("vec_id").alias("name"), F.xxhash64("v").alias("_h"), F.col("v").alias("_v"))
    asking = every_row.where(queries).withColumn("h", F.xxhash64("v"))
    asking = staged(asking.join(names, (F.col("h") == F.col("_h")) & (F.col("v") == F.col("_v"))).select("vec_id", "name"), "ann-asking")
    wanted = staged(table.join(asking.select(F.col("name").alias("vec_id")).distinct(), "vec_id"), "ann-wanted")
    learned = fit(table, dim, n_rows, k, recall, sample_most, sample_bytes)
    shared = table.sparkSession.sparkContext.broadcast(learned)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = shared.value.centroids
        for batch in batches:
            lists = nearest_of(matrix(batch.column(1), dim), centroids).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists)], names=["vec_id", "v", "list"])

    index = staged(table.mapInArrow(assign, "vec_id long, v array<double>, list int"), "ann-index")
    sizes = np.zeros(len(learned.centroids), np.int64)
    for r in index.groupBy("list").agg(F.count("*").alias("n")).collect():  # a row per list, sample_most / 16 at most
        sizes[r.list] = r.n
    bin_rows = int(max(1, min(max(n_rows / 200, bin_least), bin_most, bin_bytes // (8 * dim))))
    first_bin, n_bins = pack(sizes, bin_rows)
    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            ids, q = batch.column(0).to_numpy(), matrix(batch.column(1), dim)
            step = max(1, _HELD // (8 * len(own.sample)))
            for lo in range(0, len(ids), step):
                rank = np.argsort(squared(q[lo : lo + step], own.centroids), axis=1, kind="stable")
                close = squared(q[lo : lo + step], own.sample)
                rows: list[tuple] = []
                for j, order in enumerate(rank):
                    qid, vector = int(ids[lo + j]), q[lo + j]
                    others = np.flatnonzero(own.sample_ids != qid)
                    some = others[np.argpartition(close[j][others], min(k + 4, len(others) - 1))[: k + 5]] if len(others) > k + 5 else others
                    d = exact(vector, own.sample[some])
                    top = np.lexsort((own.sample_ids[some], d))[:k]
                    rows += [(None, qid, None, None, int(own.sample_ids[some[t]]), float(d[t])) for t in top]
                    bound = float(d[top[-1]]) if len(top) == k else float("inf")
                    enough = int(np.searchsorted(np.cumsum(sizes[order]), k + 1)) + 1
                    probed = order[: max(own.probes, enough)]
                    where: dict[int, list[int]] = {}
                    for x in probed[sizes[probed] > 0].tolist():
                        for b in range(int(first_bin[x]), int(first_bin[x] + n_bins[x])):
                            where.setdefault(b, []).append(x)
                    rows += [(b, qid, vector, lists, None, bound) for b, lists in where.items()]
                kinds = (pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int32()), pa.int64(), pa.float64())
                names = ["bin", "query_id", "q", "lists", "vec_id", "score"]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], names=names)

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        if left.num_rows and right.num_rows:
            rows = matrix(left.column("v").combine_chunks(), dim)
            ids, lists = left.column("vec_id").to_numpy(), left.column("list").to_numpy()
            by_list = np.argsort(lists, kind="stable")
            rows, ids, lists = rows[by_list], ids[by_list], lists[by_list]
            rotated = rows @ shared.value.rotation
            for r in right.select(["query_id", "q", "lists", "score"]).to_pylist():
                begin, end = np.searchsorted(lists, r["lists"], "left"), np.searchsorted(lists, r["lists"], "right")
                alive = np.concatenate([np.arange(a, b) for a, b in zip(begin, end, strict=True)])
                alive = alive[ids[alive] != r["query_id"]]
                q = np.array(r["q"])
                turned = q @ shared.value.rotation
                bound = r["score"]
                if not np.isfinite(bound) and len(alive) > k:  # no bound yet: k rows give one
                    bound = float(np.sort(exact(q, rows[alive[: 4 * k]]))[k - 1])
                # rotation rounds: equal vectors may come out a little apart
                alive = abandon(rotated, turned, alive, bound + 1e-9 * (bound + float(np.linalg.norm(q))), block, doubt)
                d = exact(q, rows[alive])
                for t in np.lexsort((ids[alive], d))[:k]:
                    out.append((r["query_id"], int(ids[alive[t]]), float(d[t])))
        return pa.table({"query_id": pa.array([o[0] for o in out], pa.int64()), "vec_id": pa.array([o[1] for o in out], pa.int64()), "score": pa.array([o[2] for o in out], pa.float64())})

    sent = staged(wanted.mapInArrow(asked, "bin int, query_id long, q array<double>, lists array<int>, vec_id long, score double"), "ann-queries")
    first = sent.where("bin IS NULL").select("query_id", "vec_id", "score")
    visits = sent.where("bin IS NOT NULL")
    copies = np.ones(int((first_bin + n_bins).max()), np.int64)
    counts = staged(visits.groupBy("bin").agg(F.ceil(F.count("*") / query_block).cast("long").alias("copies")), "ann-copies")
    for r in counts.where("copies > 1").collect():  # a row per bin
        copies[r.bin] = r.copies

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, ids = batch.column(2).to_numpy(), batch.column(0).to_numpy()
            bins = first_bin[lists] + _spread(ids) % n_bins[lists]
            for b in range(int(copies[bins].max(initial=0))):
                rows = np.flatnonzero(copies[bins] > b)
                own = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array(bins[rows].astype(np.int32)), pa.array(np.full(len(rows), b, np.int32)), *own.columns], names=["bin", "part", "vec_id", "v", "list"])

    there = index.mapInArrow(binned, "bin int, part int, vec_id long, v array<double>, list int")
    dealt = visits.join(counts, "bin").withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("copies")).cast("int")).drop("copies")
    scanned = there.groupBy("bin", "part").cogroup(dealt.groupBy("bin", "part")).applyInArrow(scan, "query_id long, vec_id long, score double")
    near = first.unionAll(scanned).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    best = Window.partitionBy("name").orderBy("score", "near_id")
    near = near.select(F.col("query_id").alias("name"), F.col("vec_id").alias("near_id"), "score")
    near = near.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).drop("place")
    # back to rows: the query's own vector at distance 0, each vector by its smallest ids, and no row its own neighbour
    itself = wanted.select(F.col("vec_id").alias("name"), F.col("vec_id").alias("near_id"), F.lit(0.0).alias("score"))
    members = ids.select(F.xxhash64("v").alias("h"), F.col("v").alias("mv"), "vec_id")
    groups = staged(members.join(names, (F.col("h") == F.col("_h")) & (F.col("mv") == F.col("_v"))).select(F.col("name").alias("near_id"), "vec_id"), "ann-members")
    full = near.unionAll(itself).join(groups, "near_id").select("name", "vec_id", "score")
    most = Window.partitionBy("name").orderBy("score", "vec_id")
    short = full.withColumn("place", F.row_number().over(most)).where(F.col("place") <= k + 1).drop("place")
    answers = asking.select(F.col("vec_id").alias("query_id"), "name").join(short, "name").where("query_id <> vec_id")
    rank = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return answers.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _spread(ids: np.ndarray) -> np.ndarray:
    """A non-negative hash of ids."""
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ (h >> np.uint64(29))) >> np.uint64(1)).astype(np.int64)


def pack(sizes: np.ndarray, bin_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """For each list its first bin and number of bins: small lists share a bin, large ones take several."""
    first, n = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
    at, room = -1, 0
    for i, size in enumerate(sizes.tolist()):
        if size > bin_rows:
            n[i] = -(-size // bin_rows)
            first[i] = at + 1
            at, room = at + int(n[i]), 0
        else:
            if size > room:
                at, room = at + 1, bin_rows
            first[i] = max(at, 0)
            room -= size
    return first, n
