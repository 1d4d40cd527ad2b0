"""Centroid clustering: Lloyd's rounds by two trees.

Vectors are cut into chunks, in whatever partitions they come, and each chunk gets a cover tree: a node's
children stand further apart than a share of its radius, and all its points lie within that of a child.  Chunks and
trees are written once.  In each round the current centroids get a cover tree as well, and in every chunk
pairs of nodes, one from either tree, are followed from the roots down, all pairs of a level at once.  A pair
goes no further when the triangle inequality says that no point of the one can have its nearest centroid in
the other; a node left with one centroid is assigned whole, by the sums it keeps; what is left at the leaves is
compared exactly, in whole numbers.  A task returns a sum a centroid and dimension, so a round shuffles and
collects a few numbers a task, whatever the number or the skew of the vectors.

Equal vectors of a chunk are one point with a weight.  Components become floor(``scale`` * x); sums are
divided to the floor, ties go to the smaller centroid, and a centroid without vectors stays.  Centroids
start as the ``k`` vectors with the smallest sha256 of ``<salt>:<vec_id>``.

Held by the driver and by each task: the centroids, k times ``dim`` numbers; checked to be at most
``centroids_most`` bytes.

Cases: vectors that are null, of another length than ``dim``, or that hold a null or a component that is not
finite take no part; floor(scale * x) beyond 2**25 is an error, as squared distances have to fit 64 bits; each
row is a vector of its own, repeated ids and repeated rows alike, and a null id is returned like others, but is no start unless
fewer than k others are there (then by the components in order, as for equal ids); with fewer than k vectors there are as many centroids; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Components beyond this could bring squared distances over 64 bits.
COMPONENT_MOST = 1 << 25
_CHUNK = 1024
_LEAF = 12
#: Children reach this share of their parent's radius.
_SHRINK = 0.8
_PAIRS = 1 << 14
_CHUNKS = "ids array<bigint>, point array<int>, points binary, nodes binary"
#: A node of a cover tree: its central point, where its children stand (``n`` = 0: none), its points (a run of
#: the tree's order), and how far they are from the centre at most.
_NODE = np.dtype([("center", np.int32), ("first", np.int32), ("n", np.int32), ("lo", np.int32), ("hi", np.int32), ("radius", np.float64)])


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows that stand opposite each other."""
    out = np.empty(len(a), np.int64)
    for lo in range(0, len(a), _PAIRS):
        d = a[lo : lo + _PAIRS].astype(np.int64) - b[lo : lo + _PAIRS]
        out[lo : lo + _PAIRS] = np.einsum("ij,ij->i", d, d)
    return out


def cover_tree(points: np.ndarray, leaf: int = _LEAF, fan: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, order): the root is node 0, and node i holds the points ``order[lo:hi]``.

    Children are chosen farthest first until each point of the node is within ``_SHRINK`` times the node's
    radius of one.  A node of at most ``leaf`` points has none, nor one whose children would be more than the
    share ``fan`` of its points."""
    x = points.astype(np.float64)
    size = (x * x).sum(1)
    order = np.arange(len(points))
    nodes = [(0, 0, 0, 0, len(points), _radius(points, 0, order))]
    at = 0
    while at < len(nodes):
        center, _, _, lo, hi, radius = nodes[at]
        members = order[lo:hi]
        if len(members) > leaf and radius > 0:
            heads, near = [center], np.maximum(size[members] + size[center] - 2 * x[members] @ x[center], 0)
            owner = np.zeros(len(members), np.int64)
            while len(heads) <= len(members) * fan:
                far = int(np.argmax(near))
                if near[far] <= (_SHRINK * radius) ** 2:
                    break
                head = members[far]
                d = np.maximum(size[members] + size[head] - 2 * x[members] @ x[head], 0)
                d[far] = 0  # a head is its own, also where products are rounded
                closer = d < near
                owner[closer], near[closer] = len(heads), d[closer]
                heads.append(head)
            if 1 < len(heads) <= len(members) * fan:
                by_owner = np.argsort(owner, kind="stable")
                order[lo:hi] = members[by_owner]
                ends = lo + np.searchsorted(owner[by_owner], np.arange(len(heads) + 1))
                nodes[at] = (center, len(nodes), len(heads), lo, hi, radius)
                nodes += [(h, 0, 0, int(a), int(b), _radius(points, h, order[a:b])) for h, a, b in zip(heads, ends[:-1], ends[1:], strict=True)]
        at += 1
    return np.array(nodes, _NODE), order


def _radius(points: np.ndarray, center: int, members: np.ndarray) -> float:
    d = squared(points[members], np.broadcast_to(points[center], (len(members), points.shape[1])))
    return float(np.sqrt(d.max(initial=0)))


def spread(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``first``, first + 0 .. n - 1) for each."""
    who = np.repeat(np.arange(len(n)), n)
    return who, first[who] + np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)


class Centroids:
    def __init__(self, centroids: np.ndarray):
        self.vectors = centroids
        self.nodes, self.order = cover_tree(centroids, leaf=1, fan=1.0)


def dual_assign(points: np.ndarray, nodes: np.ndarray, centroids: Centroids) -> tuple[np.ndarray, np.ndarray]:
    """(whole, single): per node the centroid that all its points take, -1 where it isn't settled whole, and per
    point (in the tree's order) that of the points settled at leaves, else -1."""
    ctree, vectors, corder = centroids.nodes, centroids.vectors, centroids.order
    whole, single = np.full(len(nodes), -1), np.full(len(points), -1)
    a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)
    bound = np.full(len(nodes), np.inf)
    while len(a):
        d = np.sqrt(squared(points[nodes["center"][a]], vectors[ctree["center"][b]]).astype(np.float64))
        ra, rb = nodes["radius"][a], ctree["radius"][b]
        np.minimum.at(bound, a, d + ra)
        slack = 1e-9 * (d + ra + rb) + 1e-6
        near = d - ra - rb - slack <= bound[a]
        a, b = a[near], b[near]
        choices = np.bincount(a, ctree["hi"][b] - ctree["lo"][b], len(nodes)).astype(np.int64)
        alone = choices[a] == 1
        whole[a[alone]] = corder[ctree["lo"][b[alone]]]
        a, b = a[~alone], b[~alone]
        inner_a, inner_b = nodes["n"][a] > 0, ctree["n"][b] > 0
        ends = ~inner_a & ~np.isin(a, a[inner_b])  # all that is left for a leaf are leaves
        if ends.any():
            _settle(points, nodes, centroids, a[ends], b[ends], single)
        a, b, inner_a, inner_b = a[~ends], b[~ends], inner_a[~ends], inner_b[~ends]
        # one step down on both sides, where there is one
        who, b = spread(np.where(inner_b, ctree["first"][b], b), np.where(inner_b, ctree["n"][b], 1))
        a, inner_a = a[who], inner_a[who]
        who, down = spread(np.where(inner_a, nodes["first"][a], a), np.where(inner_a, nodes["n"][a], 1))
        up = a[who]
        bound[down] = np.minimum(bound[down], bound[up])
        a, b = down, b[who]
    return whole, single


def _settle(points: np.ndarray, nodes: np.ndarray, centroids: Centroids, a: np.ndarray, b: np.ndarray, single: np.ndarray) -> None:
    """Compare the points of leaves with the centroids left for them."""
    who, place = spread(centroids.nodes["lo"][b], centroids.nodes["hi"][b] - centroids.nodes["lo"][b])
    a, c = a[who], centroids.order[place]
    who, p = spread(nodes["lo"][a].astype(np.int64), nodes["hi"][a] - nodes["lo"][a])
    c = c[who]
    best = np.lexsort((c, squared(points[p], centroids.vectors[c]), p))
    p, c = p[best], c[best]
    first = np.ones(len(p), bool)
    first[1:] = p[1:] != p[:-1]
    single[p[first]] = c[first]


def assigned(points: np.ndarray, nodes: np.ndarray, centroids: Centroids) -> np.ndarray:
    """The centroid of each point, points in the tree's order."""
    whole, out = dual_assign(points, nodes, centroids)
    for i in np.flatnonzero(whole >= 0):
        out[nodes["lo"][i] : nodes["hi"][i]] = whole[i]
    return out


def whole_vectors(rows: DataFrame, dim: int, scale: int) -> DataFrame:
    """(vec_id, v array<int>) of the rows that take part."""
    fit = F.expr(f"size(embedding) = {dim} AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))")
    whole = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(x * scale))
    most = F.expr(f"exists(v, x -> abs(x) > {COMPONENT_MOST})")
    kept = rows.where(fit).select(F.col("vec_id").cast("long"), whole.alias("v"))
    return kept.select("vec_id", F.when(most, F.raise_error(F.lit("a component is too large to be squared in 64 bits"))).otherwise(F.col("v")).cast("array<int>").alias("v"))


def chunks(vectors: DataFrame, dim: int) -> DataFrame:
    """A row per chunk of vectors: ids, the point each is, and the points with their cover tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, _CHUNK):
                piece = batch.slice(lo, _CHUNK)
                values = piece.column(1).flatten().to_numpy().reshape(-1, dim)
                points, point = np.unique(values, axis=0, return_inverse=True)
                nodes, order = cover_tree(points)
                place = np.empty(len(order), np.int32)
                place[order] = np.arange(len(order))
                nodes["center"] = place[nodes["center"]]
                yield pa.RecordBatch.from_arrays([pa.array([piece.column(0)], pa.list_(pa.int64())), pa.array([place[point.reshape(-1)]], pa.list_(pa.int32())), pa.array([points[order].tobytes()], pa.binary()), pa.array([nodes.tobytes()], pa.binary())], names=["ids", "point", "points", "nodes"])

    return vectors.mapInArrow(run, _CHUNKS)


def _read(batch: pa.RecordBatch, dim: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    for i in range(batch.num_rows):
        points = np.frombuffer(batch.column("points")[i].as_py(), np.int32).reshape(-1, dim)
        yield batch.column("ids")[i].values, batch.column("point")[i].values.to_numpy(), points, np.frombuffer(batch.column("nodes")[i].as_py(), _NODE)


def _moved(grown: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, sums = Centroids(centroids), np.zeros((k, dim + 1), np.int64)
        for batch in batches:
            for _, point, points, nodes in _read(batch, dim):
                weight = np.bincount(point, minlength=len(points))
                weighted = np.concatenate([points * weight[:, None], weight[:, None]], axis=1)
                whole, single = dual_assign(points, nodes, tree)
                below = np.concatenate([np.zeros((1, dim + 1), np.int64), np.cumsum(weighted, axis=0)])
                done = np.flatnonzero(whole >= 0)
                np.add.at(sums, whole[done], below[nodes["hi"][done]] - below[nodes["lo"][done]])
                left = np.flatnonzero(single >= 0)
                np.add.at(sums, single[left], weighted[left])
        cluster, part = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(cluster.astype(np.int32)), pa.array(part.astype(np.int32)), pa.array(sums[cluster, part])], names=["cluster", "part", "s"])

    total = [[0] * (dim + 1) for _ in range(k)]
    sums = grown.select("ids", "point", "points", "nodes").mapInArrow(run, "cluster int, part int, s long")
    for r in sums.groupBy("cluster", "part").agg(F.sum(F.col("s").cast("decimal(20,0)")).alias("s")).collect():
        total[r.cluster][r.part] = int(r.s)
    return np.array([[s // row[dim] for s in row[:dim]] if row[dim] else old.tolist() for row, old in zip(total, centroids, strict=True)], np.int64)


def clusters(rows: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, salt: str = "1", centroids_most: int = 64 << 20) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for every vector that takes part."""
    if k * dim * 8 > centroids_most:
        raise ValueError(f"{k} centroids of {dim} numbers do not fit {centroids_most} bytes")
    vectors = whole_vectors(rows, dim, scale)
    mark = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    start = vectors.orderBy(mark.asc_nulls_last(), "v").limit(k).collect()
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not start:
        return rows.sparkSession.createDataFrame([], schema)
    centroids = np.array([r.v for r in start], np.int64)
    grown = staged(chunks(vectors, dim), "cover-trees")
    for _ in range(rounds):
        centroids = _moved(grown, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Centroids(centroids)
        for batch in batches:
            for ids, point, points, nodes in _read(batch, dim):
                cluster = assigned(points, nodes, tree)
                distance = squared(points, centroids[cluster])
                yield pa.RecordBatch.from_arrays([ids, pa.array(cluster[point].astype(np.int32)), pa.array(distance[point])], names=["vec_id", "cluster", "distance"])

    final = staged(grown.mapInArrow(run, "vec_id long, cluster int, distance long"), "assigned")
    inertia = {r.cluster: int(r.s) for r in final.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    named = [(c, s, sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in inertia.items()]
    about = rows.sparkSession.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return final.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _round_sql(i: int) -> str:
    """SQL: assign every vector, then move the centroids."""
    return f"""
a{i} AS (SELECT r, c, d FROM (SELECT r, c, d, row_number() OVER (PARTITION BY r ORDER BY d, c) AS place FROM (
    SELECT v.r, c{i}.c, list_sum(list_transform(list_zip(v.v, c{i}.v), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS d FROM v CROSS JOIN c{i})) WHERE place = 1),
s{i} AS (SELECT c, j, sum(x) AS s, count(*) AS n FROM (SELECT a{i}.c, unnest(v.v) AS x, unnest(generate_series(1, len(v.v))) AS j FROM a{i} JOIN v USING (r)) GROUP BY c, j),
m{i} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS v FROM s{i} GROUP BY c),
c{i + 1} AS (SELECT c, coalesce(m{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN m{i} USING (c))"""


ORACLE_SQL = f"""
WITH k AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE len(embedding) = 64),
v AS MATERIALIZED (SELECT r, vec_id, list_transform(e, lambda x: CAST(floor(64 * x) AS BIGINT)) AS v FROM k
      WHERE len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS (SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS c, v FROM (SELECT sha256('1:' || vec_id) AS h, v FROM v ORDER BY h NULLS LAST, v LIMIT 16)),
{",".join(_round_sql(i) for i in range(4))}
SELECT v.vec_id, a3.c AS cluster, CAST(a3.d AS BIGINT) AS distance, CAST(sum(a3.d) OVER (PARTITION BY a3.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(a3.d) OVER () AS BIGINT) AS inertia, sha256(list_aggregate(c3.v, 'string_agg', ',')) AS centroid_sha256
FROM a3 JOIN v USING (r) JOIN c3 USING (c)
"""
