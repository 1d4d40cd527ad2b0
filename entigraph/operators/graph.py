"""Graph reads as joins: degrees, neighbourhoods, subgraphs, fixed and shortest paths.

An edge is (id, source_entity_id, target_entity_id, relationship_type, ...).  An undirected read turns
it into two rows; no join ever has an OR.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import settled


def both_ways(edges: DataFrame, *keep: str) -> DataFrame:
    """(own, far, direction, *keep): each edge seen from either end; a self-loop once."""
    out = edges.select(F.col("source_entity_id").alias("own"), F.col("target_entity_id").alias("far"), F.lit("outgoing").alias("direction"), *keep)
    into = edges.where("source_entity_id <> target_entity_id").select(F.col("target_entity_id").alias("own"), F.col("source_entity_id").alias("far"), F.lit("incoming").alias("direction"), *keep)
    return out.unionAll(into)


def of_types(edges: DataFrame, types: tuple[str, ...] = ()) -> DataFrame:
    return edges.where(F.col("relationship_type").isin(*types)) if types else edges


def degrees(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """``entities`` with relationship_count, zero where there is none."""
    counted = both_ways(edges).groupBy("own").agg(F.count("*").alias("relationship_count"))
    return entities.join(counted, entities.id == counted.own, "left").drop("own").withColumn("relationship_count", F.coalesce("relationship_count", F.lit(0)))


def _hop(front: DataFrame, edges: DataFrame, *keys: str) -> DataFrame:
    """What one undirected hop from ``front`` (keys, node) reaches, once each."""
    ends = ("source_entity_id", "target_entity_id")
    sides = [front.join(edges.select(F.col(own).alias("node"), F.col(far).alias("_far")), "node").select(*keys, F.col("_far").alias("node")) for own, far in (ends, ends[::-1])]
    return sides[0].unionAll(sides[1]).distinct()


def neighbours(edges: DataFrame, start: DataFrame, depth: int, types: tuple[str, ...] = ()) -> DataFrame:
    """(start, node, depth): nodes within ``depth`` undirected hops of each id of ``start``, at their
    least depth; the start itself at depth 0.

    Edges are made once, and each frontier is settled before the next hop, so no hop repeats an earlier
    one.  A node that is new can only be told from those of the last two depths and itself: what a hop
    reaches lies at most one depth back."""
    found = start.select(F.col("id").alias("start"), F.col("id").alias("node"), F.lit(0).alias("depth"))
    own = of_types(edges, types).select("source_entity_id", "target_entity_id")
    if depth > 1:
        own, found = settled(own), settled(found.distinct())
    before, front = None, found
    for d in range(1, depth + 1):
        reached = _hop(front.select("start", "node"), own, "start")
        known = front.select("start", "node") if before is None else front.select("start", "node").unionAll(before.select("start", "node"))
        new = reached.join(known, ["start", "node"], "left_anti").withColumn("depth", F.lit(d))
        if d < depth:
            new = settled(new)
        found = found.unionAll(new)
        before, front = front, new
    return found


def top_per_depth(found: DataFrame, entities: DataFrame, n: int) -> DataFrame:
    """Of each depth the ``n`` most confident neighbours."""
    joined = found.where("depth > 0").join(entities.select(F.col("id").alias("node"), "confidence"), "node")
    best = Window.partitionBy("start", "depth").orderBy(F.desc("confidence"), "node")
    return joined.withColumn("place", F.row_number().over(best)).where(F.col("place") <= n).drop("place")


def subgraph(entities: DataFrame, edges: DataFrame, centre: DataFrame, radius: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): the centre, the ``most`` most confident nodes within ``radius`` hops, and every edge between them."""
    near = neighbours(edges, centre, radius).where("depth > 0").select("node").distinct()
    chosen = entities.join(near, entities.id == near.node, "left_semi").orderBy(F.desc("confidence"), "id").limit(most)
    nodes = chosen.unionAll(entities.join(centre.select("id"), "id", "left_semi").select(*entities.columns)).distinct()
    ids = nodes.select("id")
    inside = edges.join(ids, edges.source_entity_id == ids.id, "left_semi").join(ids, edges.target_entity_id == ids.id, "left_semi")
    return nodes, inside


def fixed_path(edges: DataFrame, starts: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """(n0, n1, ...): directed paths whose edges have the given types in turn."""
    paths = starts.select(F.col("id").alias("n0"))
    for i, kind in enumerate(types):
        hop = edges.where(F.col("relationship_type") == kind).select(F.col("source_entity_id").alias(f"n{i}"), F.col("target_entity_id").alias(f"n{i + 1}"))
        paths = paths.join(hop, f"n{i}")
    return paths.select(*[f"n{i}" for i in range(len(types) + 1)])


def trails(edges: DataFrame, starts: DataFrame, depth: int, types: tuple[str, ...] = ()) -> DataFrame:
    """(start, node, hops, edge_ids): directed trails of 1 to ``depth`` hops; no edge twice."""
    step = of_types(edges, types).select(F.col("source_entity_id").alias("own"), F.col("target_entity_id").alias("far"), F.col("id").alias("edge"))
    front = starts.select(F.col("id").alias("start"), F.col("id").alias("node"), F.array().cast("array<string>").alias("edge_ids"))
    out = None
    for d in range(1, depth + 1):
        front = front.join(step, F.col("node") == F.col("own")).where(~F.array_contains("edge_ids", F.col("edge"))).select("start", F.col("far").alias("node"), F.array_append("edge_ids", F.col("edge")).alias("edge_ids"))
        rows = front.select("start", "node", F.lit(d).alias("hops"), "edge_ids")
        out = rows if out is None else out.unionAll(rows)
    return out


def shortest_lengths(edges: DataFrame, starts: DataFrame, depth: int, types: tuple[str, ...] = ()) -> DataFrame:
    """(start, node, hops) of the shortest undirected path, within ``depth``."""
    return neighbours(edges, starts, depth, types).where("depth > 0").withColumnRenamed("depth", "hops")


def shortest_paths(edges: DataFrame, pairs: DataFrame, depth: int, types: tuple[str, ...] = ()) -> DataFrame:
    """(source, target, hops, path): all shortest undirected paths between the ends of each pair (source, target), of up
    to ``depth`` hops; a path is the list of its nodes, and that from a node to itself the node alone.

    Two frontiers, one from either end, go on until they meet, the smaller one first.  A frontier is kept for each
    distinct end, not for each pair, so many pairs with one end go through its neighbourhood once.  Ends all of whose
    pairs have met go no further.  Paths are put together from the meeting nodes outward, over those edges alone that
    lead one depth back."""
    # repeated edges are harmless: what a hop reaches is made distinct
    own = settled(of_types(edges, types).select("source_entity_id", "target_entity_id").where("source_entity_id <> target_entity_id"))
    open_ = settled(pairs.select("source", "target").where("source IS NOT NULL AND target IS NOT NULL").distinct())
    keys = ["source", "target"]
    seen = {end: [settled(open_.select(end, F.col(end).alias("node")).distinct())] for end in keys}  # a frontier for each depth
    sizes = {end: seen[end][0].count() for end in keys}
    met: list[tuple[int, int, DataFrame]] = [(0, 0, open_.where("source = target").select(*keys, F.col("source").alias("node")))]
    open_ = open_.where("source <> target")
    for hops in range(1, depth + 1):
        if open_.isEmpty():
            break
        end = min(keys, key=sizes.__getitem__)
        other = keys[1 - keys.index(end)]
        front = seen[end][-1].join(open_.select(end).distinct(), end, "left_semi")
        reached = _hop(front, own, end)
        for old in seen[end][-2:]:
            reached = reached.join(old, [end, "node"], "left_anti")
        new = settled(reached)
        seen[end].append(new)
        sizes[end] = new.count()
        # pairs take on the frontier that gives them fewer rows, and meet the other
        near, far = sorted(keys, key=lambda e: open_.join(seen[e][-1], e).count())
        here = settled(open_.join(seen[near][-1], near).join(seen[far][-1], [far, "node"]).select(*keys, "node"))
        met.append((len(seen["source"]) - 1, len(seen["target"]) - 1, here))
        open_ = settled(open_.join(here.select(*keys), keys, "left_anti"))
    out = None
    for i, j, middle in met:
        paths = middle.select(*keys, F.array("node").alias("path"))
        for end, n in (("source", i), ("target", j)):
            for d in range(n - 1, -1, -1):
                last = F.element_at("path", 1 if end == "source" else -1)
                back = _steps_back(paths.select(end, last.alias("node")).distinct(), own, seen[end][d], end)
                grown = F.concat(F.array("_back"), F.col("path")) if end == "source" else F.concat(F.col("path"), F.array("_back"))
                paths = paths.withColumn("node", last).join(back, [end, "node"]).select(*keys, grown.alias("path"))
        rows = paths.select(*keys, F.lit(i + j).alias("hops"), "path")
        out = rows if out is None else out.unionAll(rows)
    return out


def _steps_back(at: DataFrame, edges: DataFrame, depth_before: DataFrame, end: str) -> DataFrame:
    """(end, node, _back): the neighbours of each node that lie one depth nearer to the end."""
    ends = ("source_entity_id", "target_entity_id")
    sides = [at.join(edges.select(F.col(own).alias("node"), F.col(far).alias("_back")), "node").select(end, "node", "_back") for own, far in (ends, ends[::-1])]
    return sides[0].unionAll(sides[1]).distinct().join(depth_before.withColumnRenamed("node", "_back"), [end, "_back"], "left_semi")


def shortest_path(edges: DataFrame, source: str, target: str, depth: int) -> list[str] | None:
    """Ids along one shortest undirected path, the first in order, or None."""
    pair = edges.sparkSession.createDataFrame([(source, target)], "source string, target string")
    found = shortest_paths(edges, pair, depth).agg(F.min("path").alias("path")).first()
    return found.path


def connected(entities: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """Entities one hop away."""
    near = both_ways(edges).where(F.col("own") == node).select("far").distinct()
    return entities.join(near, entities.id == near.far, "left_semi")


def repeated_edges(edges: DataFrame) -> DataFrame:
    """Edges whose (source, type, target) an edge of smaller id has."""
    same = Window.partitionBy("source_entity_id", "relationship_type", "target_entity_id").orderBy("id")
    return edges.withColumn("place", F.row_number().over(same)).where("place > 1").drop("place")
