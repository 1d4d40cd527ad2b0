"""Entity resolution, conflict detection and resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.similarity import severity
from ..session import settled
from .alike import first_of, greedy_leaders
from .blocking import classes, similar_classes

#: Types that speak against each other.
CONTRADICTIONS = {
    "EMPLOYED_BY": ("UNEMPLOYED", "RETIRED_FROM"),
    "MARRIED_TO": ("DIVORCED_FROM", "SINGLE"),
    "OWNS": ("SOLD", "DOES_NOT_OWN"),
    "LOCATED_IN": ("NOT_LOCATED_IN", "MOVED_FROM"),
}


def keep_first(rows: DataFrame, keys: list, order: list) -> DataFrame:
    first = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_place", F.row_number().over(first)).where("_place = 1").drop("_place")


def resolve_exact(entities: DataFrame) -> DataFrame:
    """Of entities with the same lower-cased text and type, the most confident, the first on ties."""
    return keep_first(entities, [F.lower("entity_text"), F.col("entity_type")], [F.desc("confidence"), F.asc("id")])


def resolve_fuzzy(entities: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(entity_type, leader, id, confidence, n_merged): greedy clusters per type, in order of id; the most
    confident member, the earliest of several, stands for the cluster."""
    # equal texts are one item: their order decides nothing but the id
    survivor = first_of(F.col("confidence"), F.col("id"), F.col("id"), F.col("confidence")).alias("best")
    texts = settled(entities.groupBy("entity_type", F.lower("entity_text").alias("item")).agg(F.min("id").alias("place"), survivor, F.count("*").alias("n")))
    led = greedy_leaders(texts.select(F.col("entity_type").alias("block"), "item", "place"), threshold)
    both = texts.join(led.withColumnRenamed("block", "entity_type"), ["entity_type", "item"])
    best = first_of(F.col("best.confidence"), F.col("best.id"), F.col("best.id"), F.col("best.confidence")).alias("b")
    return both.groupBy("entity_type", "leader").agg(best, F.sum("n").alias("n_merged")).select("entity_type", "leader", "b.id", "b.confidence", "n_merged")


def resolution_statistics(before: DataFrame, after: DataFrame) -> DataFrame:
    a, b = before.agg(F.count("*").alias("n_original")), after.agg(F.count("*").alias("n_resolved"))
    return a.join(b, F.lit(True)).withColumn("n_merged", F.col("n_original") - F.col("n_resolved"))


def duplicates(entities: DataFrame, block: list[str], least: float = 0.8) -> DataFrame:
    """(a_id, b_id, score, severity) by words and letters: every pair of entities, from pairs of their texts."""
    of = classes(entities, block)
    near = similar_classes(of, least).unionByName(of.where("n > 1").select("block", F.col("text").alias("a"), F.col("text").alias("b"), F.lit(1.0).alias("score")))
    side = lambda s: entities.select(F.struct(*block).alias("block"), F.lower("entity_text").alias(s), F.col("id").alias(f"{s}_id"))
    pairs = near.join(side("a"), ["block", "a"]).join(side("b"), ["block", "b"]).where("a <> b OR a_id < b_id")
    return pairs.select(F.least("a_id", "b_id").alias("a_id"), F.greatest("a_id", "b_id").alias("b_id"), "score", severity(F.col("score")).alias("severity"))


def contradictions(edges: DataFrame) -> DataFrame:
    """(a_edge, b_edge, score): edges of one pair of ends whose types speak against each other."""
    table = edges.sparkSession.createDataFrame([(a, b) for a, others in CONTRADICTIONS.items() for b in others] + [(b, a) for a, others in CONTRADICTIONS.items() for b in others], "a_kind string, b_kind string").distinct()
    a = edges.select("source_entity_id", "target_entity_id", F.col("id").alias("a_edge"), F.col("relationship_type").alias("a_kind"), F.col("confidence").alias("ac"))
    b = edges.select("source_entity_id", "target_entity_id", F.col("id").alias("b_edge"), F.col("relationship_type").alias("b_kind"), F.col("confidence").alias("bc"))
    pairs = a.join(b, ["source_entity_id", "target_entity_id"]).where("a_edge < b_edge").join(table, ["a_kind", "b_kind"])
    return pairs.select("a_edge", "b_edge", F.least(F.coalesce("ac", F.lit(0.5)), F.coalesce("bc", F.lit(0.5))).alias("score"), F.lit("high").alias("severity"))


def overlapping_times(edges: DataFrame) -> DataFrame:
    """Edges (source, type, start, end) that begin before the one before them ends, or end before they begin."""
    w = Window.partitionBy("source_entity_id", "relationship_type").orderBy("start", "id")
    return edges.withColumn("next_start", F.lead("start").over(w)).withColumn("problem", F.when(F.col("end") < F.col("start"), "ends_before_start").when(F.col("next_start") < F.col("end"), "overlaps_next")).where("problem IS NOT NULL")


def new_conflicts(found: DataFrame, known: DataFrame) -> DataFrame:
    """Conflicts (entity_id, other_id) that are not known in either order."""
    key = lambda d: d.withColumn("_a", F.least("entity_id", "other_id")).withColumn("_b", F.greatest("entity_id", "other_id"))
    return key(found).join(key(known).select("_a", "_b").distinct(), ["_a", "_b"], "left_anti").drop("_a", "_b")


def by_rule(conflicts: DataFrame) -> DataFrame:
    """``conflicts`` with resolution and confidence by the fixed rules, null where none applies."""
    duplicate = (F.col("conflict_type") == "possible_duplicate") & (F.col("score") >= 0.95)
    source = F.col("source_reliability") > F.col("target_reliability") + 0.2
    return conflicts.withColumn("resolution", F.when(duplicate, "merge").when(source, "keep_source")).withColumn("resolution_confidence", F.when(duplicate, 0.9).when(source, 0.8))


def completeness(n_properties: Column, n_required: Column, confidence: Column, verified: Column, reliability: Column, days_old: Column) -> Column:
    return 0.1 * n_properties + 0.3 * n_required + 0.4 * confidence + 0.5 * verified.cast("double") + 0.2 * reliability + 0.3 * F.greatest(F.lit(0.0), 1.0 - days_old / 365.0)


def merge_entities(entities: DataFrame, edges: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities of ``mapping`` (loser, winner) go; their edges move to the winners; repeated edges and
    loops that arise are dropped, the smallest id staying."""
    m = mapping.select("loser", "winner").distinct()
    kept = entities.join(m, entities.id == m.loser, "left_anti")
    moved = edges
    for side in ("source_entity_id", "target_entity_id"):
        moved = moved.join(m, F.col(side) == F.col("loser"), "left").withColumn(side, F.coalesce("winner", side)).drop("loser", "winner")
    moved = keep_first(moved.where("source_entity_id <> target_entity_id"), ["source_entity_id", "relationship_type", "target_entity_id"], ["id"])
    return kept, moved.select(*edges.columns)


def leader_clusters(items: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(cluster, item): greedy leader clusters of ``items`` (block, item) by the sequence ratio, per block in
    order of the item."""
    led = greedy_leaders(items.select("block", "item").distinct().withColumn("place", F.col("item")), threshold)
    return led.select(F.col("leader").alias("cluster"), "item")


def keep_best(rows: DataFrame, keys: list, score: str, order: str) -> DataFrame:
    """Per key the row of the highest score, the first in order on ties."""
    return keep_first(rows, keys, [F.desc(score), F.asc(order)])


def detect_all(*found: DataFrame) -> DataFrame:
    """Conflicts of several detectors, each (entity_id, other_id, conflict_type, score), in one table."""
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def conflicts_by_source(entities: DataFrame) -> DataFrame:
    """(entity_text, entity_type, n_sources, n_values): one text and type from several documents whose label differs."""
    return entities.groupBy("entity_text", "entity_type").agg(F.count_distinct("source").alias("n_sources"), F.count_distinct("label").alias("n_values")).where("n_sources > 1 AND n_values > 1")


def transfer_edges(edges: DataFrame, loser: str, winner: str) -> DataFrame:
    """``edges`` with those of the loser repointed; one that the winner has already is made inactive."""
    ends = F.col("source_entity_id"), F.col("target_entity_id")
    touched = F.coalesce((ends[0] == loser) | (ends[1] == loser), F.lit(False))
    near = settled(edges.where(ends[0].isin(loser, winner) | ends[1].isin(loser, winner)))  # all others pass as they are
    have = near.where((ends[0] == winner) | (ends[1] == winner)).select(ends[0].alias("s"), ends[1].alias("t"), F.col("relationship_type").alias("k")).distinct()
    to = lambda c: F.when(F.col(c) == loser, F.lit(winner)).otherwise(F.col(c))
    moved = near.where(touched).withColumn("ns", to("source_entity_id")).withColumn("nt", to("target_entity_id"))
    joined = moved.join(have, (F.col("ns") == F.col("s")) & (F.col("nt") == F.col("t")) & (F.col("relationship_type") == F.col("k")), "left")
    clash = F.coalesce(F.col("s").isNotNull() | (F.col("ns") == F.col("nt")), F.lit(False))
    new = joined.withColumn("is_active", F.col("is_active") & ~clash).withColumn("source_entity_id", F.when(clash, F.col("source_entity_id")).otherwise(F.col("ns"))).withColumn("target_entity_id", F.when(clash, F.col("target_entity_id")).otherwise(F.col("nt"))).select(*edges.columns)
    return edges.where(~touched).unionByName(new)


def set_status(conflicts: DataFrame, condition: Column, status: str, by: str | None = None) -> DataFrame:
    """Conflicts that meet a condition get a status, and an assignee if one is given."""
    changed = {"status": F.when(condition, status).otherwise(F.col("status"))}
    if by is not None:
        changed["assigned_to"] = F.when(condition, by).otherwise(F.col("assigned_to"))
    return conflicts.withColumns(changed)
