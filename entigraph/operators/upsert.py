"""Writes as new versions of a table: inserts, upserts, merges, deletes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.properties import merge_over


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` and the rows of ``new`` whose key it lacks."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti").select(*old.columns))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same key; of several new ones the last in ``order`` wins."""
    if order:
        last = Window.partitionBy(*keys).orderBy(F.desc(order))
        new = new.withColumn("_place", F.row_number().over(last)).where("_place = 1").drop("_place")
    return old.join(new.select(*keys), keys, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def resolve_edges(edges: DataFrame, entities: DataFrame, order: str = "id") -> DataFrame:
    """Edges (source_text, target_text, relationship_type, confidence) with both ends resolved by text, the
    last id winning; an edge with a missing end is dropped; type and confidence have defaults."""
    ids = entities.groupBy("entity_text").agg(F.max_by("id", order).alias("id"))
    a = ids.select(F.col("entity_text").alias("source_text"), F.col("id").alias("source_entity_id"))
    b = ids.select(F.col("entity_text").alias("target_text"), F.col("id").alias("target_entity_id"))
    joined = edges.join(a, "source_text").join(b, "target_text")
    return joined.select("source_entity_id", "target_entity_id", F.coalesce("relationship_type", F.lit("RELATED_TO")).alias("relationship_type"), F.coalesce("confidence", F.lit(0.5)).alias("confidence"))


def update_properties(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """Rows (id, properties) with the maps of ``changes`` (id, properties) laid over theirs."""
    joined = rows.join(changes.select("id", F.col("properties").alias("_new")), "id", "left")
    return joined.withColumn("properties", F.when(F.col("_new").isNull(), F.col("properties")).otherwise(merge_over(F.col("properties"), F.col("_new")))).drop("_new").select(*rows.columns)


def change_log(old: DataFrame, new: DataFrame, field: str) -> DataFrame:
    """(id, field, old_value, new_value) where the field changed."""
    b = new.select("id", F.col(field).cast("string").alias("new_value"))
    pairs = old.select("id", F.col(field).cast("string").alias("old_value")).join(b, "id").where(~F.col("old_value").eqNullSafe(F.col("new_value")))
    return pairs.select("id", F.lit(field).alias("field"), "old_value", "new_value")


def soft_delete(entities: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities of ``gone`` (id) become inactive and lose their edges."""
    marks = gone.select("id", F.lit(True).alias("_gone")).distinct()
    kept = entities.join(marks, "id", "left").withColumn("is_active", F.col("is_active") & F.col("_gone").isNull()).select(*entities.columns)
    return kept, without_edges_of(edges, gone)


def without_edges_of(edges: DataFrame, gone: DataFrame) -> DataFrame:
    ids = gone.select("id").distinct()
    return edges.join(ids, edges.source_entity_id == ids.id, "left_anti").join(ids, edges.target_entity_id == ids.id, "left_anti")


def hard_delete(entities: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    return entities.join(gone.select("id"), "id", "left_anti").select(*entities.columns), without_edges_of(edges, gone)


def edit_errors(edits: DataFrame) -> DataFrame:
    """``edits`` (edit_type, entity_text, source_entity_id, target_entity_id, relationship_type) with their errors."""
    create = F.col("edit_type") == "create_entity"
    relate = F.col("edit_type") == "create_relationship"
    missing = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    errors = F.array_compact(F.array(F.when(create & missing("entity_text"), "entity_text is required"), F.when(relate & (missing("source_entity_id") | missing("target_entity_id")), "both ends are required"), F.when(relate & missing("relationship_type"), "relationship_type is required"), F.when(relate & (F.col("source_entity_id") == F.col("target_entity_id")), "an entity can't relate to itself")))
    return edits.withColumn("errors", F.array_join(errors, "; "))


def uniqueness_audit(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that stand in more than one row."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def save_version(df: DataFrame, folder: str, version: int) -> None:
    df.write.mode("errorifexists").parquet(f"{folder}/version={version:08d}")


def rollback(spark, folder: str, version: int) -> DataFrame:
    """The table as it was at a version."""
    return spark.read.parquet(f"{folder}/version={version:08d}")


def resolve_texts(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """(mention, id): the entity of the same lower-cased text, else the smallest id whose text holds the mention
    or is held by it, within a document: ``mentions`` (doc_id, mention), ``entities`` (doc_id, id, entity_text)."""
    m = mentions.select("doc_id", "mention").distinct().withColumn("low", F.lower("mention"))
    e = entities.select("doc_id", "id", F.lower("entity_text").alias("text"))
    found = m.join(e, "doc_id").where(F.contains("text", "low") | F.contains("low", "text"))
    return found.groupBy("doc_id", "mention").agg(F.min(F.struct((F.col("text") != F.col("low")).alias("part"), "id")).alias("b")).select("doc_id", "mention", F.col("b.id").alias("id"))


def rolled_back(rows: DataFrame, actions: DataFrame, key: str = "id") -> DataFrame:
    """``rows`` with ``actions`` (seq, action, key, old) undone in reverse order: created rows go, deleted and
    updated ones are as they were before their first action.  ``old`` holds the row's other columns."""
    first = actions.groupBy(key).agg(F.min_by(F.struct("action", "old"), "seq").alias("f"))
    kept = rows.join(first.select(key), key, "left_anti")
    others = [F.col("f.old")[c].alias(c) for c in rows.columns if c != key]
    back = first.where(F.col("f.action") != "create").select(key, *others).select(*rows.columns)
    return kept.select(*rows.columns).unionByName(back)


def inverse_actions(actions: DataFrame) -> DataFrame:
    """(seq, id, inverse): what undoes each action, to be done from the highest seq down."""
    inverse = F.when(F.col("action") == "create", "delete").when(F.col("action") == "delete", "create").otherwise("update")
    return actions.select("seq", "id", inverse.alias("inverse"))
