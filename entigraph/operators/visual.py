"""Data for graph, tree, table and chart views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import rescale

#: Colour of each type.
COLOURS = {"CUSTOMER": "#4285F4", "ORGANIZATION": "#34A853", "PRODUCT": "#FBBC05", "LOCATION": "#EA4335"}


def nodes(entities: DataFrame, size_column: str = "confidence", low: float = 0.0, high: float = 1.0, to_low: float = 10.0, to_high: float = 50.0) -> DataFrame:
    """(id, label, group, colour, node_size), each id once."""
    colour = F.lit("#999999")
    for kind, c in COLOURS.items():
        colour = F.when(F.col("entity_type") == kind, c).otherwise(colour)
    return entities.dropDuplicates(["id"]).select("id", F.col("entity_text").alias("label"), F.col("entity_type").alias("group"), colour.alias("colour"), rescale(F.coalesce(size_column, F.lit(low)), low, high, to_low, to_high).alias("node_size"))


def edges(relationships: DataFrame, shown: DataFrame) -> DataFrame:
    """Edges whose ends are both shown."""
    ids = shown.select("id")
    kept = relationships.join(ids, relationships.source_entity_id == ids.id, "left_semi").join(ids, relationships.target_entity_id == ids.id, "left_semi")
    return kept.select("id", F.col("source_entity_id").alias("source"), F.col("target_entity_id").alias("target"), F.col("relationship_type").alias("label"))


def table(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Chosen columns; ``properties.x`` hoists a property."""
    return rows.select(*[F.col("properties")[c.split(".", 1)[1]].alias(c.split(".", 1)[1]) if c.startswith("properties.") else F.col(c) for c in columns])


def scatter(rows: DataFrame, x: str, y: str) -> DataFrame:
    number = lambda c: F.coalesce(F.col(c).cast("string").try_cast("double"), F.lit(0.0))
    return rows.select(number(x).alias("x"), number(y).alias("y"))


def merged(a: tuple[DataFrame, DataFrame], b: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Two graphs laid together, nothing dropped."""
    return a[0].unionByName(b[0]), a[1].unionByName(b[1])
