"""Ontology loading and mapping of types to classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.similarity import sequence_ratio

_RDFS = "http://www.w3.org/2000/01/rdf-schema#"
_OWL = "http://www.w3.org/2002/07/owl#"
_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"

#: Relationship types that are named in a filter at most.
_NAMED = 1000


def classes(triples: DataFrame) -> DataFrame:
    """(uri, label, description, parent_class_uri, domain) of (s, p, o, n): the first of each predicate in order of n."""
    first = lambda p, only=None: F.min_by(F.when((F.col("p") == p) & (only if only is not None else F.lit(True)), F.col("o")), F.when((F.col("p") == p) & (only if only is not None else F.lit(True)), F.col("n")))
    ids = triples.where((F.col("p") == _TYPE) & (F.col("o") == f"{_OWL}Class")).select("s").distinct()
    rows = triples.join(ids, "s", "left_semi").groupBy("s").agg(first(f"{_RDFS}label").alias("label"), first(f"{_RDFS}comment").alias("description"), first(f"{_RDFS}subClassOf", F.col("o").startswith("http")).alias("parent_class_uri"))
    return rows.select(F.col("s").alias("uri"), "label", "description", "parent_class_uri", F.regexp_extract("s", "/ontology/([^/]+)", 1).alias("domain"))


def properties(triples: DataFrame) -> DataFrame:
    """(uri, label, property_type, domain_uri, range_uri) of object and datatype properties."""
    first = lambda p: F.min_by(F.when(F.col("p") == p, F.col("o")), F.when(F.col("p") == p, F.col("n")))
    kind = F.when(F.col("o") == f"{_OWL}ObjectProperty", "object").when(F.col("o") == f"{_OWL}DatatypeProperty", "datatype")
    ids = triples.where(F.col("p") == _TYPE).select("s", kind.alias("property_type")).where("property_type IS NOT NULL").groupBy("s").agg(F.min("property_type").alias("property_type"))
    rows = triples.groupBy("s").agg(first(f"{_RDFS}label").alias("label"), first(f"{_RDFS}domain").alias("domain_uri"), first(f"{_RDFS}range").alias("range_uri"))
    return ids.join(rows, "s").select(F.col("s").alias("uri"), "label", "property_type", "domain_uri", "range_uri")


def with_parent_ids(found: DataFrame) -> DataFrame:
    """Unique classes with an id, and the id of the parent where it is known."""
    unique = found.dropDuplicates(["uri"]).withColumn("id", F.sha2("uri", 256))
    parents = unique.select(F.col("uri").alias("parent_class_uri"), F.col("id").alias("parent_class_id"))
    return unique.join(parents, "parent_class_uri", "left")


def map_types(entities: DataFrame, mappings: DataFrame, least: float = 0.7) -> DataFrame:
    """``entities`` with class_uri and mapping_confidence by lower-cased type, or an unmapped_reason.

    ``mappings`` (type_key, class_uri, confidence); one class per type, the surest."""
    best = mappings.where(F.col("confidence") >= least).groupBy(F.lower("type_key").alias("_key")).agg(F.max_by("class_uri", F.struct("confidence", "class_uri")).alias("class_uri"), F.max("confidence").alias("mapping_confidence"))
    joined = entities.join(best, F.lower("entity_type") == F.col("_key"), "left").drop("_key")
    return joined.withColumn("unmapped_reason", F.when(F.col("class_uri").isNull(), "no mapping for this type"))


def map_fuzzy(types: DataFrame, mappings: DataFrame, above: float = 0.6) -> DataFrame:
    """(entity_type, class_uri, score): the most alike mapping of each type, over all mappings.

    ``types`` are distinct type names, few by nature; the ratio is Python, in Arrow batches."""
    pairs = types.select("entity_type").distinct().join(mappings.select("type_key", "class_uri").distinct(), F.length("entity_type") > 0)
    words = lambda c: F.array_distinct(F.split(F.regexp_replace(F.lower(c), "[_-]", " "), " "))
    shared = F.size(F.array_intersect(words("entity_type"), words("type_key"))) / F.greatest(F.size(words("entity_type")), F.size(words("type_key")))
    scored = pairs.withColumn("ratio", sequence_ratio(F.lower("entity_type"), F.lower("type_key"))).withColumn("score", F.when(F.col("ratio") >= 0.8, F.col("ratio")).when(shared > 0.3, F.greatest("ratio", shared)).otherwise(F.col("ratio")))
    return scored.where(F.col("score") > above).groupBy("entity_type").agg(F.max_by("class_uri", F.struct("score", "class_uri")).alias("class_uri"), F.max("score").alias("score"))


def mapping_coverage(mapped: DataFrame) -> DataFrame:
    """(entity_type, n_total, n_mapped, n_unmapped, coverage)."""
    hit = F.col("class_uri").isNotNull()
    return mapped.groupBy("entity_type").agg(F.count("*").alias("n_total"), F.count_if(hit).alias("n_mapped"), F.count_if(~hit).alias("n_unmapped"), F.avg(hit.cast("double")).alias("coverage"))


def suggest(candidates: DataFrame, text: str, most: int = 5) -> DataFrame:
    """(name, rank_no, suggestion_confidence): names that hold the text at 0.8, descriptions at 0.6."""
    named = F.col("name").ilike(f"%{text}%")
    told = F.col("description").ilike(f"%{text}%")
    found = candidates.where(named | told).withColumn("suggestion_confidence", F.when(named, 0.8).otherwise(0.6))
    order = Window.orderBy(F.desc("suggestion_confidence"), "name")
    return found.orderBy(F.desc("suggestion_confidence"), "name").limit(most).withColumn("rank_no", F.row_number().over(order)).select("name", "rank_no", "suggestion_confidence")


def endpoint_violations(edges: DataFrame, entities: DataFrame, allowed: DataFrame) -> DataFrame:
    """Edges whose end types are not among those allowed (relationship_type, source_types, target_types);
    a type without a rule, or an empty list, allows any.

    Types that no rule restricts cannot be violated; where the others are at most ``_NAMED``, only their edges are joined."""
    strict = allowed.where((F.size("source_types") > 0) | (F.size("target_types") > 0))
    named = [r[0] for r in strict.select("relationship_type").where("relationship_type IS NOT NULL").distinct().limit(_NAMED + 1).collect()]
    if len(named) <= _NAMED:
        edges = edges.where(F.col("relationship_type").isin(named))
    ends = entities.select("id", "entity_type")
    joined = edges.join(ends.select(F.col("id").alias("source_entity_id"), F.col("entity_type").alias("source_type")), "source_entity_id").join(ends.select(F.col("id").alias("target_entity_id"), F.col("entity_type").alias("target_type")), "target_entity_id").join(allowed, "relationship_type")
    bad = lambda kinds, kind: (F.size(kinds) > 0) & ~F.array_contains(kinds, F.col(kind))
    return joined.where(bad("source_types", "source_type") | bad("target_types", "target_type"))


def backfill_types(entities: DataFrame, types: DataFrame) -> DataFrame:
    """The type table with the missing types added, ids going on from the largest."""
    missing = entities.select(F.col("entity_type").alias("name")).distinct().join(types.select("name"), "name", "left_anti")
    top = types.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    numbered = missing.join(top, F.lit(True)).withColumn("id", (F.col("top") + F.row_number().over(Window.orderBy("name"))).cast("int"))
    return types.select("id", "name").unionByName(numbered.select("id", "name"))
