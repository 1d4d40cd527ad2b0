"""A knowledge graph derived from the star-schema tables, in Spark and in SQL.

Nothing is sampled: every row of the tables becomes an entity or takes part in a relationship.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: All "recent" operators count back from here.
AS_OF = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, entity_text, entity_type, num (key), confidence, is_verified, is_active, label, amount."""
    none_s, none_d = F.lit(None).cast("string"), F.lit(None).cast("double")
    parts = (("region", "r", "LOCATION", None, None), ("nation", "n", "COUNTRY", None, None), ("customer", "c", "CUSTOMER", "c_mktsegment", "c_acctbal"), ("supplier", "s", "ORGANIZATION", None, "s_acctbal"), ("part", "p", "PRODUCT", "p_brand", "p_retailprice"))
    keys = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey"}
    out = None
    for name, prefix, kind, label, amount in parts:
        key = F.col(keys[name]).cast("long")
        rows = table(spark, sf_dir, name).select(
            F.concat(F.lit(f"{prefix}:"), key.cast("string")).alias("id"),
            F.col(f"{prefix}_name").alias("entity_text"),
            F.lit(kind).alias("entity_type"),
            key.alias("num"),
            ((key % 100) / 100.0).cast("double").alias("confidence"),
            (key % 3 == 0).alias("is_verified"),
            (key % 11 != 0).alias("is_active"),
            (F.col(label) if label else none_s).alias("label"),
            (F.col(amount) if amount else none_d).alias("amount"),
        )
        out = rows if out is None else out.unionAll(rows)
    return out


def edge_id() -> Column:
    """The id of a relationship, from its ends and type."""
    return F.concat_ws("|", "source_entity_id", "relationship_type", "target_entity_id")


def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, source_entity_id, target_entity_id, relationship_type, num, confidence, is_active."""

    def edge(rows: DataFrame, source: str, target: str, kind: str) -> DataFrame:
        sp, sk = source.split(":")
        tp, tk = target.split(":")
        # keys are made distinct as numbers, before they become texts
        pair = rows.select(F.col(sk).alias("_s"), F.col(tk).alias("_t")).distinct().select(F.concat(F.lit(f"{sp}:"), F.col("_s").cast("string")).alias("source_entity_id"), F.concat(F.lit(f"{tp}:"), F.col("_t").cast("string")).alias("target_entity_id"), (F.col("_s").cast("long") + F.col("_t").cast("long")).alias("num"))
        return pair.withColumn("relationship_type", F.lit(kind))

    t = lambda n: table(spark, sf_dir, n)
    items = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    bought = t("orders").select("o_orderkey", "o_custkey").join(items, F.col("o_orderkey") == F.col("l_orderkey"))
    out = edge(t("nation"), "n:n_nationkey", "r:n_regionkey", "LOCATED_IN").unionAll(edge(t("customer"), "c:c_custkey", "n:c_nationkey", "LOCATED_IN")).unionAll(edge(t("supplier"), "s:s_suppkey", "n:s_nationkey", "LOCATED_IN"))
    out = out.unionAll(edge(items, "s:l_suppkey", "p:l_partkey", "SUPPLIES")).unionAll(edge(bought, "c:o_custkey", "p:l_partkey", "PURCHASED"))
    return out.select(edge_id().alias("id"), "source_entity_id", "target_entity_id", "relationship_type", "num", ((F.col("num") % 100) / 100.0).cast("double").alias("confidence"), (F.col("num") % 13 != 0).alias("is_active"))


def _entity_sql(name: str, prefix: str, key: str, kind: str, label: str, amount: str) -> str:
    return f"SELECT '{prefix}:' || {key} AS id, {prefix}_name AS entity_text, '{kind}' AS entity_type, CAST({key} AS BIGINT) AS num, CAST({key} % 100 AS DOUBLE) / 100 AS confidence, {key} % 3 = 0 AS is_verified, {key} % 11 <> 0 AS is_active, {label} AS label, {amount} AS amount FROM {name}"


def _edge_sql(rows: str, sp: str, sk: str, tp: str, tk: str, kind: str) -> str:
    return f"SELECT DISTINCT '{sp}:' || {sk} AS source_entity_id, '{tp}:' || {tk} AS target_entity_id, CAST({sk} AS BIGINT) + CAST({tk} AS BIGINT) AS num, '{kind}' AS relationship_type FROM {rows}"


_NS, _ND = "CAST(NULL AS VARCHAR)", "CAST(NULL AS DOUBLE)"
ENTITIES_SQL = " UNION ALL ".join([
    _entity_sql("region", "r", "r_regionkey", "LOCATION", _NS, _ND),
    _entity_sql("nation", "n", "n_nationkey", "COUNTRY", _NS, _ND),
    _entity_sql("customer", "c", "c_custkey", "CUSTOMER", "c_mktsegment", "c_acctbal"),
    _entity_sql("supplier", "s", "s_suppkey", "ORGANIZATION", _NS, "s_acctbal"),
    _entity_sql("part", "p", "p_partkey", "PRODUCT", "p_brand", "p_retailprice"),
])
RELATIONSHIPS_SQL = "SELECT source_entity_id || '|' || relationship_type || '|' || target_entity_id AS id, source_entity_id, target_entity_id, relationship_type, num, CAST(num % 100 AS DOUBLE) / 100 AS confidence, num % 13 <> 0 AS is_active FROM (" + " UNION ALL ".join([
    _edge_sql("nation", "n", "n_nationkey", "r", "n_regionkey", "LOCATED_IN"),
    _edge_sql("customer", "c", "c_custkey", "n", "c_nationkey", "LOCATED_IN"),
    _edge_sql("supplier", "s", "s_suppkey", "n", "s_nationkey", "LOCATED_IN"),
    _edge_sql("lineitem", "s", "l_suppkey", "p", "l_partkey", "SUPPLIES"),
    _edge_sql("orders JOIN lineitem ON o_orderkey = l_orderkey", "c", "o_custkey", "p", "l_partkey", "PURCHASED"),
]) + ") e"
#: To stand before the SELECT of an oracle query.
GRAPH_SQL = f"WITH RECURSIVE entities AS ({ENTITIES_SQL}), relationships AS ({RELATIONSHIPS_SQL})"
