"""Queries over pairs of entities: candidates by shared words, conflicts, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import table
from ..functions import tables
from ..operators import blocking, temporal
from .registry import query as register

#: Parts as entities: a text of six words (three are in all of them), brand and type as block, two properties, and the
#: embedding of the vector whose id is the part's remainder by 5.
_PARTS_SQL = "e AS (SELECT 'p:' || p_partkey AS id, lower(p_name || ' part of size ' || (p_size % 5)) AS n, p_brand || '|' || p_type AS g, CAST(p_size AS VARCHAR) AS size, CAST(p_size % 10 AS VARCHAR) AS digit, p_partkey % 2 AS odd, p_partkey % 5 AS v, CAST(embedding AS DOUBLE[]) AS x FROM part LEFT JOIN embeddings ON vec_id = p_partkey % 5)"
_WORDS = "CAST(len(list_intersect(list_distinct(string_split(a.n, ' ')), list_distinct(string_split(b.n, ' ')))) AS DOUBLE) / len(list_distinct(list_concat(string_split(a.n, ' '), string_split(b.n, ' '))))"
_SCORE = f"CASE WHEN a.n = b.n THEN 1 ELSE ({_WORDS} + jaccard(a.n, b.n)) / 2 END"
_COS = "list_inner_product(a.x, b.x) / (sqrt(list_inner_product(a.x, a.x)) * sqrt(list_inner_product(b.x, b.x)))"
_NEAR = 0.15


def parts(spark: SparkSession, sf: str) -> DataFrame:
    v = F.broadcast(table(spark, sf, "embeddings").where("vec_id BETWEEN -4 AND 4").select("vec_id", "embedding"))  # remainders by 5
    p = table(spark, sf, "part")
    text = F.concat_ws(" ", "p_name", F.lit("part of size"), (F.col("p_size") % 5).cast("string"))
    properties = F.create_map(F.lit("size"), F.col("p_size").cast("string"))
    digits = F.create_map(F.lit("digit"), (F.col("p_size") % 10).cast("string"), F.lit("odd"), (F.col("p_partkey") % 2).cast("string"))
    return p.join(v, F.col("p_partkey") % 5 == F.col("vec_id"), "left").select(F.concat(F.lit("p:"), F.col("p_partkey").cast("string")).alias("id"), text.alias("entity_text"), F.concat_ws("|", "p_brand", "p_type").alias("brand"), properties.alias("properties"), digits.alias("digits"), "embedding")


def _conflicts_sql(most: int) -> str:
    return f"""WITH {_PARTS_SQL},
p AS (SELECT a.id AS entity_id, b.id AS other_id, {_SCORE} AS s, {_COS} AS c, a.size <> b.size AS differs FROM e a JOIN e b ON a.g = b.g AND a.id <> b.id),
t AS (SELECT entity_id, other_id, CASE WHEN s >= 0.8 AND c >= {_NEAR} THEN 'high_confidence_duplicate' WHEN s >= 0.8 THEN 'possible_duplicate' WHEN differs THEN 'inconsistent_attributes' END AS conflict_type,
             CASE WHEN s >= 0.8 AND c >= {_NEAR} THEN (s + c) / 2 WHEN s >= 0.8 THEN s ELSE 0.7 END AS score FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY other_id) AS k FROM t WHERE conflict_type IS NOT NULL)
SELECT entity_id, other_id, conflict_type, round(score, 6) AS score FROM r WHERE k <= {most}"""


def _conflicts(spark: SparkSession, sf: str, most: int) -> DataFrame:
    return blocking.conflicts(parts(spark, sf), ["brand"], embedding_least=_NEAR, most=most).withColumn("score", F.round("score", 6))


@register("r06_conflicts", _conflicts_sql(5))
def r06(spark, sf):
    return _conflicts(spark, sf, 5)


@register("w04_most_conflicts", f"SELECT entity_id, other_id, score FROM ({_conflicts_sql(3)}) x")
def w04(spark, sf):
    """At most three conflicts an entity."""
    return _conflicts(spark, sf, 3).select("entity_id", "other_id", "score")


@register("r08_batch_statistics", f"SELECT conflict_type, count(*) AS n_conflicts, count(DISTINCT entity_id) AS n_entities FROM ({_conflicts_sql(5)}) x GROUP BY conflict_type")
def r08(spark, sf):
    return _conflicts(spark, sf, 5).groupBy("conflict_type").agg(F.count("*").alias("n_conflicts"), F.count_distinct("entity_id").alias("n_entities"))


@register("r09_duplicates_by_mean", f"""WITH {_PARTS_SQL}, o AS (SELECT g, n, v, digit, odd, any_value(x) AS x, min(id) AS id FROM e GROUP BY g, n, v, digit, odd),
p AS (SELECT a.id AS a_id, b.id AS b_id, (2 + {_COS} + (CAST(a.digit = b.digit AS INTEGER) + CAST(a.odd = b.odd AS INTEGER)) / CAST(2 AS DOUBLE)) / 4 AS s FROM o a JOIN o b ON a.g = b.g AND a.n = b.n AND a.id < b.id)
SELECT a_id, b_id, round(s, 6) AS score, CASE WHEN s >= 0.95 THEN 'critical' WHEN s >= 0.9 THEN 'high' WHEN s >= 0.8 THEN 'medium' ELSE 'low' END AS severity FROM p WHERE s >= 0.85""")
def r09(spark, sf):
    found = blocking.duplicates_by_mean(parts(spark, sf).drop("properties").withColumnRenamed("digits", "properties"), ["brand"])
    return found.withColumn("score", F.round("score", 6))


@register("r09_same_entities", f"WITH {_PARTS_SQL} SELECT min(id) AS rep, count(*) AS n FROM e GROUP BY g, n, v, digit, odd")
def r09_members(spark, sf):
    return blocking.same_entities(parts(spark, sf).drop("properties").withColumnRenamed("digits", "properties"), ["brand"])


@register("d10_same_block_pairs", f"WITH {_PARTS_SQL}, d AS (SELECT DISTINCT g, n FROM e) SELECT a.g AS brand, a.n AS a, b.n AS b, round({_WORDS}, 6) AS weight FROM d a JOIN d b ON a.g = b.g AND a.n < b.n AND {_WORDS} >= 0.6")
def d10(spark, sf):
    """Candidate pairs between the distinct texts of a block, weighted by the words they share."""
    found = blocking.alike_classes(blocking.classes(parts(spark, sf), ["brand"]), 0.6)
    return found.select("block.brand", "a", "b", F.round("weight", 6).alias("weight"))


@register("d11_all_others_of_block", f"WITH {_PARTS_SQL}, d AS (SELECT g, n, count(*) AS m FROM e GROUP BY g, n), c AS (SELECT a.g, a.n, sum(b.m) - 1 AS k FROM d a JOIN d b ON a.g = b.g AND {_WORDS} >= 0.6 GROUP BY a.g, a.n) SELECT id, CAST(k AS BIGINT) AS n FROM e JOIN c USING (g, n)")
def d11(spark, sf):
    """How many others of its block each entity has to be compared with."""
    return blocking.candidate_counts(parts(spark, sf), ["brand"], 0.6)


@register("r11_overlapping_pairs", "WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_custkey AS k, o_orderpriority AS t, CAST(o_orderdate AS TIMESTAMP) AS s, CAST(o_orderdate AS TIMESTAMP) + to_days(CAST(1 + o_orderkey % 400 AS INTEGER)) AS e FROM orders) SELECT a.id AS a, b.id AS b, date_diff('day', b.s, least(a.e, b.e)) AS days FROM o a JOIN o b ON a.k = b.k AND (a.s < b.s OR a.s = b.s AND a.id < b.id) AND b.s < a.e AND a.t <> b.t")
def r11_pairs(spark, sf):
    """Orders of one customer that are open at the same time, as relationships to their priorities."""
    day = F.col("o_orderdate").cast("timestamp_ntz")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").alias("source_entity_id"), F.lit("ORDERED").alias("relationship_type"), F.col("o_orderpriority").alias("target_entity_id"), day.alias("start"), (day + F.make_dt_interval((F.lit(1) + F.col("o_orderkey") % 400).cast("int"))).alias("end"))
    return temporal.contradictory_times(o).select("a", "b", F.col("days").cast("long").alias("days"))


@register("k03_first_rows", "SELECT p_brand, p_partkey, place FROM (SELECT p_brand, p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS INTEGER) AS place FROM part) x WHERE place <= 3")
def k03(spark, sf):
    """A table function of SQL over a partitioned table."""
    tables.register(spark)
    return spark.sql("SELECT p_brand, p_partkey, place FROM first_rows(TABLE(SELECT p_brand, p_partkey, p_retailprice FROM {part}) PARTITION BY p_brand ORDER BY (p_retailprice DESC, p_partkey), n => 3)", part=table(spark, sf, "part"))
