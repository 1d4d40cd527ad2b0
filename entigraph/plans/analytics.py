"""Queries of statistics, graph, search, resolution, ontology, quality and views (G, P, R, O, V, Z)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..fixtures import entities, relationships, table
from ..operators import aggregate as agg
from ..operators import graph, ontology, quality, resolve, search, visual
from ..operators.gramindex import GramIndex
from ..operators.quality import Rule
from ..session import shared_folder
from .registry import query as register


@register("g01_count_by_type", "SELECT relationship_type, count(*) AS n FROM relationships GROUP BY relationship_type", graph=True)
def g01(spark, sf):
    return agg.counts_by(relationships(spark, sf), "relationship_type")


@register("g02_graph_statistics", "SELECT v AS n_entities, e AS n_relationships, round(2.0 * e / greatest(v, 1), 6) AS avg_relationships FROM (SELECT count(*) AS v FROM entities WHERE is_active) a, (SELECT count(*) AS e FROM relationships WHERE is_active) b".replace("2.0 *", "CAST(2 AS DOUBLE) *"), graph=True)
def g02(spark, sf):
    return agg.graph_statistics(entities(spark, sf), relationships(spark, sf)).withColumn("avg_relationships", F.round("avg_relationships", 6))


@register("g03_degree_top", """SELECT e.id, count(x.own) AS relationship_count FROM entities e LEFT JOIN (SELECT source_entity_id AS own FROM relationships UNION ALL SELECT target_entity_id FROM relationships WHERE source_entity_id <> target_entity_id) x ON x.own = e.id GROUP BY e.id ORDER BY relationship_count DESC, e.id LIMIT 20""", graph=True)
def g03(spark, sf):
    return graph.degrees(entities(spark, sf), relationships(spark, sf)).orderBy(F.desc("relationship_count"), "id").limit(20).select("id", "relationship_count")


@register("g04_group_having", "SELECT source_entity_id, count(*) AS n FROM relationships WHERE relationship_type = 'SUPPLIES' GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, source_entity_id LIMIT 50", graph=True)
def g04(spark, sf):
    return relationships(spark, sf).where("relationship_type = 'SUPPLIES'").groupBy("source_entity_id").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "source_entity_id").limit(50)


@register("g05_recent_of_types", "SELECT event_id FROM events WHERE event_type IN ('signup', 'purchase', 'error') ORDER BY ts DESC, event_id LIMIT 25")
def g05(spark, sf):
    return table(spark, sf, "events").where(F.col("event_type").isin("signup", "purchase", "error")).orderBy(F.desc("ts"), "event_id").limit(25).select("event_id")


@register("g06_conditional_counts", "SELECT count(*) FILTER (WHERE o_orderstatus = 'O') AS \"n_O\", count(*) FILTER (WHERE o_orderstatus = 'F') AS \"n_F\", count(*) FILTER (WHERE o_orderstatus = 'P') AS \"n_P\", count(*) AS n_total FROM orders")
def g06(spark, sf):
    return agg.conditional_counts(table(spark, sf, "orders"), "o_orderstatus", ("O", "F", "P"))


@register("g08_completeness", "SELECT entity_type, round(avg(CASE WHEN entity_text <> '' AND label IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS completeness FROM entities GROUP BY 1".replace("1.0 ELSE 0.0", "CAST(1 AS DOUBLE) ELSE 0"), graph=True)
def g08(spark, sf):
    return agg.share_of(entities(spark, sf), (F.col("entity_text") != "") & F.col("label").isNotNull(), "completeness", "entity_type").withColumn("completeness", F.round("completeness", 6))


@register("g09_accuracy", "SELECT round(avg(CASE WHEN is_verified THEN least(confidence * 1.2, 1) ELSE confidence END), 6) AS accuracy FROM entities", graph=True)
def g09(spark, sf):
    return agg.accuracy(entities(spark, sf)).withColumn("accuracy", F.round("accuracy", 6))


@register("g14_trend", "WITH d AS (SELECT CAST(ts AS DATE) AS day, avg(value) AS score FROM events GROUP BY 1), l AS (SELECT *, row_number() OVER (ORDER BY day DESC) AS p FROM d), m AS (SELECT avg(score) FILTER (WHERE p <= 3) AS recent, avg(score) FILTER (WHERE p BETWEEN 4 AND 7) AS earlier FROM l) SELECT round(recent, 6) AS recent, round(earlier, 6) AS earlier, CASE WHEN recent - earlier > 0.05 THEN 'improving' WHEN recent - earlier < -0.05 THEN 'declining' ELSE 'stable' END AS trend FROM m")
def g14(spark, sf):
    daily = table(spark, sf, "events").groupBy(F.col("ts").cast("date").alias("day")).agg(F.avg("value").alias("score"))
    return agg.trend(daily, "day", "score").select(F.round("recent", 6).alias("recent"), F.round("earlier", 6).alias("earlier"), "trend")


@register("g15_rule_metrics", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(sum(value), 4) AS total, round(max(value), 6) AS most, round(CASE WHEN count(*) = 0 THEN 0 ELSE CAST(count(*) FILTER (WHERE value > 50) AS DOUBLE) / count(*) END, 6) AS share FROM events GROUP BY 1")
def g15(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.sum("value"), 4).alias("total"), F.round(F.max("value"), 6).alias("most"), F.round(F.when(F.count("*") == 0, 0.0).otherwise(F.count_if(F.col("value") > 50) / F.count("*")), 6).alias("share"))


@register("g18_mapping_statistics", "SELECT count(*) AS n, count(*) FILTER (WHERE is_verified) AS n_verified, count(*) FILTER (WHERE is_active) AS n_active, count(*) FILTER (WHERE confidence >= 0.7) AS n_sure FROM entities", graph=True)
def g18(spark, sf):
    return entities(spark, sf).agg(F.count("*").alias("n"), F.count_if("is_verified").alias("n_verified"), F.count_if("is_active").alias("n_active"), F.count_if(F.col("confidence") >= 0.7).alias("n_sure"))


@register("g20_domain_overview", "SELECT r_name, count(DISTINCT n_nationkey) AS n_nations, count(DISTINCT c_custkey) AS n_customers FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name")
def g20(spark, sf):
    return table(spark, sf, "region").join(table(spark, sf, "nation"), F.col("n_regionkey") == F.col("r_regionkey"), "left").join(table(spark, sf, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("r_name").agg(F.count_distinct("n_nationkey").alias("n_nations"), F.count_distinct("c_custkey").alias("n_customers"))


@register("g22_system_statistics", "SELECT (SELECT count(DISTINCT user_id) FROM events) AS n_users, (SELECT count(*) FROM events WHERE event_type = 'error') AS n_errors, (SELECT round(sum(value), 4) FROM events) AS total")
def g22(spark, sf):
    return table(spark, sf, "events").agg(F.count_distinct("user_id").alias("n_users"), F.count_if(F.col("event_type") == "error").alias("n_errors"), F.round(F.sum("value"), 4).alias("total"))


@register("g23_vector_quality", "SELECT label, count(*) AS n, CAST(max(len(embedding)) AS INTEGER) AS dim, round(avg(s), 6) AS norm_mean, round(stddev_pop(s), 6) AS norm_std, round(min(s), 6) AS norm_min, round(max(s), 6) AS norm_max FROM (SELECT *, sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS s FROM embeddings) x GROUP BY label")
def g23(spark, sf):
    rows = agg.vector_quality(table(spark, sf, "embeddings"), "label")
    return rows.select("label", "n", "dim", *[F.round(c, 6).alias(c) for c in ("norm_mean", "norm_std", "norm_min", "norm_max")])


@register("g24_chart", "SELECT o_orderpriority AS x, o_orderstatus AS series, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1, 2")
def g24(spark, sf):
    return agg.chart(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice", "o_orderstatus").withColumn("value", F.round("value", 2))


@register("g28_step_metrics", "SELECT CAST(l_linenumber AS VARCHAR) AS step_id, count(*) AS n_runs, round(avg(l_quantity), 6) AS avg_seconds, round(sum(l_discount) / sum(l_tax + 1), 6) AS success_rate FROM lineitem GROUP BY 1")
def g28(spark, sf):
    runs = table(spark, sf, "lineitem").select(F.col("l_linenumber").cast("string").alias("step_id"), F.col("l_quantity").alias("seconds"), F.col("l_discount").alias("n_out"), (F.col("l_tax") + 1).alias("n_in"))
    return agg.run_metrics(runs).select("step_id", "n_runs", F.round("avg_seconds", 6).alias("avg_seconds"), F.round("success_rate", 6).alias("success_rate"))


@register("g29_distinct_types", "SELECT DISTINCT entity_type FROM entities", graph=True)
def g29(spark, sf):
    return entities(spark, sf).select("entity_type").distinct()


@register("g31_profile", "SELECT 's_suppkey' AS column_name, count(*) AS n, count(*) FILTER (WHERE s_suppkey IS NULL) AS n_null, count(DISTINCT s_suppkey) AS n_distinct, min(CAST(s_suppkey AS VARCHAR)) AS least, max(CAST(s_suppkey AS VARCHAR)) AS most FROM supplier UNION ALL SELECT 's_name', count(*), count(*) FILTER (WHERE s_name IS NULL), count(DISTINCT s_name), min(s_name), max(s_name) FROM supplier UNION ALL SELECT 's_nationkey', count(*), count(*) FILTER (WHERE s_nationkey IS NULL), count(DISTINCT s_nationkey), min(CAST(s_nationkey AS VARCHAR)), max(CAST(s_nationkey AS VARCHAR)) FROM supplier")
def g31(spark, sf):
    return agg.profile(table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey"))


@register("g32_rollup", "SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)")
def g32(spark, sf):
    return table(spark, sf, "orders").rollup("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))


_SYM = ", sym AS (SELECT source_entity_id AS own, target_entity_id AS far, relationship_type FROM relationships UNION ALL SELECT target_entity_id, source_entity_id, relationship_type FROM relationships)"


@register("p07_fixed_path", "SELECT 's:' || s_suppkey AS n0, 'n:' || n_nationkey AS n1, 'r:' || r_regionkey AS n2 FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def p07(spark, sf):
    return graph.fixed_path(relationships(spark, sf), entities(spark, sf).where("entity_type = 'ORGANIZATION'"), ("LOCATED_IN", "LOCATED_IN"))


@register("p08_trails", ", t AS (SELECT source_entity_id AS start, target_entity_id AS node, 1 AS hops FROM relationships WHERE relationship_type = 'LOCATED_IN' UNION ALL SELECT t.start, r.target_entity_id, t.hops + 1 FROM t JOIN relationships r ON r.source_entity_id = t.node AND r.relationship_type = 'LOCATED_IN' WHERE hops < 3) SELECT start, node, hops FROM t WHERE start LIKE 's:%'", graph=True)
def p08(spark, sf):
    return graph.trails(relationships(spark, sf), entities(spark, sf).where("entity_type = 'ORGANIZATION'"), 3, ("LOCATED_IN",)).select("start", "node", "hops")


@register("p09_neighbours", _SYM + ", h1 AS (SELECT DISTINCT far AS node FROM sym WHERE own = 'n:4' AND relationship_type = 'LOCATED_IN'), h2 AS (SELECT DISTINCT s.far AS node FROM sym s JOIN h1 ON s.own = h1.node WHERE relationship_type = 'LOCATED_IN') SELECT node, 1 AS depth FROM h1 UNION ALL SELECT node, 2 FROM h2 WHERE node <> 'n:4' AND node NOT IN (SELECT node FROM h1)", graph=True)
def p09(spark, sf):
    start = entities(spark, sf).where("id = 'n:4'").select("id")
    return graph.neighbours(relationships(spark, sf), start, 2, ("LOCATED_IN",)).where("depth > 0").select("node", "depth")


@register("p10_subgraph", _SYM + ", near AS (SELECT DISTINCT far AS node FROM sym WHERE own = 'n:4' AND far <> 'n:4'), top AS (SELECT e.id FROM entities e JOIN near ON node = e.id ORDER BY confidence DESC, e.id LIMIT 30), ids AS (SELECT id FROM top UNION SELECT 'n:4') SELECT id FROM relationships WHERE source_entity_id IN (SELECT id FROM ids) AND target_entity_id IN (SELECT id FROM ids)", graph=True)
def p10(spark, sf):
    e = entities(spark, sf)
    return graph.subgraph(e, relationships(spark, sf), e.where("id = 'n:4'"), 1, 30)[1].select("id")


@register("p11_shortest_lengths", _SYM + ", h1 AS (SELECT DISTINCT far AS node FROM sym WHERE own = 'r:0'), h2 AS (SELECT DISTINCT s.far AS node FROM sym s JOIN h1 ON s.own = h1.node), h3 AS (SELECT DISTINCT s.far AS node FROM sym s JOIN h2 ON s.own = h2.node) SELECT node, min(d) AS hops FROM (SELECT node, 1 AS d FROM h1 UNION ALL SELECT node, 2 FROM h2 UNION ALL SELECT node, 3 FROM h3) x WHERE node <> 'r:0' GROUP BY node", graph=True)
def p11(spark, sf):
    start = entities(spark, sf).where("id = 'r:0'").select("id")
    return graph.shortest_lengths(relationships(spark, sf), start, 3).select("node", "hops")


@register("p11_all_shortest_paths", ", q AS (SELECT 'c:' || c_custkey AS c, 's:' || (c_custkey % 7) AS s FROM customer WHERE c_custkey % 10 = 0) SELECT c AS source, s AS target, 2 AS hops, c || '>' || a.target_entity_id || '>' || s AS path FROM q JOIN relationships a ON a.source_entity_id = c AND a.relationship_type = 'PURCHASED' JOIN relationships b ON b.source_entity_id = s AND b.target_entity_id = a.target_entity_id AND b.relationship_type = 'SUPPLIES'", graph=True)
def p11_paths(spark, sf):
    """All paths of two hops between customers and suppliers, by the parts that both know."""
    k = F.col("c_custkey")
    pairs = table(spark, sf, "customer").where(k % 10 == 0).select(F.concat(F.lit("c:"), k.cast("string")).alias("source"), F.concat(F.lit("s:"), (k % 7).cast("string")).alias("target"))
    found = graph.shortest_paths(relationships(spark, sf), pairs, 2, ("PURCHASED", "SUPPLIES"))
    return found.select("source", "target", "hops", F.array_join("path", ">").alias("path"))


@register("p14_connected", _SYM + " SELECT id, entity_text FROM entities WHERE id IN (SELECT far FROM sym WHERE own = 'n:9')", graph=True)
def p14(spark, sf):
    return graph.connected(entities(spark, sf), relationships(spark, sf), "n:9").select("id", "entity_text")


@register("p01_exact_search", "SELECT id, CAST(1 AS DOUBLE) AS score FROM entities WHERE contains(lower(entity_text), 'an') AND entity_type IN ('COUNTRY', 'PRODUCT')", graph=True)
def p01(spark, sf):
    return search.exact(entities(spark, sf), "AN", ("COUNTRY", "PRODUCT")).select("id", "score")


@register("p02_fuzzy_search", "SELECT id, round(1 - CAST(levenshtein(lower(entity_text), 'customer#000000012') AS DOUBLE) / greatest(length(entity_text), 18), 6) AS score FROM entities WHERE 1 - CAST(levenshtein(lower(entity_text), 'customer#000000012') AS DOUBLE) / greatest(length(entity_text), 18) > 0.5", graph=True)
def p02(spark, sf):
    return search.fuzzy(entities(spark, sf), "Customer#000000012").select("id", F.round("score", 6).alias("score"))


def _indexed(spark, sf):
    """An index over all entities, made in two segments; the second replaces what it repeats."""
    index = GramIndex(spark, f"{shared_folder(spark)}/grams-{uuid.uuid4().hex}")
    e = entities(spark, sf)
    index.add(e.where("num % 5 <> 0 OR entity_type <> 'PRODUCT'"))
    index.add(e.where("entity_type = 'PRODUCT'"))
    return index


@register("p01_indexed_search", "SELECT id, CAST(1 AS DOUBLE) AS score FROM entities WHERE contains(lower(entity_text), 'late') OR contains(lower(entity_text), '#00000001')", graph=True)
def p01_indexed(spark, sf):
    index = _indexed(spark, sf)
    return index.containing("LATE").unionByName(index.containing("#00000001")).select("id", "score").distinct()


@register("p02_indexed_search", "SELECT id, round(1 - CAST(levenshtein(lower(entity_text), 'customer#000000012') AS DOUBLE) / greatest(length(entity_text), 18), 6) AS score FROM entities WHERE 1 - CAST(levenshtein(lower(entity_text), 'customer#000000012') AS DOUBLE) / greatest(length(entity_text), 18) > 0.88", graph=True)
def p02_indexed(spark, sf):
    return _indexed(spark, sf).fuzzy("Customer#000000012", 0.88).select("id", F.round("score", 6).alias("score"))


_COS = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


@register("p03_semantic_search", f"SELECT a.vec_id AS query_id, b.vec_id, round({_COS}, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND {_COS} >= 0.3")
def p03(spark, sf):
    v = table(spark, sf, "embeddings")
    return search.semantic(v, v.where("vec_id % 100 = 0"), 0.3).select("query_id", "vec_id", F.round("score", 6).alias("score"))


@register("p04_hybrid_search", f"WITH s AS (SELECT b.vec_id AS id, {_COS} AS s FROM embeddings a, embeddings b WHERE a.vec_id = 0 AND b.vec_id <> 0 AND {_COS} >= 0.1), e AS (SELECT vec_id AS id FROM embeddings WHERE label = 3) SELECT id, round(CASE WHEN s.s IS NOT NULL AND e.id IS NOT NULL THEN 0.7 + 0.3 * s.s WHEN e.id IS NOT NULL THEN 1 ELSE s.s END, 6) AS score FROM s FULL JOIN e USING (id)")
def p04(spark, sf):
    v = table(spark, sf, "embeddings")
    near = search.semantic(v, v.where("vec_id = 0"), 0.1).select(F.col("vec_id").alias("id"), "score")
    return search.hybrid(v.where("label = 3").select(F.col("vec_id").alias("id")), near).select("id", F.round("score", 6).alias("score"))


@register("r01_exact_resolution", "SELECT lower(p_name) AS t, id FROM (SELECT p_name, 'p:' || p_partkey AS id, row_number() OVER (PARTITION BY lower(p_name) ORDER BY CAST(p_partkey % 100 AS DOUBLE) / 100 DESC, 'p:' || p_partkey) AS n FROM part) x WHERE n = 1")
def r01(spark, sf):
    return resolve.resolve_exact(entities(spark, sf).where("entity_type = 'PRODUCT'")).select(F.lower("entity_text").alias("t"), "id")


@register("r02_fuzzy_resolution")
def r02(spark, sf):
    return resolve.resolve_fuzzy(entities(spark, sf))


@register("r04_resolution_statistics", "SELECT count(*) AS n_original, count(DISTINCT entity_type || '|' || lower(entity_text)) AS n_resolved, count(*) - count(DISTINCT entity_type || '|' || lower(entity_text)) AS n_merged FROM entities", graph=True)
def r04(spark, sf):
    e = entities(spark, sf)
    return resolve.resolution_statistics(e, resolve.resolve_exact(e))


_WL = "CASE WHEN lower(a.n) = lower(b.n) THEN 1 ELSE (CAST(len(list_intersect(list_distinct(string_split(lower(a.n), ' ')), list_distinct(string_split(lower(b.n), ' ')))) AS DOUBLE) / len(list_distinct(list_concat(string_split(lower(a.n), ' '), string_split(lower(b.n), ' ')))) + jaccard(lower(a.n), lower(b.n))) / 2 END"


@register("r07_new_conflicts", "SELECT o_orderkey AS entity_id, o_custkey AS other_id FROM orders WHERE o_orderstatus = 'F' AND NOT EXISTS (SELECT 1 FROM orders k WHERE k.o_orderpriority = '1-URGENT' AND least(k.o_orderkey, k.o_custkey) = least(orders.o_orderkey, orders.o_custkey) AND greatest(k.o_orderkey, k.o_custkey) = greatest(orders.o_orderkey, orders.o_custkey))")
def r07(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("entity_id"), F.col("o_custkey").alias("other_id"), "o_orderstatus", "o_orderpriority")
    known = o.where("o_orderpriority = '1-URGENT'").select(F.col("other_id").alias("entity_id"), F.col("entity_id").alias("other_id"))
    return resolve.new_conflicts(o.where("o_orderstatus = 'F'").select("entity_id", "other_id"), known)


@register("r10_contradictions", "SELECT count(*) AS n, round(sum(least(ac, bc)), 6) AS total FROM (SELECT CAST(a.o_orderkey % 100 AS DOUBLE) / 100 AS ac, CAST(b.o_orderkey % 100 AS DOUBLE) / 100 AS bc FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND CAST(a.o_orderkey AS VARCHAR) < CAST(b.o_orderkey AS VARCHAR) WHERE (a.o_orderstatus = 'O' AND b.o_orderstatus = 'F') OR (a.o_orderstatus = 'F' AND b.o_orderstatus = 'O')) x")
def r10(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").alias("source_entity_id"), F.lit("x").alias("target_entity_id"), F.when(F.col("o_orderstatus") == "O", "OWNS").when(F.col("o_orderstatus") == "F", "SOLD").otherwise("OTHER").alias("relationship_type"), ((F.col("o_orderkey") % 100) / 100.0).alias("confidence"))
    return resolve.contradictions(o).agg(F.count("*").alias("n"), F.round(F.coalesce(F.sum("score"), F.lit(0.0)), 6).alias("total"))


@register("r11_overlapping_times", "SELECT id, CASE WHEN e < s THEN 'ends_before_start' ELSE 'overlaps_next' END AS problem FROM (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderdate AS s, o_orderdate + INTERVAL 30 DAY AS e, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, CAST(o_orderkey AS VARCHAR)) AS nx FROM orders) x WHERE e < s OR nx < e")
def r11(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").alias("source_entity_id"), F.lit("P").alias("relationship_type"), F.col("o_orderdate").alias("start"), (F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("end"))
    return resolve.overlapping_times(o).select("id", "problem")


@register("r13_merge_entities", "WITH r AS (SELECT 'c:' || c_custkey AS s, 'LOCATED_IN' AS k, 'n:' || (CASE WHEN c_nationkey % 5 = 4 THEN c_nationkey - 1 ELSE c_nationkey END) AS t FROM customer) SELECT DISTINCT s AS source_entity_id, t AS target_entity_id FROM r")
def r13(spark, sf):
    mapping = table(spark, sf, "nation").where("n_nationkey % 5 = 4").select(F.concat(F.lit("n:"), F.col("n_nationkey").cast("string")).alias("loser"), F.concat(F.lit("n:"), (F.col("n_nationkey") - 1).cast("string")).alias("winner"))
    edges = relationships(spark, sf).where("relationship_type = 'LOCATED_IN' AND source_entity_id LIKE 'c:%'")
    return resolve.merge_entities(entities(spark, sf), edges, mapping)[1].select("source_entity_id", "target_entity_id")


@register("r17_rule_resolution", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_orderkey % 100 >= 95 THEN 'merge' WHEN o_custkey % 10 > o_orderkey % 10 + 2 THEN 'keep_source' END AS resolution FROM orders")
def r17(spark, sf):
    o = table(spark, sf, "orders")
    c = o.select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "possible_duplicate").otherwise("x").alias("conflict_type"), ((F.col("o_orderkey") % 100) / 100.0).alias("score"), ((F.col("o_custkey") % 10) / 10.0 + 1e-9).alias("source_reliability"), ((F.col("o_orderkey") % 10) / 10.0 + 2e-9).alias("target_reliability"))
    return resolve.by_rule(c).select("o_orderkey", "resolution")


@register("r18_completeness_score", "SELECT c_custkey, round(0.1 * 3 + 0.3 * 2 + 0.4 * (CAST(c_custkey % 100 AS DOUBLE) / 100) + CASE WHEN c_custkey % 3 = 0 THEN 0.5 ELSE 0 END + 0.2 * 0.5 + 0.3 * greatest(0, 1 - CAST(c_custkey % 500 AS DOUBLE) / 365), 6) AS score FROM customer")
def r18(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select("c_custkey", F.round(resolve.completeness(F.lit(3), F.lit(2), (k % 100) / 100.0, k % 3 == 0, F.lit(0.5), k % 500), 6).alias("score"))


_MAP = "(VALUES ('customer', 'u:client', 0.9), ('Customer', 'u:low', 0.75), ('product', 'u:thing', 0.8), ('country', 'u:place', 0.6)) AS m(type_key, class_uri, confidence)"
_MAP_ROWS = [("customer", "u:client", 0.9), ("Customer", "u:low", 0.75), ("product", "u:thing", 0.8), ("country", "u:place", 0.6)]


@register("o01_map_types", f"SELECT entity_type, count(*) AS n_total, count(class_uri) AS n_mapped, count(*) - count(class_uri) AS n_unmapped, round(CAST(count(class_uri) AS DOUBLE) / count(*), 6) AS coverage FROM entities LEFT JOIN (SELECT lower(type_key) AS k, arg_max(class_uri, confidence) AS class_uri FROM {_MAP} WHERE confidence >= 0.7 GROUP BY 1) b ON k = lower(entity_type) GROUP BY entity_type", graph=True)
def o01(spark, sf):
    mappings = spark.createDataFrame(_MAP_ROWS, "type_key string, class_uri string, confidence double")
    return ontology.mapping_coverage(ontology.map_types(entities(spark, sf), mappings)).withColumn("coverage", F.round("coverage", 6))


@register("o03_map_fuzzy")
def o03(spark, sf):
    mappings = spark.createDataFrame(_MAP_ROWS, "type_key string, class_uri string, confidence double")
    return ontology.map_fuzzy(entities(spark, sf).select("entity_type"), mappings)


@register("o08_suggest_types", "SELECT n_name AS name, CAST(row_number() OVER (ORDER BY c DESC, n_name) AS INTEGER) AS rank_no, c AS suggestion_confidence FROM (SELECT n_name, CAST(CASE WHEN n_name ILIKE '%an%' THEN 0.8 ELSE 0.6 END AS DOUBLE) AS c FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_name ILIKE '%an%' OR r_name ILIKE '%an%' ORDER BY c DESC, n_name LIMIT 5) x")
def o08(spark, sf):
    named = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("name"), F.col("r_name").alias("description"))
    return ontology.suggest(named, "an")


@register("d07_endpoint_violations", "SELECT id FROM relationships WHERE relationship_type = 'LOCATED_IN' AND source_entity_id NOT LIKE 'c:%'", graph=True)
def d07(spark, sf):
    allowed = spark.createDataFrame([("LOCATED_IN", ["CUSTOMER"], []), ("SUPPLIES", [], ["PRODUCT"])], "relationship_type string, source_types array<string>, target_types array<string>")
    return ontology.endpoint_violations(relationships(spark, sf), entities(spark, sf), allowed).select("id")


@register("o14_backfill_types", "SELECT CAST(row_number() OVER (ORDER BY entity_type) + 1 AS INTEGER) AS id, entity_type AS name FROM (SELECT DISTINCT entity_type FROM entities WHERE entity_type <> 'PRODUCT') x UNION ALL SELECT 1, 'PRODUCT'", graph=True)
def o14(spark, sf):
    return ontology.backfill_types(entities(spark, sf), spark.createDataFrame([(1, "PRODUCT")], "id int, name string"))


_TRIPLES = "WITH t AS (SELECT n_nationkey, 'http://x/fibo/ontology/D' || n_regionkey || '/N' || n_nationkey AS uri, n_name, n_regionkey FROM nation) "


def _triples(spark, sf):
    n = table(spark, sf, "nation")
    uri = F.concat(F.lit("http://x/fibo/ontology/D"), F.col("n_regionkey").cast("string"), F.lit("/N"), F.col("n_nationkey").cast("string"))
    parent = F.concat(F.lit("http://x/fibo/ontology/R"), F.col("n_regionkey").cast("string"))
    rows = [(ontology._TYPE, F.lit(f"{ontology._OWL}Class")), (f"{ontology._RDFS}label", F.col("n_name")), (f"{ontology._RDFS}label", F.lit("second")), (f"{ontology._RDFS}subClassOf", F.lit("_:blank")), (f"{ontology._RDFS}subClassOf", parent)]
    out = None
    for i, (p, o) in enumerate(rows):
        r = n.select(uri.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(i).alias("n"))
        out = r if out is None else out.unionAll(r)
    return out


@register("a20_ontology_classes", _TRIPLES + "SELECT uri, n_name AS label, CAST(NULL AS VARCHAR) AS description, 'http://x/fibo/ontology/R' || n_regionkey AS parent_class_uri, 'D' || n_regionkey AS domain FROM t")
def a20(spark, sf):
    return ontology.classes(_triples(spark, sf))


@register("a22_parent_ids", _TRIPLES + "SELECT uri, sha256(uri) AS id, CAST(NULL AS VARCHAR) AS parent_class_id FROM t")
def a22(spark, sf):
    return ontology.with_parent_ids(ontology.classes(_triples(spark, sf))).select("uri", "id", "parent_class_id")


RULES = [Rule("r1", ("*",), "entity_text", "not_empty"), Rule("r2", ("CUSTOMER", "PRODUCT"), "label", "min_length", "9"), Rule("r3", ("COUNTRY",), "entity_text", "matches_pattern", "^[A-M].*"), Rule("r4", ("PRODUCT",), "entity_text", "unique", "type"), Rule("r5", ("*",), "amount", "range", "0,9000", "error")]


@register("v01_rule_violations", "SELECT 'r2' AS rule_id, id FROM entities WHERE entity_type IN ('CUSTOMER', 'PRODUCT') AND (label IS NULL OR length(label) < 9) UNION ALL SELECT 'r3', id FROM entities WHERE entity_type = 'COUNTRY' AND NOT regexp_matches(entity_text, '^[A-M].*') UNION ALL SELECT 'r4', id FROM (SELECT id, count(*) OVER (PARTITION BY entity_text) AS n FROM entities WHERE entity_type = 'PRODUCT') x WHERE n > 1 UNION ALL SELECT 'r5', id FROM entities WHERE amount < 0 OR amount > 9000 UNION ALL SELECT 'r1', id FROM entities WHERE entity_text IS NULL OR trim(entity_text) = ''", graph=True)
def v01(spark, sf):
    return quality.violations(entities(spark, sf), RULES).select("rule_id", "id")


@register("v05_rule_summary", "SELECT 'r1' AS rule_id, count(*) FILTER (WHERE entity_text IS NULL) AS n_violations FROM entities UNION ALL SELECT 'r5', count(*) FILTER (WHERE amount < 0 OR amount > 9000) FROM entities", graph=True)
def v05(spark, sf):
    some = [RULES[0], RULES[4]]
    return quality.rule_summary(quality.violations(entities(spark, sf), some), some)


@register("g13_quality_report", ", b AS (SELECT count(*) AS n, avg(CASE WHEN label IS NOT NULL THEN CAST(1 AS DOUBLE) ELSE 0 END) AS c, avg(CASE WHEN confidence BETWEEN 0 AND 1 THEN CAST(1 AS DOUBLE) ELSE 0 END) AS v, avg(CASE WHEN is_verified THEN least(confidence * 1.2, 1) ELSE confidence END) AS a FROM entities), x AS (SELECT c, a, v, greatest(0, 1 - 2 * CAST((SELECT count(*) FROM entities WHERE NOT is_active) AS DOUBLE) / n) AS k, greatest(0, 1 - 2 * CAST(10 AS DOUBLE) / n) AS u FROM b) SELECT round(c, 6) AS completeness, round(a, 6) AS accuracy, round(k, 6) AS consistency, round(v, 6) AS validity, round(u, 6) AS uniqueness, round((c + a + k + v + u) / 5, 6) AS overall, array_to_string(list_filter([CASE WHEN c < 0.7 THEN 'improve completeness' END, CASE WHEN a < 0.7 THEN 'improve accuracy' END, CASE WHEN k < 0.7 THEN 'improve consistency' END, CASE WHEN v < 0.7 THEN 'improve validity' END, CASE WHEN u < 0.7 THEN 'improve uniqueness' END], lambda q: q IS NOT NULL), '; ') AS advice FROM x", graph=True)
def g13(spark, sf):
    e = entities(spark, sf)
    found = quality.report(e, F.col("label").isNotNull(), F.col("confidence").between(0, 1), e.agg(F.count_if(~F.col("is_active")).alias("n")), spark.range(1).select(F.lit(10).alias("n")))
    return found.select(*[F.round(c, 6).alias(c) if c != "advice" else F.col(c) for c in found.columns])


@register("z01_graph_nodes", "SELECT id, entity_text AS label, entity_type AS \"group\", CASE entity_type WHEN 'CUSTOMER' THEN '#4285F4' WHEN 'ORGANIZATION' THEN '#34A853' WHEN 'PRODUCT' THEN '#FBBC05' WHEN 'LOCATION' THEN '#EA4335' ELSE '#999999' END AS colour, round(greatest(10, least(50, 10 + confidence * 40)), 6) AS node_size FROM entities", graph=True)
def z01(spark, sf):
    return visual.nodes(entities(spark, sf)).withColumn("node_size", F.round("node_size", 6))


@register("z01_graph_edges", "SELECT id, source_entity_id AS source, target_entity_id AS target, relationship_type AS label FROM relationships WHERE source_entity_id LIKE 'n:%' AND target_entity_id LIKE 'r:%'", graph=True)
def z01_edges(spark, sf):
    return visual.edges(relationships(spark, sf), entities(spark, sf).where("entity_type IN ('COUNTRY', 'LOCATION')"))


@register("z03_table_view", "SELECT c_custkey, c_mktsegment AS segment FROM customer")
def z03(spark, sf):
    rows = table(spark, sf, "customer").withColumn("properties", F.create_map(F.lit("segment"), F.col("c_mktsegment")))
    return visual.table(rows, ["c_custkey", "properties.segment"])


@register("g25_scatter", "SELECT p_retailprice AS x, CAST(p_size AS DOUBLE) AS y FROM part")
def g25(spark, sf):
    return visual.scatter(table(spark, sf, "part"), "p_retailprice", "p_size")
