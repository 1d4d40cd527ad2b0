"""Queries of the relational surface: search, joins, sets, windows, order (C, D, W, L, U)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..fixtures import AS_OF, entities, relationships, table
from ..operators import aggregate as agg
from ..operators import graph, query, upsert
from ..operators.query import EntitySearch, QuerySpec
from .registry import query as register

_E = "id, entity_text, entity_type, confidence"
E4 = ["id", "entity_text", "entity_type", "confidence"]


@register("c01_query_builder", f"SELECT {_E} FROM entities WHERE entity_type IN ('CUSTOMER', 'PRODUCT') AND label IS NOT NULL AND lower(entity_text) LIKE '%1%' ORDER BY confidence DESC, id LIMIT 50 OFFSET 10", graph=True)
def c01(spark, sf):
    return QuerySpec(select=tuple(E4), where=(("entity_type", "in", ("CUSTOMER", "PRODUCT")), ("label", "is_null", False), ("entity_text", "ilike", "1")), order=(("confidence", True),), offset=10, limit=50).page(entities(spark, sf))


@register("c02_point_lookup", f"SELECT {_E} FROM entities WHERE id = 'n:7'", graph=True)
def c02(spark, sf):
    return QuerySpec(select=tuple(E4), where=(("id", "eq", "n:7"),)).page(entities(spark, sf))


@register("c03_entity_search", """, d AS (SELECT own, count(*) AS n FROM (SELECT source_entity_id AS own FROM relationships UNION ALL SELECT target_entity_id FROM relationships WHERE source_entity_id <> target_entity_id) x GROUP BY own)
SELECT e.id, entity_text, entity_type, confidence, coalesce(n, 0) AS relationship_count FROM entities e LEFT JOIN d ON e.id = d.own WHERE is_active AND confidence >= 0.2 AND entity_text ILIKE '%1%' ORDER BY confidence DESC, e.id LIMIT 25 OFFSET 5""", graph=True)
def c03(spark, sf):
    """The flagship: filters, degree, order, page."""
    page = EntitySearch(min_confidence=0.2, text="1").spec(offset=5, limit=25).page(entities(spark, sf))
    return graph.degrees(page, relationships(spark, sf)).select(*E4, "relationship_count")


@register("c03_entity_search_total", "SELECT count(*) AS total, count(*) > 30 AS has_more FROM entities WHERE is_active AND confidence >= 0.2 AND is_verified AND entity_type IN ('CUSTOMER', 'ORGANIZATION')", graph=True)
def c03_total(spark, sf):
    return EntitySearch(types=("CUSTOMER", "ORGANIZATION"), min_confidence=0.2, verified_only=True).spec(offset=5, limit=25).totals(entities(spark, sf))


@register("c04_relationship_search", """SELECT r.id, r.relationship_type, r.confidence, s.entity_text AS source_text, t.entity_text AS target_text FROM relationships r LEFT JOIN entities s ON s.id = source_entity_id LEFT JOIN entities t ON t.id = target_entity_id WHERE r.is_active AND r.relationship_type = 'LOCATED_IN' AND r.confidence >= 0.5""", graph=True)
def c04(spark, sf):
    found = EntitySearch(types=("LOCATED_IN",), type_column="relationship_type", min_confidence=0.5).spec(limit=None).filtered(relationships(spark, sf))
    return query.with_endpoints(found, entities(spark, sf)).select("id", "relationship_type", "confidence", "source_text", "target_text")


@register("c05_filter_algebra", f"SELECT {_E} FROM entities WHERE confidence > 0.1 AND confidence <= 0.9 AND num >= 5 AND num < 500 AND contains(lower(entity_text), 'cust') AND entity_type IN ('CUSTOMER')", graph=True)
def c05(spark, sf):
    df = entities(spark, sf)
    for f in (("confidence", "gt", 0.1), ("confidence", "lte", 0.9), ("num", "gte", 5), ("num", "lt", 500), ("entity_text", "contains", "Cust"), ("entity_type", "in", ("CUSTOMER",))):
        df = df.where(query.predicate(*f))
    return df.select(*E4)


@register("c06_semi_join_filter", f"SELECT {_E} FROM entities e WHERE EXISTS (SELECT 1 FROM relationships r JOIN entities t ON t.id = r.target_entity_id WHERE r.source_entity_id = e.id AND relationship_type = 'PURCHASED' AND t.label = 'Brand#11')", graph=True)
def c06(spark, sf):
    e = entities(spark, sf)
    return query.having_edge(e, relationships(spark, sf), "PURCHASED", "out", e.where("label = 'Brand#11'")).select(*E4)


@register("c07_any_column_search", f"SELECT {_E} FROM entities WHERE entity_text ILIKE '%7%' OR label ILIKE '%build%' OR entity_type ILIKE '%loc%'", graph=True)
def c07(spark, sf):
    return QuerySpec(select=tuple(E4), any_of=(("entity_text", "ilike", "7"), ("label", "ilike", "build"), ("entity_type", "ilike", "loc")), limit=None).page(entities(spark, sf))


@register("c08_type_usage", "SELECT entity_type, count(*) AS n_used, count(*) FILTER (WHERE is_verified) AS n_verified FROM entities GROUP BY entity_type", graph=True)
def c08(spark, sf):
    return entities(spark, sf).groupBy("entity_type").agg(F.count("*").alias("n_used"), F.count_if("is_verified").alias("n_verified"))


@register("c09_array_containment", "SELECT c_custkey FROM (SELECT c_custkey, list_distinct(list(o_orderstatus)) AS s FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey) x WHERE list_contains(s, 'P')")
def c09(spark, sf):
    held = table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_custkey").agg(F.collect_set("o_orderstatus").alias("statuses"))
    return held.where(query.predicate("statuses", "has", "P")).select("c_custkey")


@register("c13_json_path", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract_string(props, '$.k') = '3'")
def c13(spark, sf):
    k = F.get_json_object("props", "$.k")
    return table(spark, sf, "events").where(k == "3").select("event_id", k.cast("long").alias("k"))


@register("c14_review_queue", """SELECT o_orderkey, c_name, n_name, r_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey WHERE o_orderstatus IN ('P', 'O') ORDER BY o_orderdate, o_orderkey LIMIT 100""")
def c14(spark, sf):
    page = table(spark, sf, "orders").where(F.col("o_orderstatus").isin("P", "O")).orderBy("o_orderdate", "o_orderkey").limit(100)
    return page.join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"), "left").join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey"), "left").join(table(spark, sf, "region"), F.col("r_regionkey") == F.col("n_regionkey"), "left").select("o_orderkey", "c_name", "n_name", "r_name")


@register("c16_read_only_sql", "SELECT entity_type, count(*) AS n FROM entities GROUP BY entity_type", graph=True)
def c16(spark, sf):
    return query.read_only_sql(spark, "SELECT entity_type, count(*) AS n FROM {entities} GROUP BY entity_type", limit=1000, entities=entities(spark, sf))


@register("c19_visible_rows", "SELECT o_orderkey FROM orders WHERE o_custkey = 7 OR o_orderpriority = '1-URGENT'")
def c19(spark, sf):
    grants = spark.createDataFrame([(1, "orders")], "user_id long, resource string")
    return query.visible(table(spark, sf, "orders"), grants, 7, "o_custkey", "orders", F.col("o_orderpriority") == "1-URGENT").select("o_orderkey")


_RBAC = "WITH ur AS (SELECT DISTINCT user_id, user_id % 5 AS role_id FROM events), rp AS (SELECT n_regionkey AS role_id, n_nationkey AS permission_id FROM nation), p AS (SELECT n_nationkey AS permission_id, CASE WHEN n_nationkey % 2 = 0 THEN 'data:' ELSE 'graph:' END || n_nationkey AS name FROM nation) "


def _rbac(spark, sf):
    ur = table(spark, sf, "events").select("user_id", (F.col("user_id") % 5).alias("role_id")).distinct()
    n = table(spark, sf, "nation")
    rp = n.select(F.col("n_regionkey").alias("role_id"), F.col("n_nationkey").alias("permission_id"))
    p = n.select(F.col("n_nationkey").alias("permission_id"), F.concat(F.when(F.col("n_nationkey") % 2 == 0, "data:").otherwise("graph:"), F.col("n_nationkey").cast("string")).alias("name"))
    return query.permission_names(ur, rp, p)


@register("d01_has_permission", _RBAC + "SELECT DISTINCT user_id FROM ur WHERE EXISTS (SELECT 1 FROM rp JOIN p USING (permission_id) WHERE rp.role_id = ur.role_id AND name = 'data:4')")
def d01(spark, sf):
    return _rbac(spark, sf).where("name = 'data:4'").select("user_id").distinct()


@register("d02_user_permissions", _RBAC + "SELECT DISTINCT user_id, name, split_part(name, ':', 1) AS resource FROM ur JOIN rp USING (role_id) JOIN p USING (permission_id)")
def d02(spark, sf):
    return _rbac(spark, sf)


@register("d04_types_of_domain", "SELECT r_name, n_name FROM region JOIN nation ON n_regionkey = r_regionkey")
def d04(spark, sf):
    return table(spark, sf, "region").join(table(spark, sf, "nation"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name")


@register("d06_left_join_filtered_right", "SELECT c_custkey, count(o_orderkey) AS n_open, round(coalesce(avg(o_totalprice), 0), 6) AS avg_price FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'O' GROUP BY c_custkey")
def d06(spark, sf):
    opened = table(spark, sf, "orders").where("o_orderstatus = 'O'")
    return table(spark, sf, "customer").join(opened, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n_open"), F.round(F.coalesce(F.avg("o_totalprice"), F.lit(0.0)), 6).alias("avg_price"))


@register("d09_relationship_count", """SELECT e.id, count(x.own) AS relationship_count FROM entities e LEFT JOIN (SELECT source_entity_id AS own FROM relationships UNION ALL SELECT target_entity_id FROM relationships WHERE source_entity_id <> target_entity_id) x ON x.own = e.id GROUP BY e.id""", graph=True)
def d09(spark, sf):
    return graph.degrees(entities(spark, sf), relationships(spark, sf)).select("id", "relationship_count")


@register("d19_with_sources", "SELECT s_suppkey, n_name, count(DISTINCT l_partkey) AS n_parts FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey, n_name")
def d19(spark, sf):
    # pairs are made distinct before they are joined, dealt by both keys over the session's number of partitions
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey").repartition(width, "l_suppkey", "l_partkey").distinct()
    parts = pairs.groupBy("l_suppkey").agg(F.count("l_partkey").alias("n"))
    named = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("s_nationkey"), "left").select("s_suppkey", "n_name").distinct()
    return named.join(parts, F.col("l_suppkey") == F.col("s_suppkey"), "left").select("s_suppkey", "n_name", F.coalesce("n", F.lit(0)).alias("n_parts"))


@register("d20_any_condition_join", "SELECT n_nationkey, n_name FROM nation WHERE (n_regionkey = 1 AND n_nationkey > 3) OR n_name ILIKE '%an%'")
def d20(spark, sf):
    return table(spark, sf, "nation").where(((F.col("n_regionkey") == 1) & (F.col("n_nationkey") > 3)) | F.col("n_name").ilike("%an%")).select("n_nationkey", "n_name")


@register("d21_step_dependencies", "SELECT n_nationkey, part FROM (SELECT n_nationkey, n_regionkey, trim(unnest(string_split(inputs, ','))) AS part FROM nation, (SELECT string_agg(r_regionkey || ' ', ',' ORDER BY r_regionkey) AS inputs FROM region) r) x WHERE part = CAST(n_regionkey AS VARCHAR)")
def d21(spark, sf):
    listed = table(spark, sf, "region").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.col("r_regionkey").cast("string"), F.lit(" ")))), ",").alias("inputs"))
    n = table(spark, sf, "nation").join(listed, F.lit(True)).select("n_nationkey", "n_regionkey", F.explode(F.split("inputs", ",")).alias("part"))
    return n.select("n_nationkey", "n_regionkey", F.trim("part").alias("part")).where(F.col("part") == F.col("n_regionkey").cast("string")).select("n_nationkey", "part")


@register("d22_anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def d22(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@register("w01_keep_first", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS p FROM events) x WHERE p = 1")
def w01(spark, sf):
    from ..operators.resolve import keep_first

    return keep_first(table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@register("w03_top_n_per_level", "SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS p FROM events) x WHERE p <= 5")
def w03(spark, sf):
    best = Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id")
    return table(spark, sf, "events").withColumn("p", F.row_number().over(best)).where("p <= 5").select("event_type", "event_id")


@register("w05_repeated_edges", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderpriority, o_orderstatus ORDER BY CAST(o_orderkey AS VARCHAR)) AS p FROM orders) x WHERE p > 1")
def w05(spark, sf):
    edges = table(spark, sf, "orders").select(F.col("o_orderkey"), F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").alias("source_entity_id"), F.col("o_orderpriority").alias("relationship_type"), F.col("o_orderstatus").alias("target_entity_id"))
    return graph.repeated_edges(edges).select("o_orderkey")


@register("w08_sliding_rate", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n_in_window FROM events")
def w08(spark, sf):
    from ..streaming.limits import in_trailing_window

    return in_trailing_window(table(spark, sf, "events"), "user_id", "ts", 3600).select("event_id", "n_in_window")


@register("w09_fixed_window_rate", "SELECT event_id, row_number() OVER (PARTITION BY user_id, CAST(floor(epoch(ts) / 86400) AS BIGINT) ORDER BY ts, event_id) <= 2 AS allowed FROM events")
def w09(spark, sf):
    from ..streaming.limits import fixed_window

    return fixed_window(table(spark, sf, "events"), "user_id", "ts", "event_id", 2, 86_400).select("event_id", "allowed")


@register("l01_page_with_total", "SELECT o_orderkey, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def l01(spark, sf):
    orders = table(spark, sf, "orders")
    spec = QuerySpec(order=(("o_totalprice", True),), key="o_orderkey", offset=40, limit=20)
    return spec.page(orders).join(spec.totals(orders), F.lit(True)).select("o_orderkey", "total")


@register("l02_multi_key_sort", "SELECT s_suppkey, s_name FROM supplier ORDER BY s_nationkey, s_acctbal DESC, s_suppkey LIMIT 30 OFFSET 3")
def l02(spark, sf):
    return QuerySpec(select=("s_suppkey", "s_name"), order=(("s_nationkey", False), ("s_acctbal", True)), key="s_suppkey", offset=3, limit=30).page(table(spark, sf, "supplier"))


@register("l04_merge_feeds", "SELECT kind, k FROM (SELECT * FROM (SELECT 'order' AS kind, o_orderkey AS k, o_orderdate AS tm FROM orders ORDER BY tm DESC, k LIMIT 10) UNION ALL SELECT * FROM (SELECT 'event', event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 10)) x ORDER BY tm DESC, k LIMIT 20")
def l04(spark, sf):
    a = table(spark, sf, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("at"))
    b = table(spark, sf, "events").select(F.lit("event").alias("kind"), F.col("event_id").alias("k"), F.col("ts").alias("at"))
    return agg.newest(a, b, at="at", key="k").select("kind", "k")


@register("u01_both_neighbourhoods", "SELECT target_entity_id AS far FROM relationships WHERE source_entity_id = 'n:3' UNION SELECT source_entity_id FROM relationships WHERE target_entity_id = 'n:3'", graph=True)
def u01(spark, sf):
    return graph.both_ways(relationships(spark, sf)).where("own = 'n:3'").select("far").distinct()


@register("u02_edges_with_direction", "SELECT id, 'outgoing' AS direction FROM relationships WHERE source_entity_id = 'n:3' UNION ALL SELECT id, 'incoming' FROM relationships WHERE target_entity_id = 'n:3'", graph=True)
def u02(spark, sf):
    return graph.both_ways(relationships(spark, sf), "id").where("own = 'n:3'").select("id", "direction")


@register("u03_merge_lists", "SELECT o_orderkey, o_custkey, 1 AS list_no FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, o_custkey, 2 FROM orders WHERE o_orderstatus = 'O' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def u03(spark, sf):
    o = table(spark, sf, "orders")
    a = o.where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", F.lit(1).alias("list_no"))
    b = o.where("o_orderstatus = 'O'").select("o_orderkey", "o_custkey", F.lit(2).alias("list_no"))
    return a.unionByName(b.join(a.select("o_custkey").distinct(), "o_custkey", "left_anti"))


@register("b01_write_edges_by_text", """SELECT a.id AS source_entity_id, b.id AS target_entity_id, 'RELATED_TO' AS relationship_type, 0.5 AS confidence FROM
(SELECT n_name AS s, r_name AS t FROM nation JOIN region ON n_regionkey = r_regionkey) x JOIN (SELECT entity_text, max(id) AS id FROM entities GROUP BY 1) a ON a.entity_text = s JOIN (SELECT entity_text, max(id) AS id FROM entities GROUP BY 1) b ON b.entity_text = t""".replace("0.5 AS", "CAST(0.5 AS DOUBLE) AS"), graph=True)
def b01(spark, sf):
    none = F.lit(None)
    edges = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("source_text"), F.col("r_name").alias("target_text"), none.cast("string").alias("relationship_type"), none.cast("double").alias("confidence"))
    return upsert.resolve_edges(edges, entities(spark, sf))


@register("b02_upsert", "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'new' ELSE c_mktsegment END AS c_mktsegment FROM customer UNION ALL SELECT c_custkey + 10000000, 'new' FROM customer WHERE c_mktsegment = 'BUILDING'")
def b02(spark, sf):
    old = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    quarter = old.where("c_mktsegment = 'BUILDING'")
    new = quarter.select("c_custkey", F.lit("new").alias("c_mktsegment")).unionAll(quarter.select(F.col("c_custkey") + 10_000_000, F.lit("new")))
    return upsert.upsert(old, new, ["c_custkey"])


@register("b06_insert_missing", "SELECT p_name, min(p_brand) AS p_brand FROM part WHERE p_size > 25 GROUP BY p_name UNION ALL SELECT p_name, min(p_brand) FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_size > 25) GROUP BY p_name")
def b06(spark, sf):
    part = table(spark, sf, "part")
    by_name = lambda d: d.groupBy("p_name").agg(F.min("p_brand").alias("p_brand"))
    return upsert.insert_missing(by_name(part.where("p_size > 25")), by_name(part), ["p_name"])


@register("b08_property_merge", "SELECT c_custkey, 'x' AS a, c_mktsegment AS b, CAST(c_nationkey AS VARCHAR) AS c FROM customer")
def b08(spark, sf):
    from ..functions.properties import merge_over

    c = table(spark, sf, "customer")
    old = F.create_map(F.lit("a"), F.lit("x"), F.lit("b"), F.lit("old"))
    new = F.create_map(F.lit("b"), F.col("c_mktsegment"), F.lit("c"), F.col("c_nationkey").cast("string"))
    m = c.select("c_custkey", merge_over(old, new).alias("m"))
    return m.select("c_custkey", F.col("m")["a"].alias("a"), F.col("m")["b"].alias("b"), F.col("m")["c"].alias("c"))


@register("b09_soft_delete", "SELECT id, is_active AND NOT (entity_type = 'COUNTRY') AS is_active FROM entities", graph=True)
def b09(spark, sf):
    e = entities(spark, sf)
    return upsert.soft_delete(e, relationships(spark, sf), e.where("entity_type = 'COUNTRY'"))[0].select("id", "is_active")


@register("b10_hard_delete_edges", "SELECT id FROM relationships WHERE source_entity_id NOT LIKE 'n:%' AND target_entity_id NOT LIKE 'n:%'", graph=True)
def b10(spark, sf):
    e = entities(spark, sf)
    return upsert.hard_delete(e, relationships(spark, sf), e.where("entity_type = 'COUNTRY'"))[1].select("id")


@register("b13_edit_validation", "SELECT event_id, CASE WHEN event_type = 'click' AND value < 20 THEN 'entity_text is required' WHEN event_type = 'view' AND user_id % 10 = event_id % 10 THEN 'an entity can''t relate to itself' ELSE '' END AS errors FROM events")
def b13(spark, sf):
    e = table(spark, sf, "events")
    edits = e.select("event_id", F.when(F.col("event_type") == "click", "create_entity").when(F.col("event_type") == "view", "create_relationship").otherwise("none").alias("edit_type"), F.when(F.col("value") < 20, "").otherwise("t").alias("entity_text"), (F.col("user_id") % 10).cast("string").alias("source_entity_id"), (F.col("event_id") % 10).cast("string").alias("target_entity_id"), F.lit("T").alias("relationship_type"))
    return upsert.edit_errors(edits).select("event_id", "errors")


@register("b16_uniqueness_audit", "SELECT p_name, p_brand, count(*) AS n FROM part GROUP BY ALL HAVING count(*) > 1")
def b16(spark, sf):
    return upsert.uniqueness_audit(table(spark, sf, "part"), "p_name", "p_brand")


@register("t08_recent_activity", f"SELECT event_id FROM events WHERE ts > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AND ts <= TIMESTAMP '{AS_OF}'")
def t08(spark, sf):
    return agg.recent(table(spark, sf, "events"), "ts", AS_OF, 7).select("event_id")


@register("t09_tumbling_windows", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def t09(spark, sf):
    from ..streaming.windows import tumbling

    return tumbling(table(spark, sf, "events"), "ts", "1 day", "event_type", "value").select("start", "event_type", "n", F.round("total", 6).alias("total"))


@register("t09_sessions", """SELECT user_id, count(*) AS n_sessions FROM (SELECT user_id, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL THEN 1 END AS first FROM events) x WHERE first = 1 GROUP BY user_id""".replace("ts > lag(ts)", "ts >= lag(ts)"))
def t09_sessions(spark, sf):
    from ..streaming.windows import sessions

    return sessions(table(spark, sf, "events"), "ts", "6 hours", "user_id").groupBy("user_id").agg(F.count("*").alias("n_sessions"))
