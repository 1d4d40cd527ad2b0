"""Queries of inventory rows that the other modules only cover through shared helpers."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..fixtures import AS_OF, entities, relationships, table
from ..functions import properties as props
from ..functions import similarity as sim
from ..functions import text as tx
from ..operators import chunking, graph, ontology, resolve, search, upsert, visual
from ..sources import files, rdf
from .registry import query as register

_KEY = "CAST({} AS VARCHAR)"


def _files(rows, path, content):
    """(path, size, modified, media_type, content) as the binary source gives it."""
    data = content.cast("binary")
    return rows.select(path.alias("path"), F.octet_length(data).cast("long").alias("size"), F.lit(AS_OF).cast("timestamp").alias("modified"), tx.media_type(path).alias("media_type"), data.alias("content"))


# -- A: sources ---------------------------------------------------------------------------------


@register("a01_dispatch", "SELECT CAST(page_id AS VARCHAR) || CASE page_id % 3 WHEN 0 THEN '.txt' WHEN 1 THEN '.bin' ELSE '.doc' END AS path, CASE page_id % 3 WHEN 0 THEN md5(html) END AS h, CASE page_id % 3 WHEN 1 THEN 'unsupported file type: application/octet-stream' WHEN 2 THEN 'ValueError: the old .doc format is not supported' END AS error FROM pages")
def a01(spark, sf):
    path = F.concat(F.col("page_id").cast("string"), F.element_at(F.array(F.lit(".txt"), F.lit(".bin"), F.lit(".doc")), (F.col("page_id") % 3 + 1).cast("int")))
    return files.parsed(_files(table(spark, sf, "pages"), path, F.col("html"))).select("path", F.md5(F.col("text").cast("binary")).alias("h"), "error")


@register("a03_file_metadata", "SELECT 'in/' || page_id || '.HTML' AS path, octet_length(encode(html)) AS size, 'text/html' AS media_type, page_id || '.HTML' AS name, '.html' AS extension FROM pages")
def a03(spark, sf):
    path = F.concat(F.lit("in/"), F.col("page_id").cast("string"), F.lit(".HTML"))
    rows = _files(table(spark, sf, "pages"), path, F.col("html"))
    return rows.select("path", "size", "media_type", F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.lower(F.regexp_extract("path", r"(\.[^.]+)$", 1)).alias("extension"))


_CSV_SQL = "SELECT 'r' || n_regionkey || '.csv' AS path, 'key: ' || n_nationkey || ' | name: ' || n_name AS line FROM nation"


@register("a05_csv_rows", _CSV_SQL)
def a05(spark, sf):
    row = F.concat(F.col("n_nationkey").cast("string"), F.lit(',"'), F.col("n_name"), F.lit('"'))
    by_region = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list(row)), "\n").alias("rows"))
    read = files.parsed(_files(by_region, F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit(".csv")), F.concat(F.lit("key,name\n"), F.col("rows"))))
    return read.select("path", F.explode(F.split("text", "\n")).alias("line"))


@register("a05_csv_all_rows", "SELECT CAST(c_nationkey AS VARCHAR) || '.csv' AS path, count(*) AS n FROM customer GROUP BY 1")
def a05_all(spark, sf):
    """Files of any length come whole: as many lines as rows."""
    by_nation = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.array_join(F.collect_list(F.concat_ws(",", "c_custkey", "c_name")), "\n").alias("rows"))
    read = files.parsed(_files(by_nation, F.concat(F.col("c_nationkey").cast("string"), F.lit(".csv")), F.concat(F.lit("key,name\n"), F.col("rows"))))
    return read.select("path", F.size(F.split("text", "\n")).cast("long").alias("n"))


@register("a06_json", "SELECT r_regionkey || '.json' AS path, 'name: ' || r_name || chr(10) || 'nations:' || chr(10) || string_agg('  Item ' || i || ':' || chr(10) || '    ' || n_name, chr(10) ORDER BY i) AS text FROM (SELECT r_regionkey, r_name, n_name, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_name) AS i FROM region JOIN nation ON n_regionkey = r_regionkey) x GROUP BY r_regionkey, r_name")
def a06(spark, sf):
    named = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("nations"))
    both = table(spark, sf, "region").join(named, F.col("r_regionkey") == F.col("n_regionkey"))
    read = files.parsed(_files(both, F.concat(F.col("r_regionkey").cast("string"), F.lit(".json")), F.to_json(F.struct(F.col("r_name").alias("name"), "nations"))))
    return read.select("path", "text")


@register("a07_xml", "SELECT n_nationkey || '.xml' AS path, CASE WHEN n_nationkey % 5 = 0 THEN '<n><key>' || n_nationkey ELSE 'key: ' || n_nationkey || chr(10) || 'name: ' || n_name END AS text FROM nation")
def a07(spark, sf):
    """What does not parse is returned as it is."""
    key = F.concat(F.lit("<n><key>"), F.col("n_nationkey").cast("string"))
    content = F.when(F.col("n_nationkey") % 5 == 0, key).otherwise(F.concat(key, F.lit("</key><name>"), F.col("n_name"), F.lit("</name><empty/></n>")))
    return files.parsed(_files(table(spark, sf, "nation"), F.concat(F.col("n_nationkey").cast("string"), F.lit(".xml")), content)).select("path", "text")


@register("a11_old_doc", "SELECT n_nationkey || '.doc' AS path, 'ValueError: the old .doc format is not supported' AS error FROM nation")
def a11(spark, sf):
    return files.parsed(_files(table(spark, sf, "nation"), F.concat(F.col("n_nationkey").cast("string"), F.lit(".doc")), F.col("n_name"))).where("text IS NULL").select("path", "error")


@register("a17_latest_upload", "SELECT o_custkey AS source_id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS file_id FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def a17(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("source_id"), F.col("o_orderkey").alias("file_id"), F.col("o_orderdate").alias("uploaded_at"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("failed").alias("status"))
    return files.latest_upload(o)


@register("a19_n_triples", "SELECT 'http://ex.org/n/' || n_nationkey AS s, 'http://www.w3.org/2000/01/rdf-schema#label' AS p, 'the \"' || n_name || '\"' AS o FROM nation UNION ALL SELECT 'http://ex.org/n/' || n_nationkey, 'http://ex.org/in', 'http://ex.org/r/' || n_regionkey FROM nation UNION ALL SELECT '_:b' || r_regionkey, 'http://ex.org/key', CAST(r_regionkey AS VARCHAR) FROM region")
def a19(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    node = F.concat(F.lit("<http://ex.org/n/"), F.col("n_nationkey").cast("string"), F.lit(">"))
    labels = n.select(F.concat(node, F.lit(' <http://www.w3.org/2000/01/rdf-schema#label> "the \\"'), F.col("n_name"), F.lit('\\""@en .')))
    inside = n.select(F.concat(node, F.lit("\t<http://ex.org/in> <http://ex.org/r/"), F.col("n_regionkey").cast("string"), F.lit("> . # where")))
    blank = r.select(F.concat(F.lit("_:b"), F.col("r_regionkey").cast("string"), F.lit(' <http://ex.org/key> "'), F.col("r_regionkey").cast("string"), F.lit('"^^<http://www.w3.org/2001/XMLSchema#int> .')))
    noise = r.select(F.lit("# no triple"))
    lines = labels.unionAll(inside).unionAll(blank).unionAll(noise).toDF("value").withColumn("n", F.monotonically_increasing_id())
    return rdf.n_triples(lines).select("s", "p", "o")


_PROPERTY_SQL = "SELECT 'http://ex.org/p/' || n_nationkey AS uri, n_name AS label, CASE WHEN n_nationkey % 2 = 0 THEN 'object' ELSE 'datatype' END AS property_type, 'http://ex.org/r/' || n_regionkey AS domain_uri, CASE WHEN n_nationkey % 3 = 0 THEN 'http://ex.org/c/1' END AS range_uri FROM nation"


def _property_triples(spark, sf):
    n = table(spark, sf, "nation")
    s = F.concat(F.lit("http://ex.org/p/"), F.col("n_nationkey").cast("string")).alias("s")
    kind = F.when(F.col("n_nationkey") % 2 == 0, "http://www.w3.org/2002/07/owl#ObjectProperty").otherwise("http://www.w3.org/2002/07/owl#DatatypeProperty")
    parts = [("http://www.w3.org/1999/02/22-rdf-syntax-ns#type", kind), ("http://www.w3.org/2000/01/rdf-schema#label", F.col("n_name")), ("http://www.w3.org/2000/01/rdf-schema#label", F.lit("later")), ("http://www.w3.org/2000/01/rdf-schema#domain", F.concat(F.lit("http://ex.org/r/"), F.col("n_regionkey").cast("string"))), ("http://www.w3.org/2000/01/rdf-schema#range", F.when(F.col("n_nationkey") % 3 == 0, "http://ex.org/c/1"))]
    out = None
    for i, (p, o) in enumerate(parts):
        rows = n.select(s, F.lit(p).alias("p"), o.alias("o"), F.lit(i).cast("long").alias("n")).where("o IS NOT NULL")
        out = rows if out is None else out.unionAll(rows)
    return out


@register("a21_properties", _PROPERTY_SQL)
def a21(spark, sf):
    return ontology.properties(_property_triples(spark, sf))


@register("a23_property_ids", f"SELECT uri, domain_uri, r_regionkey AS domain_id FROM ({_PROPERTY_SQL}) p LEFT JOIN region ON domain_uri = 'http://ex.org/r/' || r_regionkey AND r_regionkey > 0")
def a23(spark, sf):
    """Properties with the ids of their domain classes; one that is not known stays null."""
    known = table(spark, sf, "region").where("r_regionkey > 0").select(F.concat(F.lit("http://ex.org/r/"), F.col("r_regionkey").cast("string")).alias("domain_uri"), F.col("r_regionkey").alias("domain_id"))
    return ontology.properties(_property_triples(spark, sf)).join(known, "domain_uri", "left").select("uri", "domain_uri", "domain_id")


@register("a24_merged_config", "SELECT c_custkey AS source_id, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'utf-8' END AS encoding, ';' AS delimiter FROM customer")
def a24(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("source_id"), "c_mktsegment")
    defaults = c.select("source_id", F.create_map(F.lit("encoding"), F.lit("utf-8"), F.lit("delimiter"), F.lit(";")).alias("config"))
    explicit = c.where("source_id % 2 = 0").select("source_id", F.create_map(F.lit("encoding"), F.col("c_mktsegment")).alias("config"))
    merged = files.merged_config(explicit, defaults)
    return merged.select("source_id", F.col("config")["encoding"].alias("encoding"), F.col("config")["delimiter"].alias("delimiter"))


@register("a25_upload_check", "SELECT page_id, CASE WHEN page_id % 4 IN (0, 1) THEN 'text/csv' ELSE 'application/json' END = CASE WHEN page_id % 2 = 0 THEN 'text/csv' ELSE 'application/json' END AS matches FROM pages")
def a25(spark, sf):
    name = F.when(F.col("page_id") % 4 < 2, "up.CSV").otherwise("up.json")
    declared = F.when(F.col("page_id") % 2 == 0, "text/csv").otherwise("application/json")
    return table(spark, sf, "pages").select("page_id", (tx.media_type(name) == declared).alias("matches"))


# -- B: writes ----------------------------------------------------------------------------------


@register("b03_nodes_without_id", "SELECT entity_type, count(*) AS n FROM entities WHERE num % 4 <> 0 GROUP BY 1", graph=True)
def b03(spark, sf):
    """Entities that the graph lacks are added; those it has stay single."""
    e = entities(spark, sf)
    have = e.where("num % 4 = 0").select("id", "entity_type")
    added = upsert.insert_missing(have, e.select("id", "entity_type"), ["id"]).join(have.select("id"), "id", "left_anti")
    return added.groupBy("entity_type").agg(F.count("*").alias("n"))


@register("b04_edges_with_both_ends", "SELECT r.id FROM relationships r JOIN entities a ON a.id = r.source_entity_id AND a.is_active JOIN entities b ON b.id = r.target_entity_id AND b.is_active WHERE r.relationship_type = 'LOCATED_IN'", graph=True)
def b04(spark, sf):
    active = entities(spark, sf).where("is_active").select("id")
    e = graph.of_types(relationships(spark, sf), ("LOCATED_IN",))
    return e.join(active, e.source_entity_id == active.id, "left_semi").join(active, e.target_entity_id == active.id, "left_semi").select("id")


@register("b07_prompt_text", "SELECT p_partkey, p_name || ' brand: ' || p_brand || ' type: ' || p_type AS prompt FROM part")
def b07(spark, sf):
    p = F.create_map(F.lit("type"), F.col("p_type"), F.lit("brand"), F.col("p_brand"))
    return table(spark, sf, "part").select("p_partkey", props.prompt_text(F.col("p_name"), p).alias("prompt"))


@register("b11_new_relationships", "SELECT 's:' || s_suppkey AS source_entity_id, 'PREFERS' AS relationship_type, 'n:' || (s_suppkey % 25) AS target_entity_id FROM supplier UNION SELECT source_entity_id, relationship_type, target_entity_id FROM relationships WHERE relationship_type = 'LOCATED_IN'", graph=True)
def b11(spark, sf):
    keys = ["source_entity_id", "relationship_type", "target_entity_id"]
    s = table(spark, sf, "supplier")
    new = s.select(F.concat(F.lit("s:"), F.col("s_suppkey").cast("string")).alias("source_entity_id"), F.lit("PREFERS").alias("relationship_type"), F.concat(F.lit("n:"), (F.col("s_suppkey") % 25).cast("string")).alias("target_entity_id"))
    return upsert.insert_missing(graph.of_types(relationships(spark, sf), ("LOCATED_IN",)).select(*keys), new, keys)


_LOG_SQL = "SELECT p_partkey AS id, CASE WHEN p_partkey % 6 = 0 THEN 'create' WHEN p_partkey % 6 = 1 THEN 'delete' ELSE 'update' END AS action FROM part WHERE p_partkey % 6 < 3"


def _part_log(spark, sf):
    """Actions on parts: two of six are updated, or updated and then deleted, one is created."""
    p = table(spark, sf, "part")
    action = F.when(F.col("p_partkey") % 6 == 0, "create").when(F.col("p_partkey") % 6 == 1, "delete").otherwise("update")
    first = p.where("p_partkey % 6 < 3").select(F.col("p_partkey").alias("seq"), F.col("p_partkey").alias("id"), action.alias("action"), F.struct(F.col("p_name").alias("name"), F.col("p_retailprice").alias("price")).alias("old"))
    again = first.where("action = 'update'").select((F.col("seq") + 10_000_000).alias("seq"), "id", "action", F.struct(F.lit("wrong").alias("name"), F.lit(0.0).alias("price")).alias("old"))
    return first.unionAll(again)


@register("b12_rollback", "SELECT p_partkey AS id, p_name AS name, p_retailprice AS price FROM part WHERE p_partkey % 6 <> 0")
def b12(spark, sf):
    """Changed rows are as they were, deleted ones are back, created ones are gone."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"))
    changed = p.where("id % 6 <> 1").withColumn("price", F.when(F.col("id") % 6 == 2, F.lit(-1.0)).otherwise(F.col("price")))
    return upsert.rolled_back(changed, _part_log(spark, sf))


@register("b12_inverse_actions", f"SELECT id, CASE action WHEN 'create' THEN 'delete' WHEN 'delete' THEN 'create' ELSE 'update' END AS inverse, CASE action WHEN 'update' THEN 2 ELSE 1 END AS n FROM ({_LOG_SQL}) x".replace("CASE action WHEN 'update' THEN 2 ELSE 1 END", "CAST(CASE action WHEN 'update' THEN 2 ELSE 1 END AS BIGINT)"))
def b12_inverse(spark, sf):
    return upsert.inverse_actions(_part_log(spark, sf)).groupBy("id", "inverse").agg(F.count("*").alias("n"))


@register("b14_upsert", "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'CHANGED' ELSE c_mktsegment END AS c_mktsegment FROM customer UNION ALL SELECT c_custkey + 10000000, 'NEW' FROM customer WHERE c_custkey % 10 = 1")
def b14(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    new = c.where("c_custkey % 10 = 0").select("c_custkey", F.lit("CHANGED").alias("c_mktsegment")).unionAll(c.where("c_custkey % 10 = 1").select(F.col("c_custkey") + 10_000_000, F.lit("NEW")))
    return upsert.upsert(c, new, ["c_custkey"])


@register("b15_metadata_merge", "SELECT o_orderkey AS id, 'done' AS status, o_orderpriority AS priority FROM orders WHERE o_orderkey % 3 = 0")
def b15(spark, sf):
    o = table(spark, sf, "orders")
    rows = o.select(F.col("o_orderkey").alias("id"), F.create_map(F.lit("status"), F.lit("new"), F.lit("priority"), F.col("o_orderpriority")).alias("properties"))
    changes = o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"), F.create_map(F.lit("status"), F.lit("done")).alias("properties"))
    p = F.col("properties")
    return upsert.update_properties(rows, changes).where(p["status"] == "done").select("id", p["status"].alias("status"), p["priority"].alias("priority"))


@register("b17_export", "SELECT n_nationkey, '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' AS as_json, n_nationkey || ',' || n_name AS as_csv FROM nation")
def b17(spark, sf):
    row = F.struct("n_nationkey", "n_name")
    return table(spark, sf, "nation").select("n_nationkey", F.to_json(row).alias("as_json"), F.to_csv(row).alias("as_csv"))


# -- D: joins -----------------------------------------------------------------------------------

_ROLES = "SELECT c_custkey AS user_id, CASE c_custkey % 3 WHEN 0 THEN 'admin' WHEN 1 THEN 'expert' ELSE 'user' END AS role FROM customer"


def _roles(spark, sf):
    role = F.when(F.col("c_custkey") % 3 == 0, "admin").when(F.col("c_custkey") % 3 == 1, "expert").otherwise("user")
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), role.alias("role"))


@register("d03_has_role", f"SELECT o_orderkey, EXISTS (SELECT 1 FROM ({_ROLES}) r WHERE r.user_id = o_custkey AND role = 'expert') AS has_role FROM orders")
def d03(spark, sf):
    experts = _roles(spark, sf).where("role = 'expert'").select(F.col("user_id").alias("o_custkey"), F.lit(True).alias("yes")).distinct()
    return table(spark, sf, "orders").join(experts, "o_custkey", "left").select("o_orderkey", F.coalesce("yes", F.lit(False)).alias("has_role"))


@register("d05_type_lookup", "SELECT s_suppkey, n_nationkey AS type_id FROM supplier LEFT JOIN nation ON n_name = (SELECT n_name FROM nation m WHERE m.n_nationkey = s_nationkey) AND n_regionkey = 1")
def d05(spark, sf):
    """A type's id by name, within one domain; null outside it."""
    n = table(spark, sf, "nation")
    wanted = table(spark, sf, "supplier").join(n.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("name")), "s_nationkey")
    types = n.where("n_regionkey = 1").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("type_id"))
    return wanted.join(types, "name", "left").select("s_suppkey", "type_id")


_KINDS = ("EMPLOYED_BY", "UNEMPLOYED", "RETIRED_FROM", "MARRIED_TO", "DIVORCED_FROM", "SINGLE", "OWNS", "SOLD", "DOES_NOT_OWN", "LOCATED_IN", "NOT_LOCATED_IN", "MOVED_FROM")
_KIND_SQL = "CASE o_orderkey % 12 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_KINDS)) + " END"


@register("d12_contradictory_pairs", f"WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_custkey AS c, {_KIND_SQL} AS k, CAST(o_orderkey % 100 AS DOUBLE) / 100 AS conf FROM orders), x(a, b) AS (VALUES ('EMPLOYED_BY', 'UNEMPLOYED'), ('EMPLOYED_BY', 'RETIRED_FROM'), ('MARRIED_TO', 'DIVORCED_FROM'), ('MARRIED_TO', 'SINGLE'), ('OWNS', 'SOLD'), ('OWNS', 'DOES_NOT_OWN'), ('LOCATED_IN', 'NOT_LOCATED_IN'), ('LOCATED_IN', 'MOVED_FROM')) SELECT p.id AS a_edge, q.id AS b_edge, least(p.conf, q.conf) AS score, 'high' AS severity FROM o p JOIN o q ON p.c = q.c AND p.id < q.id WHERE EXISTS (SELECT 1 FROM x WHERE (a = p.k AND b = q.k) OR (a = q.k AND b = p.k))")
def d12(spark, sf):
    kind = F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (F.col("o_orderkey") % 12 + 1).cast("int"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").alias("source_entity_id"), F.lit("x").alias("target_entity_id"), kind.alias("relationship_type"), ((F.col("o_orderkey") % 100) / 100.0).alias("confidence"))
    return resolve.contradictions(o)


_COS = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


@register("d13_nearest_by_cosine", f"SELECT query_id, vec_id, score FROM (SELECT a.vec_id AS query_id, b.vec_id, round({_COS}, 6) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS place FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0) x WHERE place <= 5")
def d13(spark, sf):
    v = table(spark, sf, "embeddings")
    return search.semantic(v, v.where("vec_id % 50 = 0"), -1.0, k=5).select("query_id", "vec_id", F.round("score", 6).alias("score"))


@register("d14_similarity_matrix", "SELECT r_regionkey, n_nationkey, round(1 - CAST(levenshtein(lower(r_name), lower(n_name)) AS DOUBLE) / greatest(length(r_name), length(n_name)), 6) AS score FROM region, nation")
def d14(spark, sf):
    """A against B, both stated lists of names."""
    pairs = table(spark, sf, "region").join(table(spark, sf, "nation"), F.lit(True))
    return pairs.select("r_regionkey", "n_nationkey", F.round(sim.levenshtein(F.lower("r_name"), F.lower("n_name")), 6).alias("score"))


@register("d18_resolved_texts", "WITH m AS (SELECT n_regionkey AS doc_id, n_nationkey, n_name, CASE WHEN n_nationkey % 3 = 0 THEN lower(n_name) WHEN n_nationkey % 3 = 1 THEN left(n_name, 4) ELSE n_name || ' and more' END AS mention FROM nation), f AS (SELECT DISTINCT m.doc_id, m.mention, e.n_nationkey AS id, lower(e.n_name) <> lower(m.mention) AS part FROM m JOIN nation e ON e.n_regionkey = m.doc_id AND (contains(lower(e.n_name), lower(m.mention)) OR contains(lower(m.mention), lower(e.n_name)))) SELECT doc_id, mention, id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, mention ORDER BY part, id) AS p FROM f) x WHERE p = 1")
def d18(spark, sf):
    n = table(spark, sf, "nation")
    mention = F.when(F.col("n_nationkey") % 3 == 0, F.lower("n_name")).when(F.col("n_nationkey") % 3 == 1, F.substring("n_name", 1, 4)).otherwise(F.concat("n_name", F.lit(" and more")))
    return upsert.resolve_texts(n.select(F.col("n_regionkey").alias("doc_id"), mention.alias("mention")), n.select(F.col("n_regionkey").alias("doc_id"), F.col("n_nationkey").alias("id"), F.col("n_name").alias("entity_text")))


# -- F: functions -------------------------------------------------------------------------------


@register("f02_exact", "SELECT c_custkey, CASE WHEN lower(c_mktsegment) = 'building' THEN CAST(1 AS DOUBLE) ELSE 0 END AS s FROM customer")
def f02(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", sim.exact(F.col("c_mktsegment"), F.lit("Building")).alias("s"))


_UP = "regexp_replace(upper(p_name), '[^A-Z]', '', 'g')"
_DIGITS = f"translate(substr({_UP}, 2), 'BFPVCGJKQSXZDTLMNRAEIOUHWY', '111122222222334556')"
for _d in "123456":
    _DIGITS = f"regexp_replace({_DIGITS}, '{_d}+', '{_d}', 'g')"


@register("f06_sound_code", f"SELECT p_partkey, rpad(left({_UP} , 1) || {_DIGITS}, 4, '0')[1:4] AS code FROM part")
def f06(spark, sf):
    return table(spark, sf, "part").select("p_partkey", sim.sound_code(F.col("p_name")).alias("code"))


#: One letter after the other, by what stands beside it.
_SOUND = """CASE WHEN c IN ('A', 'E', 'I', 'O', 'U') THEN CASE WHEN i = 1 THEN c ELSE '' END
    WHEN c = 'C' THEN CASE WHEN after IN ('E', 'I', 'Y') THEN 'S' ELSE 'K' END
    WHEN c = 'H' THEN CASE WHEN i = 1 OR before IN ('A', 'E', 'I', 'O', 'U') THEN 'H' ELSE '' END
    WHEN c = 'P' AND after = 'H' THEN 'F' WHEN c = 'S' AND after = 'H' THEN 'X' WHEN c = 'T' AND after = 'H' THEN '0'
    WHEN c = 'D' THEN 'T' WHEN c IN ('G', 'Q') THEN 'K' WHEN c = 'V' THEN 'F' WHEN c = 'X' THEN 'KS' WHEN c = 'Z' THEN 'S' ELSE c END"""


@register("f07_metaphone", f"WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM documents), l AS (SELECT word, upper(word) AS u, unnest(generate_series(1, length(word))) AS i FROM w), c AS (SELECT word, i, substr(u, i, 1) AS c, substr(u, i + 1, 1) AS after, CASE WHEN i > 1 THEN substr(u, i - 1, 1) END AS before FROM l) SELECT word, string_agg({_SOUND}, '' ORDER BY i) AS code FROM c GROUP BY word")
def f07(spark, sf):
    """Codes of all words of the documents."""
    words = table(spark, sf, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("word")).distinct()
    return words.select("word", sim.metaphone(F.col("word")).alias("code"))


_NEXT = "WITH p AS (SELECT a.vec_id AS a, CAST(a.embedding AS DOUBLE[]) AS x, CAST(b.embedding AS DOUBLE[]) AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) "


def _next_vectors(spark, sf):
    v = table(spark, sf, "embeddings")
    return v.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")).join(v.select((F.col("vec_id") - 1).alias("a"), F.col("embedding").alias("y")), "a")


@register("f09_euclidean", _NEXT + "SELECT a, round(1 - list_distance(x, y) / (sqrt(list_inner_product(x, x)) + sqrt(list_inner_product(y, y))), 6) AS s FROM p")
def f09(spark, sf):
    return _next_vectors(spark, sf).select("a", F.round(sim.euclidean(F.col("x"), F.col("y")), 6).alias("s"))


@register("f10_manhattan", _NEXT + "SELECT a, round(1 - list_sum(list_transform(list_zip(x, y), lambda t: abs(t[1] - t[2]))) / (list_sum(list_transform(x, lambda t: abs(t))) + list_sum(list_transform(y, lambda t: abs(t)))), 6) AS s FROM p")
def f10(spark, sf):
    return _next_vectors(spark, sf).select("a", F.round(sim.manhattan(F.col("x"), F.col("y")), 6).alias("s"))


@register("f11_dot_product", _NEXT + "SELECT a, round(list_inner_product(x, y) / (sqrt(list_inner_product(x, x)) * sqrt(list_inner_product(y, y))), 6) AS s FROM p")
def f11(spark, sf):
    return _next_vectors(spark, sf).select("a", F.round(sim.cosine(F.col("x"), F.col("y"), 0.0), 6).alias("s"))


@register("f12_float32", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(CAST(CAST(x AS DOUBLE) / 3 AS FLOAT) AS DOUBLE))), 6) AS s FROM embeddings")
def f12(spark, sf):
    small = F.transform("embedding", lambda x: (x.cast("double") / 3).cast("float").cast("double"))
    return table(spark, sf, "embeddings").select("vec_id", F.round(F.aggregate(small, F.lit(0.0), lambda a, x: a + x), 6).alias("s"))


@register("f14_tokens", r"SELECT doc_id, CAST(len(list_filter(string_split(regexp_replace(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), '[^a-zA-Z0-9\s]', '', 'g'), ' '), lambda w: w <> '')) AS INTEGER) AS n FROM documents")
def f14(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(tx.tokens(F.col("text"))).alias("n"))


@register("f17_entity_similarity", "SELECT p_partkey, round(0.4 * t + 0.2 * CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END + 0.3 * pr + 0.1 * t, 6) AS s FROM (SELECT p_partkey, p_size, CAST(p_partkey % 100 AS DOUBLE) / 100 AS t, CAST(p_size AS DOUBLE) / 50 AS pr FROM part) x")
def f17(spark, sf):
    t = (F.col("p_partkey") % 100) / 100.0
    return table(spark, sf, "part").select("p_partkey", F.round(sim.entity_similarity(t, F.col("p_size") % 2 == 0, F.col("p_size") / 50.0), 6).alias("s"))


@register("f23_completeness", "SELECT c_custkey, round(0.1 * 3 + 0.3 * (c_custkey % 3) + 0.4 * CAST(c_custkey % 100 AS DOUBLE) / 100 + 0.5 * CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END + 0.2 * 0.5 + 0.3 * greatest(CAST(0 AS DOUBLE), 1 - CAST(c_custkey % 500 AS DOUBLE) / 365), 6) AS s FROM customer")
def f23(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select("c_custkey", F.round(resolve.completeness(F.lit(3), k % 3, (k % 100) / 100.0, k % 2 == 0, F.lit(0.5), k % 500), 6).alias("s"))


@register("f27_dotted_path", "SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(NULL AS VARCHAR) AS nothing FROM events")
def f27(spark, sf):
    return table(spark, sf, "events").select("event_id", tx.at_path(F.col("props"), "k").alias("k"), tx.at_path(F.col("props"), "k.deeper").alias("nothing"))


@register("f32_sealed_and_opened", "SELECT s_suppkey, s_name AS name, true AS hidden FROM supplier")
def f32(spark, sf):
    key = "0123456789abcdef"
    hidden = table(spark, sf, "supplier").select("s_suppkey", "s_name", tx.sealed(F.col("s_name"), key).alias("x"))
    return hidden.select("s_suppkey", tx.opened(F.col("x"), key).alias("name"), (~F.contains("x", "s_name")).alias("hidden"))


@register("f34_suggestion", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'merge' WHEN 1 THEN 'keep_source' ELSE 'manual' END AS method, CASE event_id % 3 WHEN 0 THEN 0.9 WHEN 1 THEN 0.7 ELSE 0.5 END AS confidence, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN 'because of ' || event_type ELSE '' END AS reasoning FROM events".replace("THEN 0.9 WHEN 1 THEN 0.7 ELSE 0.5", "THEN CAST(0.9 AS DOUBLE) WHEN 1 THEN CAST(0.7 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE)"))
def f34(spark, sf):
    as_json = F.concat(F.lit('I think: {"method": "merge", "confidence": 0.9, "reasoning": "'), F.col("event_type"), F.lit('"} is best'))
    as_lines = F.concat(F.lit("Method: keep_source\nConfidence: 0.7\nReasoning: because of "), F.col("event_type"))
    answer = F.when(F.col("event_id") % 3 == 0, as_json).when(F.col("event_id") % 3 == 1, as_lines).otherwise(F.lit("no idea"))
    return table(spark, sf, "events").select("event_id", tx.suggestion(answer).alias("s")).select("event_id", "s.method", "s.confidence", "s.reasoning")


@register("f36_uptime", "SELECT o_orderkey, CASE WHEN t >= 86400 THEN (t // 86400) || 'd ' ELSE '' END || CASE WHEN t % 86400 >= 3600 THEN (t % 86400 // 3600) || 'h ' ELSE '' END || (t % 3600 // 60) || 'm' AS uptime FROM (SELECT o_orderkey, o_orderkey * 37 % 400000 AS t FROM orders) x")
def f36(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", tx.uptime(F.col("o_orderkey") * 37 % 400_000).alias("uptime"))


@register("f37_counters", "SELECT event_type, json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY 1, 2")
def f37(spark, sf):
    """Nested counters are grouped counts over the path."""
    return table(spark, sf, "events").groupBy("event_type", tx.at_path(F.col("props"), "k").alias("k")).agg(F.count("*").alias("n"))


@register("f39_short_date", "SELECT event_id, strftime(ts, '%d/%m/%Y %H:%M') AS at FROM events")
def f39(spark, sf):
    return table(spark, sf, "events").select("event_id", tx.short_date(F.col("ts")).alias("at"))


# -- G, K, L, N ---------------------------------------------------------------------------------


@register("g26_unread", "SELECT user_id, count(*) FILTER (WHERE event_id % 3 <> 0) AS unread, count(*) AS total FROM events GROUP BY 1")
def g26(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.count_if(F.col("event_id") % 3 != 0).alias("unread"), F.count("*").alias("total"))


@register("g27_task_states", "SELECT o_orderstatus AS state, count(*) AS n, count(DISTINCT o_custkey) AS workers FROM orders GROUP BY 1")
def g27(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("state")).agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("workers"))


@register("k05_weighted_mean", "SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS m FROM lineitem GROUP BY 1")
def k05(spark, sf):
    """A user's aggregate as an expression of built-in ones keeps partial aggregation."""
    weighted = F.sum(F.col("l_discount") * F.col("l_quantity")) / F.sum("l_quantity")
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(weighted, 6).alias("m"))


@register("l06_limited_paths", "SELECT CAST(least(10, count(*)) AS BIGINT) AS n FROM supplier")
def l06(spark, sf):
    """Any ten paths; only their number is fixed."""
    paths = graph.fixed_path(relationships(spark, sf), entities(spark, sf).where("entity_type = 'ORGANIZATION'"), ("LOCATED_IN",)).limit(10)
    return paths.agg(F.count("*").alias("n"))


def _ends_sql(pattern: str, back: int) -> str:
    """DuckDB: cuts at the first end within 100 characters of 1000, the next 200 before it."""
    found = f"length(regexp_extract(substring(text, {{s}} + 901, least({{s}} + 1100, n) - {{s}} - 900), '{pattern}'))"
    end = f"CASE WHEN {{s}} + 1000 < n THEN CASE WHEN {found} > 0 THEN {{s}} + 900 + {found} - {back} ELSE {{s}} + 1000 END ELSE n END"
    return f"""WITH RECURSIVE d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) > 0),
c AS (SELECT doc_id, text, n, 0 AS k, CAST(0 AS BIGINT) AS s, CAST(CASE WHEN n <= 1000 THEN n ELSE {end.format(s='0')} END AS BIGINT) AS e FROM d
UNION ALL SELECT doc_id, text, n, k + 1, e - 200, CAST({end.format(s='(e - 200)')} AS BIGINT) FROM c WHERE e < n)
SELECT doc_id, CAST(k AS INTEGER) AS chunk_index, md5(substring(text, s + 1, e - s)) AS h FROM c"""


def _hashed(chunks):
    return chunks.select("doc_id", "chunk_index", F.md5(F.col("chunk").cast("binary")).alias("h"))


@register("n03_ends_hashed", _ends_sql(r"^[^.!?\n]*[.!?\n]", 0))
def n03(spark, sf):
    return _hashed(chunking.chunked(table(spark, sf, "documents"), chunking.cut_at_ends, size=1000, overlap=200))


@register("n04_spaced_ends", _ends_sql(r"(?s)^.*?[.!?\n]\s", 1))
def n04(spark, sf):
    return _hashed(chunking.chunked(table(spark, sf, "documents"), chunking.cut_at_ends, size=1000, overlap=200, spaced=True))


@register("n08_extractor_counts", r"SELECT count(*) AS n_files, CAST(sum(length(text)) AS BIGINT) AS n_chars, CAST(sum(len(regexp_extract_all(text, '\S+'))) AS BIGINT) AS n_words FROM documents")
def n08(spark, sf):
    s = tx.statistics(F.col("text"))
    return table(spark, sf, "documents").agg(F.count("*").alias("n_files"), F.sum(s["char_count"]).cast("long").alias("n_chars"), F.sum(s["word_count"]).cast("long").alias("n_words"))


@register("n10_custom_types", r"SELECT doc_id, 'Mail' AS entity_type, unnest(regexp_extract_all(text, '(?i)\b[a-z0-9._-]+@[a-z0-9.-]+\b')) AS entity_text FROM documents UNION ALL SELECT doc_id, 'Number', unnest(regexp_extract_all(text, '\b[0-9]{3,9}\b')) FROM documents")
def n10(spark, sf):
    """Types that the user brings along."""
    return chunking.entity_values(table(spark, sf, "documents"), {"Mail": r"\b[a-z0-9._-]+@[a-z0-9.-]+\b", "Number": r"\b[0-9]{3,9}\b"}).select("doc_id", "entity_type", "entity_text")


@register("n11_relations_by_pattern", """WITH o AS (SELECT o_orderkey AS doc_id, c_name, o_orderpriority AS p FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT doc_id, c_name AS source_text, p AS target_text, 'owns_account' AS relationship_type, CAST(0.6 AS DOUBLE) AS confidence FROM o WHERE doc_id % 4 = 0
UNION ALL SELECT doc_id, c_name, c_name, 'transfers_money_to', 0.6 FROM o WHERE doc_id % 4 = 1 AND contains(c_name, '5')""")
def n11(spark, sf):
    """Ends are matched with entities whole, or else by containment; the pattern of three groups tells nothing."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    fourth = F.col("o_orderkey") % 4
    text = F.when(fourth == 0, F.concat("c_name", F.lit(" MỞ "), "o_orderpriority", F.lit(" tại đây"))).when(fourth == 1, F.concat(F.lit("ông "), "c_name", F.lit(" chuyển 5\ncho ai"))).when(fourth == 2, F.concat("c_name", F.lit(" là khách hàng của BIDV"))).otherwise(F.lit("nothing here"))
    chunks = o.select(F.col("o_orderkey").alias("doc_id"), F.lit(0).alias("chunk_index"), text.alias("chunk"), "c_name", "o_orderpriority")
    found = chunks.select("doc_id", "chunk_index", F.explode(F.array(F.struct(F.col("c_name").alias("entity_text"), F.lit("Person").alias("entity_type"), F.lit(0).alias("start_position")), F.struct(F.col("o_orderpriority").alias("entity_text"), F.lit("Account").alias("entity_type"), F.lit(30).alias("start_position")))).alias("e")).select("doc_id", "chunk_index", "e.*")
    return chunking.relations_by_pattern(chunks, found).select("doc_id", "source_text", "target_text", "relationship_type", "confidence")


@register("n14_file_totals", r"SELECT doc_id, n_chunks, n_entities FROM (SELECT doc_id, greatest(CAST(ceil((length(text) - 200) / CAST(800 AS DOUBLE)) AS BIGINT), 1) AS n_chunks, len(regexp_extract_all(text, '\b\d{10,14}\b')) + len(regexp_extract_all(text, '\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b')) AS n_entities FROM documents WHERE length(text) > 0) x")
def n14(spark, sf):
    docs = table(spark, sf, "documents")
    return chunking.in_document_totals(chunking.fixed_windows(docs, 1000, 200), chunking.entity_values(docs, {k: chunking.ENTITY_PATTERNS[k] for k in ("Account", "Date")}))


# -- O: ontology --------------------------------------------------------------------------------


@register("o02_map_relationships", "SELECT relationship_type, count(*) AS n, max(CASE relationship_type WHEN 'LOCATED_IN' THEN 'ex:isLocatedIn' WHEN 'SUPPLIES' THEN 'ex:supplies' END) AS class_uri, max(CASE relationship_type WHEN 'PURCHASED' THEN 'no mapping for this type' END) AS unmapped_reason FROM relationships GROUP BY 1", graph=True)
def o02(spark, sf):
    mappings = spark.createDataFrame([("located_in", "ex:isLocatedIn", 0.9), ("Supplies", "ex:supplies", 0.7), ("purchased", "ex:bought", 0.69)], "type_key string, class_uri string, confidence double")
    mapped = ontology.map_types(relationships(spark, sf).withColumnRenamed("relationship_type", "entity_type"), mappings)
    return mapped.groupBy(F.col("entity_type").alias("relationship_type")).agg(F.count("*").alias("n"), F.max("class_uri").alias("class_uri"), F.max("unmapped_reason").alias("unmapped_reason"))


@register("o07_suggest_properties", "SELECT n_name AS name, CAST(row_number() OVER (ORDER BY c DESC, n_name) AS INTEGER) AS rank_no, c AS suggestion_confidence FROM (SELECT n_name, CAST(CASE WHEN n_name ILIKE '%ia%' THEN 0.8 ELSE 0.6 END AS DOUBLE) AS c FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_name ILIKE '%ia%' OR r_name ILIKE '%ia%' ORDER BY c DESC, n_name LIMIT 10) x")
def o07(spark, sf):
    named = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return ontology.suggest(named.select(F.col("n_name").alias("name"), F.col("r_name").alias("description")), "ia", most=10)


@register("o11_type_constraints", "SELECT r.id FROM relationships r JOIN entities a ON a.id = r.source_entity_id WHERE r.relationship_type = 'LOCATED_IN' AND a.entity_type NOT IN ('COUNTRY', 'ORGANIZATION')", graph=True)
def o11(spark, sf):
    allowed = spark.createDataFrame([("LOCATED_IN", ["COUNTRY", "ORGANIZATION"], []), ("SUPPLIES", [], ["PRODUCT"])], "relationship_type string, source_types array<string>, target_types array<string>")
    return ontology.endpoint_violations(relationships(spark, sf), entities(spark, sf), allowed).select("id")


# -- P, R, T, U, V, W, X, Z ---------------------------------------------------------------------


@register("r14_merged_edges", "SELECT DISTINCT CASE WHEN source_entity_id = 's:2' THEN 's:1' ELSE source_entity_id END AS source_entity_id, target_entity_id FROM relationships WHERE relationship_type = 'SUPPLIES'", graph=True)
def r14(spark, sf):
    e = entities(spark, sf)
    merged = resolve.merge_entities(e, graph.of_types(relationships(spark, sf), ("SUPPLIES",)), spark.createDataFrame([("s:2", "s:1")], "loser string, winner string"))[1]
    return merged.select("source_entity_id", "target_entity_id")


@register("r15_resolutions", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'merged' WHEN 1 THEN 'kept_separate' ELSE 'deleted' END AS status FROM orders")
def r15(spark, sf):
    c = table(spark, sf, "orders").select("o_orderkey", F.lit("detected").alias("status"))
    for i, status in enumerate(("merged", "kept_separate", "deleted")):
        c = resolve.set_status(c, F.col("o_orderkey") % 3 == i, status)
    return c


@register("r22_assigned", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'under_review' ELSE 'detected' END AS status, CASE WHEN o_totalprice > 200000 THEN 'expert-1' END AS assigned_to FROM orders")
def r22(spark, sf):
    c = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.lit("detected").alias("status"), F.lit(None).cast("string").alias("assigned_to"))
    return resolve.set_status(c, F.col("o_totalprice") > 200_000, "under_review", "expert-1").drop("o_totalprice")


@register("u05_merged_graphs", "SELECT id, count(*) AS n FROM (SELECT id FROM entities WHERE entity_type = 'COUNTRY' UNION ALL SELECT id FROM entities WHERE entity_type IN ('COUNTRY', 'LOCATION')) x GROUP BY 1", graph=True)
def u05(spark, sf):
    """Nodes and edges are put together, and nothing is dropped."""
    e, r = entities(spark, sf), relationships(spark, sf)
    countries, places = e.where("entity_type = 'COUNTRY'"), e.where("entity_type IN ('COUNTRY', 'LOCATION')")
    both, _ = visual.merged((countries, r), (places, r))
    return both.groupBy("id").agg(F.count("*").alias("n"))


@register("u06_set_algebra", "SELECT p_partkey, CAST(len(list_intersect(string_split(p_name, ' '), string_split(p_type, ' '))) AS INTEGER) AS n_both, CAST(len(list_distinct(list_concat(string_split(p_name, ' '), string_split(p_type, ' ')))) AS INTEGER) AS n_either FROM part")
def u06(spark, sf):
    a, b = F.split("p_name", " "), F.split("p_type", " ")
    return table(spark, sf, "part").select("p_partkey", F.size(F.array_intersect(a, b)).alias("n_both"), F.size(F.array_union(a, b)).alias("n_either"))


@register("w07_timeline", "SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS place, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders")
def w07(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("place"), F.lag("o_orderkey").over(w).alias("before"))


@register("x02_text_router", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN CAST(0 AS DOUBLE) ELSE round(1 - CAST(levenshtein(lower(c_mktsegment), 'building') AS DOUBLE) / greatest(length(c_mktsegment), 8), 6) END AS s FROM customer")
def x02(spark, sf):
    """Both sides are normalized; a null side scores 0."""
    a = F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit("  "), F.col("c_mktsegment"), F.lit("! ")))
    return table(spark, sf, "customer").select("c_custkey", F.round(sim.text_similarity(a, F.lit("Building"), "levenshtein"), 6).alias("s"))


@register("x03_set_router", "SELECT p_partkey, round(CAST(len(list_intersect(a, b)) AS DOUBLE) / len(list_distinct(list_concat(a, b))), 6) AS s FROM (SELECT p_partkey, list_distinct(string_split(lower(p_name), ' ')) AS a, list_distinct(string_split(lower(p_type), ' ')) AS b FROM part) x")
def x03(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.round(sim.text_similarity(F.col("p_name"), F.col("p_type"), "jaccard"), 6).alias("s"))


@register("x29_any_and_all_roles", f"SELECT user_id, role IN ('admin', 'expert') AS has_any, role = 'admin' AND user_id % 2 = 0 AS has_all FROM ({_ROLES}) r")
def x29(spark, sf):
    has = F.when(F.col("user_id") % 2 == 0, F.array("role", F.lit("expert"))).otherwise(F.array("role"))
    wanted = F.array(F.lit("admin"), F.lit("expert"))
    rows = _roles(spark, sf).withColumn("has", has)
    return rows.select("user_id", (F.col("role").isin("admin", "expert")).alias("has_any"), (F.size(F.array_except(wanted, "has")) == 0).alias("has_all"))


_PAIRS = "('Anna Bell opened', '1000000000', 'has_account'), ('Anna Bell opened', 'BIDV', 'associated_with'), ('1000000000', 'at BIDV', 'belongs_to'), ('1000000000', 'BIDV', 'related_to'), ('at BIDV', 'BIDV', 'associated_with'), ('It cost', '5,000 USD', 'related_to'), ('It cost', '01/02/2024', 'related_to'), ('5,000 USD', 'USD on', 'related_to'), ('5,000 USD', '01/02/2024', 'related_to'), ('USD on', '01/02/2024', 'related_to')"


@register("n12_related_told", f"SELECT c_custkey AS doc_id, a AS source_text, b AS target_text, k AS relationship_type FROM customer, (VALUES {_PAIRS}) v(a, b, k)")
def n12_told(spark, sf):
    """One account opening per customer, whose pairs were worked out by hand: entities of different types within
    one sentence, in order of their places."""
    text = F.lit("Anna Bell opened 1000000000 at BIDV. It cost 5,000 USD on 01/02/2024!")
    chunks = table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit(0).alias("chunk_index"), text.alias("chunk"))
    return chunking.related_in_sentences(chunking.entity_spans(chunks), chunking.sentences(chunks)).select("doc_id", "source_text", "target_text", "relationship_type")
