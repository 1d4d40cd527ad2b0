"""Queries of text, similarity and extraction (A, F, N)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import table
from ..functions import properties as props
from ..functions import similarity as sim
from ..functions import text as tx
from ..operators import chunking
from .registry import query as register


@register("a02_media_type", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'text/html' WHEN 1 THEN 'application/pdf' ELSE 'application/octet-stream' END AS kind FROM pages")
def a02(spark, sf):
    name = F.concat(F.lit("d/f"), F.col("page_id").cast("string"), F.element_at(F.array(F.lit(".HTML"), F.lit(".pdf"), F.lit(".bin")), (F.col("page_id") % 3 + 1).cast("int")))
    return table(spark, sf, "pages").select("page_id", tx.media_type(name).alias("kind"))


@register("a04_text_statistics", r"SELECT doc_id, CAST(length(text) AS INTEGER) AS char_count, CAST(len(regexp_extract_all(text, '\S+')) AS INTEGER) AS word_count, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS INTEGER) AS line_count FROM documents")
def a04(spark, sf):
    s = tx.statistics(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", *[s[c].cast("int").alias(c) for c in ("char_count", "word_count", "line_count")])


@register("a12_strip_html", r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages")
def a12(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.strip_html(F.col("html")).alias("text"))


@register("a13_strip_markdown", r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '[#*`\[\]()_~]', '', 'g'), '\s+', ' ', 'g'))) AS h FROM documents")
def a13(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(tx.strip_markdown(F.col("text")).cast("binary")).alias("h"))


@register("a18_connection_url", "SELECT n_nationkey, CASE n_nationkey % 2 WHEN 0 THEN 'postgresql://u:p@' || n_name || ':5432/d' ELSE 'mysql+pymysql://u:p@' || n_name || ':3306/d' END AS url FROM nation")
def a18(spark, sf):
    kind = F.when(F.col("n_nationkey") % 2 == 0, "postgresql").otherwise("mysql")
    return table(spark, sf, "nation").select("n_nationkey", tx.connection_url(kind, F.lit("u"), F.lit("p"), F.col("n_name"), F.lit(None).cast("string"), F.lit("d")).alias("url"))


@register("f01_normalize", r"SELECT p_partkey, regexp_replace(trim(regexp_replace(lower(p_name || ' - ' || p_brand), '\s+', ' ', 'g')), '[^a-zA-Z0-9\s]', '', 'g') AS t FROM part")
def f01(spark, sf):
    return table(spark, sf, "part").select("p_partkey", tx.normalize(F.concat("p_name", F.lit(" - "), "p_brand")).alias("t"))


@register("f04_levenshtein", "SELECT a.n_nationkey AS a, b.n_nationkey AS b, round(1 - CAST(levenshtein(a.n_name, b.n_name) AS DOUBLE) / greatest(length(a.n_name), length(b.n_name)), 6) AS s FROM nation a, nation b")
def f04(spark, sf):
    n = table(spark, sf, "nation")
    a, b = n.select(F.col("n_nationkey").alias("a"), F.col("n_name").alias("x")), n.select(F.col("n_nationkey").alias("b"), F.col("n_name").alias("y"))
    return a.join(b, F.lit(True)).select("a", "b", F.round(sim.levenshtein(F.col("x"), F.col("y")), 6).alias("s"))


@register("f05_jaro_winkler", "SELECT a.n_nationkey AS a, b.n_nationkey AS b, round(jaro_winkler_similarity(a.n_name, b.n_name), 6) AS s FROM nation a, nation b")
def f05(spark, sf):
    n = table(spark, sf, "nation")
    a, b = n.select(F.col("n_nationkey").alias("a"), F.col("n_name").alias("x")), n.select(F.col("n_nationkey").alias("b"), F.col("n_name").alias("y"))
    return a.join(b, F.lit(True)).select("a", "b", F.round(sim.jaro_winkler(F.col("x"), F.col("y")), 6).alias("s"))


@register("f08_vector_similarities", "WITH p AS (SELECT a.vec_id AS a, b.vec_id AS b, CAST(a.embedding AS DOUBLE[]) AS x, CAST(b.embedding AS DOUBLE[]) AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) SELECT a, b, round(list_cosine_similarity(x, y), 6) AS cosine, round(1 - list_distance(x, y) / (sqrt(list_inner_product(x, x)) + sqrt(list_inner_product(y, y))), 6) AS euclidean, round(1 - list_sum(list_transform(list_zip(x, y), lambda z: abs(z[1] - z[2]))) / (list_sum(list_transform(x, lambda z: abs(z))) + list_sum(list_transform(y, lambda z: abs(z)))), 6) AS manhattan FROM p")
def f08(spark, sf):
    v = table(spark, sf, "embeddings")
    pairs = v.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")).join(v.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y")), F.col("b") == F.col("a") + 1)
    return pairs.select("a", "b", *[F.round(f(F.col("x"), F.col("y")), 6).alias(n) for n, f in (("cosine", sim.cosine), ("euclidean", sim.euclidean), ("manhattan", sim.manhattan))])


_SETS = "list_distinct(string_split(a.p_name, ' '))", "list_distinct(string_split(b.p_name, ' '))"


@register("f13_set_similarities", f"WITH u AS (SELECT DISTINCT p_name FROM part), p AS (SELECT a.p_name AS a, b.p_name AS b, CAST(len({_SETS[0]}) AS DOUBLE) AS na, CAST(len({_SETS[1]}) AS DOUBLE) AS nb, CAST(len(list_intersect({_SETS[0]}, {_SETS[1]})) AS DOUBLE) AS c FROM u a, u b) SELECT a, b, round(c / (na + nb - c), 6) AS jaccard, round(2 * c / (na + nb), 6) AS dice, round(c / least(na, nb), 6) AS overlap FROM p")
def f13(spark, sf):
    u = table(spark, sf, "part").select("p_name").distinct()
    pairs = u.select(F.col("p_name").alias("a")).join(u.select(F.col("p_name").alias("b")), F.lit(True))
    x, y = F.split("a", " "), F.split("b", " ")
    return pairs.select("a", "b", *[F.round(f(x, y), 6).alias(n) for n, f in (("jaccard", sim.jaccard), ("dice", sim.dice), ("overlap", sim.overlap))])


@register("f15_hybrid_similarity")
def f15(spark, sf):
    n = table(spark, sf, "nation")
    a, b = n.select(F.col("n_nationkey").alias("a"), F.col("n_name").alias("x")), n.select(F.col("n_nationkey").alias("b"), F.col("n_name").alias("y"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(sim.hybrid(F.col("x"), F.col("y")), 6).alias("s"))


@register("f16_null_rule", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 1 WHEN event_id % 4 IN (1, 2) THEN 0 ELSE 1 END AS s FROM events".replace("THEN 1 WHEN", "THEN CAST(1 AS DOUBLE) WHEN"))
def f16(spark, sf):
    a = F.when(F.col("event_id") % 4 >= 2, F.col("event_type"))
    b = F.when(F.col("event_id") % 2 == 1, F.col("event_type"))
    return table(spark, sf, "events").select("event_id", sim.null_rule(a, b, sim.exact(a, b)).alias("s"))


@register("f22_severity", "SELECT p_partkey, CASE WHEN s >= 0.95 THEN 'critical' WHEN s >= 0.9 THEN 'high' WHEN s >= 0.8 THEN 'medium' ELSE 'low' END AS severity FROM (SELECT p_partkey, CAST(p_partkey % 100 AS DOUBLE) / 100 AS s FROM part) x")
def f22(spark, sf):
    return table(spark, sf, "part").select("p_partkey", sim.severity((F.col("p_partkey") % 100) / 100.0).alias("severity"))


@register("f25_property_merge", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN length(c_name) > length(c_mktsegment) THEN c_name ELSE c_mktsegment END AS v FROM customer")
def f25(spark, sf):
    c = table(spark, sf, "customer")
    a, b = F.create_map(F.lit("k"), F.col("c_name")), F.create_map(F.lit("k"), F.col("c_mktsegment"))
    return c.select("c_custkey", props.merge_verified(a, b, F.col("c_custkey") % 3 == 0, F.lit(False))["k"].alias("v"))


@register("f18_property_similarity", "SELECT c_custkey, round(((1 - CAST(levenshtein(c_mktsegment, 'BUILDING') AS DOUBLE) / greatest(length(c_mktsegment), 8)) + (1 - abs(c_acctbal - 5000) / greatest(abs(c_acctbal), 5000))) / 2 * 2 / 3, 6) AS s FROM customer")
def f18(spark, sf):
    c = table(spark, sf, "customer")
    a = F.create_map(F.lit("seg"), F.col("c_mktsegment"), F.lit("bal"), F.col("c_acctbal").cast("string"))
    b = F.create_map(F.lit("seg"), F.lit("BUILDING"), F.lit("bal"), F.lit("5000"), F.lit("x"), F.lit("y"))
    return c.select("c_custkey", F.round(props.similarity(a, b), 6).alias("s"))


@register("f28_reading_time", r"SELECT doc_id, round(CAST(len(regexp_extract_all(text, '\S+')) AS DOUBLE) / 200, 6) AS reading_minutes FROM documents")
def f28(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.round(tx.statistics(F.col("text"))["reading_minutes"], 6).alias("reading_minutes"))


@register("f29_graph_label", "SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(p_brand || '-' || p_type, '[^a-zA-Z0-9_]', '_', 'g'), '_+', '_', 'g'), '_+$', '') AS label FROM part")
def f29(spark, sf):
    return table(spark, sf, "part").select("p_partkey", tx.graph_label(F.concat("p_brand", F.lit("-"), "p_type")).alias("label"))


@register("f30_pair_key", "SELECT n_nationkey, md5(least(n_name, 'M') || '||' || greatest(n_name, 'M') || '||fuzzy') AS k FROM nation")
def f30(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", tx.pair_key(F.col("n_name"), F.lit("M"), "fuzzy").alias("k"))


@register("f31_key_hash", "SELECT c_custkey, sha256(c_name) AS h FROM customer")
def f31(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", tx.secret_hash(F.col("c_name")).alias("h"))


@register("c20_validators", r"SELECT page_id, regexp_matches(url, '^https?://[^\s/$.?#][^\s]*$') AS is_url, regexp_matches(url, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$') AS is_email FROM pages")
def c20(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.valid("url", F.col("url")).alias("is_url"), tx.valid("email", F.col("url")).alias("is_email"))


@register("c21_escape_html", "SELECT page_id, md5(replace(replace(replace(replace(replace(html, '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;'), '/', '&#x2F;')) AS h FROM pages")
def c21(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(tx.escape_html(F.col("html")).cast("binary")).alias("h"))


@register("n05_fixed_windows", "SELECT doc_id, CAST(k AS INTEGER) AS chunk_index, md5(substring(text, k * 800 + 1, 1000)) AS h FROM (SELECT doc_id, text, unnest(generate_series(0, greatest(CAST(ceil((length(text) - 200) / CAST(800 AS DOUBLE)) AS BIGINT) - 1, 0))) AS k FROM documents WHERE length(text) > 0) x")
def n05(spark, sf):
    return chunking.fixed_windows(table(spark, sf, "documents"), 1000, 200).select("doc_id", "chunk_index", F.md5(F.col("chunk").cast("binary")).alias("h"))


@register("n03_sentence_ends")
def n03(spark, sf):
    return chunking.chunked(table(spark, sf, "documents"), chunking.cut_at_ends, size=1000, overlap=200)


@register("n01_packed_sentences")
def n01(spark, sf):
    return chunking.chunked(table(spark, sf, "documents"), chunking.pack_sentences)


@register("n06_paragraphs", r"SELECT doc_id, CAST(k AS INTEGER) AS chunk_index, md5(array_to_string(p[k * 5 + 1:k * 5 + 5], chr(10) || chr(10))) AS h FROM (SELECT doc_id, p, unnest(generate_series(0, CAST(ceil(len(p) / CAST(5 AS DOUBLE)) AS BIGINT) - 1)) AS k FROM (SELECT doc_id, list_filter(string_split_regex(text, '\n\s*\n'), lambda x: trim(x) <> '') AS p FROM documents) d) e")
def n06(spark, sf):
    return chunking.paragraphs(table(spark, sf, "documents")).select("doc_id", "chunk_index", F.md5(F.col("chunk").cast("binary")).alias("h"))


# RE2's \b knows ASCII alone, so letters beyond it become underscores, which it takes for part of a word
_PLAIN = r"regexp_replace(text, '[^\P{L}A-Za-z]', '_', 'g')"
_NINE = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS entity_type, unnest(regexp_extract_all({_PLAIN if k in ('Bank', 'Person', 'Account', 'Date') else 'text'}, '(?i){p}')) AS entity_text FROM documents" for k, p in chunking.ENTITY_PATTERNS.items())


@register("n09_entity_values", _NINE)
def n09(spark, sf):
    return chunking.entity_values(table(spark, sf, "documents")).select("doc_id", "entity_type", "entity_text")


@register("n12_related_in_sentences")
def n12(spark, sf):
    chunks = chunking.chunked(table(spark, sf, "documents"), chunking.cut_at_ends, size=1000, overlap=200)
    return chunking.related_in_sentences(chunking.entity_spans(chunks), chunking.sentences(chunks))
