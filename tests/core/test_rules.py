"""Rules that SQL does not say, by hand-computed values."""

import io
import json
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from entigraph.functions import similarity as sim
from entigraph.functions import text as tx
from entigraph.operators import chunking, graph, ontology, query, resolve
from entigraph.plans import pipeline
from entigraph.sources import files, http, rdf
from entigraph.streaming import limits, stateful


def test_sounds(spark):
    """Worked out by hand from the rules; letters beyond A-Z do not count, doubled sounds stay."""
    want = {"Pfister": ("P123", "PFSTR"), "Robert": ("R163", "RBRT"), "Rupert": ("R163", "RPRT"), "": ("0000", ""), "A": ("A000", "A"), "Hello": ("H400", "HLL"), "Phone": ("P500", "FN"), "city": ("C300", "STY"), "cat": ("C300", "KT"), "Thomas": ("T520", "0MS"), "Xavier": ("X160", "KSFR"), "school": ("S240", "SKL"), "Ahab": ("A100", "AHB"), "Élan": ("L500", "LN"), "Quick": ("Q200", "KKK"), "which": ("W200", "WK"), "Bush": ("B200", "BX"), "12": ("0000", "")}
    rows = spark.createDataFrame([(w,) for w in want], "w string").select("w", sim.sound_code(F.col("w")).alias("s"), sim.metaphone(F.col("w")).alias("m")).collect()
    assert {r.w: (r.s, r.m) for r in rows} == want


def test_jaro_winkler():
    assert sim.jaro_winkler_of("MARTHA", "MARHTA") == pytest.approx(0.961111, abs=1e-6)
    assert sim.jaro_winkler_of("", "") == 1 and sim.jaro_winkler_of("a", "") == 0


def test_chunks():
    with pytest.raises(ValueError):
        chunking.cut_at_ends("x", 100, 50)
    text = "A sentence here. " * 200
    parts = chunking.cut_at_ends(text, 1000, 200)
    assert parts[0].endswith(".") and len(parts[0]) <= 1100
    assert all(text.find(p) >= 0 for p in parts) and "".join(parts)[-20:] == text[-20:]
    assert chunking.pack_sentences("short") == []
    packed = chunking.pack_sentences(text.strip(), 500, 100)
    assert all(len(p) >= 100 for p in packed)


def test_text_functions(spark):
    rows = [("<b>a</b> <i>b</i>", "Weiß & Co., 1st", "a\n\nb c")]
    r = spark.createDataFrame(rows, "h string, n string, t string").select(tx.strip_html(F.col("h")).alias("h"), tx.normalize(F.col("n")).alias("n"), *[c.alias(k) for k, c in tx.statistics(F.col("t")).items()], tx.json_in(F.lit('so: {"a": 1} ok')).alias("j")).first()
    assert (r.h, r.n, r.line_count, r.filled_lines, r.word_count, r.j) == ("a b", "wei  co 1st", 3, 2, 3, '{"a": 1}')


def test_graph(spark):
    edges = spark.createDataFrame([("e1", "a", "b", "T"), ("e2", "b", "c", "T"), ("e3", "c", "a", "T"), ("e4", "c", "d", "U"), ("e5", "a", "a", "T")], "id string, source_entity_id string, target_entity_id string, relationship_type string")
    assert graph.shortest_path(edges, "a", "d", 5) == ["a", "c", "d"]
    assert graph.shortest_path(edges, "a", "x", 3) is None and graph.shortest_path(edges, "a", "a", 1) == ["a"]
    start = spark.createDataFrame([("a",)], "id string")
    hops = {(r.node, r.hops) for r in graph.trails(edges, start, 4, ("T",)).collect()}
    assert ("c", 3) in hops and all(h <= 4 for _, h in hops)
    far = {r.node: r.depth for r in graph.neighbours(edges, start, 3).collect()}
    assert far == {"a": 0, "b": 1, "c": 1, "d": 2}


def test_resolution_depends_on_order(spark):
    rows = [("1", "Acme Corp", "O", 0.5), ("2", "Acme Corp.", "O", 0.9), ("3", "Zeta", "O", 0.1), ("4", "acme corp", "P", 0.2)]
    got = {(r.entity_type, r.leader): (r.id, r.n_merged) for r in resolve.resolve_fuzzy(spark.createDataFrame(rows, "id string, entity_text string, entity_type string, confidence double")).collect()}
    assert got == {("O", "acme corp"): ("2", 2), ("O", "zeta"): ("3", 1), ("P", "acme corp"): ("4", 1)}


def test_read_only():
    assert query.forbidden_words("select * from t where created > 1") == []
    assert query.forbidden_words("DROP TABLE t") and query.forbidden_words("select 1; drop table t") and query.forbidden_words("")


def test_limits(spark):
    t0 = datetime(2024, 1, 1)
    calls = spark.createDataFrame([("u", t0 + timedelta(seconds=s), i) for i, s in enumerate([0, 1, 2, 3, 11, 12])], "k string, at timestamp, n int")
    allowed = lambda rule: [r.allowed for r in limits.decide(calls, "k", "at", "n", rule).orderBy("call_id").collect()]
    assert allowed(limits.Limit(2, 10)) == [True, True, False, False, True, True]
    assert allowed(limits.Limit(2, 10, "token_bucket")) == [True, True, False, False, True, True]


def test_limits_on_a_stream(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [("u", t0 + timedelta(seconds=s), i) for i, s in enumerate([0, 1, 2, 3, 11, 12])]
    schema = "k string, at timestamp, n int"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = stateful.decide(stream, "k", "at", "n", limits.Limit(2, 10)).writeStream.format("memory").queryName("decided").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.allowed for r in spark.table("decided").orderBy("call_id").collect()] == [True, True, False, False, True, True]


def test_levels():
    steps = [pipeline.Step("c", "x", ("a", "b")), pipeline.Step("b", "x", ("a",), 2), pipeline.Step("a", "x"), pipeline.Step("d", "x", ("a",), 1), pipeline.Step("e", "x", enabled=False)]
    assert [[s.step_id for s in level] for level in pipeline.levels(steps)] == [["a"], ["d", "b"], ["c"]]
    with pytest.raises(ValueError):
        pipeline.levels([pipeline.Step("a", "x", ("b",)), pipeline.Step("b", "x", ("a",))])


def test_document_pipeline(spark, sf_dir, tmp_path):
    mappings = spark.createDataFrame([("person", "u:p", 0.9)], "type_key string, class_uri string, confidence double")
    steps = pipeline.from_template("file", read={"path": f"{sf_dir}/documents.parquet"}, map={"mappings": mappings})
    log = pipeline.run(spark, steps, str(tmp_path), ("resolve", "map"))
    assert log == [("resolve", "completed", None), ("map", "completed", None)]
    assert spark.read.parquet(str(tmp_path / "map")).where("class_uri = 'u:p'").count() > 0


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("Grüße".encode("latin-1"))
    (tmp_path / "b.html").write_text("<p>Hi <b>you</b></p>")
    (tmp_path / "c.csv").write_text("x,y\n1,2\n3\n,4\n")
    (tmp_path / "d.json").write_text(json.dumps({"k": [1, {"z": 2}]}))
    (tmp_path / "e.bin").write_bytes(b"\0")
    (tmp_path / "f.docx").write_bytes(b"no zip")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Two</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "g.docx").write_bytes(out.getvalue())
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.error) for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert got["a.txt"][0] == "Grüße" and got["b.html"][0] == "Hi you" and got["c.csv"][0] == "x: 1 | y: 2\ny: 4"
    assert got["d.json"][0] == "k:\n  Item 1:\n    1\n  Item 2:\n    z: 2" and got["g.docx"][0] == "One\n\nTwo"
    assert got["e.bin"][1].startswith("unsupported") and got["f.docx"][1]


def test_http_requests():
    assert http.request("http://x/a", {"auth": "bearer", "token": "t"}).headers["Authorization"] == "Bearer t"
    assert http.request("http://x/a?b=1", {"auth": "api_key", "key": "k", "keyin": "query"}).full_url == "http://x/a?b=1&api_key=k"
    with pytest.raises(ValueError):
        http.HttpReader({})


def test_ontology_file(spark, tmp_path):
    (tmp_path / "o.owl").write_text("""<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:owl="http://www.w3.org/2002/07/owl#">
    <owl:Class rdf:about="http://x/ontology/D/A"><rdfs:label>A</rdfs:label></owl:Class>
    <owl:Class rdf:about="http://x/ontology/D/B"><rdfs:label>B</rdfs:label><rdfs:subClassOf rdf:resource="http://x/ontology/D/A"/></owl:Class>
    <owl:ObjectProperty rdf:about="http://x/ontology/D/p"><rdfs:label>p</rdfs:label><rdfs:domain rdf:resource="http://x/ontology/D/A"/><rdfs:range rdf:resource="http://x/ontology/D/B"/></owl:ObjectProperty></rdf:RDF>""")
    triples = rdf.read_triples(spark, str(tmp_path / "o.owl"))
    classes = {r.label: r for r in ontology.with_parent_ids(ontology.classes(triples)).collect()}
    assert classes["B"].parent_class_id == classes["A"].id and classes["A"].domain == "D" and classes["A"].parent_class_id is None
    p = ontology.properties(triples).first()
    assert (p.property_type, p.domain_uri, p.range_uri) == ("object", "http://x/ontology/D/A", "http://x/ontology/D/B")


@pytest.mark.parametrize(("word", "code"), [("Cher", "KR"), ("Michel", "MKL"), ("Schema", "SKM"), ("cell", "SLL"), ("accent", "AKSNT"), ("phone", "FN"), ("ship", "XP"), ("thatch", "0TK"), ("hello", "HLL"), ("ahha", "AH"), ("hhe", "H"), ("box", "BKS"), ("12", "")])
def test_metaphone(spark, word, code):
    assert spark.createDataFrame([(word,)], "w string").select(sim.metaphone(F.col("w"))).first()[0] == code


def test_relation_ends(spark):
    """The first entity with the same text wins, else the first that contains the end or lies in it; no entity, no relation."""
    chunks = spark.createDataFrame([(1, 0, "Ann Lee MỞ tài khoản 77 tại BIDV\nBob chuyển 5 cho x"), (2, 0, "Ann Lee là khách hàng của BIDV"), (3, 0, "Zed có 1 tại y")], "doc_id long, chunk_index int, chunk string")
    found = [(1, 0, "Ann", "Person", 0), (1, 0, "ann lee", "Person", 3), (1, 0, "77", "Account", 20), (1, 0, "Bob 5", "Person", 40), (2, 0, "Ann Lee", "Person", 0), (2, 0, "BIDV", "Bank", 30), (3, 0, "Zed", "Person", 0)]
    spans = spark.createDataFrame(found, "doc_id long, chunk_index int, entity_text string, entity_type string, start_position int")
    got = {tuple(r)[2:] for r in chunking.relations_by_pattern(chunks, spans).collect()}
    assert got == {("ann lee", "77", "owns_account", 0.6), ("Bob 5", "Bob 5", "transfers_money_to", 0.6)}


def test_packed_sentences():
    """Hand-computed: greedy up to the size, the next chunk begins with the end of the last one, short ones are left out."""
    text = "Aaaa bbbb. Cccc dddd! Eeee ffff? Gggg."
    assert chunking.pack_sentences(text, size=20, overlap=5, least=1) == ["Aaaa bbbb. Cccc dddd!", "dddd!Eeee ffff? Gggg."]
    assert chunking.pack_sentences(text, size=19, overlap=3, least=13) == ["bb.Cccc dddd!", "dd!Eeee ffff? Gggg."]
    assert chunking.pack_sentences("One. Two.", size=100, overlap=5, least=1) == ["One. Two."]
    assert chunking.pack_sentences("One. Two.", size=100, overlap=5, least=50) == []
    assert chunking.pack_sentences("", least=1) == []
