"""One graph in each syntax gives the same triples."""

import re

import pytest

from entigraph.sources import rdf, turtle

RDF, EX = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://ex.org/"
TURTLE = '''@prefix : <http://ex.org/> . # the graph
PREFIX ex: <http://ex.org/v#>
@base <http://ex.org/> .
:Bank a ex:Class ; ex:label "Bank"@en , """a "long" \\u00e9
name""" ; ex:rank 3, 1.5e0, true ; ; .
<Branch> ex:of :Bank ; ex:at [ ex:city 'Han\\'oi' ; ex:zip "10"^^ex:int ] .
_:x ex:list ( :Bank "two" ) . _:x ex:empty () .
[ ex:alone :Bank ] .
'''
TRIG = "@prefix : <http://ex.org/> . @prefix ex: <http://ex.org/v#> .\n" + ":g {" + ':Bank a ex:Class ; ex:label "Bank"@en , """a "long" é\nname""" ; ex:rank 3, 1.5e0, true }\nGRAPH <http://ex.org/h> { :Branch ex:of :Bank ; ex:at [ ex:city "Han\'oi" ; ex:zip "10"^^ex:int ] . _:x ex:list ( :Bank "two" ) ; ex:empty () . }\n{ [] ex:alone :Bank }\n'
JSON = '''{"@context": {"@base": "http://ex.org/", "ex": "http://ex.org/v#", "label": "ex:label", "of": {"@id": "ex:of", "@type": "@id"}, "list": {"@id": "ex:list", "@container": "@list"}, "id": "@id"},
"@graph": [{"id": "Bank", "@type": "ex:Class", "label": [{"@value": "Bank", "@language": "en"}, "a \\"long\\" \\u00e9\\nname"], "ex:rank": [3, "1.5e0", true], "note": "unexplained"},
{"id": "Branch", "of": "Bank", "ex:at": {"ex:city": "Han'oi", "ex:zip": {"@value": "10", "@type": "ex:int"}}},
{"id": "_:x", "list": [{"@id": "Bank"}, "two"], "ex:empty": {"@list": []}},
{"ex:alone": {"@id": "Bank"}}]}'''


def shape(rows):
    """Triples with blank nodes told apart by what is said of them."""
    rows = [(r.s, r.p, r.o) for r in rows]
    blank = lambda x: x.startswith("_:")
    names = {x: "_" for t in rows for x in t if blank(x)}
    for _ in range(len(names)):
        names = {x: "_" + "|".join(sorted([f"{p}>{names.get(o, o)}" for s, p, o in rows if s == x] + [f"{names.get(s, s)}>{p}" for s, p, o in rows if o == x])) for x in names}
        names = {x: f"_{hash(v)}" for x, v in names.items()}
    return sorted((names.get(s, s), p, names.get(o, o)) for s, p, o in rows)


def test_the_same_graph(spark, tmp_path):
    for name, text in (("a.ttl", TURTLE), ("a.trig", TRIG), ("a.jsonld", JSON)):
        (tmp_path / name).write_text(text)
    read = {n: turtle.read_turtle(spark, f"{tmp_path}/a.{n}").collect() for n in ("ttl", "trig")}
    read["jsonld"] = turtle.read_json_ld(spark, f"{tmp_path}/a.jsonld").collect()
    v = EX + "v#"
    told = [(EX + "Bank", RDF + "type", v + "Class"), (EX + "Bank", v + "label", "Bank"), (EX + "Bank", v + "label", 'a "long" é\nname'), *[(EX + "Bank", v + "rank", x) for x in ("3", "1.5e0", "true")], (EX + "Branch", v + "of", EX + "Bank")]
    for rows in read.values():
        assert set(told) <= {(r.s, r.p, r.o) for r in rows} and len(rows) == 17
        assert len({r.n for r in rows}) == 17
        assert shape(rows) == shape(read["ttl"])
    # the same statements line by line
    term = lambda x: x if x.startswith("_:") else f"<{x}>" if re.match("http", x) else '"' + x.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'
    (tmp_path / "a.nt").write_text("".join(f"{term(r.s)} {term(r.p)} {term(r.o)} .\n" for r in read["ttl"]))
    assert shape(rdf.read_n_triples(spark, f"{tmp_path}/a.nt").collect()) == shape(read["ttl"])


def test_blank_nodes_of_files_differ(spark, tmp_path):
    (tmp_path / "1.ttl").write_text("_:x <http://p> [] .")
    (tmp_path / "2.ttl").write_text("_:x <http://p> [] . # another file")
    once, again = (sorted(map(tuple, turtle.read_turtle(spark, f"{tmp_path}/*.ttl").collect())) for _ in range(2))
    assert once == again and len({x for s, _, o, _ in once for x in (s, o)}) == 4


@pytest.mark.parametrize("text", [":a :b :c .", "<http://a> <http://b> .", "<http://a> <http://b> <http://c>", '<http://a> <http://b> "open .', "<http://a> <http://b> ( 1 "])
def test_what_is_no_statement(text):
    with pytest.raises(ValueError):
        turtle.Statements(text).read()
