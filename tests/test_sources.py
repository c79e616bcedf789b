import pytest

from tektonis.operators import triples
from tektonis.sources import files, sinks, turtle

DOC = """@prefix : <http://x/#> . @prefix ex: <http://x/e/> .
@base <http://b/> .
# a comment
ex:a a :Thing ; :label "Dämmung"@de , 'x "y"' ; :n 5 , 2.5 , 1e3 , true ;
    :part [ :value "7,5 cm" ; :unit <http://u#cm> ] ; :list ( ex:b "c" ) .
<rel> :see <http://z/q#frag> . _:k :is _:k .
ex:long :text \"\"\"two
"lines\"\"\" .
"""


def test_parse():
    t = turtle.parse_turtle(DOC, "f")
    assert ("http://x/e/a", triples.RDF_TYPE, "http://x/#Thing", "iri", None, None) in t
    assert ("http://x/e/a", "http://x/#label", "Dämmung", "literal", "de", None) in t
    assert ("http://x/e/long", "http://x/#text", 'two\n"lines', "literal", None, None) in t
    assert {x[5] for x in t if x[1].endswith("#n")} == {turtle.XSD + k for k in ("integer", "decimal", "double", "boolean")}
    assert sum(x[1] == turtle.RDF + "first" for x in t) == 2 and any(x[2] == turtle.RDF + "nil" for x in t)
    assert any(x[0] == "http://b/rel" for x in t)
    assert turtle.parse_turtle("") == []
    for bad in ("ex:a ex:b ex:c .", "<a> <b> .", "<a> <b> <c>", '<a> <b> "c .'):
        with pytest.raises(turtle.TurtleError):
            turtle.parse_turtle(bad)


def test_round_trip(spark, tmp_path):
    (tmp_path / "a.ttl").write_text(DOC)
    (tmp_path / "b.ttl").write_text(DOC)
    g = turtle.read_turtle(spark, [str(tmp_path / "a.ttl"), str(tmp_path / "b.ttl")])
    bnodes = g.where("s LIKE '\\_:%'").count()
    assert bnodes == 2 * turtle.read_turtle(spark, [str(tmp_path / "a.ttl")]).where("s LIKE '\\_:%'").count()  # blank nodes of files stay apart
    named = g.where("o_kind <> 'bnode' AND s NOT LIKE '\\_:%'")
    turtle.write_turtle(named, str(tmp_path / "out"))
    again = turtle.read_turtle(spark, [str(tmp_path / "out" / "*.txt")])
    assert named.exceptAll(again).count() == 0 and again.exceptAll(named).count() == 0


def test_ntriples(spark, tmp_path):
    (tmp_path / "a.nt").write_text('<a> <p> <b> .\n_:x <p> "l"@en .\n<a> <q> "1"^^<t> .\nnonsense\n<a> <p> <b> .\n')
    got = {tuple(r) for r in turtle.read_ntriples(spark, str(tmp_path / "a.nt")).collect()}
    assert got == {("a", "p", "b", "iri", None, None), ("_:x", "p", "l", "literal", "en", None), ("a", "q", "1", "literal", None, "t")}


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"buildings": [{"building": {"id": "x"}}, {"building": {"id": "y"}}]}')
    (tmp_path / "b.json").write_text('[{"building": {"id": "z"}}]')
    got = files.read_json_records(spark, [str(tmp_path / "*.json")], "buildings")
    assert sorted(r.record for r in got.collect()) == [f'{{"building":{{"id":"{k}"}}}}' for k in "xyz"]
    assert tuple(files.combine(got).collect()[0]) == (3, "a.json,b.json")
    (tmp_path / ".env").write_text("﻿# c\nexport A='1'\nB=\"2\"\nA=3\nnothing\n")
    assert files.read_env(str(tmp_path / ".env"), {"B": "kept"}) == {"A": "1", "B": "kept"}
    with pytest.raises(FileNotFoundError):
        files.resolve(str(tmp_path / "none"), "NO_SUCH_VARIABLE", "x")
    (tmp_path / "c.csv").write_text("n,v\na,1\n,2\n")
    assert files.read_csv(spark, str(tmp_path / "c.csv"), "n string, v int", ["n"]).count() == 1
    cases = spark.createDataFrame([("a", 1), ("b", 2)], "id string, place int")
    assert files.select_case(cases, "place", 2).collect()[0].id == "b" and files.select_case(cases, "place", case_id="a").count() == 1
    with pytest.raises(IndexError):
        files.select_case(cases, "place", 3)


def test_ntriples_escapes_and_rejects(spark, tmp_path):
    lines = [r'<http://e/a> <http://e/p> "q\"u\\o\te\u00e4\'s" .', r'<http://e/b> <http://e/p> "far \U0001F600 and \n near"@de-AT .', "# note", "", "no triple", r'<http://e/c> <http://e/p> "' + "x" * 50_000 + '" .']
    (tmp_path / "g.nt").write_text("\n".join(lines), encoding="utf-8")
    got = {r.s: (r.o, r.o_lang) for r in turtle.read_ntriples(spark, str(tmp_path / "g.nt")).collect()}
    assert got == {"http://e/a": ('q"u\\o\teä\'s', None), "http://e/b": ("far \U0001F600 and \n near", "de-AT"), "http://e/c": ("x" * 50_000, None)}
    assert [r.value for r in turtle.ntriples_rejects(spark, str(tmp_path / "g.nt")).collect()] == ["no triple"]


def test_too_many_edges(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "x")], "id string, label string")
    edges = spark.createDataFrame([("a", f"b{i}", "p") for i in range(12)], "src string, dst string, label string")
    with pytest.raises(ValueError):
        sinks.network_html(nodes, edges, str(tmp_path / "g.html"), most=1)
