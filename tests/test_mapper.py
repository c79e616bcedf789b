import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tektonis.functions import layout as lf
from tektonis.operators import compose, emit, mapper, triples
from tektonis.sources import sinks


def test_offline_mapping(spark):
    rows = [(1, "24 cm Leichtbeton; Luftschicht 4 cm; 11,5 cm brick"), (2, "nothing to see"), (3, None), (4, "80 mm insulation, Putz")]
    df = spark.createDataFrame(rows, "id bigint, text string")
    got = {r.id: r.l for r in df.select("id", mapper.map_layers(F.col("text"), F.lit("")).alias("l")).collect()}
    assert [(x.fn, x.cat, x.thickness_cm) for x in got[1]] == [("LoadBearing", "Concrete", 24.0), ("Air", None, 4.0), ("LoadBearing", "Brick", 11.5)] and got[2] is None and got[3] is None

    def broken(text, context):
        raise RuntimeError

    assert {r.l for r in df.select(mapper.map_layers(F.col("text"), F.lit(""), broken).alias("l")).collect()} == {None}
    corpus = spark.createDataFrame([("Insulating", "layer_function", "thermal insulation"), ("Brick", "material", "brick"), ("Other", "none", "brick")], "item string, branch string, text string")
    out = {r.id: r for r in mapper.process(df.where("text IS NOT NULL"), corpus, "tabula").collect()}
    assert out[1].topology == "MultiLayer" and [x.fn for x in out[2].layers] == ["LoadBearing"] or out[2].layers == []
    assert [x.fn for x in out[4].layers] == ["Insulating", "Finishing"]
    assert {r.branch for r in mapper.matches(df, corpus, "tabula").collect()} <= {"layer_function", "material"}
    with pytest.raises(KeyError):
        mapper.profile("none")


def test_small_helpers(spark):
    one = spark.range(1)
    r = one.select(mapper.zip_variants(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("x"))).alias("z"), mapper.translate(F.lit("Wand aus Holz"), {"wand": "wall", "holz": "wood"}).alias("t"), mapper.translate(F.lit("xyz"), {"wand": "wall"}).alias("n")).collect()[0]
    assert [tuple(x) for x in r.z] == [("a", "a"), ("b", "b")] and r.t == "wall aus wood" and r.n is None
    g = spark.createDataFrame([("p", "domain", "D", "iri", None, None), ("q", "range", "R", "iri", None, None)], triples.SCHEMA)
    assert sorted(r.line for r in mapper.axiom_listing(g, "domain", "range").collect()) == ["p: D -> —", "q: — -> R"]


def test_flags(spark):
    c = spark.createDataFrame([("A",), ("B",), ("T",), ("X",)], "item string")
    iri = lambda *x: spark.createDataFrame([(i,) for i in x], "iri string")
    got = {r.item: (r.is_function, r.is_category, r.is_type) for r in mapper.candidate_flags(c, iri("A", "X"), iri("none"), iri("B"), iri("A", "T", "X"), "X").collect()}
    assert got == {"A": (True, False, False), "B": (False, True, False), "T": (False, False, True), "X": (False, False, False)}
    found = spark.createDataFrame([(1, "A")], "id bigint, item string")
    assert mapper.allowed_items(found, "slice", iri("Z")).collect()[0].allowed == ["A"]
    assert sorted(mapper.allowed_items(found, "tabula", iri("Z")).collect()[0].allowed) == ["A", "Z"]


def test_lines(spark):
    rows = [("1.2 Decke",), ("l.S Decke",), ("- 12 -",), ("Außenwände: 24 cm Ziegel, zweischichtig",), ("text",), (None,)]
    df = spark.createDataFrame(rows, "t string")
    got = df.select(lf.line_kind(F.col("t")).alias("k"), lf.section_header(F.col("t")).alias("s"), lf.wall(F.col("t")).alias("w"), lf.measurement(F.col("t")).alias("m")).collect()
    assert [r.k for r in got[:5]] == ["section", "section", "page", "key", "text"] and tuple(got[1].s) == ("1.5", "Decke")
    assert (got[3].w.thickness, got[3].w.material, got[3].w.layers) == ("24 cm", "brick", 2)
    m = spark.sql("SELECT map('Außenwände', 'a', 'Dach', 'd') AS p").select(lf.pick_field(F.col("p"), ["wand", "aussenw"]).alias("x")).collect()[0].x
    assert m == "a"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    sinks.write_report(df, str(tmp_path / "r"), {"total": F.sum("v")})
    assert spark.read.json(str(tmp_path / "r" / "totals")).collect()[0].total == 3 and spark.read.json(str(tmp_path / "r" / "rows")).count() == 2
    assert json.loads(sinks.payload(df, "k", ["v"]).orderBy("k").collect()[0].value) == {"v": 1}
    assert sinks.counts(df, {"big": F.col("v") > 1}).collect()[0].big == 1
    sets = spark.createDataFrame([(7, "SingleLayer", [(1, "Air", None, None, 4.0)])], f"id bigint, topology string, layers array<{compose.LAYER}>")
    nodes, edges = emit.network(emit.composition_triples(sets, "id", "layers", "topology"))
    assert sinks.network_html(nodes, edges, str(tmp_path / "g.html")) == nodes.count() and "hasLayer" in Path(tmp_path / "g.html").read_text()
    with pytest.raises(ValueError):
        sinks.network_html(nodes, edges, str(tmp_path / "g.html"), most=0)
    sinks.bar_chart_svg([("a", 50.0)], str(tmp_path / "c.svg"))
    assert "<rect" in Path(tmp_path / "c.svg").read_text()
