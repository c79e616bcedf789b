from pyspark.sql import functions as F

from tektonis.operators import compose, emit, retrieval, triples, validate
from tektonis.sources import files


def test_description_sources(spark):
    s = spark.createDataFrame([("DE.1", "Roof 1", "usual", None, "add"), ("DE.1", "Roof 1", "existing", None, " ")], "b string, e string, st string, de string, en string")
    got = files.stage_descriptions(s, "b", "e", "st", "de", "en").collect()
    assert [r.subject for r in got] == ["Building_DE_1_Layer_Roof_1_usual"] and got[0].metadata == {"element": "Roof 1", "stage": "usual"}
    w = spark.createDataFrame([("a | b", 1, 12), (None, 1, 1)], "w string, e int, l int")
    assert [r.subject for r in files.worksection_descriptions(w, "w", "e", "l").collect()] == ["E01_L12"] and files.source_label("/x/kb.ttl") == "kb"


def test_edges_and_taxonomy(spark):
    rows = [("a", "p", "x"), ("a", "q", "x"), ("b", "p", "y"), ("c", triples.SUBCLASS, "top"), ("d", triples.SUBCLASS, "top"), ("c", triples.LABEL, "see")]
    g = spark.createDataFrame([(*r, "iri", None, None) for r in rows], triples.SCHEMA)
    ids = lambda *x: spark.createDataFrame(list(x), "iri string, id bigint")
    assert [tuple(r) for r in triples.edges_between(g, ids(("a", 0), ("b", 1)), ids(("x", 7))).collect()] == [(0, 7)]
    assert {r.iri: r.text for r in triples.taxonomy_index(g, "top").collect()} == {"c": "see", "d": ""}


def test_building_stages(spark):
    rows = [("concrete wall 24 cm", "Wall 1", "add 12 cm insulation"), ("glass", "Window 1", "triple glazing"), ("", "Wall 2", None), (None, "Door", None)]
    df = spark.createDataFrame(rows, "t string, label string, m string")
    existing = compose.existing_set(F.col("t"), F.col("label"))
    got = df.select(existing.alias("e"), compose.refurbished_set(existing, F.col("m"), F.col("label")).alias("r")).collect()
    assert [(x.fn, x.cat, x.thickness_cm) for x in got[0].r] == [("LoadBearing", "Concrete", 24.0), ("Insulating", "MineralFibre", 12.0)]
    assert got[1].e == [] and [(x.fn, x.cat) for x in got[1].r] == [("Glazing", "Glass")] and got[2].r == [] and got[3].r == []
    st = spark.createDataFrame([("B", "Wall 1", "existing", ["l1"]), ("B", "Wall 1", "usual", ["l1", "l2"]), ("B", "Door", "usual", None)], "b string, e string, s string, l array<string>")
    g = emit.staged_triples(st, "b", "e", "s", "l")
    assert g.where("p LIKE '%hasLayer'").select("o").distinct().count() == 2 and g.where("p LIKE '%hasLayer'").count() == 3 and g.where("p LIKE '%status'").count() == 3
    assert emit.status_schema(st).count() == 3


def test_scores(spark):
    df = spark.createDataFrame([("Red ring", ["red", "ring", "red"]), ("blue", ["red"])], "h string, t array<string>")
    assert [r.s for r in df.select(F.round(retrieval.overlap_score(F.col("h"), F.col("t")), 3).alias("s")).collect()] == [0.7, None]
    assert [r.m for r in df.select(retrieval.is_material_entity(F.col("t"), F.array(F.col("h")), "ring", ["blue"]).alias("m")).collect()] == [True, True]
    ids = lambda *x: spark.createDataFrame(list(x), "id string, signature string")
    got = {r.id: r.score for r in validate.gold_score(spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "id string"), ids(("a", "x"), ("b", "y")), ids(("a", "x"), ("b", "z"), ("d", "w"))).collect()}
    assert got == {"a": 100.0, "b": 0.0, "c": 100.0, "d": None}
    path = lambda *x: spark.createDataFrame(list(x), "path string, severity string")
    audit = {r.path: (r.issues, r.violations, r.warnings, r.conforms) for r in validate.file_audit(path(("f", "x")), path(("f", "violation"), ("g", "warning")), path(("f", ""), ("g", ""), ("h", ""))).collect()}
    assert audit == {"f": (1, 1, 0, False), "g": (0, 0, 1, True), "h": (0, 0, 0, True)}


def test_validated_sets(spark):
    from tektonis.operators import ontology

    edges = spark.createDataFrame([("Lwc", "Concrete"), ("Bmu", "Brick")], "child string, parent string")
    closed = ontology.closure(edges)
    iri = lambda *x: spark.createDataFrame([(i,) for i in x], "iri string")
    anchors = ontology.nearest_anchor(closed, iri("Concrete", "Brick"))
    layers = [(1, "Insulating", None, "Lwc", 5.0), (2, "Bmu", None, None, None), (3, None, "Lwc", None, None), (4, "what", "Insulating", "Insulating", None), (5, None, "Brick", "Lwc", None), (6, None, "Concrete", "Concrete", 1.0), (7, None, None, None, None)]
    df = spark.createDataFrame([(1, layers, []), (2, layers[6:], []), (3, layers[:1], ["Insulating"]), (4, None, None)], f"id bigint, layers array<{compose.LAYER}>, ok array<string>").withColumn("fn", F.lit("clash"))
    got = {r.id: [tuple(x) for x in r.layers] for r in compose.validate_sets(df, "id", "layers", anchors, iri("Insulating"), iri("Lwc", "Bmu"), closed, "ok").collect()}
    assert got == {
        1: [(1, "Insulating", "Concrete", "Lwc", 5.0), (2, None, "Brick", "Bmu", None), (3, None, "Concrete", "Lwc", None), (4, None, "Concrete", "Lwc", None), (5, None, "Concrete", None, 1.0)],
        3: [(1, "Insulating", None, None, 5.0)],
    }
