"""Queries over small tables of their own, where the whole job shows."""

import json

import pytest

import __spark_entry__ as entry
from tektonis.operators import nested, ontology


@pytest.fixture
def tables(spark, tmp_path):
    def run(name, **made):
        for t, df in made.items():
            df.write.mode("overwrite").parquet(f"{tmp_path}/{t}.parquet")
        return entry.queries()[name](spark, str(tmp_path))

    return run


LAYER_STRUCT = "struct<predicted_function_iri:string,predicted_category_iri:string,predicted_type_iri:string,thickness_cm:double,thickness_text:string>"
FLOORS = f"case_id bigint, renovation_states array<struct<id:string,status_iri:string,english:string,german:string,layer_sets:array<struct<kind:string,layers:array<{LAYER_STRUCT}>>>>>"


def floors(spark):
    a, b, new = ("f", "c", None, 1.0, None), ("f", "c", "t", 2.0, None), ("ins", None, None, 8.0, None)
    states = [
        ("existing", None, None, None, [("given", [a]), ("given", [b])]),
        ("usual", None, None, None, [("below", [a, new]), ("top", [new, b]), ("given", [])]),
        ("advanced", None, None, None, None),
    ]
    return spark.createDataFrame([(7, states), (7, states), (8, None)], FLOORS)


def test_every_set_is_named(spark, tables):
    got = {(r.i, r.j, r.k): (r.uri, r.reused) for r in tables("renovation_layer_uris", tabula_floor_renovation=floors(spark)).collect()}
    assert got == {
        (1, 1, 1): ("case_7_state_1_set_1_layer_1", False), (1, 2, 1): ("case_7_state_1_set_2_layer_1", False),
        (2, 1, 1): ("case_7_state_1_set_1_layer_1", True), (2, 1, 2): ("case_7_state_2_set_1_layer_2", False),
        (2, 2, 1): ("case_7_state_2_set_2_layer_1", False), (2, 2, 2): ("case_7_state_1_set_2_layer_1", True),
    }


def test_every_set_is_counted(spark, tables):
    got = sorted((r.i, r.j or 0, r.kind or "", r.reused, r.added) for r in tables("renovation_reuse", tabula_floor_renovation=floors(spark)).collect())
    assert got == [(1, 1, "given", 1, 0), (1, 2, "given", 1, 0), (2, 1, "below", 1, 1), (2, 2, "top", 1, 1), (2, 3, "given", 0, 0), (3, 0, "", 0, 0)]


def test_energy_of_wrapped_records(spark, tables):
    one = {"building": {"id": "B1", "size_class": "AB"}, "energy_need_for_heating": {"existing_state": 200.5, "advanced_refurbishment": {"total": 50}}}
    two = {"building": {"id": "B2", "size_class": "TH"}, "energy": {"heating_demand": {"states": {"existing_state": 90}}}}
    plain = json.dumps(one)
    payloads = [plain, plain, json.dumps(plain), json.dumps(json.dumps(plain)), "\ufeff" + plain, json.dumps({"buildings": [one, two]}), json.dumps([two]), plain[:-3], None, "{}"]
    df = spark.createDataFrame([(max(i, 1), p) for i, p in enumerate(payloads)], "record_id bigint, payload string")
    got = sorted(map(tuple, tables("building_energy", building_records=df).collect()), key=str)
    first, second = ("B1", "AB", 200.5, 50.0), ("B2", "TH", 90.0, None)
    assert got == [(1, *first), (2, *first), (3, *first), (4, *first), (5, *first), (5, *second), (6, *second), (9, None, None, None, None)]


def test_energy_of_both_layouts(spark, tables):
    states = [{"existing": 129.2, "advanced_refurbishment": {"total": 46.6, "components": {"heating": 21.4}}}, {"existing_state": 90, "advanced_refurbishment": 30.5}, {"existing_state": 80, "advanced_refurbishment": {"components": {"heating": 1}}}]
    df = spark.createDataFrame([(i, json.dumps({"building": {"id": "B", "size_class": "AB"}, "energy": {"heating_demand": {"states": s}}})) for i, s in enumerate(states, 1)], "record_id bigint, payload string")
    got = sorted((r.record_id, r.existing, r.advanced) for r in tables("building_energy", building_records=df).collect())
    assert got == [(1, 129.2, 46.6), (2, 90.0, 30.5), (3, 80.0, None)]


def test_flat_tables_of_renovations(spark, tables):
    df = floors(spark)
    rows = lambda name: sorted(map(tuple, tables(name, tabula_floor_renovation=df).collect()))
    assert rows("p5_renovation_state_table") == [(7, "", f"states/{i}", i, s, None, None, None) for i, s in enumerate(["existing", "usual", "advanced"], 1)]
    assert rows("p5_renovation_set_table") == [(7, f"states/{i}", f"states/{i}/sets/{j}", j, k) for i, j, k in [(1, 1, "given"), (1, 2, "given"), (2, 1, "below"), (2, 2, "top"), (2, 3, "given")]]
    layers = {r.node: r for r in tables("p5_renovation_layer_table", tabula_floor_renovation=df).collect()}
    assert len(layers) == 6 and {n.rpartition("/layers/")[0] for n in layers} == {r.parent_node for r in layers.values()}
    assert layers["states/2/sets/2/layers/2"][4:] == ("f", "c", "t", "2.0", None)


def test_flat_tables_of_buildings(spark, tables):
    one = {"building": {"heat_supply_system": {"type": "x", "category": "c"}}, "elements": {"Wall": {"a": 1, "states": {"existing": {"u_value_W_m2K": 2.5}}}}}
    df = spark.createDataFrame([(1, json.dumps(one)), (2, json.dumps({"building": {"heat_supply_system": "stove"}}))], "record_id bigint, payload string")
    assert sorted(map(tuple, tables("p5_heat_table", building_records=df).collect())) == [(1, "", "heat", 1, "x", None, "c", None), (2, "", "heat", 1, None, None, None, "stove")]
    assert list(map(tuple, tables("p5_element_state_table", building_records=df).collect())) == [(1, "elements/Wall", "elements/Wall/existing", 1, "2.5", None)]


def test_triples_of_arrays(spark):
    schema = "id bigint, at array<struct<a:string,b:struct<c:int>,m:map<string,int>,more:array<int>>>"
    df = spark.createDataFrame([(1, [("x", (3,), {"k": 1}, [5, None]), (None, None, None, None), None])], schema)
    got = sorted(map(tuple, nested.array_triples(df, "id", "at", [("at", "at"), ("more", "more")]).collect()), key=str)
    first = [("at/*", "", "at/1", 1, f, v) for f, v in (("a", "x"), ("b.c", "3"), ("m", '{"k":1}'))]
    want = [*first, ("at/*", "", "at/2", 2, None, None), ("at/*", "", "at/3", 3, None, None), ("at/*/more/*", "at/1", "at/1/more/1", 1, "value", "5"), ("at/*/more/*", "at/1", "at/1/more/2", 2, None, None)]
    assert got == sorted(((1, *x) for x in want), key=str)


BOXES = "box_id bigint, scan_id string, page_no int, printed_page int, box_no int, page_header struct<main_section:struct<section:string,title:string>,subseries:struct<section:string,title:string>>, section_title string"


def test_sections_begin_where_marks_change(spark, tables):
    head = lambda n: ((n, "T"), None)
    rows = [
        ("a", 1, 1, head("1"), None), ("a", 2, 1, None, "x"), ("a", 2, 2, head("1"), "x"), ("a", 3, 1, None, None), ("a", 4, 1, head("1"), " "), ("a", 6, 1, head("2"), "x"), ("a", 7, 1, head("2"), "y"), ("a", 7, 2, head("3"), "y"), ("a", 9, 1, None, None),
        ("b", 3, 1, None, None), ("b", 4, 1, ((None, None), None), ""),
    ]
    df = spark.createDataFrame([(i, s, p, p, b, h, t) for i, (s, p, b, h, t) in enumerate([*rows, rows[0]])], BOXES)
    assert sorted(map(tuple, tables("section_ranges", page_boxes=df).collect())) == [("a", 1, 1), ("a", 2, 5), ("a", 6, 6), ("a", 7, 9), ("b", 3, 4)]


def test_only_missing_pages_are_filled(spark, tables):
    pages = [("a", 2, 12), ("a", 3, 99), ("a", 4, None), ("a", 6, 20), ("a", 7, None), ("a", 9, None)]
    df = spark.createDataFrame([(i, s, n, p, 1, None, None) for i, (s, n, p) in enumerate(pages)], BOXES)
    assert sorted((r.page_no, r.printed, r.filled) for r in tables("fill_missing_pages", page_boxes=df).collect()) == [(2, 12, 12), (3, 99, 99), (4, None, 100), (6, 20, 20), (7, None, 21), (9, None, None)]


VOCABULARY = [("category", "Brick"), ("category", "Wood"), ("category", "Glass"), ("material", "Clinker"), ("material", "Plank"), ("function", "AirSpace"), ("function", "Tightening")]
SETS = "set_id bigint, layers array<struct<layer_index:int,predicted_function_iri:string,predicted_category_iri:string,predicted_type_iri:string,thickness_cm:double>>, thickness_cm double, layer_set_description string"


def layer_sets(spark, layers):
    """The vocabulary and one set of layers (function, category, type), given by local names."""
    iri = lambda x: x and f"https://vocab.example/bm#{x}"
    made = [(n, *map(iri, x), 1.0) for n, x in enumerate(layers, 1)]
    words = spark.createDataFrame([(i, k, iri(n), n, n, n) for i, (k, n) in enumerate(VOCABULARY)], "ref_id bigint, kind string, iri string, local_name string, label_en string, label_de string")
    return {"vocabulary": words, "material_alternatives": spark.createDataFrame([(1, made, None, None)], SETS)}


LEGAL = [(f, c, t) for f, c, t in [("AirSpace", "Brick", None), ("Tightening", "Wood", "Plank"), ("Tightening", "Glass", "Clinker")]]
WRONG = [("Flying", "Cheese", "Gouda")]


def test_audit_knows_the_whole_vocabulary(spark, tables):
    got = lambda layers: {r.kind: (r.n, r.objects) for r in tables("range_audit", **layer_sets(spark, layers)).collect()}
    assert got(LEGAL) == {"type_orphan": (2, 2)}  # the vocabulary has no edges from types to categories
    assert got(LEGAL + WRONG) == {"type_orphan": (2, 2), "function_range": (1, 1), "category_range": (1, 1), "type_invalid": (1, 1)}


def test_validity_knows_the_whole_vocabulary(spark, tables):
    got = lambda layers: [tuple(r) for r in tables("validity_pct", **layer_sets(spark, layers)).select("slots", "bad", "validity").collect()]
    assert got(LEGAL) == [(3, 0, 100.0)] and got(LEGAL + WRONG) == [(4, 1, 75.0)]


def test_every_category_is_an_anchor(spark, tables):
    got = sorted(map(tuple, tables("validated_layer_sets", **layer_sets(spark, [("Tightening", c, None) for c in ("Brick", "Wood", "Glass", "Cheese")])).select("layer_index", "cat").collect()))
    assert got == [(1, "Brick"), (2, "Wood"), (3, "Glass"), (4, None)]


def test_closure_of_a_deep_chain(spark):
    n = 66
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(n)], "child string, parent string").coalesce(1)
    got = ontology.closure(chain)
    assert got.count() == (n + 1) * (n + 2) // 2 and got.where(f"child = 'n0' AND ancestor = 'n{n}' AND depth = {n}").count() == 1
    with pytest.raises(ValueError):
        ontology.closure(chain, max_depth=2)
