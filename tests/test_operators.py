import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from tektonis.functions import lca, text
from tektonis.operators import compose, features, impact, layout, matching, ontology, retrieval, triples, validate
from tektonis.runtime import number_distinct


def brute_closure(edges):
    nodes = {x for e in edges for x in e}
    out = {(n, n) for n in nodes}
    while True:
        new = {(a, d) for a, b in out for c, d in edges if b == c} - out
        if not new:
            return out
        out |= new


@pytest.mark.parametrize("seed", [1, 2])
def test_closure_with_cycles(spark, seed):
    rng = random.Random(seed)
    edges = [(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}") for _ in range(18)] + [("n1", "n2"), ("n2", "n1")]
    df = spark.createDataFrame([*edges, edges[0], (None, "x"), ("y", None)], "child string, parent string").withColumn("ancestor", F.lit("clash"))
    got = {(r.child, r.ancestor) for r in ontology.closure(df).collect()}
    assert got == brute_closure([e for e in edges if e[0] != e[1]])
    assert ontology.closure(df.limit(0)).count() == 0


def test_sums_are_null_without_values(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", None, 2), ("b", 1.5, 3), ("b", None, 4)], "k string, v double, o int")
    got = {r.k: (r.s, r.f) for r in df.groupBy("k").agg(impact.null_sum("v").alias("s"), impact.first_by("v", "o").alias("f")).collect()}
    assert got == {"a": (None, None), "b": (1.5, 1.5)}


def test_text_functions(spark):
    df = spark.createDataFrame([("DÄMMUNG 7,5 cm und 30 mm",), ("steps",), ("",), (None,)], "t string")
    r = df.select(text.rule_chunks(F.col("t")).alias("c"), text.thickness_cm(F.col("t")).alias("cm"), text.has_word(F.col("t"), "insulation").alias("i"), lca.safe_id(F.col("t")).alias("id")).collect()
    assert "thermal insulation" in r[0].c and "7,5 cm thickness" in r[0].c and r[0].cm == 7.5 and r[0].i
    assert r[1].c == ["expanded polystyrene insulation"] and r[1].cm is None and not r[1].i
    assert r[2].c == [] and r[2].id == "Unknown" and r[3].id == "Unknown"


def test_composition_rules(spark):
    rows = [([(1, "LoadBearing", None, None, 24.0), (2, "Air", None, None, None), (3, "Facade", None, None, 11.5)], "inner leaf of Leichtbeton, air gap; outer leaf of brick"), ([], "")]
    got = compose.with_materials(spark.createDataFrame(rows, f"l array<{compose.LAYER}>, t string"), "l", "t", "o").collect()
    assert [(x["cat"], x["typ"]) for x in got[0].o] == [("Concrete", "LightWeightConcrete"), (None, None), ("Brick", None)] and got[1].o == []
    texts = spark.createDataFrame([("Stahlbeton oder Beton, Ziegelelement, Ziegel",), (None,)], "t string").select(compose.find_mentions("t").alias("m")).collect()
    assert [m[:2] for m in texts[0].m] == [("Concrete", "ReinforcedConcrete"), ("Concrete", None), ("Brick", None)]
    assert texts[1].m == []


def test_assignment_against_all_ways(spark):
    """Against a search through every way to give mentions to layers, of which the first in lexical order that leaves no layer open for nothing is the one."""
    names = ["inner leaf of concrete", "outer leaf of brick 12 cm", "air gap", "24 cm Leichtbeton", "insulation 8 cm", "tragend Stahlbeton", "Hohllochziegel putz", "", "brick"]
    kinds = [("LoadBearing", None, None, 24.0), ("Facade", None, None, 12.0), ("Air", None, None, None), ("Insulating", None, None, 8.0), ("Finishing", "Binders", None, None), (None, None, None, 12.0), (None, None, None, None)]
    rng = random.Random(4)
    cases = [([(i, *rng.choice(kinds)) for i in range(rng.randrange(0, 5))], rng.choice(["; ", ", ", " und "]).join(rng.sample(names, rng.randrange(1, 5)))) for _ in range(120)]
    df = spark.createDataFrame(cases, f"l array<{compose.LAYER}>, t string").withColumn("m", compose.find_mentions("t")).repartition(2)
    for r in compose.with_materials(df, "l", "t", "o").collect():
        named = [m for m in r.m if m.cat != "Binders"]

        def speaks(words, x):
            low = words.lower()
            told = any(w in low for w in compose.FUNCTION_WORDS.get(x.fn, ())) or (x.thickness_cm is not None and re.search(rf"\b{x.thickness_cm:g}\s*cm\b", low))
            return bool(told)

        fits = lambda m, x: speaks(r.t[max(0, m.start - 80) : m.end + 80], x) or any(m.words.lower() in c.lower() and speaks(c, x) for c in re.split("[;,]", r.t))
        free = [x.fn != "Air" and not x.cat for x in r.l]
        ways = itertools.product(*[[i for i, m in enumerate(named) if f and fits(m, x)] + [99] for x, f in zip(r.l, free)])
        best = min((w for w in ways if len({i for i in w if i < 99}) == sum(i < 99 for i in w)), default=())
        want = [(named[i].cat, named[i].typ) if i < 99 else (x.cat, x.typ) for i, x in zip(best, r.l)]
        rest = [n for n, (f, (cat, _)) in enumerate(zip(free, want)) if f and not cat]
        unused = [m for i, m in enumerate(named) if i not in best]
        if len(rest) == 1 and (unused or len(named) == 1):
            m = (unused or named)[0]
            want[rest[0]] = (m.cat, m.typ)
        assert [(x.cat, x.typ) for x in r.o] == want, (r.t, r.l)


def test_named_material_rules(spark):
    wall, air = (1, "LoadBearing", None, "Odd", 24.0), (2, "Air", "x", "y", 4.0)
    rows = [
        ("a", 0, [wall, air], "Wand aus Leichtbeton oder Ziegel, geputzt"), ("a", 1, [air], "Wand aus Leichtbeton oder Ziegel, geputzt"),
        ("b", 0, [wall, air], "brick wall"), ("c", 0, [wall], None), ("d", 0, [], "brick"),
    ]
    df = spark.createDataFrame([(k, n, "SingleLayer", 30.0, ls, t) for k, n, ls, t in rows], f"k string, pos int, topology string, thickness_cm double, layers array<{compose.LAYER}>, t string")
    got = {(r.k, r.pos): (r.topology, [tuple(x)[1:] for x in r.layers]) for r in compose.named_material_rules(df, "t").collect()}
    plaster = ("Finishing", "Binders", "Gypsum", None)
    assert got == {
        ("a", 0): ("MultiLayer", [plaster, ("LoadBearing", "Concrete", "LightWeightConcrete", 24.0), plaster]), ("a", 1): ("MultiLayer", [plaster, ("LoadBearing", "Brick", None, 24.0), plaster]),
        ("b", 0): ("SingleLayer", [("LoadBearing", "Brick", None, 24.0), ("Air", None, None, 4.0)]), ("c", 0): ("SingleLayer", [wall[1:]]),
    }


def test_payload_shapes(spark):
    one = '{"layer_topology": "t", "layers": [{"layer_index": 1, "thickness_cm": 2}]}'
    rows = [(one,), (f"[{one}]",), (f'{{"element_thickness_cm": 3, "layer_sets": [{one}, {one}]}}',), ("{",), (None,), ("{}",)]
    got = spark.createDataFrame(rows, "raw string").select(compose.normalise_payload(F.col("raw")).alias("p")).collect()
    assert [len(r.p.layer_sets) for r in got] == [1, 1, 2, 0, 0, 0] and got[2].p.element_thickness_cm == 3.0


def test_retrieval(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0])], "query_id bigint, vector array<double>")
    c = spark.createDataFrame([(i, [1.0, float(i)], i % 2) for i in range(6)], "item_id bigint, vector array<double>, b int")
    whole = retrieval.top_matches(q, c, 2).collect()
    blocks = retrieval.top_matches(q, c, 2, block=2).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, blocks)) and [r.item_id for r in whole if r.query_id == 1] == [0, 1]
    assert {r.branch for r in retrieval.top_matches(q, c, 1, branch="b").collect()} == {"0", "1"}
    assert retrieval.top_matches(q, c.limit(0), 2).count() == 0
    e = spark.createDataFrame([("abc",), (None,)], "t string").select(retrieval.embed("t").alias("v")).collect()
    assert len(e[0].v) == 64 and e[1].v is None


def test_substring_join(spark):
    df = spark.createDataFrame([(1, "red ring"), (2, None), (3, "")], "id bigint, t string")
    words = spark.createDataFrame([("red",), ("in",), ("",), (None,), ("red",)], "w string")
    for block in (1, 100):
        assert sorted(map(tuple, matching.substring_join(df, "id", "t", words, "w", block).collect())) == [(1, "in"), (1, "red")]
    assert matching.substring_join(df, "id", "t", words.limit(0), "w").count() == 0


def test_layout(spark):
    assert layout.anchored_rows([0, 4, 9, 12, 25], 10) == [1, 1, 1, 2, 3]
    w = spark.createDataFrame([(1, 5, 0, "b"), (1, 0, 3, "a"), (1, 0, 30, "c"), (2, 0, 0, None)], "page_id bigint, x int, y int, text string")
    assert sorted(map(tuple, layout.group_rows(w).collect())) == [(1, 1, "a b"), (1, 2, "c")]
    e = spark.createDataFrame([(1, i, n) for i, n in enumerate([1, 2, 9, 4, None, 6])], "d bigint, o bigint, n bigint")
    assert [r.repaired for r in layout.repair_numbers(e, "d", "o", "n").orderBy("place").collect()] == [1, 2, 3, 4, 5, 6]
    p = spark.createDataFrame([(1, 1, 5), (1, 2, None), (1, 3, None), (1, 7, None)], "d int, n int, p int")
    assert [r.filled for r in layout.fill_missing_pages(p, "d", "n", "p").orderBy("n").collect()] == [5, 6, 7, None]


def test_shapes(spark):
    t = triples.RDF_TYPE
    rows = [("a", t, "L"), ("a", t, "T1"), ("a", t, "T2"), ("a", "fn", "Air"), ("a", "mat", "m"), ("b", t, "L"), ("b", "fn", "x"), ("b", "fn", "y")]
    g = spark.createDataFrame([(*r, "iri", None, None) for r in [*rows, rows[0]]], triples.SCHEMA)
    assert [r.focus for r in validate.cardinality(g, "L", "fn", 1, 1).collect()] == ["b"]
    assert [r.focus for r in validate.mixed_types(g, ["T1", "T2"]).collect()] == ["a"]
    assert [r.focus for r in validate.none_of(g, "L", ["T1", "T2"]).collect()] == ["b"]
    assert [r.focus for r in validate.forbidden_with(g, "fn", "Air", "mat").collect()] == ["a"]
    assert [r.focus for r in validate.object_class(g, "mat", "M").collect()] == ["a"]
    assert [r.focus for r in validate.either_property(g, g.where("o = 'L'"), [["fn"], ["mat"]]).collect()] == ["b"]


def test_numbers_and_scaling(spark):
    df = spark.createDataFrame([(x,) for x in ["b", "a", None, "c", "a"]], "v string")
    assert {r.v: r.i for r in number_distinct(df, "v", "i").collect()} == {"a": 0, "b": 1, "c": 2}
    s = features.standard_scale(spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, y double"), ["x", "y"]).orderBy("x").collect()
    assert [(r.x_scaled, r.y_scaled) for r in s] == [(-1.0, 0.0), (1.0, 0.0)]


def test_transe_learns():
    import numpy as np

    t = np.array([(i, 0, i + 10) for i in range(10)])
    e, r = features.train_transe(t, 20, 1, epochs=300)
    d = lambda h, q: np.linalg.norm(e[h] + r[0] - e[q])
    assert np.mean([d(i, i + 10) < d(i, (i + 3) % 10 + 10) for i in range(10)]) >= 0.8
