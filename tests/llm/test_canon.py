import itertools
import random

import pytest

from tektonis.llm import canon

REF = [(1, "c", "FiredClay", "fired clay", "gebrannter Ton"), (2, "c", "RubberLayer", "rubber layer", "Gummilage"), (3, "c", "MineralWool", "mineral wool", "Mineralwolle"), (4, "d", "FiredClay", "other fired clay", None)]


@pytest.mark.parametrize(
    "value,want",
    [("<https://www.vocab.example/bm#FiredClay/>", "fired clay"), ("fn=FiredClay [2]", "fired clay"), ("presumably fired  CLAY?", "fired clay"), ("Existing: FIRED_CLAY. Usual: 8 cm of insulation", "fired clay"), ("fired clay, 12 cm", "fired clay"), ("Wärmedämmung with 5 cm insulation", "waermedaemmung"), ("see plan", ""), (" ", "")],
)
def test_tokens(value, want):
    assert " ".join(canon.tokens(value)) == want


def test_keys_lose_no_pair():
    rng = random.Random(3)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(3, 13))) for _ in range(150)]
    for a, b in itertools.product(words, words):
        if canon.osa(a, b, canon.reach(len(b))) <= canon.reach(len(b)):
            assert canon.query_keys(a) & canon.reference_keys(b), (a, b)


def test_map(spark):
    ref = spark.createDataFrame(REF, "ref_id bigint, kind string, local_name string, label_en string, label_de string").selectExpr("*", "concat('https://v/bm#', local_name) AS iri")
    values = ["fired clay", "FiredClya", "clay/fired", "fir. clay", "firedcaly", "Gummilge", "rubber boots", "minralwool", "nothing at all", "", "layer", "x" * 5000, "fired clay layer"]
    rows = [(i, "c", v) for i, v in enumerate(values)] + [(50, "c", None), (51, "d", "fired clay"), (52, None, "fired clay"), (0, "c", "fired clay")]
    df = spark.createDataFrame(rows, "id bigint, kind string, value string").selectExpr("*", "1 AS score", "2 AS token")
    got = {r.id: r.ref_id for r in canon.map_to_reference(df, ref).collect()}
    assert got == dict(enumerate([1, 1, 1, 1, 1, 2, 0, 3, 0, 0, 0, 0, 1])) | {51: 4, 52: 0}
    assert canon.map_to_reference(df.limit(0), ref).count() == 0
    assert {r.ref_id for r in canon.map_to_reference(df, ref.limit(0)).collect()} == {0}


def test_synonyms_are_an_input(spark):
    ref = spark.createDataFrame(REF, "ref_id bigint, kind string, local_name string, label_en string, label_de string").selectExpr("*", "concat('https://v/bm#', local_name) AS iri")
    long = "fernwaermeleitungsdaemmung" * 4  # a name of more than 64 characters
    more = spark.createDataFrame([("c", "FiredClay", "Backstein"), ("c", "Unknown", "clay brick"), ("c", "FiredClay", None), ("c", "MineralWool", " "), ("c", "MineralWool", long)], "kind string, local_name string, name string")
    df = spark.createDataFrame([(0, "c", "Backstien"), (1, "c", "Papiergeld"), (2, "c", long[:80] + "x" + long[81:])], "id bigint, kind string, value string")
    refs = lambda *a: {r.id: r.ref_id for r in canon.map_to_reference(df, ref, *a).collect()}
    assert refs() == {0: 0, 1: 0, 2: 0} and refs(0.7, more) == {0: 1, 1: 0, 2: 3}
