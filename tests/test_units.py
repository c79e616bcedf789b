from decimal import Decimal
from fractions import Fraction

import pytest

from tektonis.operators import units


@pytest.mark.parametrize(
    "text,found",
    [
        (None, []),
        ("", []),
        ("12,5 cm", [("12.5", "cm")]),
        ("ca. 300Millimeter", [("300", "mm")]),
        ('6 1/8" of felt', [("6.125", "in")]),
        ("1/4 in", [("0.25", "in")]),
        ("8/10 cm", [("8", "cm"), ("10", "cm")]),
        ("22 to 28 cm", [("22", "cm"), ("28", "cm")]),
        ("4–6 mm + 140 + 160 mm", [("4", "mm"), ("6", "mm"), ("140", "mm"), ("160", "mm")]),
        ("eight centimetres, 12-cm", [("8", "cm"), ("12", "cm")]),
        ("140 m² attic, 45 kg/m3, U = 0.8 W/(m²K), 22 degrees, WLS 035", []),
        ("2 layers of felt, 2.5-6.5 cm fill", [("2.5", "cm"), ("6.5", "cm")]),
    ],
)
def test_quantities(text, found):
    assert [(str(v), u) for v, u in units.quantities(text)] == found


@pytest.mark.parametrize(
    "text,found",
    [
        ("1,200 mm", [("1200", "mm")]),
        ("1.200,5 mm and 12'500 mm", [("1200.5", "mm"), ("12500", "mm")]),
        ("0,125 m, 6.125 in", [("0.125", "m"), ("6.125", "in")]),
        ("one hundred and twenty mm", [("120", "mm")]),
        ("two hundred mm", [("200", "mm")]),
        ("half an inch", [("0.5", "in")]),
        ("one and a half inches", [("1.5", "in")]),
        ("1½ in, ¾ inch", [("1.5", "in"), ("0.75", "in")]),
        ("zwanzig cm", [("20", "cm")]),
        ("fünfundzwanzig Zentimeter oder hundertzwanzig mm", [("25", "cm"), ("120", "mm")]),
        ("zweihundert mm", [("200", "mm")]),
        ("ein in Holz gefasster Rand", []),
    ],
)
def test_figures_in_words(text, found):
    assert [(f"{v:f}", u) for v, u in units.quantities(text)] == found


@pytest.mark.parametrize("note,unit", [(None, None), ("in.", "in"), ("Angaben in m", "m"), ("thickness in dm", "dm"), ("draft", None), ("Maße in Zoll", "in"), ("checked against sheet, centimetres", "cm")])
def test_noted_unit(note, unit):
    assert units.noted_unit(note) == unit


def test_thickness_order():
    assert units.thickness("d = 5 mm", 9.0, "cm", "9 in") == ("5", "mm")
    assert units.thickness(" ", 9.0, "dm", "9 in") == ("9.0", "dm")
    assert units.thickness(None, 50.0, "draft", "add 50 mm insulation") == ("50.0", "mm")
    assert units.thickness(None, 5.0, None, "add 50 mm insulation") == ("5.0", "cm")
    assert units.thickness(None, -1.0, "cm", None) is None and units.thickness(None, float("nan"), None, None) is None and units.thickness("0 cm", None, None, None) is None


def test_graph_is_consistent_and_checked():
    got = units.compositions()
    assert got["in"] == ("um", Fraction(25400), Fraction(0)) and got["degF"][1:] == (Fraction(5, 9), Fraction(-160, 9))
    with pytest.raises(ValueError):
        units.compositions((*units.EDGES, ("ft", "mm", "300", "0")))


def test_to_common(spark):
    df = spark.createDataFrame([("a", "12.5", "cm"), ("b", "0.25", "in"), ("c", "1", "parsec"), ("d", None, "cm")], "id string, figure string, unit string")
    got = {r.id: r.um for r in units.to_common(df).collect()}
    assert got == {"a": 125000, "b": 6350, "d": None}
    assert units.to_common(df.limit(0)).count() == 0
    rows = spark.createDataFrame([(1, "x", None, 5.0, "mm", "e"), (2, "y", "1 m", None, None, None), (3, "z", None, None, None, None)], "record_id bigint, extra string, thickness_text string, thickness_cm double, unit_note string, english string")
    assert sorted(map(tuple, units.layer_quantities(rows).collect())) == [(1, "x", "5.0", "mm"), (2, "y", "1", "m")]
    text = spark.createDataFrame([(1, "boards 8 cm, air 4/6 mm"), (2, None), (3, "")], "id bigint, t string")
    assert [(r.id, r.mention_no, Decimal(r.figure), r.unit) for r in units.text_quantities(text, "t").orderBy("mention_no").collect()] == [(1, 1, 8, "cm"), (1, 2, 4, "mm"), (1, 3, 6, "mm")]
