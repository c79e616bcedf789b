import pytest

from tektonis.operators import packed

ALL = frozenset(packed.CANDIDATES)


@pytest.mark.parametrize(
    "text,items",
    [
        (None, []),
        ("  ", []),
        ("one", ["one"]),
        ("2,5 cm screed, reed board", ["2,5 cm screed", "reed board"]),
        ("clay/straw filling / felt ply", ["clay/straw filling", "felt ply"]),
        ("tongue-and-groove boards oder felt or air", ["tongue-and-groove boards", "felt", "air"]),
        ("'brick or block, as found' or felt", ["brick or block, as found", "felt"]),
        ("mason's mortar; felt; ; air;", ["mason's mortar", "felt", "air"]),
        ('a|"so-called ""light"" brick, hollow"', ["a", 'so-called "light" brick, hollow']),
        ('["a, b", "c \\"d\\""]', ["a, b", 'c "d"']),
        ("(1) a 5 cm (2) b (3) c", ["a 5 cm", "b", "c"]),
        ("1] a\n2] b", ["a", "b"]),
        ("- a\r\n- b", ["a", "b"]),
        ("• a • «b; c»", ["a", "b; c"]),
        ("foamed glass (closed cell)\tx", ["foamed glass (closed cell)", "x"]),
        ("„a + b“ + c & d //e", ["a + b", "c", "d", "e"]),
    ],
)
def test_split(text, items):
    assert packed.split_packed(text, ALL) == items


def test_explode(spark):
    rows = [(1, "s", "a, b"), (1, "s", "a, b"), (2, None, "c"), (3, "s", None), (4, "s", " "), (5, "s", ", ".join(["x y"] * 3000))]
    df = spark.createDataFrame(rows, "id bigint, source string, text string").withColumnRenamed("text", "t").selectExpr("*", "1 AS key", "2 AS pos", "'z' AS item")
    got = packed.explode_packed(df, "id", "t", "source")
    assert got.columns == ["id", "pos", "item"]
    out = sorted(map(tuple, got.collect()))
    assert out[:3] == [(1, 1, "a"), (1, 2, "b"), (2, 1, "c")] and len(out) == 3 + 3000
    assert packed.explode_packed(df.limit(0), "id", "t", "source").count() == 0


def test_source_decides_on_soft_delimiters(spark):
    # in source b the slash stands between bare figures: no value in its own right
    rows = [(i, "a", "felt / reed") for i in range(60)] + [(100 + i, "b", "brick 3 / 4") for i in range(60)]
    df = spark.createDataFrame(rows, "id bigint, source string, text string")
    scores = {(r.source, r.delimiter): r.score for r in packed.delimiter_scores(df, "text", "source", prior=1.0).collect()}
    assert scores["a", "slash"] > scores["b", "slash"]


def test_every_delimiter_must_prove_itself(spark):
    # source b has semicolons inside brackets and before bare figures: they part no values there
    rows = [(i, "a", f"felt {i}; reed; clay") for i in range(200)] + [(1000 + i, "b", f"brick (old; as found; {i})") for i in range(400)] + [(5000, None, "one; two")]
    df = spark.createDataFrame(rows, "id bigint, source string, text string")
    for limit in (0, 100):
        got = {}
        for r in packed.explode_packed(df, "id", "text", "source", send_limit=limit).collect():
            got.setdefault(r.id, {})[r.pos] = r.item
        assert got[3] == {1: "felt 3", 2: "reed", 3: "clay"} and got[1003] == {1: "brick (old; as found; 3)"} and got[5000] == {1: "one", 2: "two"} and len(got) == 601
