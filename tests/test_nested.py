import json
from pathlib import Path

import pyarrow.parquet as pq
import pytest

from tektonis.operators import nested

ONE = {"building": {"heat_supply_system": {"type": "x"}}, "elements": {"Roof 1": {"a": 1, "states": {"existing": {"u": 2.5}, "usual": None, "more": {}}}, "Wall": {}, "Door": None}}


def nodes(payload):
    return sorted({(t[1], t[2]) for t in nested.record_triples(payload)})


def test_layouts():
    want = [("", "elements/Roof 1"), ("", "heat"), ("elements/Roof 1", "elements/Roof 1/existing")]
    text = json.dumps(ONE)
    listed = json.dumps(ONE | {"elements": [None, {"name": "Wall"}, {"name": "Roof 1"} | ONE["elements"]["Roof 1"]]})
    for payload in (text, "﻿" + text, json.dumps(text), json.dumps(json.dumps(text)), json.dumps({"buildings": [ONE]}), json.dumps([ONE]), listed):
        assert nodes(payload) == want
    assert nodes(json.dumps({"building": {"heat_supply_system": "stove"}})) == [("", "heat")]
    for payload in (None, "", "{}", "null", text[:-3], "[]", json.dumps({"building": None, "elements": []}), json.dumps({"building": {"heat_supply_system": " "}})):
        assert nodes(payload) == []


def test_tables(spark):
    rows = [(1, json.dumps(ONE)), (1, json.dumps(ONE)), (2, None), (3, "{")]
    df = spark.createDataFrame(rows, "id bigint, payload string").selectExpr("*", "'q' AS node", "'r' AS grp")
    got = nested.triples(df, "id", "payload")
    assert sorted(map(tuple, nested.nodes(got, "id").collect())) == [(1, "", "elements/Roof 1"), (1, "", "heat"), (1, "elements/Roof 1", "elements/Roof 1/existing")]
    assert nested.pivot_group(got, "id", "elements/*", ["a", "none"]).collect()[0].asDict() == {"id": 1, "parent_node": "", "node": "elements/Roof 1", "ordinal": 1, "a": "1", "none": None}
    assert nested.triples(df.limit(0), "id", "payload").count() == 0


def test_array_nodes(spark):
    schema = "id bigint, states array<struct<s:string, sets array<struct<l:string, layers array<int>>>>>".replace("s:string", "s string").replace("l:string", "l string")
    rows = [(1, [("a", [("x", [1, None]), None]), ("b", None), None]), (2, None), (3, [])]
    got = nested.array_nodes(spark.createDataFrame(rows, schema), "id", "states", [("states", "states"), ("sets", "sets"), ("layers", "layers")])
    assert sorted(r.node for r in got.collect()) == ["states/1", "states/1/sets/1", "states/1/sets/1/layers/1", "states/1/sets/1/layers/2", "states/1/sets/2", "states/2", "states/3"]


def leaves(value):
    if isinstance(value, str) and value.lstrip()[:1] in ("{", "["):
        return leaves(got) if (got := nested.unwrap(value)) is not None else 1
    if isinstance(value, dict | list):
        return sum(map(leaves, value.values() if isinstance(value, dict) else value))
    return value is not None


def test_no_leaf_is_lost():
    wall = {"m": 1, "layers": [{"m": "clay", "parts": [[1, 2], {"q": 0}]}, {}, None, "bare"], "tags": ["x", "y"], "states": {"existing": 2.5, "usual": {"u": 1}}}
    odd = {"building": {"id": "B", "extra": {"deep": [{"a": 1}, {"a": [2, 3]}]}, "heat_supply_system": ""}, "elements": {"Wall": wall, "Note": "seen", "Gap": None}, "energy": {"states": [1, 2]}}
    listed = {"version": 3, "buildings": [odd, {"elements": [{"name": "only"}, {"name": "W", "u": 1}, 7, None]}], "said": "text"}
    for value in (odd, listed, [odd, odd], 5, {"a": {"b": 1}}):
        got = [t for t in nested.record_triples(json.dumps(value), every=True) if t[4] is not None]
        assert len(got) == leaves(value), value
    found = {(t[0], t[1], t[2]) for t in nested.record_triples(json.dumps(odd), every=True)}
    assert ("elements/*/layers/*", "elements/Wall", "elements/Wall/layers/1") in found and ("elements/*/*", "elements/Wall", "elements/Wall/usual") in found
    assert ("record/building.extra.deep/*", "record/1", "building.extra.deep/2") in found
    text = json.dumps(odd)
    for _ in range(12):
        text = json.dumps(text)
    assert nested.record_triples(text) == nested.record_triples(json.dumps(odd))


def test_no_leaf_of_the_tables_is_lost():
    at = Path("/root/testdata/sf0.001/building_records.parquet")
    if not at.exists():
        pytest.skip("no test tables")
    payloads = pq.read_table(at, columns=["payload"])["payload"].to_pylist()
    assert sum(t[4] is not None for p in payloads for t in nested.record_triples(p, every=True)) == sum(leaves(nested.unwrap(p)) for p in payloads)
